"""Pages by another hand than the model's training layouts, odd markup, and pages meant to stall the parser."""

import random
import time
from collections import Counter

import pytest

from memspark.llm import html_text as h

SENTENCES = (
    "The river rose in the night and by morning the lower road was under water. "
    "Nobody had expected the bridge to hold, yet it did, and the mail came through at noon. "
    "In den Bergen fiel der erste Schnee, und die Schule blieb bis Montag geschlossen. "
    "Der Rat beschloss nach langer Debatte, den alten Markt nicht abzureißen. "
    "La cosecha fue buena este año, según los vecinos del valle, pero los precios bajaron. "
    "Los trenes vuelven a parar en el pueblo después de doce años. "
    "Le musée rouvre ses portes au printemps, avec une salle consacrée aux cartes anciennes. "
    "On y trouve aussi des lettres que personne n'avait lues depuis un siècle."
).split(". ")


@pytest.fixture(scope="module")
def judge():
    return h.model()


class Hand:
    def __init__(self, seed):
        self.r = random.Random(seed)

    def par(self):
        return " ".join(s.strip(".") + "." for s in self.r.sample(SENTENCES, self.r.randint(1, 4)))

    def menu(self):
        return self.r.sample(["Home", "News", "Local", "Sport", "Weather", "Archive page", "About us", "Kontakt", "Impressum"], self.r.randint(3, 7))

    def links(self, between):
        return between.join(f"<a href='/{k}'>{m}</a>" for k, m in enumerate(self.menu()))

    def page(self):
        r = self.r
        pars = [self.par() for _ in range(r.randint(2, 7))]
        title = self.par().split(",")[0][:60].strip()
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>\n" for p in pars)
        menu = "<ul>" + "".join(f"<li>{x}</li>" for x in self.links("|").split("|")) + "</ul>"
        kind = r.randrange(9)
        page = [
            f"<body>{body}</body>",
            f"<body>{menu}{body}</body>",
            f"<body><div><div>{menu}</div><div>{body}</div></div></body>",
            f"<body><table width=100%><tr><td width=120>{self.links('<br>')}<td>{body}</table></body>",
            f"<body><center>{self.links(' | ') if r.random() < 0 else ''}</center><div id=x17>{body}</div></body>",
            f"<body><div class='l-grid'><div class='l-col'>{body}</div></div><footer><p>{self.links(' ')}</p></footer></body>",
            f"<body><header>{menu}</header><main>{body}</main></body>",
            f"<body><nav>{self.links(' ')}</nav><div class='post-body'>{body}<div class='share-buttons'>{self.links(' ')}</div></div></body>",
            f"<body><section>{body}</section><aside><h4>More</h4>{menu}</aside></body>",
        ][kind]
        return f"<html><head><title>{title}</title></head>{page}</html>", " ".join([title, *pars])


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    both = sum((a & b).values())
    return 2 * both / max(1, sum(a.values()) + sum(b.values()))


def test_layouts_of_another_hand(judge):
    hand = Hand(3)
    pages = [hand.page() for _ in range(200)]
    texts = [h.main_text(p, judge) for p, _ in pages]
    scores = [f1(t, want) for t, (_, want) in zip(texts, pages, strict=True)]
    assert all(texts)
    assert sum(scores) / len(scores) >= 0.95


P = "The river rose in the night and by morning the lower road was under water, so the bus took the long way round past the mill and the old quarry."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><h1>High water</h1><p>{P}</p><p>{P}</p></body>", f"High water {P} {P}"),
        (f"<body><p>{P}</p></body>", P),
        (f"<body><div><p>{P}</p><p>{P}</p></div></body>", f"{P} {P}"),
        (f"<table><tr><td><p>{P}</p><p>{P}</p></td></tr></table>", f"{P} {P}"),
        (f"<body><div>{P}<br><br>{P}</div></body>", f"{P} {P}"),
        (P, P),
        (f'<article><h1>High water</h1><p>{P}<span hidden>a</span><b style="display:none">b</b> <span class="advertisement">Buy now</span></p><p>{P}</p></article>', f"High water {P} {P}"),
        (f"<article><h1>High water</h1><p>{P} <a href=x title=it's>link</a></p><p>{P}</p></article>", f"High water {P} link {P}"),
        (f'<article><p title="a > b" class=x>{P}</p></article>', P),
        (f"<article><p>{'İ' * 40}</p><script>x</ſcript></SCRIPT ><p>{P}</p></article>", f"{'İ' * 40} {P}"),
        (f"<article><p>{P}</p><p>one<wbr>word <!--> kept <!-- gone --> </3> a < b &lt;i&gt;</p></article>", f"{P} oneword kept a < b <i>"),
        (f"<article><p>{P}</p><table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e<dt>f</dl></article>", f"{P} a b c d e f"),
    ],
)
def test_odd_pages(judge, page, want):
    assert h.main_text(page, judge) == want


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<div>" * n + "</p>" * n,
        lambda n: '<a title="x' * n,
        lambda n: "<a title='x>" * n + '"',
        lambda n: "<i><div>" + "<b>" * n + "</i>" * n,
        lambda n: "<p>" * n + "<b>" * n + "<p>" * n,
        lambda n: "<table>" + "<tr><td>" * n,
        lambda n: "<a " * n,
        lambda n: "<!" * n,
    ],
)
def test_time_grows_with_the_page_only(judge, make):
    page = make(100_000)
    began = time.perf_counter()
    h.main_text(page, judge)
    assert time.perf_counter() - began < 10


def test_a_long_and_deep_page(judge):
    deep = "<article>" + "<section>" * 3000 + f"<p>{P}</p>" * 2000 + "</section>" * 3000 + "</article>"
    assert h.main_text(deep, judge) == " ".join([P] * 2000)


MENU = "<ul class=menu><li><a href=/>Home</a><li><a href=/n>News</a></ul>"
FOOT = "<footer><p>Copyright 2020 Press</p></footer>"
TWO = f"<p>{P}</p><p>{P}</p>"
OUTER = ("home has-sidebar", "single right-sidebar", "page-template-default no-comments cookies-not-set", "archive category-menu logged-in")
INNER = ("post comments-open", "post no-sidebar", "post tag-alert", "post category-privacy", "review reviews-single", "hentry format-standard tag-comments status-publish")
BOXES = ("entry-content ad-free", "main-content legal-page", "main search-results", "content has-widgets", "post-body no-share", "article__body is-paywall-free")


@pytest.mark.parametrize("body", [f'<body class="{c}">{MENU}<article>{TWO}</article>{FOOT}</body>' for c in OUTER] + [f'<body>{MENU}<article class="{c}">{TWO}</article>{FOOT}</body>' for c in INNER] + [f'<body>{MENU}<div class="{c}">{TWO}</div>{FOOT}</body>' for c in BOXES])
def test_names_of_two_meanings_do_not_empty_a_page(judge, body):
    assert h.main_text(body, judge) == f"{P} {P}"


@pytest.mark.parametrize("inner", [f"<div id=main>{TWO}</div>", f"<div>{TWO}</div>", f"<article>{TWO}</article>", f"<div class=thread><div class=post><p>{P}</p></div><div class=post><p>{P}</p></div></div>"])
def test_a_page_within_one_form(judge, inner):
    assert h.main_text(f"<body><form id=form1 method=post>{MENU}{inner}{FOOT}</form></body>", judge) == f"{P} {P}"
    assert h.main_text(f"<body>{MENU}{inner}{FOOT}</body>", judge) == f"{P} {P}"


@pytest.mark.parametrize("head", ["<header><h1>High water here</h1></header>", '<div class="content-header"><h1>High water here</h1></div>', '<div class="page-header"><h1>High water here</h1></div>', '<header class="entry-header"><h1 class="entry-title">High water here</h1></header>'])
def test_titles_in_a_header_of_their_own_stay(judge, head):
    assert h.main_text(f"<body>{MENU}<article>{head}{TWO}</article>{FOOT}</body>", judge) == f"High water here {P} {P}"


def test_adverts_within_an_article_go(judge):
    page = f"<body>{MENU}<article><p>{P}</p><p class=sponsored>Buy the new thing now at half price</p><p>{P}</p></article>{FOOT}</body>"
    assert h.main_text(page, judge) == f"{P} {P}"


def test_an_article_of_links(judge):
    items = [s.strip(".") for s in SENTENCES]
    page = f"<body>{MENU}<article><h1>Links of the week</h1><ul>{''.join(f'<li><a href=/x>{s}</a></li>' for s in items)}</ul></article>{FOOT}</body>"
    assert h.main_text(page, judge) == " ".join(["Links of the week", *items])


def test_comments_that_outweigh_the_article_go(judge):
    rest = "".join(f"<div class=comment><p>{P} {k}</p></div>" for k in range(5))
    text = h.main_text(f'<body>{MENU}<article><p>{P}</p></article><section class="comments">{rest}</section>{FOOT}</body>', judge)
    assert text == P


class Named(Hand):
    """Pages whose elements have lists of names as blog and shop software writes them."""

    def page(self):
        r = self.r
        pars = [self.par() for _ in range(r.randint(2, 6))]
        title = self.par().split(",")[0][:60].strip()
        extra = lambda: " ".join(r.sample(["has-sidebar", "no-widgets", "comments-open", "category-news", "tag-banner", "col-md-8", "clearfix", "is-ready", "author-promo", "footer-hidden-off", "type-post", "post-123"], r.randint(0, 4)))
        head = r.choice([f"<h1>{title}</h1>", f'<header class="entry-header"><h1 class="entry-title">{title}</h1></header>', f'<div class="post-header {extra()}"><h1>{title}</h1></div>'])
        text = "".join(f"<p>{p}</p>" for p in pars)
        core = r.choice([f'<article class="post {extra()}">{head}{text}</article>', f'<article id="post-7" class="{extra()}">{head}<div class="entry-content {extra()}">{text}</div></article>', f'<main class="site-main {extra()}">{head}{text}</main>', f'<div class="article-body {extra()}">{head}{text}</div>'])
        side = r.choice([f'<aside class="widget-area">{self.links(" ")}</aside>', f'<div class="sidebar-inner"><h3>Related</h3><ul><li>{self.links("</li><li>")}</li></ul></div>', f'<div class="related-posts">{self.links(" ")}</div>', ""])
        top = r.choice([f'<div class="main-menu">{self.links(" | ")}</div>', f'<nav class="navbar-nav">{self.links(" ")}</nav>', f'<header class="site-header"><p>The Valley Post</p>{self.links(" ")}</header>'])
        foot = r.choice(['<footer class="site-footer"><p>All rights reserved.</p></footer>', '<div class="footer-widgets"><p>All rights reserved.</p></div>'])
        inner = f'<div id="page" class="site {extra()}">{top}{core}{side}{foot}</div>'
        if r.random() < 0.2:
            inner = f"<form id=form1>{inner}</form>"
        return f'<html><body class="{extra()}">{inner}</body></html>', " ".join([title, *pars])


def test_realistic_lists_of_names(judge):
    hand = Named(11)
    pages = [hand.page() for _ in range(300)]
    texts = [h.main_text(p, judge) for p, _ in pages]
    scores = [f1(t, want) for t, (_, want) in zip(texts, pages, strict=True)]
    assert all(texts)
    assert sum(scores) / len(scores) >= 0.95
