"""Message passing against enumeration, the fit on held-out pages, whole pages by hand."""

import itertools
import math
import random

import numpy as np
import pytest

from memspark.llm import html_text as h


@pytest.fixture(scope="module")
def judge():
    return h.model()


def test_marginals_against_every_labelling():
    rng = random.Random(1)
    for _ in range(20):
        n = rng.randint(1, 8)
        parents = [-1, *(rng.randrange(k) for k in range(1, n))]
        kinds = [rng.randrange(3) for _ in range(n)]
        unary = [rng.gauss(0, 2) for _ in range(n)]
        pair = [[[rng.gauss(0, 2) for _ in range(2)] for _ in range(2)] for _ in range(3)]
        total, one = 0.0, [0.0] * n
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(u * s for u, s in zip(unary, y, strict=True)) + sum(pair[kinds[k]][y[parents[k]]][y[k]] for k in range(1, n)))
            total += w
            one = [a + w * s for a, s in zip(one, y, strict=True)]
        assert np.allclose(h.marginals(unary, kinds, parents, pair), np.array(one) / total)


def test_gradient_points_uphill():
    pages = [(*h.features(nodes, pieces), y) for nodes, pieces, y in h.labelled(6, seed=3)]
    forest = h._Forest(pages)
    grad_w, grad_p = forest.gradient(np.zeros(h.N_FEATURES), np.zeros((h.N_EDGES, 2, 2)))

    def likelihood(weights):
        out = 0.0
        for x, kinds, parents, y in pages:
            p = np.array(h.marginals((x @ weights).tolist(), kinds.tolist(), parents.tolist(), np.zeros((h.N_EDGES, 2, 2)).tolist()))
            out += np.log(np.where(y == 1, p, 1 - p)).sum()
        return out / len(pages) / 20

    for k in np.flatnonzero(grad_w)[:8]:
        step = np.zeros(h.N_FEATURES)
        step[k] = 1e-4
        assert abs((likelihood(step) - likelihood(-step)) / 2e-4 - grad_w[k]) < 1e-5
    assert np.isfinite(grad_p).all()


def test_held_out_pages(judge):
    right = total = 0
    for nodes, pieces, y in h.labelled(80, seed=1234):
        right += ((judge.content(nodes, pieces) > 0.5) == (y == 1)).sum()
        total += len(y)
    assert right / total > 0.99


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
<header><h1>Site name</h1><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav></header>
<div id="cookie-notice"><p>We use cookies on this site.</p><button>OK</button></div>
<article><h1>The  title &amp; more</h1><p>First <b>bold</b>ed line&nbsp;with an &eacute; and &#x41;&am<br>after a break.<p>Second paragraph, unclosed
<div class="ad">Buy this now</div><ul><li>One item<li>Another item</ul>
<p>A plain paragraph with a <a href="x">link</a>, and a fair number of words to read.</p>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Nice article, I liked it a lot indeed.</p></div></section></article>
<aside><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside><form><p>Join our letter</p><input name="m"></form>
<!-- <p>hidden</p> --><footer>&copy; 2024 All of us</footer></body></html>"""


def test_a_page(judge):
    want = "The title & more First bolded line with an é and A&am after a break. Second paragraph, unclosed One item Another item A plain paragraph with a link , and a fair number of words to read."
    assert h.main_text(PAGE, judge) == want.replace("link ,", "link,")


def test_broken_pages(judge):
    for page in [None, "", "   ", "<", "<p", "</p></div>", "<script>never ends", "<!-- never ends", "<div " + "x" * 5000, "<b>" * 300 + "deep", "<article><p>text"]:
        assert isinstance(h.main_text(page, judge), str)
    assert h.main_text("<article><p>a < b and c", judge) == "a < b and c"
    long = "<article><h1>T</h1>" + "<p>some words of a long text here</p>" * 3000 + "</article>"
    assert h.main_text(long, judge) == "T" + " some words of a long text here" * 3000


def test_query(spark, judge):
    rows = [(1, "u", PAGE, 9), (1, "u", PAGE, 9), (None, None, None, 9), (3, "v", "", 9)]
    out = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"))
    got = [tuple(r) for r in out.collect()]
    text = h.main_text(PAGE, judge)
    assert sorted(got, key=str) == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
