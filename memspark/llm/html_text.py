"""Main text of web pages by a graphical model over the document's tree.

Every block element is a node with two states, content or not. A node's own
features give it a weight, and each edge from a parent to a child has
potentials by the kind of the child. Messages passed up from the leaves and
down from the root (sum-product, exact on a tree) give each node's probability
of being content; the text directly inside content blocks is the result.
Weights are fitted to labelled pages by the gradient of the log-likelihood,
which compares observed features with those expected under the marginals. The
labelled pages are made up from layouts, a bounded number (TRAIN).
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN = 600
STEPS = 200
RATE, DECAY = 0.1, 1e-4

#: Fixed values of HTML: elements without an end tag, with raw text, and that lie inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: A block that begins inside an open paragraph ends it; these end an open one of their own kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
NEVER = frozenset("script style noscript template head title textarea iframe noframes xmp svg math select option button object".split())

NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: The rest of a tag: a quote counts right after an equals sign, and where it ends.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
ATTRIBUTE = re.compile(r"""([^\s=/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(\S*+)))?+""")
READ = re.compile(r"class|id|role|itemprop|hidden|style", re.I | re.A)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I | re.A)
NAMES = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Words of class, id and role that hint at a block's part.
HINTS = (
    "ad ads adv advert advertisement banner sponsor sponsored promo promotion adsense doubleclick outbrain taboola",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header masthead topbar toolbar logo branding",
    "footer foot copyright legal colophon bottom",
    "side sidebar aside widget related recommended popular trending rail teaser archive tags tagcloud categories",
    "comment comments reply replies respond discussion disqus thread reviews feedback",
    "cookie cookies consent notice gdpr alert popup modal overlay toast paywall banner privacy warning",
    "form newsletter subscribe signup login search contact share social sharing follow buttons poll",
    "article content main post entry story body text prose page articlebody",
)
HINT_OF = {w: k for k, h in reversed([*enumerate(HINTS)]) for w in h.split()}
CONTENT, HEADER = len(HINTS) - 1, 2
#: Words that make a name one of a state, at its beginning or end, or of a subject; and words that name no part of their own.
STATE_FIRST = frozenset("no not has is with without hide show can enable disable".split())
STATE_LAST = frozenset("open opened closed free enabled disabled active ready loaded off".split())
SUBJECT = frozenset("tag category cat type format status author term topic section template taxonomy keyword lang language".split())
GENERIC = frozenset("wrap wrapper container inner outer area box block list item section row col column region zone holder panel group unit slot module content body text icon link bar top left right".split())
TAGS = ("body", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "ol", "td", "table", "blockquote", "pre", "figure", "figcaption", "dl", "fieldset", "address", "menu", "dialog", "details", "dt", "dd", "tr", "th")
TAG_AT = {t: k for k, t in enumerate(TAGS)}
#: Potentials of edges are shared by children of the same kind.
EDGES = {"nav": 1, "header": 1, "footer": 1, "aside": 1, "form": 1, "menu": 1, "dialog": 1, "article": 2, "main": 2, "section": 3, "div": 3, "table": 3, "p": 4, "h1": 4, "h2": 4, "h3": 4, "h4": 4, "h5": 4, "h6": 4, "li": 4, "ul": 4, "ol": 4, "dt": 4, "dd": 4, "blockquote": 4, "pre": 4}
INLINE_EDGE = 6
N_EDGES = 7
LINKS, DENSE, LENGTHS, SHARES, AROUND = 5, 4, 5, 4, 5
#: Where each group of features begins: tag (any other, inline), constant, what names say, what their other words hint at, share of links, length, links,
#: the parent's share of the page's prose and how much that is, place towards a container of content, place in the page's frame.
HINT_AT = len(TAGS) + 3
WEAK_AT = HINT_AT + len(HINTS)
LINK_AT = WEAK_AT + len(HINTS)
LENGTH_AT = LINK_AT + LINKS
DENSE_AT = LENGTH_AT + LENGTHS
SHARE_AT = DENSE_AT + DENSE
AROUND_AT = SHARE_AT + SHARES
PLACE_AT = AROUND_AT + AROUND
FRAME_AT = PLACE_AT + 3
N_FEATURES = FRAME_AT + 1
#: A page has a container of content if such ones hold this share of its prose.
HOLDS = 0.3
#: An element that holds MOST of the page's prose, with less than FREE of it outside, is no part of the page's frame, whatever it is called.
MOST, FREE = 0.5, 0.1
#: Characters of prose for which a page does not stay without a text; of a link that is prose where a page has less than that.
SENTENCE, HEADLINE = 80, 30
FRAME = frozenset("nav header footer aside form menu dialog".split())


@dataclass
class Node:
    tag: str
    parent: int
    names: frozenset = frozenset()
    hidden: bool = False
    #: An element inside a line, a node of its own because it is hidden or named like a part that is no content.
    inline: bool = False
    attributes: str = ""
    linked: int = 0
    links: int = 0


@lru_cache(maxsize=100)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A)


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """The elements that are nodes (a parent before its children) and the pieces of text in page order, each with its node.

    A broken page gives what its tags allow: unclosed elements end with their
    parent, stray end tags are ignored, what opens without any > after it is
    text. If quotes swallow the rest of a page from some tag on, quotes count
    no more from that tag on. Time is linear in the page but for a logarithm of
    the depth.
    """
    nodes, pieces = [Node("body", -1)], []
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements with their node
    places: dict[str, list[int]] = defaultdict(list)  # the depths at which a tag is open
    blocks = [0]  # the depths of open blocks
    at, page = 0, page or ""
    last = page.rfind(">")
    quotes = True

    def text(raw: str) -> None:
        if not raw:
            return
        block = stack[-1][1]
        value = entities.unescape(raw) if "&" in raw else raw
        pieces.append((block, value))
        if places["a"]:
            nodes[block].linked += len(value.strip())

    def open_(tag: str, node: int) -> None:
        places[tag].append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, node))

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop()[0]].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    def deepest(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    while at < len(page):
        start = page.find("<", at)
        if start < 0 or start > last:
            text(page[at:])
            break
        after = page[start + 1 : start + 2]
        closing = after == "/"
        m = NAME.match(page, start + 1 + closing)
        if not m:
            if after not in ("!", "?", "/"):
                text(page[at : start + 1])
                at = start + 1
                continue
            text(page[at:start])
            if page.startswith("<!--", start):
                short = page.startswith((">", "->"), start + 4)
                end = start + 3 if short else page.find("-->", start + 4) + 2
                if end < start:
                    break
                at = page.find(">", end) + 1
            else:
                at = page.find(">", start) + 1
            continue
        text(page[at:start])
        rest = REST.match(page, m.end()) if quotes else None
        if rest is None:
            quotes = False
        at = rest.end() if rest else page.find(">", m.end()) + 1
        attributes = page[m.end() : at - 1]
        tag = m[0].lower()
        if closing:
            if places[tag] and (tag not in INLINE or places[tag][-1] > blocks[-1]):
                close(places[tag][-1])
            if tag not in INLINE:
                pieces.append((stack[-1][1], "\n"))
            continue
        if tag in ("html", "head", "body"):
            if tag == "head":
                open_(tag, len(nodes))
                nodes.append(Node("head", 0, hidden=True))
            elif tag == "body":
                close(1)  # its names tell of the whole page, not of a part
            continue
        if tag in VOID:
            if tag != "wbr":
                pieces.append((stack[-1][1], "\n"))
            continue
        if stack[-1][0] == "head" and tag not in RAW and tag not in ("meta", "link", "base"):
            close(1)
        if tag in INLINE:
            own = stack[-1][1]
            if READ.search(attributes) and not nodes[own].hidden:
                names, hidden = _names(attributes)
                # names inside code are those of its colours
                if hidden or not (places["pre"] or places["code"]) and any(k != CONTENT for k in _hints(names)[0]):
                    nodes.append(Node(tag, own, names, hidden, True, attributes))
                    own = len(nodes) - 1
            if tag == "a":
                nodes[own].links += 1
            open_(tag, own)
            continue
        if tag in ENDS_P and places["p"] and places["p"][-1] == blocks[-1]:
            close(blocks[-1])
        if tag in ENDS_OWN:
            own, until = ENDS_OWN[tag]
            limit = deepest(until)
            found = [d[bisect(d, limit) if tag == "tr" else -1] for t in own.split() if (d := places[t]) and d[-1] > limit]
            if found:
                close(min(found) if tag == "tr" else max(found))
        names, hidden = _names(attributes) if READ.search(attributes) else (frozenset(), False)
        parent = stack[-1][1]
        pieces.append((parent, "\n"))
        nodes.append(Node(tag, parent, names, hidden or tag in NEVER or nodes[parent].hidden, False, attributes))
        if attributes.endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in RAW:
            end = _end_of(tag).search(page, at)
            gap = page.find(">", end.end()) if end else -1
            at = len(page) if gap < 0 else gap + 1
            continue
        open_(tag, len(nodes) - 1)
    return nodes, pieces


def _names(attributes: str) -> tuple[frozenset, bool]:
    names, hidden = set(), False
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif key == "style":
            hidden |= bool(UNSEEN.search(value))
        elif key in ("class", "id", "role", "itemprop"):
            names.update(value.split())
    return frozenset(names), hidden


@lru_cache(maxsize=20_000)
def _said(name: str) -> tuple[frozenset, frozenset]:
    """The parts that one name says its element is, and those that its other words hint at.

    The last word tells, but for words that name no part: a main-menu is a
    menu, a comment-body belongs to comments. Names of states (has-sidebar,
    comments-open) and subjects (tag-alert) say nothing. The header of a page's
    or an article's content only hints at a header.
    """
    none: frozenset = frozenset()
    words = [w.lower() for w in NAMES.findall(CAMEL.sub(" ", name))]
    if len(words) > 1 and (words[0] in STATE_FIRST | SUBJECT or words[-1] in STATE_LAST):
        return none, none
    while len(words) > 1 and (words[-1] in GENERIC or words[-1].removesuffix("s") in GENERIC) and any(w in HINT_OF for w in words[:-1]):
        words.pop()
    parts = [HINT_OF.get(w, HINT_OF.get(w.removesuffix("s"))) for w in words]
    if not parts:
        return none, none
    last, others = parts[-1], frozenset(k for k in parts[:-1] if k is not None)
    if last is None:
        return none, others
    foreign = others - {CONTENT}
    if last == CONTENT and foreign and words[-1] != "page":
        return foreign, frozenset([CONTENT])
    if last == HEADER and CONTENT in others:
        return none, frozenset([HEADER, CONTENT])
    return frozenset([last]), others - {last}


@lru_cache(maxsize=20_000)
def _hints(names: frozenset) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """What an element's names say, and what else they hint at."""
    both = [_said(x) for x in names]
    said = frozenset().union(*(a for a, _ in both))
    return tuple(sorted(said)), tuple(sorted(frozenset().union(*(b for _, b in both)) - said))


def _step(value: float, bounds: tuple) -> int:
    return bisect(bounds, value)


def active(nodes: list[Node], pieces: list[tuple[int, str]]) -> tuple[list[list[int]], list[int], list[int]]:
    """For each node the features that it has; the kind of the edge above it; its parent."""
    n = len(nodes)
    own = [0] * n
    for k, value in pieces:
        own[k] += len(value.strip())
    said = [((), ())] + [_hints(x.names) for x in nodes[1:]]
    below, linked, links = own[:], [x.linked for x in nodes], [x.links for x in nodes]
    within, alone = [False] * n, 0
    for k, x in enumerate(nodes):
        within[k] = k > 0 and (within[x.parent] or x.hidden or x.tag in FRAME or any(h != CONTENT for h in said[k][0]))
        alone += 0 if within[k] else max(0, own[k] - x.linked)
    if alone < SENTENCE:
        # a page of links: those as long as a headline are its prose
        for k, x in enumerate(nodes):
            if not within[k] and x.linked >= HEADLINE * max(1, x.links):
                linked[k] = links[k] = 0
    direct = linked[:]
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        if not nodes[k].hidden:
            below[p] += below[k]
            linked[p] += linked[k]
            links[p] += links[k]
    prose = max(1, below[0] - linked[0])
    holder = [False] * n
    for k in range(1, n):
        up = nodes[p := nodes[k].parent]
        holder[k] = holder[p] or up.tag in ("article", "main") or CONTENT in said[p][0]
    # elements that look like a part of the frame: the header of what holds content is none
    apart = [k > 0 and (x.tag in FRAME and not (x.tag == "header" and holder[k]) or any(h != CONTENT for h in said[k][0]) and CONTENT not in said[k][0]) for k, x in enumerate(nodes)]
    # those with most of the page's prose lie within each other; free: prose by the number of them around it, if nothing else of the frame is
    big = [a and not x.hidden and not x.inline and below[k] - linked[k] >= MOST * prose for k, (a, x) in enumerate(zip(apart, nodes, strict=True))]
    depth, free = [0] * n, defaultdict(int)
    for k in range(n):
        up = depth[nodes[k].parent] if k else 0
        depth[k] = -1 if up < 0 or nodes[k].hidden or apart[k] and not big[k] else up + big[k]
        if depth[k] >= 0:
            free[depth[k]] += max(0, own[k] - direct[k])
    outside = 0
    for k in range(n):
        if big[k]:
            outside += free[depth[k] - 1] if depth[k] > 0 else FREE * prose
            if outside >= FREE * prose:
                break  # the article is elsewhere: this is a large part beside it
            apart[k] = False
            said[k] = (tuple(h for h in said[k][0] if h == CONTENT), ())
        else:
            big[k] = False
    neutral = [b and not a for a, b in zip(apart, big, strict=True)]
    frame, held = [False] * n, 0
    for k, x in enumerate(nodes):
        if k:
            frame[k] = frame[x.parent] or apart[x.parent]
        if holder[k] and not frame[k] and not x.hidden:
            held += max(0, own[k] - direct[k])
    has_holder = held >= HOLDS * prose
    out = []
    for k, x in enumerate(nodes):
        beside = max(0, below[x.parent] - linked[x.parent]) if k else prose
        length = min(LENGTHS - 1, int(math.log1p(own[k]) / 1.6))
        ids = [len(TAGS) + 1 if x.inline else len(TAGS) if neutral[k] else TAG_AT.get(x.tag, len(TAGS)), len(TAGS) + 2]
        ids += [HINT_AT + h for h in said[k][0]]
        ids += [WEAK_AT + h for h in said[k][1]]
        ids += [
            LINK_AT + min(LINKS - 1, int(linked[k] / max(1, below[k]) * LINKS)),
            LENGTH_AT + length,
            DENSE_AT + min(DENSE - 1, links[k]),
            SHARE_AT + _step(beside / prose, (0.1, 0.3, 0.6)),
            AROUND_AT + _step(beside, (60, 200, 600, 2000)),
            PLACE_AT + (2 if not has_holder else 0 if holder[k] else 1),
        ]
        if frame[k]:
            ids.append(FRAME_AT)
        out.append(ids)
    kinds = [INLINE_EDGE if x.inline else 3 if bare else EDGES.get(x.tag, 5) for x, bare in zip(nodes, neutral, strict=True)]
    kinds[0] = 0
    return out, kinds, [x.parent for x in nodes]


def features(nodes: list[Node], pieces: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """active() as a row of 0 and 1 for each node."""
    each, kinds, parents = active(nodes, pieces)
    x = np.zeros((len(nodes), N_FEATURES))
    for row, ids in zip(x, each, strict=True):
        row[ids] = 1
    return x, np.array(kinds), np.array(parents)


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(unary: list[float], kinds: list[int], parents: list[int], pair: list) -> list[float]:
    """Each node's probability of content, by sum-product on the tree, in logarithms.

    unary: log weights of content against none; pair: for each kind the log
    potentials by the parent's, then the child's state. A parent stands before
    its children.
    """
    n = len(unary)
    up0, up1 = [0.0] * n, list(unary)
    to0, to1 = [0.0] * n, [0.0] * n
    for k in range(n - 1, 0, -1):
        (a, b), (c, d) = pair[kinds[k]]
        p, x, y = parents[k], up0[k], up1[k]
        to0[k], to1[k] = _add(a + x, b + y), _add(c + x, d + y)
        up0[p] += to0[k]
        up1[p] += to1[k]
    down0, down1 = [0.0] * n, [0.0] * n
    for k in range(1, n):
        (a, b), (c, d) = pair[kinds[k]]
        p = parents[k]
        x, y = up0[p] + down0[p] - to0[k], up1[p] + down1[p] - to1[k]
        down0[k], down1[k] = _add(x + a, y + c), _add(x + b, y + d)
    return [1 / (1 + math.exp(min(700.0, up0[k] + down0[k] - up1[k] - down1[k]))) for k in range(n)]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def content(self, nodes: list[Node], pieces: list[tuple[int, str]]) -> np.ndarray:
        """Each node's probability of being content."""
        each, kinds, parents = active(nodes, pieces)
        weights = self.weights.tolist()
        return np.array(marginals([sum([weights[f] for f in ids]) for ids in each], kinds, parents, self.pair.tolist()))


_WORDS = "th er an on re in at es le eau ung sch ción os ion ent ar ment".split()


class _Layouts:
    """Made-up pages with the label of each block, as an attribute of its own (data-y)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        sizes = self.r.choices((1, 2, 3, 4), k=self.r.randint(low, high))
        parts = iter(self.r.choices(_WORDS, k=sum(sizes)))
        return " ".join("".join(islice(parts, n)) for n in sizes)

    def tag(self, name: str, body: str, y: int, attributes: str = "") -> str:
        return f"<{name} {attributes} data-y={y}>{body}</{name}>"

    def link(self) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>'

    def list_(self, low: int, high: int) -> str:
        return self.tag("ul", "".join(self.tag("li", self.link(), 0) for _ in range(self.r.randint(low, high))), 0)

    def name(self, part: int) -> str:
        """A list of names, one of which says the part."""
        r = self.r
        word = r.choice(HINTS[part].split())
        own = r.choice([word, word, f"site-{word}", f"js-{word}", f"{word}-{r.choice(['wrap', 'inner', 'box', 'list', 'area', 'container'])}", f"{self.words(1, 1)}__{word}", f"the{word.title()}"])
        if r.random() < 0.4:
            return f'{r.choice(["class", "class", "id"])}="{own}"'
        return f'class="{" ".join([own, *self.decoys(part == CONTENT)])}"'

    def decoys(self, content: bool = True) -> list[str]:
        """Names that a list may hold beside what the element is: states, subjects, layout."""
        r = self.r
        word = lambda: r.choice(HINTS[r.randrange(CONTENT)].split())
        make = [
            lambda: f"{r.choice(sorted(STATE_FIRST))}-{word()}",
            lambda: f"{word()}-{r.choice(sorted(STATE_LAST))}",
            lambda: f"{r.choice(sorted(SUBJECT))}-{r.choice([word(), self.words(1, 1)])}",
            lambda: f"{word()}-{self.words(1, 1)}",
            lambda: f"{word()}-page" if content else "row",
            lambda: f"{self.words(1, 1)}-{r.randint(1, 999)}",
            lambda: r.choice(["row", "clearfix", "hentry", "col-md-8", "grid", "is-wide"]),
        ]
        return [r.choice(make)() for _ in range(r.randint(0, 3))]

    def outer(self) -> str:
        """Attributes of the whole page's body."""
        return r'class="%s"' % " ".join([self.words(1, 1), *self.decoys(), *self.r.sample(["right-sidebar", "home", "single", "header-fixed"], k=1)]) if self.r.random() < 0.4 else ""

    #: The element of a paragraph.
    par = "p"

    def inline(self) -> str:
        """A part within a line that is no content."""
        shown = self.r.choice(["hidden", 'style="display: none"', *[self.name(self.r.choice([0, 0, 6, 7]))] * 3])
        return self.tag(self.r.choice(["span", "small", "a", "em"]), self.words(1, 8), 0, shown)

    def prose(self, y: int, low: int = 1, high: int = 7) -> str:
        out = []
        many, short = y and self.r.random() < 0.12, self.r.random() < 0.15
        for _ in range(self.r.randint(20, 70) if many else self.r.randint(low, high)):
            if short and self.r.random() < 0.8:
                out.append(self.tag("p", self.words(1, 4), y))
                continue
            kind = self.r.random()
            if kind < 0.72:
                body = self.words(1, 60)
                if self.r.random() < 0.2:
                    body += f" {self.link()} {self.words(2, 20)}"
                if self.r.random() < 0.15:
                    body = f"<b>{body}</b>"
                if self.r.random() < 0.08:
                    body = f"{body} {self.inline()} {self.words(0, 20)}"
                out.append(self.tag(self.par, body, y))
            elif kind < 0.8:
                out.append(self.tag(self.r.choice(["h2", "h3"]), self.words(1, 6), y))
            elif kind < 0.87:
                out.append(self.tag(self.r.choice(["ul", "ol"]), "".join(self.tag("li", self.words(1, 15), y) for _ in range(self.r.randint(1, 4))), y))
            elif kind < 0.91:
                out.append(self.tag("blockquote", self.r.choice([self.words(3, 30), self.tag("p", self.words(3, 30), y)]), y))
            elif kind < 0.94:
                out.append(self.tag("pre", self.words(2, 12), y))
            elif kind < 0.97:
                out.append(self.tag("figure", f'<img src="x.png">{self.tag("figcaption", self.words(2, 8), y)}', y))
            elif self.r.random() < 0.5:
                out.append(self.tag("table", self.tag("tr", "".join(self.tag("td", self.words(1, 4), y) for _ in range(3)), y), y))
            else:
                out.append(self.tag("dl", "".join(self.tag("dt", self.words(1, 3), y) + self.tag("dd", self.words(1, 12), y) for _ in range(self.r.randint(1, 3))), y))
        return "".join(out)

    def noise(self) -> str:
        r = self.r
        return r.choice(
            [
                lambda: self.tag("nav", r.choice([self.list_(2, 8), " ".join(self.link() for _ in range(4))]), 0, r.choice(["", self.name(1)])),
                lambda: self.tag("div", r.choice([self.list_(2, 8), " ".join(self.link() for _ in range(4))]), 0, self.name(1)),
                *[lambda: self.tag("div", r.choice([self.words(2, 25), self.tag("p", self.words(2, 25), 0), self.link()]), 0, self.name(0))] * 2,
                lambda: self.tag(r.choice(["aside", "aside", "div"]), self.tag("h3", self.words(1, 3), 0) + r.choice([self.list_(2, 6), self.prose(0, 1, 3)]), 0, self.name(4)),
                lambda: self.tag("aside", self.prose(0, 1, 3), 0),
                lambda: self.tag(r.choice(["div", "ul", "p"]), " ".join(self.link() for _ in range(r.randint(3, 9))), 0),
                lambda: self.list_(3, 9),
                lambda: self.tag(r.choice(["div", "section", "dialog"]), self.tag("p", self.words(3, 25), 0) + "<button>OK</button>", 0, self.name(6)),
                lambda: self.tag("form", self.tag("p", self.words(2, 12), 0) + f'<label>{self.words(1, 2)}</label><input name="q">', 0, r.choice(["", self.name(7)])),
                lambda: self.tag("div", self.tag("p", self.words(2, 12), 0) + self.link(), 0, self.name(7)),
                *[lambda: self.tag("p", self.words(2, 25), 0, self.name(r.choice([0, 0, 6])))] * 2,
                lambda: self.tag(r.choice(["section", "div"]), self.tag("h3", self.words(1, 3), 0) + "".join(self.tag(r.choice(["div", "li", "article"]), self.tag("p", self.words(2, 40), 0), 0, r.choice(["", self.name(5)])) for _ in range(r.randint(1, 5))), 0, self.name(5)),
            ]
        )()

    def unmarked(self, inside: str) -> str:
        """An article that no element and no name tells from the rest."""
        r = self.r
        any_name = r.choice(["", "", f'class="{self.words(1, 2)}"', f'id="{r.choice("abcdwxyz")}{r.randint(1, 99)}"', 'align="center"'])
        cell = lambda body, y: self.tag("td", body, y, 'valign="top"')
        beside = lambda: cell(r.choice([self.list_(2, 8), "<br>".join(self.link() for _ in range(r.randint(2, 6)))]), 0)
        return r.choice(
            [
                lambda: inside,
                lambda: inside,
                lambda: self.tag(r.choice(["div", "section", "center"]), inside, 1, any_name),
                lambda: self.tag("div", self.tag("div", inside, 1, any_name), 1),
                lambda: self.tag("table", self.tag("tr", r.choice([beside() + cell(inside, 1), cell(inside, 1) + beside(), cell(inside, 1)]), 1), 1),
                lambda: self.tag("div", "<br><br>".join(self.words(20, 60) for _ in range(r.randint(2, 5))), 1, any_name) if r.random() < 0.4 else self.tag("div", inside, 1, any_name),
            ]
        )()

    def page(self) -> str:
        r = self.r
        title = self.tag("h1", self.words(2, 9), 1)
        some = lambda most: "" if links else "".join(self.noise() for _ in range(r.randint(0, most)))
        plain = r.random() < 0.35
        self.par = "div" if plain and r.random() < 0.15 else "p"
        inside = self.prose(1, 2 if plain else 1)
        self.par = "p"
        while r.random() < 0.4:
            inside = self.prose(1, 1, 4) + self.noise() + inside
        if r.random() < 0.25:
            inside += self.noise()
        if r.random() < 0.3:
            inside = self.tag(r.choice(["div", "section"]), inside, 1, r.choice(["", self.name(8)]))
        links = not plain and r.random() < 0.05
        if links:
            # an article of linked items
            inside = self.tag(r.choice(["ul", "ol"]), "".join(self.tag("li", f'<a href="/x">{self.words(9, 20)}</a>', 1) for _ in range(r.randint(3, 15))), 1)
        own_header = False
        if not plain and r.random() < 0.35:
            # the article's own header
            own, own_header = r.choice(["article", "content", "entry", "page", "post"]), True
            title = self.tag(*r.choice([("header", title, 1), ("header", title + self.tag("p", self.words(2, 8), 1), 1), ("div", title, 1, f'class="{own}-header"'), ("header", title, 1, f'class="{own}-header {self.words(1, 1)}"')]))
        holder = r.choice(["article", "article", "article", "main", "div", "section"])
        attributes = self.name(8) if holder in ("div", "section") or r.random() < 0.5 else ""
        if not links and r.random() < 0.06:
            # one post after the other, in something that is called a thread
            core = self.tag("div", "".join(self.tag("div", self.prose(1, 3, 6), 1, 'class="post"') for _ in range(r.randint(3, 6))), 1, self.name(5))
            core = title + core
        elif not own_header and not links and r.random() < 0.1:
            core = title + self.tag(holder, inside, 1, attributes)  # a title outside what holds the content
        else:
            core = self.tag(holder, title + inside, 1, attributes)
        if plain:
            core = self.unmarked(r.choice([title, title, ""]) + inside)
        elif r.random() < 0.3:
            core = self.tag(r.choice(["main", "div"]), some(1) + core + some(2), 1, r.choice(["", self.name(8)]))
        head = r.choice(["", self.tag("header", r.choice([self.tag("h1", self.words(1, 3), 0), self.tag("p", self.words(1, 6), 0), self.link()]) + r.choice(["", self.list_(2, 6)]), 0), self.tag("div", self.tag("p", self.words(1, 6), 0), 0, self.name(2))])
        foot = r.choice([self.tag("footer", f"&copy; {self.words(1, 14)}", 0), self.tag("footer", self.tag("p", self.words(1, 14), 0) + self.list_(1, 4), 0), self.tag("div", self.tag("p", self.words(1, 14), 0), 0, self.name(3)), ""])
        body = head + some(3) + core + some(3) + foot
        if r.random() < 0.25:
            body = self.tag("div", body, 1, r.choice(["", 'id="wrapper"', 'class="container"']))
        if r.random() < 0.1:
            body = self.tag("form", body, 1, 'id="form1" method="post"')
        return f"<!DOCTYPE html><html><head><title>x</title></head><body {self.outer()}>{body}</body></html>"


LABEL = re.compile(r"data-y=([01])")


def labelled(n: int = TRAIN, seed: int = 5) -> Iterator[tuple[list[Node], list[tuple[int, str]], np.ndarray]]:
    """Parsed pages with each node's label; the body, which holds both, counts as content."""
    layouts = _Layouts(seed)
    for _ in range(n):
        nodes, pieces = parse(layouts.page())
        labels = np.array([1, *(int(y[1]) if (y := LABEL.search(x.attributes)) else 0 for x in nodes[1:])])
        yield nodes, pieces, labels


@lru_cache(maxsize=1)
def model() -> Model:
    """Weights of the largest penalised log-likelihood found in STEPS steps from zero, each scaled by how much its gradient varies, shorter towards the end."""
    # all pages as one forest under a root that is fixed: messages run over depths at once
    forest = _Forest([(*features(nodes, pieces), y) for nodes, pieces, y in labelled()])
    size = N_FEATURES
    both = np.zeros(size + N_EDGES * 4)  # node weights, then edge potentials
    mean, square = np.zeros_like(both), np.zeros_like(both)
    for k in range(1, STEPS + 1):
        grad_w, grad_p = forest.gradient(both[:size], both[size:].reshape(N_EDGES, 2, 2))
        grad = np.concatenate([grad_w, grad_p.ravel()]) - DECAY * both
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        step = mean / (1 - 0.9**k) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        both = both + RATE * min(1.0, 2 * (1 - k / (STEPS + 1))) * step
    return Model(both[:size], both[size:].reshape(N_EDGES, 2, 2))


class _Forest:
    """Labelled trees whose messages are passed depth by depth, all pages together."""

    def __init__(self, pages: list[tuple]):
        offset, depths = 0, []
        xs, kinds, parents, labels = [], [], [], []
        for x, kind, parent, y in pages:
            depth = np.zeros(len(x), np.int64)
            for k in range(1, len(x)):
                depth[k] = depth[parent[k]] + 1
            xs.append(x), kinds.append(kind), labels.append(y), depths.append(depth)
            parents.append(np.where(parent >= 0, parent + offset, -1))
            offset += len(x)
        self.x, self.kinds, self.parents, self.y, depth = (np.concatenate(v) for v in (xs, kinds, parents, labels, depths))
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
        self.pages = len(pages)
        self.inner = np.concatenate(self.levels[1:])
        self.seen = self._by_kind(np.eye(4)[2 * self.y[self.parents[self.inner]] + self.y[self.inner]])

    def _by_kind(self, edges: np.ndarray) -> np.ndarray:
        """Sums of rows of four, for the inner nodes, by their kinds of edge."""
        return np.stack([np.bincount(self.kinds[self.inner], e, N_EDGES) for e in edges.T], 1).reshape(N_EDGES, 2, 2)

    def gradient(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.x)
        up = np.stack([np.zeros(n), self.x @ weights], 1)
        message, down = np.zeros((n, 2)), np.zeros((n, 2))
        for at in self.levels[:0:-1]:
            message[at] = np.logaddexp(pair[self.kinds[at], :, 0] + up[at, :1], pair[self.kinds[at], :, 1] + up[at, 1:])
            up += np.stack([np.bincount(self.parents[at], message[at, y], n) for y in (0, 1)], 1)
        edges = np.zeros((n, 2, 2))
        for at in self.levels[1:]:
            p = self.parents[at]
            rest = up[p] + down[p] - message[at]
            down[at] = np.logaddexp(rest[:, :1] + pair[self.kinds[at], 0], rest[:, 1:] + pair[self.kinds[at], 1])
            joint = rest[:, :, None] + pair[self.kinds[at]] + up[at][:, None, :]
            edges[at] = np.exp(joint - joint.max((1, 2), keepdims=True))
            edges[at] /= edges[at].sum((1, 2), keepdims=True)
        belief = up + down
        one = 1 / (1 + np.exp(belief[:, 0] - belief[:, 1]))
        grad_w = self.x.T @ (self.y - one) / self.pages
        grad_p = self.seen - self._by_kind(edges[self.inner].reshape(-1, 4))
        return grad_w / 20, grad_p / self.pages / 20


def main_text(page: str | None, judge: Model) -> str:
    """The text of content blocks, in page order, by one space each."""
    nodes, pieces = parse(page)
    if not any(v.strip() for _, v in pieces):
        return ""
    chance = judge.content(nodes, pieces)
    limit = 0.5
    if not (chance[1:] > limit).any() and not any(v.strip() for k, v in pieces if not k):
        # no block is: then those that are as likely as the likeliest one with a sentence of prose
        prose = defaultdict(int)
        for k, v in pieces:
            prose[k] += len(v.strip())
        limit = min(limit, max((c for k, (c, x) in enumerate(zip(chance, nodes, strict=True)) if not x.hidden and prose[k] - x.linked >= SENTENCE), default=limit) - 1e-9)
    # what is left out of a line leaves no gap there
    instead = ["" if x.inline else "\n" for x in nodes]
    kept = []
    for c, x in zip(chance, nodes, strict=True):
        kept.append(c > limit and not x.hidden and (not x.inline or kept[x.parent]))
    return " ".join("".join(v if kept[k] else instead[k] for k, v in pieces).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page, or one without content, has an empty text. Repeated
    rows each give a row; other columns are not read; an empty table gives no
    rows. Long and deeply nested pages are read whole, in time that grows with
    the page; equal pages have equal texts.
    """
    judge = model()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(page.as_py(), judge) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_tree_model_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
