"""Operator 4, HTML main text by tag-path ratios.

Every run of text in a page is a leaf, reached from the root over a path of tags (with the
first class or id of each). Leaves with equal paths are pooled: a path's text ratio is its
text length over its number of leaves, its punctuation ratio the same with punctuation
marks. Over the leaves in page order both ratios are smoothed by a Gaussian window, fused as
a product, and weighted by hints: words in classes and ids that speak of boilerplate lower the weight of what lies below
(much where the whole name does, a little where other words stand beside them), and so does a form. Leaves above a threshold (the mean
plus a share of the standard deviation) are content and vote, with their text length, for the elements they are in; the
deepest one that holds most of the votes and isn't a mere paragraph is the core. The main element
is the deepest one that covers the core, all leaves that voted and all prose (blocks with punctuation
and at least ``PROSE`` characters outside links, or a quarter of the longest leaf that voted, if that
is less) of no lower hint than the core's, so articles split over several elements stay whole.

The page's main text are the content leaves of the main element and what belongs to them: paths below the threshold
(headings, short paragraphs, lists) whose hint isn't much lower than the core's; outside the core only in parts that hold content or prose
or aren't made of links. Hints above the core count for all alike, so names of a whole page's layout decide nothing.
What HTML itself declares to be navigation, footers, asides, dialogs, scripts and styles is no content anywhere; headers are none
outside an article. Where the core lies in ``article`` or ``main``, only text in such elements counts.

Blocks are runs between block-level tags. Character references are decoded, white space
inside a block becomes one space, empty blocks are dropped and blocks join by two newlines.

Defined results: null, empty and markup-only pages have an empty text; plain text without
tags is one block; unclosed and stray tags, comments and cut-off pages parse like this: a new
block-level tag closes open paragraphs, an end tag closes up to its nearest open start or
nothing, script and style run to their end tag or the end of the page. Ties of ratios share their fate, ties of votes go to the deeper element. Very long pages
are read in one pass over their tags. Repeated rows give
repeated results, and an empty table an empty one. Only the id, url and html are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

SCHEMA = "page_id long, url string, text string, n_chars long"

# Fixed values of HTML.
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An opening tag of this name closes an open one of these, within the given boundary.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are never main text, and those that aren't unless they lie in an article.
NEVER = frozenset("nav footer aside button dialog menu object audio video canvas map".split()) | RAW
#: Of these, the ones that may stand inside a block.
WITHIN_BLOCK = RAW - {"xmp", "noframes", "noembed"}
OUTSIDE = frozenset(["header"])
#: Words in classes, ids and roles that name boilerplate.
BOILERPLATE = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion sidebar side aside menu nav navbar navigation breadcrumb
    breadcrumbs footer header masthead comment comments commentlist disqus reply replies respond notice notices alert cookie cookies consent gdpr popup modal overlay
    newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager copyright disclaimer
    hidden complementary contentinfo search outbrain taboola""".split()
)
#: Boilerplate words that mean nothing beside one of GOOD (the header of an article holds its title).
GOOD, EXCUSED = frozenset("article main content post entry story body text".split()), frozenset("header masthead side".split())
#: Boilerplate words whose elements may hold articles that aren't the page's (comments, teasers).
FOREIGN = frozenset("comment comments commentlist disqus reply replies respond related recommended recommendations ad ads adv advert adverts sponsored promoted".split())
#: Words that say nothing about a part's kind.
GENERIC = GOOD | frozenset(
    """list lists item items box block container wrapper wrap inner outer section area bar group row col column unit slot zone panel top bottom left right site page pages global
    posts articles stories links link buttons button form title heading head text""".split()
)
#: Weights of elements whose whole name is boilerplate, and of those with other words in it; least hint of what belongs to the core.
NAMED, MIXED, BELONGS = 0.01, 0.5, 0.5
SIGMA, RADIUS, LAMBDA, MAJORITY = 1.0, 2, 0.5, 0.6
#: Characters outside links that make a block with punctuation prose.
PROSE = 80
_TAG = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?、。，！？،؟।]")
_WORDS = re.compile(r"[A-Za-z]+")


class Element:
    """path: a number, equal for equal paths; hint: the weight of its text by names; hard: no content by its tag; foreign: articles in it aren't the page's."""

    __slots__ = ("content", "depth", "foreign", "hard", "hint", "name", "parent", "path", "votes")

    def __init__(self, name: str, parent: Element | None, path: int, hard: bool, hint: float, foreign: bool):
        self.name, self.parent, self.path = name, parent, path
        self.depth = parent.depth + 1 if parent else 0
        self.content = bool(parent and parent.content) or name in ("article", "main")
        self.hard = hard or bool(parent and parent.hard)
        self.foreign = foreign or bool(parent and parent.foreign)
        if name in ("article", "main", "body", "html") and not self.foreign:
            hint = 1.0
        self.hint = hint * (parent.hint if parent else 1.0)
        self.votes = 0.0


class Leaf:
    __slots__ = ("block", "element", "marks", "size", "text")

    def __init__(self, text: str, element: Element, block: int):
        self.text, self.element, self.block = text, element, block
        plain = text.strip()
        self.size = len(plain)
        self.marks = len(_PUNCTUATION.findall(plain))


def _hint(name: str) -> tuple[float, bool]:
    """The weight of one class or id; whether it names foreign text."""
    words = {w.lower() for w in _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))}
    named = words & BOILERPLATE
    if not named or (words & GOOD and named <= EXCUSED):
        return 1.0, False
    rest = {w for w in words - named if len(w) > 1}
    return (MIXED, False) if rest - GENERIC else (NAMED, bool(named & FOREIGN))


def _marks(attributes: str) -> tuple[str, bool, float, bool]:
    """The path mark of a tag's class or id; whether it is hidden; its hint; whether it names foreign text."""
    mark, hidden, hint, foreign = "", False, 1.0, False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            for name in value.split():
                weight, other = _hint(name)
                hint, foreign = min(hint, weight), foreign or other
            if not mark and value.split():
                mark = ("#" if key == "id" else ".") + value.split()[0].lower()
    return mark, hidden, hint, foreign


def leaves(html: str) -> list[Leaf]:
    """The page's runs of text in order, with their elements and block numbers."""
    root = Element("", None, 0, False, 1.0, False)
    numbers: dict[tuple[int, str], int] = {}
    stack = [root]
    out: list[Leaf] = []
    block, at = 0, 0
    n = len(html)
    low = None

    def text(start: int, stop: int) -> None:
        if stop > start:
            out.append(Leaf(unescape(html[start:stop]), stack[-1], block))

    for m in iter(_Scan(html)):
        start, stop, name, closing, attributes = m
        text(at, start)
        at = stop
        if name is None:
            continue
        within = name in INLINE or name in WITHIN_BLOCK
        if not within:
            block += 1
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name not in INLINE:
                    break
        if name in SIBLINGS:
            ends, bounds = SIBLINGS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in bounds:
                    break
                if stack[k].name in ends:
                    del stack[k:]
                    break
        if name in VOID or attributes.endswith("/") and name in INLINE:
            if name == "br" and out and stop < n:
                out.append(Leaf(" ", stack[-1], block))
            continue
        mark, hidden, hint, foreign = _marks(attributes) if attributes else ("", False, 1.0, False)
        hard = hidden or name in NEVER or (name in OUTSIDE and not stack[-1].content)
        if name in ("body", "html"):
            hard, hint, foreign = False, 1.0, False
        if name == "form":
            hint = min(hint, NAMED)
        if name in RAW:
            low = low or html.lower()
            end = low.find("</" + name, at)
            at = n if end < 0 else end
            m.skip(at)
            block += not within
            continue
        path = numbers.setdefault((stack[-1].path, name + mark), len(numbers) + 1)
        stack.append(Element(name, stack[-1], path, hard, hint, foreign))
    text(at, n)
    return out


class _Scan:
    """Tags of a page, one after the other; ``skip`` on a result moves the scan on."""

    class Hit(tuple):
        scan: _Scan

        def skip(self, to: int) -> None:
            self.scan.at = to

    def __init__(self, html: str):
        self.html, self.at = html, 0

    def __iter__(self):
        while (m := _TAG.search(self.html, self.at)) is not None:
            self.at = m.end()
            name = m[1]
            hit = _Scan.Hit((m.start(), m.end(), name.lower() if name else None, m[0].startswith("</"), (m[2] or "").strip()))
            hit.scan = self
            yield hit


def _smooth(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel)[RADIUS:-RADIUS]
    return np.convolve(x, kernel)[RADIUS:-RADIUS] / weight


def ratios(own: list[Leaf]) -> np.ndarray:
    """The fused, smoothed tag-path ratio of each leaf."""
    size, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for leaf in own:
        path = leaf.element.path
        size[path] += leaf.size
        marks[path] += leaf.marks
        count[path] += 1
    paths = [leaf.element.path for leaf in own]
    length = np.array([size[p] / count[p] for p in paths], dtype=np.float64)
    points = np.array([marks[p] / count[p] for p in paths], dtype=np.float64)
    return _smooth(length) * (_smooth(points) + 0.1)


def voters_of(own: list[Leaf]) -> list[Leaf]:
    """The leaves whose weighted ratio is above the threshold."""
    if not own:
        return []
    ratio = ratios(own) * np.array([x.element.hint for x in own])
    threshold = min(ratio.mean() + LAMBDA * ratio.std(), ratio.max() * 0.5)
    return [leaf for leaf, r in zip(own, ratio, strict=True) if r >= threshold]


def core_element(voters: list[Leaf]) -> Element:
    """The deepest element with most of the votes."""
    total = 0.0
    elements: set[Element] = set()
    for leaf in voters:
        total += leaf.size
        e = leaf.element
        while e is not None:
            e.votes += leaf.size
            elements.add(e)
            e = e.parent
    most = [e for e in elements if e.votes >= MAJORITY * total]
    best = max(most, key=lambda e: e.depth)
    semantic = [e for e in most if e.name in ("article", "main")]
    if semantic:
        return max(semantic, key=lambda e: e.depth)
    while best.parent is not None and (best.name in INLINE or best.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "dd", "dt")):
        best = best.parent
    return best


def linked(leaves: list[Leaf]) -> set[Element]:
    """The elements of leaves that lie in links."""
    known: dict[Element, bool] = {}
    for leaf in leaves:
        passed, e, found = [], leaf.element, False
        while e is not None and e not in known and not found:
            passed.append(e)
            found = e.name == "a"
            e = e.parent
        known.update(dict.fromkeys(passed, found or bool(e is not None and known.get(e))))
    return {e for e, found in known.items() if found}


def prose(own: list[Leaf], links: set[Element], least: float) -> list[Leaf]:
    """Leaves of blocks with punctuation and ``least`` characters outside links."""
    size, marks = defaultdict(int), defaultdict(int)
    plain = [x for x in own if x.element not in links]
    for leaf in plain:
        size[leaf.block] += leaf.size
        marks[leaf.block] += leaf.marks
    return [x for x in plain if marks[x.block] and size[x.block] >= least]


def cover(core: Element, elements: set[Element]) -> Element:
    """The deepest element that holds the core and all others."""
    top = core
    for e in elements:
        while e.depth > top.depth:
            e = e.parent
        while e is not top:
            if top.depth >= e.depth:
                top = top.parent
            if e.depth > top.depth:
                e = e.parent
    return top


def branches(leaves: list[Leaf], top: Element) -> list[Element | None]:
    """For each leaf, the element below ``top`` that it lies in; None for leaves outside ``top``, ``top`` for its own."""
    known: dict[Element, Element | None] = {top: top}
    out = []
    for leaf in leaves:
        passed, e = [], leaf.element
        while e is not None and e not in known:
            passed.append(e)
            e = e.parent
        found = known[e] if e is not None else None
        if found is top and passed:
            found = passed[-1]
        known.update(dict.fromkeys(passed, found))
        out.append(found)
    return out


def extract(html: str | None) -> str:
    """The main text of a page."""
    plain = [x for x in leaves(html or "") if not x.element.hard]
    own = [x for x in plain if x.size]
    voters = voters_of(own)
    if not voters:
        return ""
    core = core_element(voters)
    least = BELONGS * core.hint
    links = linked(own)
    belongs = [x for x in own if x.element.hint >= least]
    content = {x.element for x in voters + prose(belongs, links, min(PROSE, max(x.size for x in voters) / 4)) if x.element.content or not core.content}
    top = cover(core, content)
    chosen = {x.element for x in voters}
    # the parts of the main element beside the core that are made of links and hold no content are menus
    branch = dict(zip(map(id, plain), branches(plain, top), strict=True))
    core_branch = core
    while core_branch is not top and core_branch.parent is not top:
        core_branch = core_branch.parent
    holds = {core_branch} | {branch[id(x)] for x in own if x.element in content}
    size, in_links = defaultdict(int), defaultdict(int)
    for x in own:
        size[branch[id(x)]] += x.size
        in_links[branch[id(x)]] += x.size * (x.element in links)
    parts: list[str] = []
    last = None
    for leaf in plain:
        e, at = leaf.element, branch[id(leaf)]
        if at is None or (core.content and not e.content) or (e.hint < least and e not in chosen):
            continue
        if at is not top and at not in holds and 2 * in_links[at] > size[at]:
            continue
        if leaf.block == last:
            parts[-1] += leaf.text
        else:
            parts.append(leaf.text)
            last = leaf.block
    return "\n\n".join(t for t in (" ".join(p.split()) for p in parts) if t)


def _extract_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            texts = [extract(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page with its main text."""
    narrow = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return narrow.transform(arrow_map, _extract_all, SCHEMA)
