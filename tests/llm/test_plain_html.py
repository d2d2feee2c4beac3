"""Main text by a second, slow implementation: the operator's definition over a tree with lists of ancestors, every sum taken anew."""

import math
import os
import random
import re
from html.parser import HTMLParser

import pytest

from sablefish.llm import htmltext as H

INLINE_OR_PARAGRAPH = H.INLINE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "dd", "dt"}


class Node:
    def __init__(self, name, parent, attrs=()):
        self.name, self.parent, self.attrs = name, parent, dict(attrs)

    def up(self):
        """This node and all above it, from the root."""
        return [*(self.parent.up() if self.parent else []), self]

    def names(self):
        return [(k, n) for k in self.attrs for n in (self.attrs[k] or "").split() if k in ("class", "id", "role")]

    def mark(self):
        first = [(k, (self.attrs[k] or "").split()) for k in self.attrs if k in ("class", "id", "role") and (self.attrs[k] or "").split()]
        return ("#" if first[0][0] == "id" else ".") + first[0][1][0].lower() if first else ""

    def content(self):
        return any(n.name in ("article", "main") for n in self.up())

    def hard(self):
        for n in self.up():
            if n.name in ("", "body", "html"):
                continue
            style = n.attrs.get("style") or ""
            hidden = "hidden" in n.attrs or (n.attrs.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style, re.I)
            if hidden or n.name in H.NEVER or (n.name == "header" and not n.parent.content()):
                return True
        return False

    def hint(self):
        total, foreign = 1.0, False
        for n in self.up():
            own, other = 1.0, False
            if n.name not in ("body", "html"):
                found = [H._hint(x) for _, x in n.names()]
                own, other = min([w for w, _ in found], default=1.0), any(f for _, f in found)
                own = min(own, H.NAMED) if n.name == "form" else own
            foreign = foreign or other
            total *= 1.0 if n.name in ("article", "main", "body", "html") and not foreign else own
        return total


class Tree(HTMLParser):
    """Leaves (text, node, block) of a page whose tags are balanced."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.here, self.block, self.leaves, self.raw = Node("", None), 0, [], None

    def handle_starttag(self, tag, attrs):
        if self.raw:
            return
        self.block += tag not in H.INLINE and tag not in H.WITHIN_BLOCK
        if tag in H.RAW:
            self.raw = tag
        elif tag == "br":
            self.leaves.append((" ", self.here, self.block))
        elif tag not in H.VOID:
            self.here = Node(tag, self.here, attrs)

    def handle_endtag(self, tag):
        if self.raw and tag != self.raw:
            return
        self.block += tag not in H.INLINE and tag not in H.WITHIN_BLOCK
        if self.raw:
            self.raw = None
        elif any(n.name == tag for n in self.here.up()):
            while self.here.name != tag:
                self.here = self.here.parent
            self.here = self.here.parent

    def handle_data(self, data):
        if not self.raw:
            self.leaves.append((data, self.here, self.block))


def plain_extract(html):
    tree = Tree()
    tree.feed(html)
    tree.close()
    plain = [x for x in tree.leaves if not x[1].hard()]
    own = [x for x in plain if x[0].strip()]
    if not own:
        return ""
    size = lambda x: len(x[0].strip())
    marks = lambda x: sum(c in ".,;:!?、。，！？،؟।" for c in x[0].strip())
    path = lambda x: [n.name + n.mark() for n in x[1].up()]
    alike = [[y for y in own if path(y) == path(x)] for x in own]
    smooth = lambda v: [sum(v[j] * math.exp(-0.5 * (i - j) ** 2) for j in range(len(v)) if abs(i - j) <= 2) / sum(math.exp(-0.5 * (i - j) ** 2) for j in range(len(v)) if abs(i - j) <= 2) for i in range(len(v))]
    length, points = (smooth([sum(map(f, a)) / len(a) for a in alike]) for f in (size, marks))
    ratio = [a * (b + 0.1) * x[1].hint() for a, b, x in zip(length, points, own, strict=True)]
    mean = sum(ratio) / len(ratio)
    threshold = min(mean + 0.5 * math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio)), max(ratio) * 0.5)
    voters = [x for x, r in zip(own, ratio, strict=True) if r >= threshold * (1 - 1e-12)]
    every = {n for x in voters for n in x[1].up()}
    votes = {n: sum(size(x) for x in voters if n in x[1].up()) for n in every}
    most = [n for n in every if votes[n] >= 0.6 * sum(map(size, voters))]
    deepest = lambda nodes: max(nodes, key=lambda n: len(n.up()))
    semantic = [n for n in most if n.name in ("article", "main")]
    core = deepest(semantic or most)
    while not semantic and core.parent is not None and core.name in INLINE_OR_PARAGRAPH:
        core = core.parent
    linked = lambda x: any(n.name == "a" for n in x[1].up())
    least = min(H.PROSE, max(map(size, voters)) / 4)
    belongs = [x for x in own if x[1].hint() >= 0.5 * core.hint() and not linked(x)]
    prose = [x for x in belongs if sum(size(y) for y in belongs if y[2] == x[2]) >= least and any(marks(y) for y in belongs if y[2] == x[2])]
    content = {x[1] for x in voters + prose if x[1].content() or not core.content()}
    top = deepest([n for n in core.up() if all(n in e.up() for e in content)])

    def branch(e):
        if top not in e.up():
            return None
        return e.up()[e.up().index(top) + 1] if e is not top else top

    holds = {branch(core)} | {branch(e) for e in content}
    out, last = [], None
    for text, e, block in plain:
        at = branch(e)
        if at is None or (core.content() and not e.content()) or (e.hint() < 0.5 * core.hint() and e not in {x[1] for x in voters}):
            continue
        inside = [x for x in own if branch(x[1]) is at]
        if at is not top and at not in holds and 2 * sum(size(x) for x in inside if linked(x)) > sum(map(size, inside)):
            continue
        if block == last:
            out[-1] += text
        else:
            out.append(text)
            last = block
    return "\n\n".join(t for t in (" ".join(p.split()) for p in out) if t)


def page(rng):
    """A balanced page of an article among menus, notices and teasers, in any nesting."""
    sentence = lambda n: " ".join(rng.choice(["stone", "river", "the", "light &amp; dark", "of", "caf&eacute;"]) for _ in range(n)) + rng.choice([".", "!", ", so."])
    link = lambda: f'<a href="/x">{sentence(rng.randint(1, 3))}</a>'
    paragraph = lambda: f"<p>{sentence(rng.randint(5, 40))} {rng.choice(['', '<b>' + sentence(2) + '</b>', link()])}</p>"
    names = ['class="post"', 'class="sidebar"', 'id="footer"', 'class="related-list"', 'class="content wide"', 'class="ad"', "", 'role="banner"', 'style="display:none"']
    parts = [paragraph() for _ in range(rng.randint(1, 8))]
    parts += [f"<div {rng.choice(names)}>{rng.choice(['<ul>' + ''.join(f'<li>{link()}</li>' for _ in range(4)) + '</ul>', paragraph(), '<h2>' + sentence(3) + '</h2>' + paragraph()])}</div>" for _ in range(rng.randint(0, 5))]
    parts += [f"<{t}>{sentence(6)}</{t}>" for t in rng.sample(["nav", "footer", "aside", "form", "header", "section", "h1"], rng.randint(0, 4))]
    rng.shuffle(parts)
    body = "\n".join(parts)
    for t in rng.sample(["article", "main", "div", 'div class="wrap"'], rng.randint(0, 3)):
        body = f"<{t}>{body}</{t.split()[0]}>"
    return f"<html><head><title>x</title><script>var a = '<p>no</p>';</script></head><body>{body}</body></html>"


def test_made_pages():
    rng = random.Random(6)
    found = 0
    for _ in range(400):
        html = page(rng)
        assert H.extract(html) == plain_extract(html), html
        found += bool(H.extract(html))
    assert found > 350


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_pages_of_the_tables():
    import duckdb

    pages = [r[0] or "" for r in duckdb.connect().sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]
    assert len(pages) > 100
    for html in pages:
        assert H.extract(html) == plain_extract(html), html
