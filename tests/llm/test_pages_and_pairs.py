"""Archives, main text, near duplicates and the pipeline."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from sablefish.llm import archives, htmltext, neardup

from .conftest import corpus

PAGES = [
    (1, "http://a/1", "<p>" + "x" * 2000), (2, "http://a/2", "<p>" + "x" * 2000), (3, "http://a 3\n", "<p>small"), (4, None, "<p>small"), (5, "http://a/5", None), (6, "http://a/6", ""),
    (7, "http://a/7", "<p>" + "x" * 2000), (None, "http://a/8", "é" * 600), (9, "http://a/9", "é" * 600), (9, "http://a/9", "é" * 600), (10, "u", "WARC/1.1\r\n\r\nhttp://x 0.0.0.0 1 text/html 5\nab\0\n" * 40),
]
PAGE_SCHEMA = "page_id long, url string, html string, record string, digest int"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "r", 1) for p in PAGES], PAGE_SCHEMA).repartition(3)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = archives.arc_start("v.arc", version, "20200101000000")
    bodies = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello", b"", b"not http\nfiledesc: 1 2 3", b"\n\nhttp://x 1 2 3 4\n"]
    for k, b in enumerate(bodies):
        data += archives.arc_record(f"http://h/{k} x", "20200102030405", "text/html", b, version)
    for stored in (data, archives.gzip_member(data) + b"\0", b"".join(map(archives.gzip_member, (data[:40], data[40:]))) + b"\0\0"):
        first, *rest = archives.read_arc(stored)
        assert first.fields["url"] == "filedesc://v.arc" and [r.body for r in rest] == bodies
        assert rest[0].fields["url"] == "http://h/0%20x" and set(rest[0].fields) == set(archives.FIELDS[version])
    kinds = [archives.convert(r).headers["WARC-Type"] for r in [first, *rest]]
    assert kinds == ["warcinfo", "response", "resource", "resource", "resource"]
    warc = archives.convert(rest[0])
    assert warc.headers["WARC-Date"] == "2020-01-02T03:04:05Z" and warc.headers["WARC-Payload-Digest"] == archives.sha1_32(b"hello")
    assert list(archives.read_warc(b"".join(map(archives.write_warc, [warc, warc])))) == [warc, warc]
    assert archives.convert(rest[0]).headers["WARC-Record-ID"] == warc.headers["WARC-Record-ID"] != archives.convert(rest[1]).headers["WARC-Record-ID"]


def test_broken_archives():
    start = archives.arc_start("v", 1, "20200101")
    for bad in (b"x", start + b"http://a 1 2 3\n", start + b"http://a 0.0.0.0 20200101000000 text/html 99\nshort", start[:40]):
        with pytest.raises(archives.ArchiveError):
            list(archives.read_arc(bad))
    with pytest.raises(archives.ArchiveError):
        list(archives.read_arc(archives.gzip_member(start * 50)[:-20]))
    with pytest.raises(archives.ArchiveError):
        archives.iso_date("20201399")
    assert archives.iso_date("2020") == "2020-01-01T00:00:00Z"


def test_archive_of_pages(spark, pages, monkeypatch):
    for broadcast in (archives.BROADCAST_REVISITS, 0):
        monkeypatch.setattr(archives, "BROADCAST_REVISITS", broadcast)
        rows = archives.archive(spark, pages).collect()
        got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
        assert sum(got.values()) == len(PAGES)
        for page, _, html in PAGES:
            data = (html or "").encode()
            assert any(k[:3] == (page, len(data), hashlib.sha1(data).hexdigest()) for k in got)
        kinds = {k[0]: k[3:] for k in got if k[0] not in (None, 9)}
        assert kinds == {1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 10: ("response", None)}
        assert sorted(k[3] for k in got.elements() if k[0] == 9) == ["response", "revisit"] and [k[3:] for k in got if k[0] is None] == [("revisit", 9)]
    assert archives.archive(spark, spark.createDataFrame([], PAGE_SCHEMA)).count() == 0


ARTICLE = "<h1>A title</h1><p><b>First, a <a href='x'>link</a> &amp; more.<br><p>Second,\n long enough. Yes, it is.<ul><li>one<li>two</ul><p>Short.</p>"
CLEAN = "A title\n\nFirst, a link & more.\n\nSecond, long enough. Yes, it is.\n\none\n\ntwo\n\nShort."
NOISE = [
    "<nav><ul><li><a href=/>Home</a></ul></nav>", "<header><p>The site of all the news, every day, for everyone.</p></header>", '<div class="sidebar"><p>Other long texts, of a similar kind. With commas, and stops.</p></div>',
    '<div id="comments"><p>Great post, thanks. I liked it, really, very much so.</p></div>', '<div class="cookie-notice">We use cookies, and so on. Accept, please.</div>', '<div class="ad">Buy now, really.</div>',
    "<aside>Related, things, are here.</aside>", "<form><label>Name, please</label><input></form>", "<script>var x = '<p>No, not this.</p>';</script>", "<style>p { a: b }</style>", "<!-- <p>hidden, text</p> -->",
    "<footer>&copy; all, of it.</footer>",
]


@pytest.mark.parametrize("body", ["<article>{0}</article>", '<div id="content">{0}</div>', '<main><div class="post-body">{0}</div></main>', "<div><div>{0}</div></div>"])
def test_main_text(body):
    html = "<!DOCTYPE html><html><head><title>No</title></head><body>" + "".join(NOISE[:6]) + body.format(ARTICLE) + "".join(NOISE[6:]) + "</body></html>"
    assert htmltext.extract(html) == CLEAN
    inside = "<html><body>" + body.format(ARTICLE.replace("<ul>", "".join(NOISE[5:9]) + "<ul>")) + "</body>"
    assert htmltext.extract(inside) == CLEAN


def test_names_of_layouts_and_foreign_articles():
    comments = '<section id="comments"><article class="comment"><p>Nice, I like it, truly. Very, very much, as I said.</p></article></section>'
    assert htmltext.extract(f'<body class="has-sidebar"><div class="layout sidebar-right"><article>{ARTICLE}</article>{comments}</div></body>') == CLEAN
    assert htmltext.extract(f'<div class="page sidebar-left"><div><div>{ARTICLE}</div></div></div>') == CLEAN
    assert htmltext.extract(f'<div class="main-menu">Home, about, news.</div><div class="content">{ARTICLE}<div class="post-footer">Filed, under, x.</div></div>') == CLEAN
    assert htmltext.extract(f'<article><header class="entry-header"><h1>Top</h1></header>{ARTICLE}</article>') == "Top\n\n" + CLEAN
    assert htmltext.extract(f"<article>{ARTICLE}{comments}</article>") == CLEAN


@pytest.mark.parametrize("shape", ["<div>{0}</div>{3}<div>{1}</div><div>{2}</div>", '<div id="one">{0}</div><h2>Next</h2><div id="two">{1}</div>{3}<div id="three">{2}</div>', '<section class="a">{0}</section><section class="b">{1}</section><section id="c">{2}</section>', "<main><article>{0}</article>{3}<article>{1}</article><article>{2}</article></main>", "<article>{0}</article><p>Unmarked, short.</p><article>{1}{2}</article>"])
def test_articles_in_several_parts(shape):
    parts = ["<p>" + "Words of this kind of text, and a few more of them. " * n + "</p>" for n in (20, 6, 6)]
    html = "<body>" + NOISE[0] + '<div class="wrap">' + shape.format(*parts, NOISE[5]) + "</div>" + "".join(NOISE[6:]) + "</body>"
    expected = [p[3:-5] for p in parts]
    assert htmltext.extract(html).split("\n\n") == expected[:1] + ["Next"] * ("Next" in shape) + expected[1:]


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ('<div class="search-results"><p>The search found, after a year, nothing. We go on.</p></div>', "The search found, after a year, nothing. We go on."),
        ('<p class="related-work">Others have done this, too.</p>', "Others have done this, too."),
        ("<p>Choose <select><option>one<option>two</select> of these, please.", "Choose of these, please."),
        ("<p>It was<script>var x;</script> here, yes.", "It was here, yes."),
        ('<div class="ad-slot-2">Buy now, really.</div>', ""),
        ('<div id="commentList"><p>I like it, I do. So much, so very much, indeed, every day.</p></div>', ""),
    ],
)
def test_names_are_hints(part, text):
    expected = CLEAN.replace("Short.", text + "\n\nShort." if text else "Short.")
    for shape in ("<article>{0}</article>", '<div class="body">{0}</div>', '<form><div class="page sidebar">{0}</div></form>', '<div class="widget"><div>{0}</div></div>'):
        html = NOISE[0] + shape.format(ARTICLE.replace("<p>Short.", part + "<p>Short.")) + "".join(NOISE[8:])
        assert htmltext.extract(html) == expected, shape


def test_unnamed_menus():
    menu = "<div><ul>" + "".join(f"<li><a href=/{k}>Topic {k}</a></li>" for k in range(8)) + "</ul></div>"
    parts = ["<p>" + "Words of this kind of text, and a few more of them. " * n + "</p>" for n in (9, 8)]
    html = f"<body>{menu}<div>{parts[0]}</div>{menu}<div>{parts[1]}<ul><li><a>own</a></ul></div></body>"
    assert htmltext.extract(html).split("\n\n") == [parts[0][3:-5], parts[1][3:-5], "own"]


def test_paths_of_deep_pages_stay_apart():
    deep = '<div class="a long name of a class">' * 60
    html = f"<div id=x>{deep}<p>" + "Text, of an article. " * 9 + f"</p></div></div><div id=y>{deep}<p>no</p></div></div>"
    found = htmltext.leaves(html)
    assert found[0].element.path != found[-1].element.path


def test_odd_pages():
    for html, text in [(None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<script>x", ""), ("<b", ""), ("a &lt; b &#233;&nbsp;c", "a < b é c"), ("<p>x</div></p>y", "x\n\ny"), ("<" * 50, "<" * 50)]:
        assert htmltext.extract(html) == text, html
    long = "<article>" + "<p>word, word. " * 20_000
    assert htmltext.extract(long).count("\n\n") == 19_999
    deep = "<div>" * 3000 + "<p>text, here."
    assert htmltext.extract(deep) == "text, here."


def test_main_text_over_a_table(spark, pages):
    rows = htmltext.main_text(pages).collect()
    assert len(rows) == len(PAGES) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert htmltext.main_text(spark.createDataFrame([], PAGE_SCHEMA)).count() == 0


def shingles(t):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_sets_and_signatures():
    texts = [t for _, t, _, _ in corpus()]
    values, offsets = neardup.shingle_sets(pa.array(texts))
    assert np.diff(offsets).tolist() == [len(shingles(t)) for t in texts]
    full = np.flatnonzero(np.diff(offsets))
    sig = neardup.signatures(values, np.concatenate([offsets[:-1][full], [offsets[-1]]]))
    for a in range(0, len(full), 3):
        for b in range(a, len(full), 5):
            s, t = shingles(texts[full[a]]), shingles(texts[full[b]])
            assert abs((sig[a] == sig[b]).mean() - len(s & t) / len(s | t)) < 0.17


def test_bound():
    """A pair at the threshold is dropped with about the chosen probability at most."""
    least = neardup.least_matches()
    rng = np.random.default_rng(0)
    same = rng.random((20_000, neardup.HASHES)) < 0.75 + 0.25 / 256
    alive, _ = neardup.survivors(same, np.ones_like(same))
    assert 1 - len(alive) / len(same) < 0.003 and least == sorted(least)
    far, _ = neardup.survivors(rng.random((2000, neardup.HASHES)) < 0.3, np.ones((2000, neardup.HASHES), bool))
    assert not len(far)


def test_near_duplicates(spark, docs, no_docs, monkeypatch):
    expected = brute_components([(i, t) for i, t in {(i, t) for i, t, _, _ in corpus()} if i is not None])
    for broadcast, block in ((neardup.BROADCAST_IDS, neardup.BLOCK), (0, 3)):
        monkeypatch.setattr(neardup, "BROADCAST_IDS", broadcast)
        monkeypatch.setattr(neardup, "BLOCK", block)
        rows = neardup.classes(spark, docs).collect()
        assert len(rows) == docs.count()
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
        assert got == expected
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert neardup.classes(spark, no_docs).count() == 0


def test_hubs_of_three_partners(spark):
    """Texts linked only through a later one, whose third best star pair is alone in its buckets."""
    rows = []
    for seed in (292, 435, 835, 845):
        hub = [f"w{seed}x{k}" for k in range(164)]
        rows += [(4 * seed + i, " ".join(p)) for i, p in enumerate((hub[38:], hub[:-38], hub[:63] + hub[93:], hub))]
    expected = brute_components(rows)
    assert len({c for _, c in expected.values()}) == 4
    got = neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected


@pytest.mark.parametrize("broadcast", [500, 0])
def test_a_class_of_texts_with_a_common_frame_is_split(spark, monkeypatch, broadcast):
    """Unlike texts that share half their words: compared by their rare shingles, with near copies found among them."""
    import random

    rng = random.Random(2)
    frame = [f"f{k}" for k in range(70)]
    rows = []
    for i in range(400):
        own = [f"o{i}x{k}" for k in range(60)]
        rows.append((i, " ".join(own[:30] + frame + own[30:])))
        if i % 25 == 0:  # near copies at several distances, some of them linked with each other only
            copy = (own[:30] + frame + own[30:])[:]
            for step in range(1, 4):
                for k in rng.sample(range(len(copy)), 2):
                    copy[k] = f"c{i}x{step}x{k}"
                rows.append((1000 + 10 * i + step, " ".join(copy)))
    rng.shuffle(rows)
    for name, value in {"WIDE": 40, "TOLD_BY": 30, "BLOCK": 32, "BROADCAST_GROUPS": broadcast}.items():
        monkeypatch.setattr(neardup, name, value)
    seen = {}
    own_narrowed = neardup.narrowed

    def spy(spark, docs, grouped, nodes):
        out = own_narrowed(spark, docs, grouped, nodes)
        for k, df in (("before", grouped), ("after", out)):
            seen[k] = [(r["grp"]["kind"], r["count"]) for r in df.groupBy("grp").count().collect()]
        return out

    monkeypatch.setattr(neardup, "narrowed", spy)
    got = neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    assert len({r["component_id"] for r in got}) > 395
    assert max(n for _, n in seen["before"]) > 150
    assert sum(n * n for _, n in seen["after"]) < sum(n * n for _, n in seen["before"]) / 10


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 60), (60, 55), (70, 71)], "a long, b long")
    got = {r["node"]: r["comp"] for r in neardup.components(spark, links, "t").collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 60: 50, 55: 50, 70: 70, 71: 70}


def test_pipeline(spark, docs, no_docs, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    from sablefish.llm import langid

    monkeypatch.setattr(langid.Network.train, "__defaults__", (60, 64, 0.02, 7))
    at = {}
    for source in (docs, no_docs):
        frame = source
        for name, stage in pipeline.STAGES:
            out = stage(spark, frame, "")
            if name != "packing":
                assert out.columns == source.columns
            frame = spark.createDataFrame(out.collect(), out.schema)
            if source is docs:
                at[name] = frame.collect()
        assert source is docs or frame.count() == 0
    ids = {k: collections.Counter(r["doc_id"] for r in v) for k, v in at.items()}
    assert set(ids["language_id"]) == {i for i, t, _, _ in corpus() if t and any(map(str.isalpha, t))}
    assert 201 not in ids["line_dedup"] and 400 in ids["line_dedup"]
    assert ids["near_dedup"][500] == 1 and len(ids["near_dedup"]) <= len(ids["line_dedup"])
    assert set(ids["mixing"]) <= set(ids["near_dedup"]) and set(ids["packing"]) == set(ids["mixing"])


def test_rows_of_one_id_in_the_near_duplicate_stage(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "one text of its own kind", "a"), (1, "another text that is quite unlike", "b"), (2, "twice in here", "a"), (2, "twice in here", "a"), (3, long, "a"), (4, long + " more", "a"), (5, long + " most", "a"), (5, "alone", "b"), (None, "x", "a"), (None, "x", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    copies = [k for k in got.elements() if k[1].startswith(long)]
    assert len(copies) == 1
    del got[copies[0]]
    assert got == {(1, rows[0][1]): 1, (1, rows[1][1]): 1, (2, rows[2][1]): 1, (5, "alone"): 1, (None, "x"): 2}


def test_language_stage_rejects_by_the_network(spark, docs, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    from sablefish.llm import langid

    class Halves:
        def shares(self, texts):
            share = np.array([[0.14, 0.1, 0.76]] * len(texts))
            share[[t == "word" for t in texts.to_pylist()]] = [0.1, 0.15, 0.75]
            return share

    monkeypatch.setattr(langid, "learn", lambda *a: (Halves(), ["de", "en"]))
    assert [r["doc_id"] for r in pipeline.identify_language(spark, docs, "").collect()] == [304]


def test_language_stage_without_labels(spark, docs):
    """Nothing to learn from: only texts without a letter go."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.identify_language(spark, bare, "")
    assert out.columns == bare.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter(i for i, t, _, _ in corpus() if t and any(map(str.isalpha, t)))
