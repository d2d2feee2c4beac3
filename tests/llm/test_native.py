"""Mixing, fingerprints and line dedup."""

import collections
import hashlib
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from sablefish.llm import common, linededup, mixing, sketches

from .conftest import corpus


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def marginals(rows, d):
    out = {r[d]: 0.0 for r in rows}
    for r in rows:
        out[r[d]] += r["prob"] * r["tokens"]
    return out


def test_raking_meets_the_marginals(spark):
    rows = [(s, lang, t, n) for k, (s, lang, t) in enumerate((s, lang, t) for s in ("a", "b", None) for lang in ("en", "de") for t in ("x", "y")) for n in [10 * (k + 1) ** 2]]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"lang": {"en": 3.0, "de": 1.0, "absent": 5.0}, "topic": {"x": 0.5, "y": 0.5}, "source": {"a": 0.2, "b": 0.5}}
    budget = 0.02 * sum(n for *_, n in rows)
    out = mixing.rake(spark, cells, targets, 0.02, rounds=15).collect()
    by = lambda d: {k: v / budget for k, v in marginals(out, d).items()}
    assert by("topic") == pytest.approx({"x": 0.5, "y": 0.5}, abs=1e-6)
    assert by("source") == pytest.approx({"a": 2 / 7, "b": 5 / 7, None: 0.0}, abs=1e-3)
    assert by("lang")["en"] / by("lang")["de"] == pytest.approx(3, rel=1e-2)
    probs = mixing.rake(spark, cells, None, 0.5).collect()
    assert sum(r["prob"] * r["tokens"] for r in probs) == pytest.approx(0.5 * sum(r["tokens"] for r in probs), rel=1e-3)
    assert all(0 <= r["prob"] <= 1 for r in probs)


@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.9])
def test_raking_under_the_cap_meets_feasible_targets(spark, fraction):
    rng = random.Random(4)
    # rare sources and topics, whose targets are above all they have
    rows = [(s, lang, t, int(rng.randint(50, 150) * ws * wl * wt)) for s, ws in (("a", 100), ("b", 30), ("c", 1)) for lang, wl in (("en", 10), ("de", 3)) for t, wt in (("x", 40), ("y", 9), ("z", 1))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    out = mixing.rake(spark, cells, None, fraction).collect()
    assert all(0 <= r["prob"] <= 1 for r in out)
    for d in mixing.DIMENSIONS:
        own = {r[d]: sum(x["tokens"] for x in out if x[d] == r[d]) for r in out}
        goal = {r[d]: r[f"goal_{d}"] for r in out}
        assert sum(goal.values()) == pytest.approx(fraction * sum(own.values()), rel=1e-6) and all(goal[k] <= own[k] for k in own)
        # those below all they have keep the proportions of their targets
        free = [goal[k] / own[k] ** mixing.TEMPER for k in own if goal[k] < own[k]]
        assert max(free) == pytest.approx(min(free), rel=1e-6)
        assert marginals(out, d) == pytest.approx(goal, rel=0.01)


def test_mixing_over_a_table(spark, docs, no_docs, monkeypatch):
    out = mixing.mix(spark, docs)
    assert no_python(out)
    rows = [tuple(r) for r in out.select("doc_id", "topic", "n_tokens", "prob").collect()]
    assert rows and all(r[3] > 0 for r in rows)
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    salted = [tuple(r) for r in mixing.mix(spark, docs).select("doc_id", "topic", "n_tokens", "prob").collect()]
    assert sorted(map(str, rows)) == sorted(map(str, salted))
    assert collections.Counter(r[0] for r in rows)[500] in (0, 2)  # equal rows share their fate
    assert mixing.mix(spark, no_docs).count() == 0


def paragraphs(t):
    return {p for p in (t or "").split("\n") if p.strip(" ")}


def test_fingerprints(spark, docs, no_docs):
    out = sketches.fingerprints(spark, docs)
    assert no_python(out)
    rows = out.collect()
    ordered = sorted(((i, t or "") for i, t, _, _ in corpus()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expected = collections.Counter()
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        like = lambda a, b: round(len(a & b) / len(a | b), 9) if a | b else 1.0
        expected[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), like(paragraphs(t), paragraphs(edited)), like(paragraphs(t), paragraphs(nxt))] += 1
    assert expected == collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows)
    texts = dict(corpus_ids())
    by_text = collections.defaultdict(set)
    for r in rows:
        if r["doc_id"] is not None:
            by_text[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({tuple(v) for v in by_text.values()}) == len(by_text)
    assert sketches.fingerprints(spark, no_docs).count() == 0
    assert sketches.fingerprints(spark, docs.where("doc_id = 0")).first()["near_next"] == 1.0


def corpus_ids():
    return [(i, t or "") for i, t, _, _ in corpus() if i is not None]


@pytest.mark.parametrize(("a", "b"), [(0, 0), (1, 0), (3, 5), (40, 40), (300, 280)])
def test_peeling_recovers_the_difference(spark, a, b):
    df = spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(a + 20)), lambda x: F.xxhash64(x)).alias("p"), F.transform(F.sequence(F.lit(a + 1), F.lit(a + b + 20)), lambda x: F.xxhash64(x)).alias("q")
    )
    row = df.selectExpr("p", "q", f"{sketches.difference('p', 'q')} AS d").first()
    assert sorted(row["d"]["found"]) == sorted(set(row["p"]) ^ set(row["q"])) and row["d"]["blocks"] >= 1


def edit_at_most_one(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y, strict=True)) <= 1
    long, short = (x, y) if len(x) > len(y) else (y, x)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def units(w, least):
    """The words of a line, as a list; a shorter line's characters, as a string; None for the shortest."""
    return w if len(w) >= least else " ".join(w) if len(" ".join(w)) >= least else None


def brute_dedup(rows, least):
    """Every line against every earlier one."""
    seen, out = [], {}
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            w = line.replace("\t", " ").replace("\r", " ").split(" ")
            w = [x for x in w if x]
            if not w:
                kept.append(line)
                continue
            same = w in seen
            u = units(w, least)
            near = u is not None and any(s != w and units(s, least) is not None and type(units(s, least)) is type(u) and edit_at_most_one(u, units(s, least)) for s in seen[: seen.index(w) if same else len(seen)])
            if not same:
                seen.append(w)
            if not same and not near:
                kept.append(line)
        full = [x for x in kept if x.strip(" \t\r")]
        out[i] = None if t is None else "\n".join(kept) if full or not any(x.strip(" \t\r") for x in t.split("\n")) else ""
    return out


LINES = [
    (1, "a b c d e f g h\nshort line\na b c d e f g h"), (2, "a b X d e f g h\nshort line\nshort lime"), (3, "a b c d e f g h i\n\n  \nunique words are in this line of mine"),
    (4, "unique words are in this odd line of mine\nb c d e f g h"), (5, "b c d e f g h i"), (6, "  a  b\tc d e f g h"), (7, None), (8, ""), (9, "short line"), (11, "1234567\n1234568\n12345678\n12345679\n123456789\nshort  lines\nshortline\nno spaces漢字\nno spaces漢🎉\nab cd ef gh ij kl mn\nab cd ef gh ij kl mn op"), (10, "q w e r t y u i\nq w e r t y u o\nq w e r t y u p p"),
]


def test_line_dedup(spark, no_docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in LINES], "doc_id long, text string, exact string, near int")
    out = linededup.dedup_lines(spark, df)
    assert no_python(out)
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows == brute_dedup(LINES, 8)
    assert rows[9] == rows[2] == "" and rows[7] is None  # "short lime" is a character from "short line"
    assert rows[11].split("\n") == ["1234567", "1234568", "12345678", "no spaces漢字", "ab cd ef gh ij kl mn", "ab cd ef gh ij kl mn op"]
    assert linededup.dedup_lines(spark, no_docs).count() == 0


def test_line_dedup_over_documents(spark, docs, monkeypatch):
    rows = sorted((r["doc_id"], r["text"]) for r in linededup.dedup_lines(spark, docs.where("doc_id IS NOT NULL AND doc_id <> 500").dropDuplicates(["doc_id"])).collect() if r["text"] is not None)
    unique = sorted({(i, t) for i, t, _, _ in corpus() if i is not None and i != 500}, key=lambda x: x[0])
    expected = brute_dedup(unique, 8)
    assert rows == sorted((k, v) for k, v in expected.items() if v is not None)
    monkeypatch.setattr(linededup, "BROADCAST_TEXTS", 0)
    both = linededup.dedup_lines(spark, docs.where("doc_id = 500 OR doc_id IS NULL")).collect()
    assert [r["text"] for r in both if r["doc_id"] == 500] == ["twice the same row in here"] * 2  # equal rows are treated alike


def test_line_dedup_of_long_lines(spark, monkeypatch):
    words = [f"w{k * 7919 % 1009}" for k in range(1000)]
    rows = [(k, " ".join(words[:at] + edit + words[at + 1 :])) for k, (at, edit) in enumerate([(0, ["w0"]), (255, ["x"]), (256, []), (512, ["y", "z"]), (999, ["x"]), (600, ["x"])])]
    rows += [(10, " ".join(words[:300] + ["x", "y"] + words[302:])), (11, "c" * 700), (12, "c" * 699 + "d")]
    monkeypatch.setattr(linededup, "BROADCAST_TEXTS", 0)
    out = linededup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_dedup(rows, 8)


def shuffled(spark, run):
    """Bytes that a run writes to shuffles."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        found = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = stages()
    run()
    return sum(v for k, v in stages().items() if k not in before)


def test_line_dedup_shuffles_few_rows_but_texts(spark, tmp_path):
    # as for tables too large for a broadcast; every 20th text repeats a line, and every 20th has one near it
    rng = random.Random(3)
    lines = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(20)) for _ in range(6000)]
    rows = [(k, "\n".join([*lines[6 * k : 6 * k + 6], *([lines[k + 6]] if k % 20 == 1 else []), *([lines[k + 6] + " end"] if k % 20 == 2 else [])])) for k in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    got = {}
    try:
        sent = shuffled(spark, lambda: got.update((r["doc_id"], r["text"]) for r in linededup.dedup_lines(spark, spark.read.parquet(str(tmp_path / "docs"))).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert got == {k: "\n".join(t.split("\n")[:6]) for k, t in rows}
    size = sum(len(t) for _, t in rows)
    assert sent < 3 * size, sent / size


def test_line_dedup_leaves_only_what_its_result_reads(spark):
    def tables():
        return {p.name for p in pathlib.Path(spark.conf.get("spark.checkpoint.dir")).iterdir()}

    before = tables()
    out = linededup.dedup_lines(spark, spark.createDataFrame(LINES, "doc_id long, text string"))
    assert [x.split("-")[1] for x in tables() - before] == ["dropped"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_dedup(LINES, 8)


@pytest.mark.parametrize("most", [1 << 28, 64])
def test_sifting_loses_no_partner(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SIEVE_MOST", most)
    rows = spark.range(20000).selectExpr("xxhash64(id) AS h", "id").unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS h, -1L AS id"))
    some = spark.range(0, 20000, 40).selectExpr("xxhash64(id) AS wanted")
    left = {r["id"] for r in common.sifted(rows, "h", some, "wanted").collect()}
    assert left >= set(range(0, 20000, 40)) and -1 not in left
    assert len(left) < 2000 or most == 64
    assert common.sifted(rows, "h", some.where("false"), "wanted").count() == 0
