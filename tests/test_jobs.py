"""The two jobs: over growing input, run again, and by their command lines."""

import json
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobs import common, findings, search_index
from sablefish.operators import search
from sablefish.streaming import batches

TEXTS = {1: "The licence of all rights", 2: "rights rights reserved", 3: "Straße é É_x a-b", 4: "", 5: None, 6: "word " * 3000}


def save(spark, folder, rows, schema="doc_id long, text string, lang string"):
    spark.createDataFrame([(*r, "en") for r in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))


def postings_of(texts):
    out = Counter()
    for i, t in texts.items():
        words = [w for w in search.re.split(r"[^\w-]+", search.fold_text(t or "")) if w]
        out.update({(i, w, n, len(words)): 1 for w, n in Counter(words).items()})
    return out


def stored(df):
    return Counter(tuple(r) for r in df.collect())


def test_index_takes_only_what_is_new(spark, tmp_path, caplog):
    table, out, check = tmp_path / "documents.parquet", str(tmp_path / "index"), str(tmp_path / "check")
    caplog.set_level("INFO", "jobs")
    save(spark, table, [*TEXTS.items(), (None, "no id"), (2, "a smaller text")])
    options = {"buckets": 3, "trigrams": True}
    assert search_index.run(spark, str(table), out, check, options) == 1
    texts = dict(TEXTS)
    assert stored(search_index.words(spark, out)) == postings_of(texts)
    assert "1 without an id" in caplog.text
    files = sorted(p for p in (tmp_path / "index").rglob("*.parquet"))
    # nothing new: nothing is written
    assert search_index.run(spark, str(table), out, check, options) == 0
    assert sorted(p for p in (tmp_path / "index").rglob("*.parquet")) == files
    # new files: new, changed and emptied texts; what was written before stays as it is
    times = {p: p.stat().st_mtime_ns for p in files}
    save(spark, table, [(7, "seven new words"), (1, "the first changed"), (2, None)])
    assert search_index.run(spark, str(table), out, check, options) == 1
    texts |= {7: "seven new words", 1: "the first changed", 2: ""}
    assert stored(search_index.words(spark, out)) == postings_of(texts)
    assert {p: p.stat().st_mtime_ns for p in files} == times
    grams = Counter((i, t.lower()[k : k + 3]) for i, t in texts.items() for k in {t.lower()[k : k + 3]: k for k in range(len(t or "") - 2)}.values() if t)
    assert stored(search_index.trigrams(spark, out)) == grams
    # the index alone answers, and the same from a compacted copy
    best = search_index.best(spark, out, ["first", "words"], 2).collect()
    assert [r["doc_id"] for r in best] == [1, 7] or [r["doc_id"] for r in best] == [7, 1]
    batches.compact(spark, out, str(tmp_path / "small"), {"words": "doc_id"}, "doc_id", {"words": ("bucket",)})
    assert stored(search_index.words(spark, str(tmp_path / "small"))) == postings_of(texts)


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one two"), (2, "two")], "doc_id long, text string")
    options = common.config("search_index")
    for part in (rows, rows):
        search_index.write_batch(part, str(tmp_path), 0, options)
    assert stored(search_index.words(spark, str(tmp_path))) == postings_of({1: "one two", 2: "two"})
    # words of a batch whose keys aren't written yet don't count
    extra = spark.createDataFrame([(1, "lost", 1, 1, 0)], "doc_id long, token string, tf long, n_tokens long, bucket int")
    extra.write.partitionBy("bucket").parquet(str(tmp_path / "words" / "batch=1"))
    assert stored(search_index.words(spark, str(tmp_path))) == postings_of({1: "one two", 2: "two"})


def test_repeated_ids_count_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "c"), (3, None), (3, None), (None, "x"), (None, "y")], "doc_id long, text string")
    for bound in (200_000, 0):
        monkeypatch.setattr(search_index, "BROADCAST_REPEATED", bound)
        assert stored(search_index.one_a_key(rows, "doc_id", "text")) == Counter([(1, "b"), (2, "c"), (3, None)])
    assert stored(search_index.one_a_key(rows.where("text = 'c'"), "doc_id", "text")) == Counter([(2, "c")])


def test_index_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    search_index.run(spark, str(tmp_path / "t"), str(tmp_path / "out"), str(tmp_path / "check"))
    search_index.run(spark, str(tmp_path / "t"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert search_index.words(spark, str(tmp_path / "out")).count() == 0


DOCS = [(1, "my password is\nhttp://bob:pw@host/x twice http://a:b@c/"), (2, None), (3, "   " + "f0" * 20 + " and secret secret"), (4, "x" * 5001), (5, "clean text\n\n"), (6, "a@b.example, c@d.example")]
PAGES = [(9, "<script>onclick=</script>\nLicense License")]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(PAGES, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return tmp_path


def test_findings(spark, folder, caplog):
    caplog.set_level("INFO", "jobs")
    settings = dict(spark.conf.getAll) if hasattr(spark.conf, "getAll") else None
    summary = findings.run(spark, str(folder), str(folder / "out"))
    rows = {(r["table_name"], r["rule_id"], r["key"], r["line"]): (r["severity"], r["n"], r["snippet"]) for r in findings.read(spark, str(folder / "out")).collect()}
    assert {k: v[1] for k, v in rows.items()} == {
        ("documents", "CRED-WORD", "1", 1): 1, ("documents", "CRED-URL", "1", 2): 2, ("documents", "CRED-HEX", "3", 1): 1, ("documents", "CRED-WORD", "3", 1): 2, ("documents", "LONG-LINE", "4", 1): 1,
        ("documents", "MAIL", "6", 1): 2, ("pages", "INLINE-CODE", "9", 1): 2, ("pages", "LICENCE", "9", 2): 2,
    }
    assert rows["documents", "CRED-URL", "1", 2] == ("critical", 2, "https://[REDACTED]@host/x twice https://[REDACTED]@c/")
    assert rows["documents", "CRED-HEX", "3", 1][2] == "[REDACTED] and secret secret" and len(rows["documents", "LONG-LINE", "4", 1][2]) == 120
    assert {(r["table_name"], r["rule_id"], r["lines"], r["texts"], r["n"]) for r in summary.collect()} >= {("documents", "CRED-WORD", 2, 2, 3), ("pages", "LICENCE", 1, 1, 2)}
    assert (folder / "out" / "findings" / "table_name=documents" / "rule_id=MAIL").is_dir() and "read 6 rows" in caplog.text
    # again: the same; with fewer rules, what is no longer found goes
    findings.run(spark, str(folder), str(folder / "out"))
    assert {(r["table_name"], r["rule_id"], r["key"], r["line"]): (r["severity"], r["n"], r["snippet"]) for r in findings.read(spark, str(folder / "out")).collect()} == rows
    findings.run(spark, str(folder), str(folder / "out"), {"rules": [{"id": "ONLY", "severity": "info", "literals": ["clean", ""]}]})
    assert [tuple(r) for r in findings.read(spark, str(folder / "out")).select("rule_id", "key", "line", "n").collect()] == [("ONLY", "5", 1, 1)]
    if settings is not None:
        assert dict(spark.conf.getAll) == settings


def test_command_lines(spark, folder, monkeypatch, capsys):
    class Kept:
        """The test's session, which a command line mustn't stop here."""

        def __getattr__(self, name):
            return getattr(spark, name)

        def stop(self):
            stopped.append(1)

    stopped: list[int] = []
    monkeypatch.setattr(common, "session", lambda name: Kept())
    args = ["--input", str(folder), "--output", str(folder / "out")]
    assert findings.main([*args, "--fail-on", "error"]) == 1
    (folder / "rules.json").write_text(json.dumps({"rules": [{"id": "A", "severity": "info", "pattern": "clean"}]}))
    assert findings.main([*args, "--config", str(folder / "rules.json"), "--fail-on", "error"]) == 0
    search_index.main(["--input", str(folder / "documents.parquet"), "--output", str(folder / "index"), "--checkpoint", str(folder / "check"), "--search", "password"])
    assert "doc_id" in capsys.readouterr().out and len(stopped) == 3


def test_postings_rank_like_plain_bm25(spark):
    import math
    import random

    from sablefish.operators import postings

    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["aa", "bb", "cc", "dd"] + ["w%d" % k for k in range(40)]) for _ in range(rng.randint(1, 60))) for i in range(400)}
    texts |= {1000 + i: texts[i] for i in range(30)} | {2000: "", 2001: "aa " * 500}
    df = spark.createDataFrame(list(texts.items()), "i long, t string").repartition(4)
    words = {i: t.split() for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    terms = ["AA", "cc", "w7", "absent"]
    scores = {}
    for term in sorted(x.lower() for x in terms):
        df_term = sum(term in w for w in words.values())
        idf = math.log(1 + (len(words) - df_term + 0.5) / (df_term + 0.5))
        for i, w in words.items():
            if tf := w.count(term):
                scores[i] = scores.get(i, 0.0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    for k, size in ((1, 4), (10, 4), (60, 64), (1000, 64), (10, 5000)):
        got = postings.bm25(postings.word_postings(df, "i", "t"), postings.lengths(df, "i", "t"), "i", terms, k, size).collect()
        wanted = sorted(((-round(s, 6), i) for i, s in scores.items()))[:k]
        assert [(r["i"], r["score"]) for r in got] == [(i, -s) for s, i in wanted]
    assert postings.bm25(postings.word_postings(df, "i", "t"), postings.lengths(df, "i", "t"), "i", ["absent"], 5).count() == 0


def test_substring_search_is_a_full_scan(spark, monkeypatch):
    from sablefish.operators import postings

    texts = ["The quick brown fox", "QUICK brown", None, "", "ab", "aaaa", "漢字の本 é", "quick  brown", "x" * 300 + "needle" + "y" * 300]
    needles = ["quick brown", "K B", "aa", "aaa", "a", "字の本", "needley", "absent text", None, "xyz", "ick", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(needles)), "k int, n string").repartition(2)
    wanted = {(k, i) for k, n in enumerate(needles) for i, t in enumerate(texts) if n is not None and t is not None and n.lower() in t.lower()}
    for bound in (200_000, 0):
        monkeypatch.setattr(postings, "BROADCAST_PAIRS", bound)
        found = postings.substring_search(spark, postings.trigram_postings(docs, "i", "t"), docs, "i", "t", asked, "k", "n")
        assert {tuple(r) for r in found.select("k", "i").collect()} == wanted and found.count() == len(wanted)


def test_trigrams_by_blocks(spark):
    from sablefish.operators import postings

    texts = ["Ab", "", None, "ABCabc", "𝔘𝔘𝔘x", "ÀÉÎ àéî", "x" * 50, "İI", "abcabc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    grams = lambda t: {t[k : k + 3] for k in range(len(t) - 2)}
    low = [r.l or "" for r in docs.selectExpr("lower(t) AS l").collect()]
    expected = sorted((i, g) for i, t in enumerate(low) for g in grams(t))
    assert sorted((r.i, r.gram) for r in postings.trigram_postings(docs, "i", "t").collect()) == expected
    few = postings.grams_of(spark.createDataFrame([("xABCa",), (None,)], "n string"), "n")
    assert sorted(few) == ["abc", "bca", "xab"]
    assert sorted((r.i, r.gram) for r in postings.trigram_postings(docs, "i", "t", few).collect()) == [x for x in expected if x[1] in few]
    counts = {g: sum(g in grams(t) for t in low) for _, g in expected}
    assert {r.gram: r.n for r in postings.trigram_counts(docs, "t").collect()} == counts
    assert [t for _, block in postings._blocks(iter([pa.record_batch({"i": list(range(9)), "t": texts})])) for t in block] == [t or "" for t in texts]
    # a block's counts are all that is shuffled
    assert "Generate" not in postings.trigram_counts(docs, "t")._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_batch_has_more_files(spark):
    rows = spark.range(2000).selectExpr("id AS doc_id", "concat('t', id % 7) AS token")
    options = {"buckets": 16, "files_per_bucket": 1}
    for size, files in ((0, 1), (search_index.BYTES_PER_FILE * 16 * 3, 3)):
        dealt = search_index._spread(rows, "doc_id", "token", options, size).select("bucket", F.spark_partition_id().alias("p"))
        assert dealt.rdd.getNumPartitions() == 16 * files and dealt.where(f"p div {files} <> bucket").isEmpty()
        # one bucket a task at most
        assert dealt.distinct().groupBy("p").count().where("count > 1").isEmpty() and dealt.select("p").distinct().count() > 16 * (files - 1)
