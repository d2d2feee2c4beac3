"""The Merkle manifest and the quality classifier."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sablefish.llm import merkle, quality

from .conftest import corpus


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows, fan=2):
    """The contract on a list of (doc_id, source, lang, n_chars, text), node by node."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h("".join(last[k : k + fan])) for k in range(0, len(last), fan)])
        return levels

    def way(levels, at):
        out = []
        for nodes in levels[:-1]:
            first = at // fan * fan
            out.append((nodes[first:at], nodes[at + 1 : first + fan]))
            at //= fan
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for g in langs}
    trees = {g: tree([plain_leaf(r) for r in groups[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for at, r in enumerate(groups[g]):
            path = way(trees[g], at) + way(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = plain_leaf((*r[:3], r[3] + 1, r[4]) if hit and r[3] is not None else r)
            for left, right in path:
                node = h("".join(left) + node + "".join(right))
            root = top[-1][0]
            out.append((r[0], plain_leaf(r), trees[g][-1][0], root, h("".join(x for a, b in path for x in a + b)), node, node == root))
    return out


def same(df, rows, fan=2):
    assert Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()) == Counter(plain_manifest(rows, fan))


ROWS = [(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in corpus()]


@pytest.mark.parametrize("fan,height,bucket", [(2, None, 4096), (2, 2, 3), (3, 1, 5)])
def test_manifest_over_a_table(spark, docs, monkeypatch, fan, height, bucket):
    monkeypatch.setattr(merkle, "BUCKET", bucket)
    if bucket < 10:
        monkeypatch.setattr(merkle, "BROADCAST_BLOCKS", 0)
        monkeypatch.setattr(merkle, "BROADCAST_BUCKETS", 0)
    same(merkle.manifest(spark, docs, fan, height), ROWS, fan)


def test_manifest_of_far_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(3)
    ids = [rng.choice([0, 1, -1, -(1 << 63), (1 << 63) - 1, rng.getrandbits(62), 7, 7, None]) for _ in range(300)]
    rows = [(i, "s", rng.choice(["en", "éa", "Z", "", None]), rng.choice([5, None]), rng.choice(["a", "b"])) for i in ids]
    monkeypatch.setattr(merkle, "BUCKET", 8)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    same(merkle.manifest(spark, df, height=2), rows)


def test_manifest_of_nothing_and_one(spark, no_docs):
    assert merkle.manifest(spark, no_docs).count() == 0
    rows = [(3, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    same(merkle.manifest(spark, df), rows)
    only = merkle.manifest(spark, df).first()
    assert only["root"] == only["leaf"] and only["proof_sha256"] == h("")


def test_ranks(spark):
    rng = random.Random(5)
    keys = [(rng.choice("ab"), "".join(rng.choice("01ef") for _ in range(rng.randint(0, 9)))) for _ in range(2000)]
    keys = sorted(set(keys))
    df = spark.createDataFrame(keys, "grp string, key string").repartition(4)
    got = {(r["grp"], r["key"]): r["rank"] for r in merkle.ranked(spark, df, bucket=16).collect()}
    for g in "ab":
        assert [got[g, k] for k in sorted(k for x, k in keys if x == g)] == list(range(sum(x == g for x, _ in keys)))


TEXTS = ["", None, "one word", "a b a b\nc!!! d", "Ünïcode wörter 漢字 " * 30, "x" * 4000, " \n\t "]


def test_interactions_by_squares_are_those_of_all_pairs():
    rows = quality.features(pa.array(TEXTS), np.array([0, -1, 8, 14, 100, 4000, 4]))
    machine = quality.Machine()
    machine.w = np.random.default_rng(2).normal(size=quality.SIZE)
    for r in range(len(TEXTS)):
        at, x = rows.at[rows.start[r] : rows.start[r + 1]], rows.value[rows.start[r] : rows.start[r + 1]].astype(float)
        assert len(set(at.tolist())) == len(at)
        pairs = sum(float(machine.v[at[i]] @ machine.v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert machine.logits(rows)[r] == pytest.approx(machine.bias + machine.w[at] @ x + pairs, abs=1e-6)


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(1)
    start = np.array([0, 3, 5, 9])
    rows = quality.Rows(start, np.array([0, 2, 5, 1, 2, 0, 3, 4, 5], np.int32), rng.normal(size=9))
    labels, machine = np.array([1.0, 0.0, 1.0]), quality.Machine(6, 3)

    def loss():
        p = machine.scores(rows)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    b, w, v = machine.gradients(rows, labels)
    for at in range(6):
        for array, got in [(machine.w, w[rows.at == at].sum()), *[(machine.v[:, f], v[rows.at == at, f].sum()) for f in range(3)]]:
            array[at] += 1e-6
            up = loss()
            array[at] -= 2e-6
            assert (up - loss()) / 2e-6 == pytest.approx(got, abs=1e-5)
            array[at] += 1e-6


def marked(docs):
    """Labels for the fixture: long texts of ordinary words are good."""
    return docs.where("doc_id < 200").select("doc_id", (F.length("text") > 300).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))


def test_quality_over_a_table(spark, docs, no_docs):
    labels = marked(docs)
    out = quality.classify(spark, docs, labels).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in out) == Counter((i, zlib.crc32(str(i if i is not None else "").encode()) % 3 == 1) for i, *_ in ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[305] == by[306] and by[3] == by[200] == by[201]
    shuffled = quality.classify(spark, docs.drop("lang", "source", "score").repartition(7), labels.union(labels)).collect()
    assert Counter((r["doc_id"], r["score"]) for r in shuffled) == Counter((r["doc_id"], r["score"]) for r in out)  # repeated labels, other partitions
    # labels without an id or a value, and of ids that no document has, teach nothing
    odd = spark.createDataFrame([(None, 1, 0), (5, None, None), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    assert Counter((r["doc_id"], r["score"]) for r in quality.classify(spark, docs, labels.union(odd)).collect()) == Counter((r["doc_id"], r["score"]) for r in out)
    nothing = quality.classify(spark, docs, labels.limit(0)).select("score", "predicted").distinct().collect()
    assert [tuple(r) for r in nothing] == [(0.5, 1)]
    assert quality.classify(spark, no_docs, labels).count() == 0


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(["red", "blue", "green", "and", "stone", "river"]) for _ in range(rng.randint(20, 200))]
        good = i % 3 > 0
        # bad texts are good ones with marks behind each word, in upper case, or with one word again and again
        spoilt = [" ".join(w + "***" for w in text), " ".join(text).upper() + "!!", " ".join([text[0]] * 80)]
        rows.append((i, " ".join(text) if good else spoilt[i // 3 % 3]))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    out = quality.classify(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int")).where("held_out").collect()
    assert len(out) > 150
    assert np.mean([r["predicted"] == labels[r["doc_id"]][1] for r in out]) >= 0.97


def test_sample_is_bounded(spark, docs):
    rows, given = quality.sample(docs, marked(docs), most=10)
    assert len(rows) == len(given) <= 10
