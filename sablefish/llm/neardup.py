"""Operator 10, near duplicates: MinHash bands, sequential Bayesian verification, exact check, components.

Texts become sets of distinct 5-word shingles (64-bit hashes). Equal sets are one node. A node has
``HASHES`` MinHash values; ``BANDS`` bands of ``ROWS`` values each put it into as many buckets. A
pair with similarity 0.75 shares no bucket with probability (1 - 0.75^ROWS)^BANDS, below 1e-5.

Candidates are compared on their signatures in growing batches of values. After each batch
the posterior probability (uniform prior) that the similarity reaches the threshold, given the
matches so far, is bounded below by ``MISS``, or the pair is dropped. Survivors are
verified exactly on their full sets, 100 * intersection >= 75 * union.

Only components matter, so no bucket emits all its pairs:

1. Star: each node of a bucket is a candidate with the bucket's smallest node; of a node's
   surviving candidates the two most similar are verified, and components formed. Then the
   others whose ends still lie in different components are verified too.
2. Blocks: the nodes of a bucket that still lies in several components are compared as
   arrays. A bucket of few nodes is one block. Larger buckets are merged by their largest
   component, and their nodes dealt out to blocks of bounded size; each block of nodes outside the
   largest component meets each block of all nodes. A group of more than ``WIDE`` nodes is split first, without loss: two sets of similarity 0.75 or more share one of the first quarter (and one)
   of each set's shingles in any order, and with the group's frequent ones last in this order (found on a sample of its nodes, which costs or saves time but no link) most
   nodes of a class of texts with a common frame share no such key with another; where the parts' pairs aren't fewer than half of the group's, it stays whole. The comparison is done twice: first with the signatures alone (``HASHES`` bytes a node), which are compared in
   batches and give the nodes that have a survivor in another component; then for these nodes with their full sets, which confirm survivors, most similar first,
   skipping pairs that the block has joined already. So every pair that shares a bucket is in one
   component, or was dropped by the bound, or has been tested on its full sets. (Buckets of two nodes were settled by the star.)

Components are found by passing on the smallest label to neighbours with pointer jumping, over tables.

Defined results: texts without words (null, empty, blank) have no shingles and are linked with
nothing; with fewer than five words, all words are one shingle. Rows equal in id are
one document (of different texts, that with the least hashes of its set speaks for it). Rows with a null id are linked with nothing, their component is null and they are kept. An
empty table gives an empty result. Texts are read whole, one row at a time, in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, blocks, sole, staged
from .tokens import MIX, hashes, mix64, split_words

SHINGLE, PERCENT = 5, 75
HASHES, BANDS, ROWS = 256, 32, 4
BATCHES = (32, 64, 128, 256)
MISS = 2e-4
#: Nodes of a block, and the shingles they may have together.
BLOCK, BLOCK_SHINGLES, STARS = 256, 256_000, 2
#: Nodes of a group that is split by rare shingles, nodes that tell the frequent shingles of one, how many of these are put last.
WIDE, TOLD_BY, FREQUENT = 1024, 512, 4096
#: Groups up to this number get their frequent shingles by broadcast (32 KB each), more by a shuffle.
BROADCAST_GROUPS = 500
#: Ids up to this number select texts by broadcast, more by a shuffled join.
BROADCAST_IDS = 200_000
SEED = 11

def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and the texts' offsets."""
    coded, offsets = split_words(texts)
    distinct = hashes(coded.dictionary)
    word = distinct[np.asarray(coded.indices)] if len(distinct) else np.empty(0, np.uint64)
    n = np.diff(offsets)
    rolling = np.zeros(len(word), np.uint64)
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    left = np.repeat(n, n) - (np.arange(len(word)) - np.repeat(offsets[:-1], n))  # words from here to the end of the text
    for j in range(k):
        part = padded[j : j + len(word)]
        rolling = mix64(rolling * MIX + np.where(left > j, part, 0).astype(np.uint64) + np.uint64(j + 1))
    keep = (left >= k) | ((np.repeat(n, n) < k) & (left == np.repeat(n, n)))
    owner = np.repeat(np.arange(len(n)), n)[keep]
    values = rolling[keep]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).tolist()
    for start, stop in zip(bounds, bounds[1:], strict=False):
        values[start:stop].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[fresh], values[fresh]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int64)


def coefficients(hashes: int = HASHES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, hashes, dtype=np.uint64)


def signatures(values: np.ndarray, offsets: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """(sets, hashes) MinHash values of 32 bits; for non-empty sets only."""
    a, b = coefficients(hashes)
    out = np.empty((len(offsets) - 1, hashes), np.uint32)
    starts = offsets[:-1]
    mixed = np.empty_like(values)
    for k in range(hashes):
        np.multiply(values, a[k], out=mixed)
        np.add(mixed, b[k], out=mixed)
        # the high halves are the values: the least number has the least one
        out[:, k] = np.minimum.reduceat(mixed, starts) >> np.uint64(32)
    return out


def least_matches(batches: tuple[int, ...] = BATCHES, percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each batch end, the fewest matching values with which a pair goes on.

    With m of n equal and a uniform prior, P(p >= t) is the chance of at most m successes in n + 1 trials of
    chance t. Eight bits of each value are kept, so unequal values match with chance 1/256.
    """
    t = percent / 100
    t += (1 - t) / 256
    out = []
    for n in batches:
        total, least = 0.0, n + 1
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                least = m
                break
        out.append(least)
    return out


def survivors(a: np.ndarray, b: np.ndarray, batches: tuple[int, ...] = BATCHES) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature arrays (pairs, hashes) that no batch drops, and their matches."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    start = 0
    for n, least in zip(batches, least_matches(batches), strict=True):
        matches = matches + (a[alive, start:n] == b[alive, start:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, start = alive[keep], matches[keep], n
    return alive, matches


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test on two sets (sorted arrays)."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def read_bytes(column: pa.Array, width: int) -> np.ndarray:
    """A column of binaries of equal width as a byte matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


# Steps over tables


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, two hashes of the set, band keys and the signature's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("neardup", dict)
        for batch in batches:
            for part in blocks(batch, "text", 2 << 20):
                values, offsets = shingle_sets(part.column("text"))
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                sums = np.zeros((2, len(n)), np.uint64)
                bands = np.zeros((len(n), BANDS), np.int64)
                low = np.zeros((len(n), HASHES), np.uint8)
                if len(full):
                    starts = offsets[:-1][full]
                    sums[0, full] = np.add.reduceat(mix64(values), starts)
                    sums[1, full] = np.bitwise_xor.reduceat(mix64(values + MIX), starts)
                    sig = signatures(values, np.concatenate([starts, [offsets[-1]]]))
                    low[full] = sig.astype(np.uint8)
                    for k in range(BANDS):
                        key = np.full(len(full), k + 1, np.uint64)
                        for j in range(k * ROWS, (k + 1) * ROWS):
                            key = mix64(key * MIX + sig[:, j])
                        bands[full, k] = key.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists, pa.array([r.tobytes() for r in low], pa.binary())],
                    names=["doc_id", "mark", "n_shingles", "f1", "f2", "bands", "sig"],
                )

    return keyed(docs).transform(arrow_map, run, "doc_id long, mark long, n_shingles long, f1 long, f2 long, bands array<long>, sig binary")


def texts_of(docs: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and text of the documents in ``ids``."""
    chosen = nodes.select(F.col("node").alias("id"), F.col("mark").alias("own")).join(ids, "id")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    met = keyed(docs).join(F.broadcast(chosen) if few else chosen, (F.col("doc_id") == F.col("id")) & (F.col("mark") == F.col("own")))
    return met.select("id", "text").dropDuplicates(["id"])


def with_signatures(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    sig_a = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    sig_b = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(sig_a, "a").join(sig_b, "b")


def prune(pairs: DataFrame) -> DataFrame:
    """a, b and matches of the pairs (a, b, sig_a, sig_b) that the posterior bound doesn't drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive, matches = survivors(read_bytes(batch.column("sig_a"), HASHES), read_bytes(batch.column("sig_b"), HASHES))
            rows = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows), pa.array(matches, pa.int64())], names=["a", "b", "matches"])

    return pairs.select("a", "b", "sig_a", "sig_b").transform(arrow_map, run, "a long, b long, matches long")


def verify(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    ids = staged(spark, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
    texts = staged(spark, texts_of(docs, ids, nodes), f"{name}-texts")
    met = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text_a", 4 << 20):
                va, oa = shingle_sets(part.column("text_a"))
                vb, ob = shingle_sets(part.column("text_b"))
                good = pa.array([similar(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]) for i in range(part.num_rows)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], names=["a", "b"])

    return staged(spark, met.select("a", "b", "text_a", "text_b").transform(arrow_map, run, "a long, b long"), f"{name}-links")


def components(spark: SparkSession, links: DataFrame, name: str) -> DataFrame:
    """node and comp (the smallest node it is linked with, over any number of links) of all linked nodes."""
    both = staged(spark, links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = staged(spark, both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("comp")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        hop = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "other").alias("to"), F.col("comp").alias("was"))
        hop = staged(spark, hop, f"{name}-hop")
        jump = hop.select(F.col("node").alias("to"), F.col("to").alias("further"))
        moved = staged(spark, hop.join(jump, "to", "left").select("node", F.least("to", "further").alias("comp"), "was"), f"{name}-labels")
        labels = moved.select("node", "comp")
        if not moved.where("comp <> was").limit(1).count():
            return labels


def open_groups(spark: SparkSession, members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """grp, node, comp, n_shingles, outer (not in the group's largest component): what is to be compared.

    Buckets of two nodes were settled by the star: their pair was dropped by the bound, verified, or lies in one component.
    """
    known = members.where("n > 2").join(labels.select("node", "comp"), "node", "left").select("bucket", "node", "n", F.coalesce("comp", "node").alias("comp"))
    known = staged(spark, known, "known-members")
    sizes = known.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("size", (-F.col("comp")).alias("less"))).alias("top"), F.max("n").alias("n"))
    main = staged(spark, main.where(F.col("top.size") < F.col("n")).select("bucket", (-F.col("top.less")).alias("main")), "open")
    opened = staged(spark, known.join(main, "bucket").join(nodes.select("node", "n_shingles"), "node"), "opened")
    weight = opened.groupBy("bucket").agg(F.sum("n_shingles").alias("w"))
    large = (F.col("n") > BLOCK) | (F.col("w") > BLOCK_SHINGLES)
    # the kind keeps a bucket's key and a component apart
    group = F.when(large, F.struct(F.lit(1).alias("kind"), F.col("main").alias("id"))).otherwise(F.struct(F.lit(0).alias("kind"), F.col("bucket").alias("id")))
    rows = opened.join(staged(spark, weight, "weights"), "bucket").select(group.alias("grp"), "node", "comp", "n_shingles", (F.col("comp") != F.col("main")).alias("outer")).distinct()
    return staged(spark, rows, "grouped")


def full_sets(docs: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its set as sorted distinct hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 2 << 20):
                values, offsets = shingle_sets(part.column("text"))
                sets = [values[offsets[i] : offsets[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return texts_of(docs, ids, nodes).transform(arrow_map, run, "node long, hashes binary")


def narrowed(spark: SparkSession, docs: DataFrame, grouped: DataFrame, nodes: DataFrame) -> DataFrame:
    """``grouped`` with its wide groups split into the nodes that share a rare shingle, where this leaves fewer pairs."""
    sizes = staged(spark, grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > WIDE), "wide")
    count = sizes.limit(BROADCAST_GROUPS + 1).count()
    if not count:
        return grouped
    spread = lambda df: F.broadcast(df) if count <= BROADCAST_GROUPS else df
    wide = grouped.join(spread(sizes), "grp")
    sets = full_sets(docs, staged(spark, wide.select(F.col("node").alias("id")).distinct(), "wide-ids"), nodes)
    members = staged(spark, wide.join(staged(spark, sets, "wide-sets"), "node").select("grp", "node", "comp", "outer", "n_shingles", "size", "hashes"), "wide-members")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b, np.int64) for b in batch.column("hashes").to_pylist()]
            row = np.repeat(np.arange(len(found)), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([batch.column("grp").take(pa.array(row)), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], names=["grp", "shingle"])

    kind = grouped.schema["grp"].dataType.simpleString()
    told = members.where(F.pmod(F.xxhash64(F.lit("told"), "node"), F.lit(1 << 20)) < F.lit((1 << 20) * TOLD_BY) / F.col("size"))
    told = told.select("grp", "hashes").transform(arrow_map, single, f"grp {kind}, shingle long").groupBy("grp", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "shingle"))  # over the shingles of TOLD_BY sets
    frequent = told.withColumn("place", place).where(F.col("place") <= FREQUENT).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("place", "shingle"))).alias("f"))
    frequent = staged(spark, frequent.select("grp", F.col("f.shingle").alias("frequent")), "frequent")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lasts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            ids, own, found = batch.column("grp").field("id").to_pylist(), batch.column("frequent"), []
            for k, b in enumerate(batch.column("hashes").to_pylist()):
                h = np.frombuffer(b, np.int64)
                if ids[k] not in lasts:
                    f = np.asarray(own[k].values if own[k].is_valid else [], dtype=np.int64)
                    order = np.argsort(f)
                    lasts[ids[k]] = f[order], -order  # the most frequent is the very last
                f, rank = lasts[ids[k]]
                at = np.minimum(np.searchsorted(f, h), max(len(f) - 1, 0))
                late = np.where(f[at] == h, rank[at], -len(f) - 1) if len(f) else np.zeros(len(h))
                found.append(h[np.lexsort((h, late))[: len(h) - -(-PERCENT * len(h) // 100) + 1]])
            row = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
            kept = [batch.column(c).take(row) for c in ("grp", "node", "comp", "outer", "n_shingles")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], names=["grp", "node", "comp", "outer", "n_shingles", "shingle"])

    met = members.join(spread(frequent), "grp", "left").select("grp", "node", "comp", "outer", "n_shingles", "hashes", "frequent")
    parts = staged(spark, met.transform(arrow_map, keys, f"grp {kind}, node long, comp long, outer boolean, n_shingles long, shingle long"), "parts")
    shared = parts.groupBy("grp", "shingle").agg(F.count(F.lit(1)).alias("m"), F.max("outer").alias("open"), (F.min("comp") < F.max("comp")).alias("several")).where("m > 1 AND open AND several")
    shared = staged(spark, shared.select("grp", "shingle", "m"), "shared")
    cost = shared.groupBy("grp").agg(F.sum(F.pow(F.col("m").cast("double"), F.lit(2))).alias("cost"))
    split = sizes.join(cost, "grp", "left").where(F.coalesce("cost", F.lit(0.0)) * 2 < F.pow(F.col("size").cast("double"), F.lit(2))).select("grp")
    split = staged(spark, split, "split")
    new = F.struct(F.lit(2).alias("kind"), F.xxhash64(F.col("grp.id"), "shingle").alias("id"))
    finer = parts.join(shared.drop("m"), ["grp", "shingle"]).join(spread(split), "grp", "left_semi").select(new.alias("grp"), "node", "comp", "n_shingles", "outer").distinct()
    return staged(spark, grouped.join(spread(split), "grp", "left_anti").select("grp", "node", "comp", "n_shingles", "outer").unionByName(finer), "narrowed")


def dealt(spark: SparkSession, grouped: DataFrame, full: DataFrame, columns: list[str], weighed: bool, name: str) -> DataFrame:
    """m and o: the blocks of all nodes and of outer nodes that meet, with these columns of ``full``."""
    weight = F.col("n_shingles") if weighed else F.lit(0)
    blocks_of = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES, F.lit(1))).cast("int")
    out = F.col("outer")
    counts = grouped.groupBy("grp").agg(
        blocks_of(F.count(F.lit(1)), F.sum(weight)).alias("n_in"), blocks_of(F.count_if(out), F.coalesce(F.sum(F.when(out, weight)), F.lit(0))).alias("n_out")
    )
    rows = grouped.join(staged(spark, counts, f"{name}-blocks"), "grp").join(full, "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = F.struct("node", "comp", *columns)
    none = F.when(F.lit(False), side)
    inner = rows.select("grp", deal("n_in").alias("j"), every("n_out").alias("i"), side.alias("m"), none.alias("o"))
    outer = rows.where("outer").select("grp", every("n_in").alias("j"), deal("n_out").alias("i"), none.alias("m"), side.alias("o"))
    met = inner.unionByName(outer).groupBy("grp", "i", "j").agg(F.collect_list("m").alias("m"), F.collect_list("o").alias("o")).where("size(m) > 0 AND size(o) > 0")
    return met.select("grp", "m", "o")


def _surviving(m: pa.Array, o: pa.Array) -> tuple[np.ndarray, ...]:
    """Nodes and components of two blocks, and (matches, place in o, place in m) of their surviving pairs of different components."""
    (node_m, comp_m), (node_o, comp_o) = ((np.asarray(x.field("node")), np.asarray(x.field("comp"))) for x in (m, o))
    sig_m, sig_o = (read_bytes(x.field("sig"), HASHES) for x in (m, o))
    pairs = [np.zeros((3, 0), np.int64)]
    for x in range(len(node_o)):
        other = np.flatnonzero(comp_m != comp_o[x])
        if len(other):
            alive, matches = survivors(np.broadcast_to(sig_o[x], (len(other), HASHES)), sig_m[other])
            pairs.append(np.stack([matches, np.full(len(alive), x), other[alive]]))
    return node_m, comp_m, node_o, comp_o, np.concatenate(pairs, axis=1)


def block_survivors(spark: SparkSession, grouped: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``grouped`` whose node has a survivor of another component, by signatures alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, ms, os_ = (batch.column(k) for k in ("grp", "m", "o"))
            for row in range(batch.num_rows):
                node_m, _, node_o, _, pairs = _surviving(ms[row].values, os_[row].values)
                found = np.union1d(node_o[pairs[1]], node_m[pairs[2]])
                if len(found):
                    yield pa.RecordBatch.from_arrays([grp.take(pa.array([row] * len(found))), pa.array(found, pa.int64())], names=["grp", "node"])

    met = dealt(spark, grouped, nodes.select("node", "sig"), ["sig"], False, "signed")
    alive = met.transform(arrow_map, run, f"grp {grouped.schema['grp'].dataType.simpleString()}, node long").distinct()
    return staged(spark, grouped.join(staged(spark, alive, "alive"), ["grp", "node"]), "surviving")


def block_links(spark: SparkSession, grouped: DataFrame, full: DataFrame) -> DataFrame:
    """Links between different components, as many as join what can be joined; tested on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms, os_ = batch.column("m"), batch.column("o")
            for row in range(batch.num_rows):
                m, o = ms[row].values, os_[row].values
                node_m, comp_m, node_o, comp_o, pairs = _surviving(m, o)
                set_m, set_o = ([np.frombuffer(b, np.uint64) for b in x.field("hashes").to_pylist()] for x in (m, o))
                pairs = pairs[:, np.argsort(-pairs[0], kind="stable")]
                root: dict[int, int] = {}

                def find(c: int, root: dict[int, int] = root) -> int:
                    while (up := root.get(c, c)) != c:
                        root[c] = root.get(up, up)
                        c = up
                    return c

                found_a, found_b = [], []
                for _, x, y in pairs.T.tolist():
                    cx, cy = find(int(comp_o[x])), find(int(comp_m[y]))
                    if cx != cy and similar(set_o[x], set_m[y]):
                        root[max(cx, cy)] = min(cx, cy)
                        a, b = int(node_o[x]), int(node_m[y])
                        found_a.append(min(a, b))
                        found_b.append(max(a, b))
                if found_a:
                    yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    met = dealt(spark, grouped, full, ["sig", "hashes"], True, "full")
    return staged(spark, met.select("m", "o").transform(arrow_map, run, "a long, b long").distinct(), "block-links")


def link(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketched rows with their node, and the components of linked nodes."""
    rows = staged(spark, sketched(docs), "sketched")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = staged(spark, full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "sets")
    nodes = full.join(sets.select("f1", "f2", "n_shingles", F.col("node").alias("doc_id")), ["f1", "f2", "n_shingles", "doc_id"], "left_semi")
    # of different texts with one id, the one with the least hashes
    several = nodes.groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("least"), F.max(F.struct("f1", "f2")).alias("most")).where("least <> most").select("doc_id", "least")
    nodes = nodes.join(staged(spark, several, "several"), "doc_id", "left").where("least IS NULL OR struct(f1, f2) = least")
    nodes = staged(spark, nodes.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "mark", "n_shingles", "bands", "sig"), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = staged(spark, banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = staged(spark, banded.join(buckets, "bucket"), "members")

    stars = staged(spark, members.where("node <> pivot").select(F.col("node").alias("b"), F.col("pivot").alias("a")).distinct(), "stars")
    alive = prune(with_signatures(stars, nodes))
    ranked = alive.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("matches"), "a")))  # at most BANDS rows a node
    ranked = staged(spark, ranked.select("a", "b", "rank"), "ranked")
    links = verify(spark, docs, nodes, staged(spark, ranked.where(F.col("rank") <= STARS).select("a", "b"), "best"), "star")
    labels = components(spark, links, "star")
    rest = ranked.where(F.col("rank") > STARS).select("a", "b")
    for end in ("a", "b"):
        rest = rest.join(labels.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}")), end, "left")
    rest = staged(spark, rest.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b"), "rest")
    if rest.limit(1).count():
        links = links.unionByName(verify(spark, docs, nodes, rest, "rest"))
        labels = components(spark, links, "rest")
    grouped = block_survivors(spark, narrowed(spark, docs, open_groups(spark, members, labels, nodes), nodes), nodes)
    if grouped.limit(1).count():
        sets_of = full_sets(docs, staged(spark, grouped.select(F.col("node").alias("id")).distinct(), "open-ids"), nodes)
        found = block_links(spark, grouped, staged(spark, sets_of.join(nodes.select("node", "sig"), "node"), "open-sets"))
        if found.limit(1).count():
            labels = components(spark, links.unionByName(found), "all")
    own = rows.select("doc_id", "n_shingles", "f1", "f2").join(sets.where("n > 1").select("f1", "f2", F.col("n_shingles").alias("size"), "node"), ["f1", "f2"], "left")
    own = own.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & (F.col("size") == F.col("n_shingles")), F.col("node")).otherwise(F.col("doc_id")).alias("node"))
    return staged(spark, own, "own"), labels


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    own, labels = link(spark, docs)
    out = own.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
