"""Operator 11, a Merkle manifest of a dataset: a tree of digests over each language, and one over their roots.

A leaf is the digest of a row's fields, each with its length in bytes. A language's leaves stand in the order of their ids;
``fan`` consecutive nodes make one of the next level until one remains, the subroot. Subroots, by language, make the root in the same way.
A proof is all that is needed to fold a leaf to the root; tampered leaves fold to something else.

No global sort. ``ranked`` numbers rows within groups by a radix method: a histogram counts the rows of each beginning of the
key (the digits of the id, then the leaf, then the place of the row in its file, so that keys differ), sums of earlier siblings are taken digit by digit, among
the beginnings that share their parent, and add up to each beginning's first rank. Beginnings with more than ``BUCKET`` rows are
counted again with more digits, so no task numbers more than ``BUCKET`` rows, whatever language or id is frequent.

A rank's digits to the base ``fan`` are the key of a leaf in a trie: the node above it has the key without the last digit. All leaves whose keys agree
but for the last ``HEIGHT`` digits make a block, a row with at most ``fan ** HEIGHT`` digests, which a task reduces to a node; these make blocks again,
until one node is left. Then the way leads down: each block gets the path of its own node to the root and gives
its items theirs, and at the bottom every leaf folds its path. Paths reach the blocks by broadcast up to ``BROADCAST_BLOCKS`` of them, else by a shuffle.

Defined results: null ids come first and are never tampered with; rows equal in id are ordered by their leaves; rows equal in all fields get
a leaf each; a null language is a group of its own, the first; null fields enter as ``-``; a table of one row has it as
root, with the digest of nothing as proof; an empty table gives an empty result. Other columns aren't read. Texts of any length are hashed as they are.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, staged

FAN, HEIGHT = 2, 10
BUCKET, DIGITS = 4096, 2
BROADCAST_BLOCKS, BROADCAST_BUCKETS = 5_000, 50_000
TAMPER = 7

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """The digest of fields, each as ``-`` or its length in bytes, a colon and itself."""
    parts = []
    for f in fields:
        v = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """grp (orders languages, null first), doc_id, leaf, and tampered: the leaf after tampering, null where there is none."""
    f = {c: F.col(c) for c in FIELDS}
    hit = (F.crc32(f["doc_id"].cast("string").cast("binary")) % TAMPER == 0) & f["n_chars"].isNotNull()
    changed = leaf_of([f[c] + 1 if c == "n_chars" else f[c] for c in FIELDS])
    grp = F.coalesce(F.concat(F.lit("="), f["lang"].cast("string")), F.lit(""))
    return docs.select(grp.alias("grp"), f["doc_id"].cast("long").alias("doc_id"), leaf_of(list(f.values())).alias("leaf"), F.when(hit, changed).alias("tampered"))


def id_key(doc_id: Column, *rest: Column) -> Column:
    """A key whose bytes order signed ids, null first, and then ``rest``."""
    flipped = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), flipped), F.lit("0")), *rest)


def _start_ranks(hist: DataFrame, above: int, depth: int) -> DataFrame:
    """``hist`` (grp, prefix, n and base, the first rank of its beginning of ``above`` characters) with ``start``, its own first rank.

    Level by level of ``DIGITS`` characters; a window holds the children of one parent.
    """
    cuts = [*range(above, depth, DIGITS), depth]
    known = hist.groupBy("grp", F.expr(f"left(prefix, {above})").alias("up")).agg(F.min("base").alias("start"))
    for parent, child in zip(cuts, cuts[1:], strict=False):
        sums = hist.groupBy("grp", F.expr(f"left(prefix, {parent})").alias("up"), F.expr(f"left(prefix, {child})").alias("cut")).agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("grp", "up").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1))
        level = sums.withColumn("before", F.coalesce(before, F.lit(0)))
        known = level.join(known, ["grp", "up"]).select("grp", F.col("cut").alias("up"), (F.col("start") + F.col("before")).alias("start"))
    return hist.drop("base").join(known.withColumnRenamed("up", "prefix"), ["grp", "prefix"])


def ranked(spark: SparkSession, rows: DataFrame, bucket: int | None = None) -> DataFrame:
    """``rows`` (grp, key and others) with ``rank``, the place of its key within its group, from 0."""
    bucket = bucket or BUCKET
    span = rows.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n"), F.max(F.length("key")).alias("longest")).first()
    if not span["n"]:
        return rows.withColumn("rank", F.lit(0).cast("long"))
    above = len(os.path.commonprefix([span["low"], span["high"]]))
    depth = above + max(1, math.ceil(math.log(max(span["n"] / bucket, 1), 16)))
    level, done = rows.withColumn("base", F.lit(0).cast("long")), []
    while True:
        level = level.withColumn("prefix", F.expr(f"left(key, {depth})"))
        counted = staged(spark, level.groupBy("grp", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("base").alias("base")), "digits")
        hist = staged(spark, _start_ranks(counted, above, depth), "starts")
        large = hist.where(F.col("n") > bucket).select("grp", "prefix", F.col("start").alias("base"))
        number = large.count() if depth < span["longest"] else 0
        own = level.drop("base")
        if number:
            large = F.broadcast(large) if number <= BROADCAST_BUCKETS else large
            own = own.join(large.drop("base"), ["grp", "prefix"], "left_anti")
        done.append(own.join(hist.select("grp", "prefix", "start"), ["grp", "prefix"]))
        if not number:
            break
        level = level.drop("base").join(large, ["grp", "prefix"])
        above, depth = depth, depth + DIGITS
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    place = F.row_number().over(Window.partitionBy("grp", "prefix").orderBy("key"))
    return out.withColumn("rank", F.col("start") + place - 1).drop("prefix", "start")


def climb(digests: list[str], fan: int, height: int | None) -> list[list[str]]:
    """The levels above a run of nodes, these first: ``height`` of them, or (None) until one node is left."""
    out = [digests]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        last = out[-1]
        out.append([digest("".join(last[k : k + fan])) for k in range(0, len(last), fan)])
    return out


def way_up(levels: list[list[str]], place: int, fan: int) -> list[tuple[str, str]]:
    """The siblings left and right of a node, level by level."""
    out = []
    for nodes in levels[:-1]:
        first = place - place % fan
        out.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + fan])))
        place //= fan
    return out


def _blocks(spark: SparkSession, nodes: DataFrame, fan: int, height: int, *more: str) -> DataFrame:
    """A row for every block of nodes: grp, block, alone (its group has no other) and an array of each column, by rank."""
    block = F.floor(F.col("rank") / fan**height).cast("long").alias("block")
    items = F.array_sort(F.collect_list(F.struct("rank", "digest", *more))).alias("items")
    flat = nodes.groupBy("grp", block).agg(items).select("grp", "block", *[F.col(f"items.{c}").alias(c) for c in ("digest", *more)])
    flat = staged(spark, flat, "blocks")
    last = flat.groupBy("grp").agg(F.max("block").alias("last"))
    return flat.join(last, "grp").withColumn("alone", F.col("last") == 0).drop("last")


def _tops(blocks: DataFrame, fan: int, height: int) -> DataFrame:
    """The node of each block: grp, rank, digest, alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = batch.column("alone").to_pylist()
            tops = [climb(d, fan, None if a else height)[-1][0] for d, a in zip(batch.column("digest").to_pylist(), alone, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), pa.array(tops, pa.string()), batch.column("alone")], names=["grp", "rank", "digest", "alone"])

    return arrow_map(blocks.select("grp", "block", "digest", "alone"), run, "grp string, rank long, digest string, alone boolean")


def reduced(spark: SparkSession, nodes: DataFrame, fan: int, height: int, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each step, from the bottom, and the one node that each group ends with: grp, digest, step."""
    steps, ends = [], None
    while True:
        blocks = _blocks(spark, nodes, fan, height, *more)
        tops = staged(spark, _tops(blocks, fan, height), "nodes")
        end = tops.where("alone").select("grp", "digest", F.lit(len(steps)).alias("step"))
        ends = end if ends is None else ends.unionByName(end)
        steps.append(blocks)
        nodes, more = tops.where("NOT alone").drop("alone"), ()
        if not nodes.limit(1).count():
            return steps, ends


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Each block with its own path and what goes with that."""
    few = paths.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    return blocks.join(F.broadcast(paths) if few else paths, ["grp", "block"])


def _down(blocks: DataFrame, fan: int, height: int) -> DataFrame:
    """The path of every item of the blocks: grp, block (the item's rank), path, subroot."""
    base = fan**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                grp, block, digests, alone, path, subroot = (c[r].as_py() for c in batch.columns)
                levels = climb(digests, fan, None if alone else height)
                above = [(p["left"], p["right"]) for p in path]
                ways = [way_up(levels, k, fan) + above for k in range(len(digests))]
                n = len(digests)
                out = [[{"left": a, "right": b} for a, b in w] for w in ways]
                yield pa.RecordBatch.from_pylist(
                    [{"grp": grp, "block": block * base + k, "path": out[k], "subroot": subroot} for k in range(n)],
                    pa.schema([("grp", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("subroot", pa.string())]),
                )

    return arrow_map(blocks.select("grp", "block", "digest", "alone", "path", "subroot"), run, f"grp string, block long, path {_PATH}, subroot string")


def lowered(spark: SparkSession, steps: list[DataFrame], ends: DataFrame, fan: int, height: int) -> DataFrame:
    """The bottom's blocks with their paths; ``ends`` has grp, step, and the path and subroot of each group's last node."""
    from_above = None
    for k in reversed(range(len(steps))):
        own = ends.where(F.col("step") == k).select("grp", F.lit(0).cast("long").alias("block"), "path", "subroot")
        paths = own if from_above is None else own.unionByName(from_above)
        met = _with_paths(steps[k], paths)
        if k:
            from_above = staged(spark, _down(met, fan, height), "paths")
    return met


def _folded(blocks: DataFrame, root: str, fan: int, height: int) -> DataFrame:
    """The result's rows for the bottom's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, digests, tampered, alone, path, subroot = (c[r].as_py() for c in batch.columns)
                levels = climb(digests, fan, None if alone else height)
                above = [(p["left"], p["right"]) for p in path]
                proofs, ends = [], []
                for k, leaf in enumerate(digests):
                    way = way_up(levels, k, fan) + above
                    proofs.append(digest("".join([a + b for a, b in way])))
                    node = tampered[k] or leaf
                    for a, b in way:
                        node = digest(a + node + b)
                    ends.append(node)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *[pa.array(c, pa.string()) for c in (digests, [subroot] * n, [root] * n, proofs, ends)], pa.array([e == root for e in ends])],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return arrow_map(blocks.select("doc_id", "digest", "tampered", "alone", "path", "subroot"), run, SCHEMA)


def manifest(spark: SparkSession, docs: DataFrame, fan: int = FAN, height: int | None = None) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    height = height or max(1, int(HEIGHT / math.log2(fan)))
    rows = staged(spark, leaves(docs), "leaves")
    place = F.lpad(F.hex(F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))), 16, "0")
    keyed = rows.select("grp", "doc_id", "tampered", F.col("leaf").alias("digest"), id_key(F.col("doc_id"), F.col("leaf"), place).alias("key"))
    steps, subroots = reduced(spark, ranked(spark, keyed).drop("key"), fan, height, "doc_id", "tampered")
    # the same once more for the subroots, as the one group of their tree
    tops = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest", F.col("grp").alias("of"), "step")
    upper, roots = reduced(spark, ranked(spark, tops).drop("key"), fan, height, "of", "step")
    last = roots.first()
    if last is None:
        return spark.createDataFrame([], SCHEMA)
    whole = roots.select("grp", "step", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"))
    met = lowered(spark, upper, whole, fan, height)
    ends = staged(spark, _of_groups(met, fan, height), "subroot-paths")
    return _folded(lowered(spark, steps, ends, fan, height), last["digest"], fan, height)


def _of_groups(blocks: DataFrame, fan: int, height: int) -> DataFrame:
    """For every group its subroot, the step that it ended with and its path to the root."""
    items = F.posexplode(F.arrays_zip("of", "step", "digest")).alias("at", "item")
    named = blocks.select("grp", "block", items).select("grp", (F.col("block") * fan**height + F.col("at")).alias("block"), "item.*")
    return _down(blocks, fan, height).drop("subroot").join(named, ["grp", "block"]).select(F.col("of").alias("grp"), "step", "path", F.col("digest").alias("subroot"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL for ``fan`` 2."""
    f = ", ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
    changed = f.replace("n_chars::VARCHAR", "(n_chars + 1)::VARCHAR")
    step = lambda name, key: f"""{name} AS (SELECT {key} AS grp, 0 AS lvl, r AS i, leaf AS h, n FROM {name}0
        UNION ALL SELECT grp, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY grp, lvl, i // 2)"""  # noqa: E731
    walk = lambda name, tree, start: f"""{name} AS ({start}
        UNION ALL SELECT w.k, w.grp, w.lvl + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN acc WHEN w.i % 2 = 0 THEN acc || s.h ELSE s.h || acc END), proof || coalesce(s.h, '')
        FROM {name} w LEFT JOIN {tree} s ON s.grp = w.grp AND s.lvl = w.lvl AND s.i = xor(w.i, 1) WHERE w.n > 1)"""  # noqa: E731
    return f"""WITH RECURSIVE crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crcs AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ord(x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM documents, crc_table),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256(concat({f})) AS leaf,
        CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND crc % {TAMPER} = 0 THEN sha256(concat({changed})) END AS tampered FROM crcs),
low0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER () AS k FROM leaves),
{step("low", "grp")},
top0 AS MATERIALIZED (SELECT grp AS name, h AS leaf, row_number() OVER (ORDER BY grp) - 1 AS r, count(*) OVER () AS n FROM low WHERE n = 1),
{step("top", "''")},
{walk("climb", "low", "SELECT k, grp, 0 AS lvl, r AS i, n, coalesce(tampered, leaf) AS acc, '' AS proof FROM low0")},
{walk("peak", "top", "SELECT c.k, '' AS grp, 0 AS lvl, t.r AS i, t.n, c.acc, c.proof FROM climb c JOIN top0 t ON t.name = c.grp WHERE c.n = 1")}
SELECT d.doc_id, d.leaf, s.leaf AS subroot, x.h AS root, sha256(p.proof) AS proof_sha256, p.acc AS folded_root, p.acc = x.h AS verified
FROM low0 d JOIN top0 s ON s.name = d.grp JOIN peak p ON p.k = d.k AND p.n = 1 JOIN (SELECT h FROM top WHERE n = 1) x ON true"""
