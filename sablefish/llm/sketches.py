"""Operator 7, document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs (its non-blank lines) become 64-bit digests, each distinct one counted once. A
sketch has blocks of ``CELLS`` cells; a digest lies in one block, there in one cell of each
third, and adds to each of these cells its count, itself and a check value (both by exclusive
or). Sketches of two versions subtract cell by cell, which cancels what they share. Peeling
then takes cells that hold one digest (count 1 or -1, and the check fits), reports the digest
and removes it from its cells, until no such cell is left. If cells stay filled, the
difference was too large for the sketch, and both versions are sketched again with four
times as many blocks. The likeness of two texts is the share of common digests among all, from
their numbers of digests and the number of recovered ones.

The fingerprint is the text's sketch of one block as a string: number of digests, a hash of
the whole text and the cells. Only DataFrame functions are used; the cells live in
arrays. The work for a text of n paragraphs is proportional to n * CELLS + n * blocks.

A document's neighbour is the next one by ascending id (the first after the last). Ids are
cut into ranges at approximate quantiles; each range is a window partition, and the first document
of each range is also sent to the range before, so no task sees more than its range.

Defined results: a null text is empty; an empty text has no digests, and is like another with likeness
1 if that has none either, else 0; null ids come first; rows of equal id are ordered by their text; a
single row is its own neighbour; an empty table gives an empty result. Only the id
and the text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = 24
THIRD = CELLS // 3
GROWTH, MOST_GROWTHS = 4, 12
QUANTILE_ACCURACY = 10_000


def let(name: str, value: str, body: str) -> str:
    """SQL in which ``name`` stands for the value of an expression that is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def digests(text: str) -> str:
    """The distinct paragraph digests of a text."""
    return f"array_distinct(transform(filter(split({text}, '\\n'), p -> trim(p) <> ''), p -> xxhash64(p)))"


def spots(d: str, blocks: str = "1") -> str:
    """A digest with its cells, check value and block; sketches of different sizes hash anew."""
    cells = ", ".join(f"{k * THIRD} + CAST(pmod(xxhash64({d}, {k + 1}, {blocks}), {THIRD}) AS INT) AS c{k}" for k in range(3))
    return f"struct({d} AS d, {cells}, xxhash64({d}, 4) AS h, pmod(xxhash64({d}, 5, {blocks}), {blocks}) AS b)"


def sketch(items: str) -> str:
    """The cells of one block, from an array (a name) of ``spots``."""
    return f"""transform(sequence(0, {CELLS - 1}), i -> aggregate({items}, struct(0 AS n, 0L AS k, 0L AS h),
        (s, x) -> IF(x.c0 = i OR x.c1 = i OR x.c2 = i, struct(s.n + 1 AS n, s.k ^ x.d AS k, s.h ^ x.h AS h), s)))"""


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> struct(p.n - q.n AS n, p.k ^ q.k AS k, p.h ^ q.h AS h))"


def peel(cells: str, blocks: str) -> str:
    """``found`` (digests) and ``cells`` (what is left) of a subtracted block."""
    pure = """array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 AND xxhash64(c.k, 4) = c.h),
        c -> struct(c.k AS d, c.n AS n)))"""
    placed = f"transform({pure}, y -> struct(y.n AS n, {spots('y.d', blocks)} AS x))"
    step = let(
        "took",
        placed,
        """struct(transform(s.cells, (c, i) -> aggregate(took, c, (t, y) -> IF(y.x.c0 = i OR y.x.c1 = i OR y.x.c2 = i,
            struct(t.n - y.n AS n, t.k ^ y.x.d AS k, t.h ^ y.x.h AS h), t))) AS cells,
            concat(s.found, transform(took, y -> y.x.d)) AS found, size(took) = 0 AS done)""",
    )
    # every round but the last recovers a digest, and a block that can be peeled holds fewer than its cells
    return f"""aggregate(sequence(0, {CELLS}), struct({cells} AS cells, CAST(array() AS ARRAY<BIGINT>) AS found, false AS done),
        (s, r) -> IF(s.done, s, {step}))"""


def attempt(a: str, b: str, blocks: str) -> str:
    """``ok``, ``found`` and ``blocks`` of a difference over so many blocks; a and b are names of arrays of digests."""
    block = let(
        "one",
        "struct(filter(spot.a, x -> x.b = g) AS p, filter(spot.b, x -> x.b = g) AS q)",
        peel(subtract(sketch("one.p"), sketch("one.q")), blocks),
    )
    spot = f"struct(transform({a}, d -> {spots('d', blocks)}) AS a, transform({b}, d -> {spots('d', blocks)}) AS b)"
    whole = let(
        "peeled",
        f"transform(sequence(0, CAST({blocks} - 1 AS INT)), g -> {block})",
        f"""struct(forall(peeled, y -> forall(y.cells, c -> c.n = 0 AND c.k = 0 AND c.h = 0)) AS ok,
            flatten(transform(peeled, y -> y.found)) AS found, CAST({blocks} AS INT) AS blocks)""",
    )
    return let("spot", spot, whole)


def difference(a: str, b: str) -> str:
    """The digests in one of two arrays of digests only (columns), with the blocks that this took.

    Sketches grow until they can be peeled; a size that is below the difference of the two
    numbers of digests can't be and is skipped. Should the largest size fail too (equal hashes
    of different digests), the arrays are compared as they are.
    """
    sizes = f"transform(sequence(0, {MOST_GROWTHS}), e -> CAST(pow({GROWTH}, e) AS INT))"
    run = f"""aggregate(filter({sizes}, z -> z <= {GROWTH} * {GROWTH} * {GROWTH} * (size(two.a) + size(two.b) + 1)),
        struct(false AS ok, CAST(array() AS ARRAY<BIGINT>) AS found, 0 AS blocks),
        (u, z) -> IF(u.ok OR abs(size(two.a) - size(two.b)) > {CELLS} * z, u, {attempt('two.a', 'two.b', 'z')}))"""
    whole = f"concat(array_except({a}, {b}), array_except({b}, {a}))"
    return let("last", let("two", f"struct({a} AS a, {b} AS b)", run), f"IF(last.ok, struct(last.found AS found, last.blocks AS blocks), struct({whole} AS found, -1 AS blocks))")


def fingerprint(text: str, found: str) -> str:
    """The printed sketch of a text, from the text and its digests (columns)."""
    cells = let("items", f"transform({found}, d -> {spots('d')})", sketch("items"))
    return f"""concat(size({found}), ':', lower(hex(xxhash64({text}))), ':',
        concat_ws(',', transform({cells}, c -> concat(c.n, '.', lower(hex(c.k)), '.', lower(hex(c.h))))))"""


def likeness(a: str, b: str, changed: str) -> str:
    """Common digests among all, from two arrays of digests and the recovered ones."""
    return f"""IF(size({a}) + size({b}) = 0, 1.0D, CAST(size({a}) + size({b}) - size({changed}) AS DOUBLE) / (size({a}) + size({b}) + size({changed})))"""


def with_next(spark: SparkSession, docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text (null: empty) and ``next_text`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = ranges or 4 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(docs.select(F.percentile_approx(F.col("doc_id").cast("long"), at, QUANTILE_ACCURACY)).first()[0] or []))
    bounds = F.lit(cuts).cast("array<bigint>")
    ranged = rows.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))))
    # the first id of each range: at most as many rows as ranges
    firsts = sorted((r["part"], r["has_null"], r["first"]) for r in ranged.groupBy("part").agg(F.min("doc_id").alias("first"), F.bool_or(F.col("doc_id").isNull()).alias("has_null")).collect())
    sent = [(None if has_null else first, firsts[k - 1][0]) for k, (_, has_null, first) in enumerate(firsts)]
    also = spark.createDataFrame(sent, "first_id long, before int")
    guests = rows.join(F.broadcast(also), F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text", F.col("before").alias("part"), F.lit(1).alias("guest"))
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    both = ranged.withColumn("guest", F.lit(0)).unionByName(guests)
    return both.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns, with the recovered digests' numbers and the blocks they took."""
    half = "CAST(floor(length(text) / 2) AS INT)"
    rows = with_next(spark, docs).selectExpr(
        "doc_id", "length(text) AS n_chars", "text", "next_text", f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half})) AS edited"
    )
    rows = rows.selectExpr("*", f"{digests('text')} AS own_d", f"{digests('edited')} AS edited_d", f"{digests('next_text')} AS next_d")
    rows = rows.selectExpr(
        "doc_id", "CAST(n_chars AS BIGINT) AS n_chars", "sha2(edited, 256) AS edited_sha256", f"{fingerprint('text', 'own_d')} AS fingerprint", f"{fingerprint('edited', 'edited_d')} AS edited_fingerprint",
        "own_d", "edited_d", "next_d", f"{difference('own_d', 'edited_d')} AS to_edited", f"{difference('own_d', 'next_d')} AS to_next",
    )
    return rows.selectExpr(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", f"{likeness('own_d', 'edited_d', 'to_edited.found')} AS near_edited",
        f"{likeness('own_d', 'next_d', 'to_next.found')} AS near_next", "size(own_d) AS n_digests", "size(to_edited.found) AS changed", "to_edited.blocks AS blocks_edited", "to_next.blocks AS blocks_next",
    )
