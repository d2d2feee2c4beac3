"""Operator 8, line deduplication by a deletion-neighbourhood join.

Lines count as equal if their words (between white space) are. Of equal lines the earliest stays, by
document id and line number. A line also goes where an earlier line differs from it by one edit (a unit replaced,
inserted or deleted) of at most one eighth of the line: the units of a line of at least ``LEAST`` words are its
words, those of a shorter line the characters of its words joined by single spaces, where these are at least ``LEAST``.
Both lines have the same kind of units. What is shorter still is compared exactly. Blank lines stay.

The join: a line's variants are its units and all its sequences with one unit less, each a
hashed key. Two lines differ by a replaced unit if they share a variant with the same place
deleted, and by an inserted or deleted unit if a variant of one is the other. Per key the
earliest line is found by aggregation, and each line of the key is paired with that one
only, never all with all: the lines of a (key, place) are all within one edit of each
other, so the earliest decides. Pairs are then verified on the units.

Before variants are made, lines that can't have a partner are set aside: by the pigeonhole principle two lines within one edit
share the first or the last half of their units (halves taken for the shorter length), so only lines with a half that another
line shares go on, and with one half shared the deleted place lies in the other one. Lines that go on are numbered
in their order, so variants are rows of a few numbers.

Rows that go back to a few keys (halves that lines share, places of suspects, lines to drop) pass a bitmap of these keys first
(``common.sifted``), so most of them aren't shuffled, whatever the size; texts are, once, for the result. Tables between the steps
are removed before that.

Only DataFrame functions. Keys with many lines (a very common line, a half that a third of
all lines share) are pre-aggregated; where rows go back to their keys, both sides are plain
tables, so that adaptive execution splits hot keys. Variants of a line of n units come from
running hashes, n rows of fixed size, taken in blocks of ``RUN``; a line of a million words takes some 10^8 steps.

Defined results: a null text stays null, an empty one empty; a text of which no line but blank
ones stays becomes empty; rows equal in id and text are treated alike (what stays of one stays
of all of them); null ids come first; an empty table gives an empty result. Columns ``n_lines``,
``n_exact`` and ``n_near`` are added, or replaced where they clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, shared_path, sifted, staged

LEAST, RUN = 8, 256
#: Keys of many lines up to this number are looked up by broadcast, more by a shuffled join.
BROADCAST_TEXTS = 50_000
#: A text with plain spaces for white space but line ends; few texts have other, and looking for these by ``contains`` is cheap.
SPACED = "IF(contains(text, '\t') OR contains(text, '\r') OR contains(text, '\x0b') OR contains(text, '\x0c'), translate(text, '\t\r\x0b\x0c', '    '), text)"
WORDS = "array_remove(split(line, ' '), '')"
#: Kind 0: words, 1: characters, 2: compared exactly.
KIND = "IF(size(w) >= {0}, 0, IF(length(array_join(w, ' ')) >= {0}, 1, 2))"
#: Of the words, and of the same words joined by single spaces.
UNITS, UNITS_AGAIN = "IF(kind = 1, split(array_join(w, ' '), ''), w)", "IF(kind = 1, split(words, ''), split(words, ' '))"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))


def _lines(docs: DataFrame) -> DataFrame:
    return _keyed(docs).selectExpr("doc_id", "mark", f"posexplode(split({SPACED}, '\\n')) AS (line_no, line)")


def occurrences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Every non-blank line: its document, number, two hashes and half keys (first and last half, for its own length and one less)."""
    lines = _lines(docs)
    # a filter on the words would split every line twice
    words = lines.where("trim(line) <> ''").selectExpr("doc_id", "mark", "line_no", f"{WORDS} AS w")
    units = words.selectExpr("doc_id", "mark", "line_no", "w", f"{KIND.format(least)} AS kind").selectExpr("*", f"{UNITS} AS u")

    def halves(m: str) -> str:
        first = f"CAST(floor(({m}) / 2) AS INT)"
        return f"xxhash64(kind, {m}, 1, slice(u, 1, {first})), xxhash64(kind, {m}, 2, slice(u, size(u) - ({m} - {first}) + 1, {m} - {first}))"

    hashed = units.selectExpr("doc_id", "mark", "line_no", "kind", "u", "xxhash64(w) AS h1", f"array({halves('size(u)')}) AS own")
    return hashed.selectExpr(
        "doc_id", "mark", "line_no", "h1", "xxhash64(h1, own) AS h2",
        f"CASE WHEN kind < 2 AND size(u) > {least} THEN concat(own, array({halves('size(u) - 1')})) WHEN kind < 2 THEN own END AS halves",
    )


def distinct_lines(found: DataFrame) -> DataFrame:
    """One row per different line, with its first occurrence and number of occurrences."""
    return found.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "mark", "line_no")).alias("first"), F.count(F.lit(1)).alias("times"), F.any_value("halves").alias("halves")
    )


def suspects(spark: SparkSession, lines: DataFrame, folder: str) -> DataFrame:
    """Different lines that share a half with another one, and whether places in the front, in the rear are to be deleted."""
    keys = lines.where(F.col("halves").isNotNull()).selectExpr("first", "h1", "h2", "posexplode(halves) AS (side, half)")
    # the half keys of a line differ, as do the lines
    shared = staged(spark, keys.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), "halves", folder)
    met = sifted(keys, "half", shared, "half").join(shared, "half")
    return met.groupBy("first", "h1", "h2").agg(F.expr("bool_or(side % 2 = 1)").alias("front"), F.expr("bool_or(side % 2 = 0)").alias("rear"))


def line_units(docs: DataFrame, firsts: DataFrame, least: int = LEAST) -> DataFrame:
    """The words of the lines at the given first occurrences and their kind, with a number in the order of the lines."""
    place = "xxhash64({0}doc_id, {0}mark, {0}line_no)".format
    met = sifted(_lines(docs), place(""), firsts, place("first."))
    # rows equal in id and text come once
    once = met.groupBy(F.struct("doc_id", "mark", "line_no").alias("first")).agg(F.any_value("line").alias("line"))
    # partitions of sorted rows are in order, and so are these numbers
    rows = once.join(firsts, "first").orderBy("first").withColumn("line_number", F.monotonically_increasing_id())
    rows = rows.selectExpr("line_number AS line", "first", "h1", "h2", "front", "rear", f"{WORDS} AS w")
    return rows.selectExpr("line", "first", "h1", "h2", "front", "rear", f"{KIND.format(least)} AS kind", "array_join(w, ' ') AS words")


def variants(units: DataFrame) -> DataFrame:
    """key, place (-1 for the line itself) and line of each variant."""

    def running(x: str) -> str:
        """Exclusive ors of all hashes before a place, by blocks."""
        block = f"transform(sequence(0, CAST((size({x}) - 1) DIV {RUN} AS INT)), k -> aggregate(slice({x}, k * {RUN} + 1, {RUN}), array(0L), (a, h) -> array_append(a, a[size(a) - 1] ^ h)))"
        return f"transform(array({block}), b -> struct(b AS inner, aggregate(b, array(0L), (a, y) -> array_append(a, a[size(a) - 1] ^ y[size(y) - 1])) AS outer))[0]"

    before = "({0}.outer[CAST({1} DIV {2} AS INT)] ^ {0}.inner[CAST({1} DIV {2} AS INT)][CAST({1} % {2} AS INT)])"
    at = lambda name, i: before.format(name, i, RUN)
    runs = units.selectExpr("line", "kind", "front", "rear", f"{UNITS_AGAIN} AS u").selectExpr(
        "line", "kind", "front", "rear", "size(u) AS n", "transform(u, (x, j) -> xxhash64(j, x)) AS here", "transform(u, (x, j) -> xxhash64(j - 1, x)) AS moved"
    ).selectExpr("line", "kind", "front", "rear", "n", f"{running('concat(here, array(0L))')} AS h", f"{running('concat(moved, array(0L))')} AS m")
    # with a shared half the deleted place lies in the other one; halves are taken for n and for n - 1 units
    begin = "IF(front, 0, CAST(floor((n - 1) / 2) AS INT))"
    stop = "IF(rear, n - 1, CAST(floor(n / 2) AS INT) - 1)"
    shorter = f"""transform(sequence({begin}, {stop}), i -> struct(
        xxhash64(kind, {at('h', 'i')} ^ {at('m', 'n')} ^ {at('m', '(i + 1)')}, n - 1) AS key, i AS place))"""
    own = f"array(struct(xxhash64(kind, {at('h', 'n')}, n) AS key, -1 AS place))"
    return runs.selectExpr("line", f"explode(concat({own}, {shorter})) AS v").selectExpr("line", "v.key", "v.place")


def candidate_pairs(spark: SparkSession, made: DataFrame, folder: str) -> DataFrame:
    """later and earlier lines that share a variant, each line with the earliest of a key only."""
    spots = made.groupBy("key", "place").agg(F.min("line").alias("least"), F.max("line").alias("most"), F.count(F.lit(1)).alias("n"))
    spots = staged(spark, spots, "spots", folder)
    pair = lambda df, a, b: df.select(F.greatest(a, b).alias("later"), F.least(a, b).alias("earlier"))
    same = spots.where("place >= 0 AND n > 1")
    whole = spots.where("place < 0").select("key", F.col("least").alias("line"))
    cut = spots.where("place >= 0").groupBy("key").agg(F.min("least").alias("longer"), F.max("most").alias("longest"), F.sum("n").alias("n"))
    both = staged(spark, whole.join(cut, "key"), "inserted", folder)
    pairs = pair(same, "least", "most").unionByName(pair(both, "line", "longer")).unionByName(pair(both, "line", "longest"))
    # two lines of a key are known by now; the others go back to theirs
    for name, many, other, keys in (("same", same.where("n > 2"), "least", ["key", "place"]), ("inserted", both.where("n > 2"), "line", ["key"])):
        many = staged(spark, many.select(*keys, F.col(other).alias("other")), f"many-{name}", folder)
        few = many.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
        met = made.where("place >= 0").join(F.broadcast(many) if few else many, keys)
        pairs = pairs.unionByName(pair(met, "line", "other"))
    return pairs.where("later > earlier").distinct()


def verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The later lines of pairs within one edit: what both ends share leaves at most one unit."""
    a = units.selectExpr("line AS later", "words AS a", "kind AS kind_a", "first", "h1", "h2")
    b = units.selectExpr("line AS earlier", "words AS b", "kind AS kind_b")
    first_off = "array_position(zip_with({0}, {1}, (x, y) -> x <=> y), false)"
    shared = f"IF({first_off} = 0, least(size(a), size(b)), {first_off} - 1)"
    front, back = shared.format("a", "b"), shared.format("reverse(a)", "reverse(b)")
    near = f"abs(size(a) - size(b)) <= 1 AND {front} + {back} >= greatest(size(a), size(b)) - 1"
    met = pairs.join(a, "later").join(b, "earlier").where("kind_a = kind_b")
    unit = lambda x: UNITS_AGAIN.replace("words", x).replace("kind", "kind_a")
    return met.selectExpr("first", "h1", "h2", f"{unit('a')} AS a", f"{unit('b')} AS b").where(near).select("first", "h1", "h2").distinct()


def dropped_lines(spark: SparkSession, docs: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """doc_id, mark and the numbers of the lines to drop, as ``exact`` and ``near``; reads tables staged in ``folder``."""
    found = staged(spark, occurrences(docs, least), "lines", folder)
    lines = staged(spark, distinct_lines(found), "distinct-lines", folder)
    units = staged(spark, line_units(docs, staged(spark, suspects(spark, lines, folder), "suspects", folder), least), "suspect-units", folder)
    made = staged(spark, variants(units), "variants", folder)
    near = staged(spark, verified(staged(spark, candidate_pairs(spark, made, folder), "pairs", folder), units), "near-lines", folder)
    marked = lines.where("times > 1").select("first", "h1", "h2", F.lit(False).alias("near")).unionByName(near.select("first", "h1", "h2", F.lit(True).alias("near")))
    fate = staged(spark, marked.groupBy("first", "h1", "h2").agg(F.bool_or("near").alias("is_near")), "fates", folder)
    gone = sifted(found, "h1", fate, "h1").select("h1", "h2", F.struct("doc_id", "mark", "line_no").alias("own")).join(fate, ["h1", "h2"])
    # equal rows have equal places; one number each is enough
    return (
        gone.where("is_near OR own <> first")
        .groupBy(F.col("own.doc_id").alias("d_id"), F.col("own.mark").alias("d_mark"))
        .agg(
            F.collect_set(F.when(F.col("own") != F.col("first"), F.when(~F.col("is_near"), F.col("own.line_no")))).alias("exact"),
            F.collect_set(F.when(F.col("is_near"), F.col("own.line_no"))).alias("near"),
        )
    )


def dedup_lines(spark: SparkSession, docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and ``n_lines``, ``n_exact``, ``n_near``."""
    folder = shared_path(spark, "line-dedup")
    gone = staged(spark, dropped_lines(spark, docs, folder, least), "dropped")
    # before the texts are shuffled
    remove(spark, folder)
    # the other columns go as one, so that none clashes with those of the join
    others = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near", "text")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text")
    )
    # the side with what to drop is the smaller one in every partition; texts needn't be sorted
    met = rows.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("mark") == F.col("d_mark")), "left")
    met = met.withColumn("line_array", F.split("text", "\n")).withColumns(
        {
            "n_lines": F.expr("coalesce(size(filter(line_array, x -> x RLIKE '[^ \\\\t\\\\r\\\\x0B\\\\f]')), 0)"),
            "n_exact": F.coalesce(F.size("exact"), F.lit(0)),
            "n_near": F.coalesce(F.size("near"), F.lit(0)),
        }
    )
    kept = """CASE WHEN exact IS NULL THEN text WHEN n_lines = size(exact) + size(near) THEN ''
        ELSE array_join(transform(array_except(sequence(0, size(line_array) - 1), concat(exact, near)), i -> line_array[i]), '\\n') END AS text"""
    out = met.select(*[F.col("row").getField(c).alias(c) for c in others], F.expr(kept), "n_lines", "n_exact", "n_near")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")], "n_lines", "n_exact", "n_near")


def oracle_sql(least: int = LEAST) -> str:
    """The same in DuckDB's SQL, with whole variants in place of hashes; document ids are unique there."""
    return f"""
WITH l AS (
  SELECT doc_id, i AS line_no, lines[i] AS line, list_filter(regexp_split_to_array(lines[i], '[ \\t\\r\\f\\x0B]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))
), o AS (SELECT *, array_to_string(w, ' ') AS words, len(w) AS n_words, row_number() OVER (ORDER BY doc_id, line_no) AS ord FROM l
), d AS (
  SELECT words, any_value(w) AS w, min(ord) AS ord, CASE WHEN any_value(n_words) >= {least} THEN 0 WHEN length(words) >= {least} THEN 1 ELSE 2 END AS kind,
         CASE WHEN any_value(n_words) >= {least} THEN any_value(n_words) ELSE length(words) END AS n
  FROM o WHERE n_words > 0 GROUP BY words
), v AS (
  SELECT ord, kind, n, i AS place, CASE WHEN kind = 0 THEN array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ') ELSE left(words, i - 1) || substr(words, i + 1) END AS variant
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE kind < 2)
), near AS (
  SELECT ord FROM (SELECT ord, min(ord) OVER (PARTITION BY variant, place, kind, n) AS least FROM v) WHERE ord > least
  UNION SELECT greatest(v.ord, d.ord) FROM v JOIN d ON v.variant = d.words AND v.kind = d.kind AND v.n = d.n + 1
), f AS (
  SELECT o.*, n_words > 0 AND d_ord <> o.ord AND NOT is_near AS exact, n_words > 0 AND is_near AS near
  FROM (SELECT o.*, d.ord AS d_ord, d.ord IN (SELECT ord FROM near) AS is_near FROM o LEFT JOIN d ON o.words = d.words AND o.n_words > 0) o
), r AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT (coalesce(exact, false) OR coalesce(near, false))), '') AS text,
         count(*) FILTER (n_words > 0) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near) AS n_near,
         count(*) FILTER (n_words > 0 AND NOT (coalesce(exact, false) OR coalesce(near, false))) AS n_kept
  FROM f GROUP BY doc_id
)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL WHEN r.n_lines > 0 AND r.n_kept = 0 THEN '' ELSE r.text END AS text,
       coalesce(r.n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near
FROM documents t LEFT JOIN r ON t.doc_id = r.doc_id
"""
