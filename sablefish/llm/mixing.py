"""Operator 1, mixing sources to target weights by raking (iterative proportional fitting).

Documents fall into cells (source, language, topic) that hold token totals. A sample keeps each document of a cell with the cell's
probability, so the cell gives probability times tokens to the sample in expectation. Raking scales the cells' probabilities in turn so that the
expected tokens by source, by language and by topic each meet their targets, and repeats this ``ROUNDS`` times. No probability is above 1: a step finds, for each
value of its dimension, the factor with which the cells below 1 make up for those that are full.

Targets are shares by value and dimension of a sample with ``fraction`` of all tokens; where none are given, a value's target is its
share of tokens to the power ``TEMPER``, which raises small values and lowers large ones. A target above all the tokens that a value has can't be met by any sample: such a value is
taken whole, and the others share the rest in proportion (``FILL`` rounds). Given values that no document has are ignored, values without a given share get none, and shares
are scaled to 1. A document stays where a uniform number from a hash of its id lies below its probability.

Only DataFrame functions. Documents are summed to cells before any shuffle, so a source with a third
of all rows is no hot key; everything after works on cells, all rounds of raking in one plan of windows. Cell probabilities reach the
documents by broadcast up to ``BROADCAST_CELLS`` cells (counted first), beyond by a join
whose keys are salted.

Defined results: null sources, languages and texts are values of their own (texts without words
have no tokens and the topic ``empty``; they stay with the probability of their cell, which is 0
where the cell has no tokens); rows equal in id share their fate; an empty table gives an
empty result. Columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, FILL, TEMPER, FRACTION = 6, 6, 0.5, 0.5
BROADCAST_CELLS, SALTS = 50_000, 32
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A coarse topic by what a whole text contains."""
    return (
        F.when(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) == 0, "empty")
        .when(text.contains(" License") | text.contains("Licensed under") | text.contains("rights reserved"), "legal")
        .when(text.contains("@"), "contact")
        .when(text.contains(" | "), "table")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame) -> DataFrame:
    """``docs`` with ``topic`` and ``n_tokens`` (its words)."""
    return docs.withColumns({"topic": topic_of(F.col("text")), "n_tokens": F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")})


def _shares(d: str, own: Column, targets: dict[str, dict[str, float]], temper: float) -> Column:
    """What a value of a dimension is to get, up to a common scale, from its own tokens."""
    if d not in targets:
        return F.pow(own.cast("double"), F.lit(temper))
    pairs = F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv])
    return F.when(own > 0, F.coalesce(F.try_element_at(pairs, F.coalesce(F.col(d), F.lit(""))), F.lit(0.0))).otherwise(0.0)


def goals(spark: SparkSession, cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, temper: float = TEMPER, fill: int = FILL) -> DataFrame:
    """``cells`` with ``goal_`` each dimension: the tokens that a sample is to hold of the cell's value, at most all it has."""
    values = None
    for d in DIMENSIONS:
        one = cells.groupBy(d).agg(F.sum("tokens").alias("own")).select(F.lit(d).alias("dim"), "own", _shares(d, F.col("own"), targets or {}, temper).alias("share"))
        values = one if values is None else values.unionByName(one)
    values = staged(spark, values, "marginals")
    # the scale of each dimension's shares: values that are taken whole leave the rest to the others
    scales = dict.fromkeys(DIMENSIONS, 0.0)
    for _ in range(fill):
        scale = F.create_map(*[F.lit(x) for kv in scales.items() for x in kv])[F.col("dim")]
        full = (F.col("share") * scale >= F.col("own")) & (scale > 0)
        sums = values.groupBy("dim").agg(F.sum("own").alias("all"), F.sum(F.when(full, F.col("own"))).alias("full"), F.sum(F.when(~full, F.col("share"))).alias("rest")).collect()
        for r in sums:
            if r["rest"]:
                scales[r["dim"]] = max(scales[r["dim"]], (fraction * r["all"] - (r["full"] or 0)) / r["rest"])
    out = cells
    for d in DIMENSIONS:
        own = F.sum("tokens").over(Window.partitionBy(d))
        out = out.withColumn(f"goal_{d}", F.least(own.cast("double"), _shares(d, own, targets or {}, temper) * scales[d]))
    return out


def rake(spark: SparkSession, cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, rounds: int = ROUNDS, temper: float = TEMPER) -> DataFrame:
    """``cells`` (dimensions and ``tokens``) with ``goal_`` each dimension and ``prob``."""
    out = staged(spark, goals(spark, cells, targets, fraction, temper), "goals").withColumn("f", F.lit(fraction))
    for _ in range(rounds):
        for d in DIMENSIONS:
            every = Window.partitionBy(d)
            order = every.orderBy(F.desc("f"), *DIMENSIONS)
            # with the cells before this one full, the others meet the goal by this factor; the first cell that it leaves below 1 tells
            before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            rest = F.sum(F.col("tokens") * F.col("f")).over(order.rowsBetween(0, Window.unboundedFollowing))
            out = out.withColumns({"place": F.row_number().over(order), "by": F.when(rest > 0, (F.col(f"goal_{d}") - before) / rest)})
            fits = F.when(F.col("f") * F.col("by") <= 1, F.struct("place", "by"))
            least = F.min(F.when(F.col("f") > 0, F.col("f"))).over(every)
            out = out.withColumns({"first": F.min(fits).over(every), "least": least})
            # none fits where all there is has to be taken
            out = out.withColumn("f", F.col("f") * F.coalesce(F.when(F.col("first.by") < 0, 0.0).otherwise(F.col("first.by")), 1 / F.col("least"), F.lit(0.0))).drop("place", "by", "first", "least")
    out = out.withColumn("prob", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("f"))).otherwise(0.0)).drop("f")
    return staged(spark, out, "raked")


def uniform(id_col: str = "doc_id", seed: str = "mix") -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION) -> DataFrame:
    """The sampled documents, all their columns and ``topic``, ``n_tokens`` and ``prob`` (6 places)."""
    # the other columns go as one, so that none clashes with those of the join
    needed = ("doc_id", "text", "source", "lang")
    others = [c for c in docs.columns if c not in (*needed, "topic", "n_tokens", "prob")]
    rows = with_cells(docs.select(F.struct(*([F.col(f"`{c}`") for c in others] or [F.lit(1).alias("none")])).alias("row"), *needed))
    cells = staged(spark, rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    table = rake(spark, cells, targets, fraction).select(*[F.col(d).alias(f"cell_{d}") for d in DIMENSIONS], "prob")
    match = [F.col(d).eqNullSafe(F.col(f"cell_{d}")) for d in DIMENSIONS]
    if cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        joined = rows.join(F.broadcast(table), match, "inner")
    else:
        table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("row_salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int"))
        joined = salted.join(table, [*match, F.col("row_salt") == F.col("salt")], "inner")
    kept = joined.where(uniform() < F.col("prob"))
    own = [F.col("row").getField(c).alias(c) if c in others else F.col(c) for c in docs.columns if c in others or c in needed]
    return kept.select(*own, "topic", "n_tokens", F.round("prob", 6).alias("prob"))


def oracle_sql(rounds: int = ROUNDS, fill: int = FILL, temper: float = TEMPER, fraction: float = FRACTION) -> str:
    """The same in DuckDB's SQL for tempered targets."""
    w = f"len(regexp_extract_all(coalesce(text, ''), '{WORD}'))"
    parts = [
        f"""docs AS (SELECT doc_id, source, lang, {w} AS n_tokens, CASE WHEN {w} = 0 THEN 'empty'
            WHEN contains(text, ' License') OR contains(text, 'Licensed under') OR contains(text, 'rights reserved') THEN 'legal'
            WHEN contains(text, '@') THEN 'contact' WHEN contains(text, ' | ') THEN 'table' ELSE 'prose' END AS topic FROM documents)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        parts.append(f"v_{d} AS (SELECT {d} AS key, sum(tokens) AS own, pow(sum(tokens), {temper}) AS share FROM cells GROUP BY {d})")
        parts.append(f"s_{d}_0 AS (SELECT 0.0::DOUBLE AS scale)")
        for k in range(fill):
            parts.append(
                f"""s_{d}_{k + 1} AS MATERIALIZED (SELECT coalesce(greatest(any_value(scale), ({fraction} * sum(own) - coalesce(sum(own) FILTER (share * scale >= own AND scale > 0), 0))
                / nullif(sum(share) FILTER (NOT (share * scale >= own AND scale > 0)), 0)), any_value(scale)) AS scale FROM v_{d}, s_{d}_{k})"""
            )
        parts.append(f"g_{d} AS (SELECT key, least(own, share * scale) AS goal FROM v_{d}, s_{d}_{fill})")
    joins = " ".join(f"JOIN g_{d} ON c.{d} IS NOT DISTINCT FROM g_{d}.key" for d in DIMENSIONS)
    parts.append(f"r0 AS MATERIALIZED (SELECT c.*, {', '.join(f'g_{d}.goal AS goal_{d}' for d in DIMENSIONS)}, {fraction}::DOUBLE AS f FROM cells c {joins})")
    at = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            order = f"PARTITION BY {d} ORDER BY f DESC, {', '.join(f'{x} NULLS FIRST' for x in DIMENSIONS)}"
            parts.append(
                f"""t{at} AS MATERIALIZED (SELECT *, row_number() OVER ({order}) AS place,
                (goal_{d} - coalesce(sum(tokens) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(tokens * f) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS by_f FROM r{at})"""
            )
            parts.append(
                f"""r{at + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, goal_source, goal_lang, goal_topic,
                f * coalesce(arg_min(CASE WHEN by_f < 0 THEN 0 ELSE by_f END, place) FILTER (f * by_f <= 1) OVER (PARTITION BY {d}), 1 / min(f) FILTER (f > 0) OVER (PARTITION BY {d}), 0) AS f FROM t{at})"""
            )
            at += 1
    parts.append(f"p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, f) ELSE 0 END AS prob FROM r{at})")
    return f"""WITH {', '.join(parts)}
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(prob, 6) AS prob FROM docs d
JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic
WHERE ('0x' || substr(md5('mix' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < prob"""
