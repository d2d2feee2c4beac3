"""Relational building blocks: predicates, anti joins, diffs, merges, last-wins and cascades.

Everything takes and returns DataFrames or Columns; nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ascii_upper(column: Column | str) -> Column:
    """Upper case of the letters a to z only, as the reference's storage compares names."""
    return F.translate(column, ascii_lowercase, ascii_uppercase)


def nocase_equal(column: Column | str, value: str) -> Column:
    """Equality that ignores the case of ASCII letters."""
    return ascii_upper(column) == value.translate(str.maketrans(ascii_lowercase, ascii_uppercase))


def contains_nocase(column: Column | str, value: str) -> Column:
    """Literal substring test that ignores case; ``%`` and ``_`` have no special meaning."""
    return F.contains(F.lower(column), F.lit(value.lower()))


def contains_word(column: Column | str, term: str) -> Column:
    """A cheap substring test, then a whole-word test (letters, digits and ``_`` make words)."""
    exact = F.lower(column).rlike(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(term.lower())}(?![\p{{L}}\p{{N}}_])")
    return contains_nocase(column, term) & exact


def snippet_around(column: Column, term: str, before: int = 30, size: int = 200) -> Column:
    """``size`` characters from ``before`` characters ahead of the term's first exact occurrence."""
    return F.substr(column, F.greatest(F.lit(1), F.instr(column, term) - before), F.lit(size))


def collapse(column: Column, most: int | None = None) -> Column:
    """White space runs as one space, trimmed; longer texts are cut and end with an ellipsis."""
    flat = F.trim(F.regexp_replace(column, "[ \\t\\r\\n]+", " "))
    if most is None:
        return flat
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


#: What is redacted, and in this order.
URL_CREDENTIALS, LONG_HEX = r"https?://[^\s:@/]+:[^\s@/]+@", r"\b[0-9a-fA-F]{40,}\b"


def redact(column: Column) -> Column:
    """URL credentials and long hexadecimal tokens replaced."""
    return F.regexp_replace(F.regexp_replace(column, URL_CREDENTIALS, "https://[REDACTED]@"), LONG_HEX, "[REDACTED]")


def normalized_name(column: Column | str) -> Column:
    """Upper case, without one leading ``U_``."""
    return F.regexp_replace(ascii_upper(column), "^U_", "")


def safe_int(column: Column | str) -> Column:
    return F.coalesce(F.trim(column).try_cast("int"), F.lit(0))


def unused(declared: DataFrame, used: DataFrame, key: str, used_key: str | None = None) -> DataFrame:
    """Rows of ``declared`` whose key (ignoring case) nothing in ``used`` has."""
    other = used.select(F.upper(F.col(used_key or key).cast("string")).alias("used_key")).where("used_key IS NOT NULL").distinct()
    return declared.join(other, F.upper(F.col(key).cast("string")) == F.col("used_key"), "left_anti")


def missing_target(df: DataFrame, target: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose target isn't known; none where nothing at all is known (an empty catalog says nothing)."""
    keys = known.select(F.col(known_key).alias("known_key")).where("known_key IS NOT NULL").distinct()
    some = keys.agg((F.count(F.lit(1)) > 0).alias("some_known"))  # one row
    return df.join(keys, F.col(target) == F.col("known_key"), "left_anti").join(F.broadcast(some), F.col("some_known")).drop("some_known")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``, and ``lost``, how many others the key had.

    An aggregate with a map-side combine; no key's rows are brought together.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("last"), (F.count(F.lit(1)) - 1).alias("lost"))
    return best.select(*keys, *[F.col(f"last.{c}").alias(c) for c in [*order, *rest]], "lost")


def first_filled(value: Column, order: Column) -> Column:
    """Aggregate: the first value that is neither null nor empty."""
    return F.min_by(value, F.when(value.isNotNull() & (value != ""), order))


def first_nonempty(parts: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """The rows of the first part that has any, tagged ``_kind``."""
    tagged = [df.withColumns({"_kind": F.lit(kind), "_prio": F.lit(k)}) for k, (kind, df) in enumerate(parts)]
    both = tagged[0]
    for other in tagged[1:]:
        both = both.unionByName(other)
    least = both.agg(F.min("_prio").alias("_least"))  # one row
    return both.join(F.broadcast(least), F.col("_prio") == F.col("_least")).drop("_prio", "_least")


def snapshot_diff(stored: DataFrame, found: DataFrame, key: str, version: str) -> DataFrame:
    """Keys that are ``deleted`` (stored only), ``new`` (found only) or ``stale`` (found version is larger)."""
    a, b = stored.select(key, F.col(version).alias("_old")), found.select(F.col(key).alias("_key"), F.col(version).alias("_new"))
    status = F.when(F.col("_key").isNull(), "deleted").when(F.col(key).isNull(), "new").when(F.col("_new") > F.col("_old"), "stale")
    both = a.join(b, F.col(key) == F.col("_key"), "full_outer")
    return both.select(F.coalesce(F.col(key), F.col("_key")).alias(key), status.alias("status")).where("status IS NOT NULL")


def replace_by_key(existing: DataFrame, fresh: DataFrame, key: str, changed: DataFrame | None = None) -> DataFrame:
    """``existing`` without the changed keys (by default those in ``fresh``), and all of ``fresh``."""
    keys = (changed if changed is not None else fresh).select(key).distinct()
    return existing.join(keys, key, "left_anti").unionByName(fresh)


def purge(existing: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """``existing`` without keys that aren't present any more."""
    return existing.join(present.select(key).distinct(), key, "left_semi")


def with_total(df: DataFrame, total: str, values: DataFrame, key: str, values_key: str) -> DataFrame:
    """``df`` with the number of rows of ``values`` that refer to each key (0 if none)."""
    n = values.groupBy(F.col(values_key).alias("_ref")).agg(F.count(F.lit(1)).alias(total))
    return df.join(n, F.col(key) == F.col("_ref"), "left").drop("_ref").withColumn(total, F.coalesce(total, F.lit(0)))


def exact_or_prefix(df: DataFrame, key: str, catalog: DataFrame, catalog_key: str, value: str, prefix: int = 4) -> DataFrame:
    """``df`` with the catalog's value for the key, else the one value that all names with its prefix have."""
    exact = catalog.groupBy(F.upper(catalog_key).alias("_exact")).agg(F.min(value).alias("_v1"))
    shared = catalog.groupBy(F.substring(F.upper(catalog_key), 1, prefix).alias("_prefix")).agg(F.min(value).alias("_v2"), F.count_distinct(value).alias("_n"))
    shared = shared.where("_n = 1").drop("_n")
    out = df.join(exact, F.upper(key) == F.col("_exact"), "left").join(shared, F.substring(F.upper(key), 1, prefix) == F.col("_prefix"), "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).drop("_exact", "_prefix", "_v1", "_v2")


def indexed_nowhere(candidates: DataFrame, column: str, table: str, indexed: str) -> DataFrame:
    """Columns that none of their candidate tables has indexed, reported for the alphabetically first table."""
    return candidates.groupBy(column).agg(F.min(table).alias(table), F.max(indexed).alias("any_indexed")).where("NOT any_indexed").drop("any_indexed")


def prefix_groups(df: DataFrame, scope: str, name: str, line: str, longest: int = 6, shortest: int = 3, least: int = 3) -> DataFrame:
    """Prefixes that at least ``least`` names of a scope share, longest first.

    A prefix is skipped where a longer emitted one of the scope begins with it. Every name
    gives ``longest - shortest + 1`` rows of a fixed size.
    """
    sizes = F.explode(F.sequence(F.lit(longest), F.lit(shortest), F.lit(-1)))
    rows = df.select(scope, F.lower(name).alias("_name"), F.col(name).alias("_own"), F.col(line).alias("_line"), sizes.alias("size"))
    rows = rows.where(F.length("_name") >= F.col("size")).withColumn("prefix", F.expr("substring(_name, 1, size)"))
    groups = rows.groupBy(scope, "prefix", "size").agg(
        F.count(F.lit(1)).alias("n"), F.min("_line").alias("first_line"), F.array_sort(F.collect_set("_own")).alias("names")
    )
    groups = groups.where(F.col("n") >= least)
    # a group is hidden by a longer one exactly where the longer prefix cut to its size is the same;
    # whether the longer one is emitted itself doesn't matter, as what hides that one hides this one too
    cuts = F.explode(F.sequence(F.lit(shortest), F.lit(longest - 1)))
    hides = groups.select(F.col(scope).alias("_s"), "prefix", cuts.alias("_size")).where(F.col("_size") < F.length("prefix"))
    hides = hides.select("_s", F.expr("substring(prefix, 1, _size)").alias("_p")).distinct()
    return groups.join(hides, (F.col(scope) == F.col("_s")) & (F.col("prefix") == F.col("_p")), "left_anti").drop("size")


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page of ordered rows with the number of all rows, and whether more follow."""
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    rows = df.orderBy(*order).offset(offset).limit(limit)
    shown = rows.join(F.broadcast(total), F.lit(True))
    return shown.withColumn("truncated", F.col("total") > offset + limit)


SEVERITIES = ("critical", "error", "warning", "info")


def severity_rank(column: Column | str) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    out = F.lit(len(SEVERITIES))
    for k, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(col == name, F.lit(k)).otherwise(out)
    return out


def by_partition_order(keys: Sequence[str], order: Sequence[Column]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)
