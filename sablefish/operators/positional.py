"""Operators on ordered rows: ranges, scopes, look-ahead, nearest following and interval containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_ends(df: DataFrame, scope: Sequence[str], start: str, total: str | Column, end: str = "range_end") -> DataFrame:
    """Each row's range ends before the next one starts, the last at ``total``; never before its own start."""
    after = F.lead(start).over(Window.partitionBy(*scope).orderBy(start))
    last = F.col(total) if isinstance(total, str) else total
    return df.withColumn(end, F.greatest(F.col(start), F.coalesce(after - 1, last)))


def unmatched(opens: DataFrame, closes: DataFrame, scope: Sequence[str], offset: str) -> DataFrame:
    """Opening rows beyond the number of closing rows of a scope, in order."""
    n = closes.groupBy(*scope).agg(F.count(F.lit(1)).alias("_closed"))
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(offset))
    return opens.join(n, list(scope), "left").withColumn("_rank", rank).where(F.col("_rank") > F.coalesce("_closed", F.lit(0))).drop("_closed", "_rank")


def exists_ahead(flag: Column, scope: Sequence[str], order: Sequence[Column], rows: int) -> Column:
    """Whether the flag holds for this row or one of the next ``rows``."""
    return F.bool_or(flag).over(Window.partitionBy(*scope).orderBy(*order).rowsBetween(0, rows))


def exists_behind(flag: Column, scope: Sequence[str], order: Sequence[Column], rows: int) -> Column:
    """Whether the flag holds for one of the ``rows`` before this one."""
    return F.coalesce(F.bool_or(flag).over(Window.partitionBy(*scope).orderBy(*order).rowsBetween(-rows, -1)), F.lit(False))


def next_following(df: DataFrame, scope: Sequence[str], position: str, wanted: Column, cap: int, name: str) -> DataFrame:
    """The position of the nearest later row that is wanted, where it is at most ``cap`` away."""
    # in descending order what follows is what came before: a growing frame, which is summed as it goes
    later = Window.partitionBy(*scope).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    found = F.min(F.when(wanted, F.col(position))).over(later)
    return df.withColumn(name, F.when(found - F.col(position) <= cap, found))


def innermost(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, name: str, cell: int) -> DataFrame:
    """``points`` with the name of the smallest range around each, ties by start, end and name.

    A range join without a nested loop: a range goes to each cell of width ``cell`` that
    it touches and a point to its own, so both meet by equality on the cell. With ``cell`` near the ranges'
    usual width a range has few cells, and rows of a cell stay few whatever the span. Each place is looked up once,
    however many points are there: places meet the ranges, and only a place and its name go back to the points.
    """
    cells = F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell)))
    spread = ranges.where(F.col(start) <= F.col(end)).select(F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(name).alias("_n"), cells.alias("_cell"))
    places = points.select(F.col(at).alias("_at")).where("_at IS NOT NULL").distinct()
    met = places.withColumn("_cell", F.floor(F.col("_at") / cell)).join(spread, "_cell").where("_at >= _s AND _at <= _e")
    best = met.groupBy("_at").agg(F.min(F.struct((F.col("_e") - F.col("_s")).alias("w"), "_s", "_e", "_n")).alias("best")).select("_at", F.col("best._n").alias(name))
    return points.join(best, F.col(at) == F.col("_at"), "left").drop("_at")


def enclosing_in_array(line: Column, ranges: Column, smallest: bool = True) -> Column:
    """The name of the range around a line, from an array of struct(start, stop, name) of the same row: no shuffle.

    The smallest range wins (the first of equals), or the first in the array.
    """
    around = F.filter(ranges, lambda r: (r["start"] <= line) & (line <= r["stop"]))
    if not smallest:
        return F.coalesce(F.get(around, F.lit(0))["name"], F.lit(""))
    sized = F.transform(around, lambda r, i: F.struct((r["stop"] - r["start"]).alias("w"), i.alias("i"), r["name"].alias("name")))
    return F.coalesce(F.array_min(sized)["name"], F.lit(""))
