"""Bounded breadth-first search over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

MOST_LEVELS = 3


def clamp_depth(depth: int) -> int:
    return max(1, min(depth, MOST_LEVELS))


def reach(edges: DataFrame, seeds: DataFrame, depth: int = MOST_LEVELS, both_ways: bool = False) -> DataFrame:
    """node, level and via (the smallest parent on the level before) of every node within ``depth`` steps.

    ``edges`` has src and dst, ``seeds`` has node. Each level is one equi-join of the frontier with
    the edges, deduplicated by aggregation, and an anti join with the nodes seen so far. The edges and each frontier are
    staged, so no level computes another again; an empty frontier ends the search. Seeds have level 0 and no parent.
    """
    step = edges.select("src", "dst")
    if both_ways:
        step = step.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    spark = edges.sparkSession
    step = staged(spark, step.where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    seen = seeds.select("node").distinct().select("node", F.lit(0).alias("level"), F.lit(None).cast(seeds.schema["node"].dataType).alias("via"))
    seen = staged(spark, seen, "seeds")
    frontier = seen
    for level in range(1, clamp_depth(depth) + 1):
        out = step.join(frontier.select(F.col("node").alias("src")), "src").groupBy("dst").agg(F.min("src").alias("via"))
        fresh = out.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        frontier = staged(spark, fresh.select(F.col("dst").alias("node"), F.lit(level).alias("level"), "via"), f"frontier-{level}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def cascade(edges: DataFrame, seeds: DataFrame, depth: int = MOST_LEVELS) -> DataFrame:
    """Every edge within ``depth`` steps of the seeds in either direction, once, at its smallest level.

    Columns: level, src, dst and via, the node from which the edge was taken on that level.
    """
    nodes = reach(edges, seeds, depth, both_ways=True).select("node", "level")
    ends = edges.select("src", "dst").distinct()
    near = nodes.where(F.col("level") < clamp_depth(depth))
    taken = ends.join(near.withColumnRenamed("node", "src"), "src").select("src", "dst", (F.col("level") + 1).alias("level"), F.col("src").alias("via"))
    back = ends.join(near.withColumnRenamed("node", "dst"), "dst").select("src", "dst", (F.col("level") + 1).alias("level"), F.col("dst").alias("via"))
    both = taken.unionByName(back).groupBy("src", "dst").agg(F.min(F.struct("level", "via")).alias("first"))
    return both.select("first.level", "src", "dst", "first.via")
