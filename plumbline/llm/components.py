"""Connected components of an edge table by alternating large-star and small-star steps, on joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import staged


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least node m among u and its neighbours. The minimum is combined per task before the shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _with_least(down)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Whether every edge leads to a root: no node has two parents, no parent has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | (F.col("up") + F.col("down") > 1)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v) that is not a root itself; root is the least node of the component.

    Every double step writes its edges to the shared folder; the loop ends when each node points at its root."""
    now = edges.where("u <> v").select("u", "v")
    while True:
        now = staged(_small_star(_large_star(now)))
        if _is_settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
