"""Connected components by alternating large and small stars, as DataFrames.

Each round points every node's larger neighbours, then its smaller ones, at its smallest neighbour;
the number of rounds grows with the logarithm of the longest path. Nothing is collected: rounds are
written tables, and two sums tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """edges (u, v), u > v. Large star keeps neighbours above u, small star those up to u."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.withColumnRenamed("m", "v"))
    return moved.where("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: longs, either order, no nulls) that is not
    itself its component's smallest node; root is that smallest node. No edges, no rows."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = None
    for _ in range(max_rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        now = written(_stars(_stars(now, True), False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
