"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroscope.session import cut


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v bigint) to (node, root): root is the smallest node of the component; nodes without edges are absent.

    Alternating star contraction: each node hands its larger, then its smaller neighbours to the smallest node that it
    knows. Rounds grow with the logarithm of a component's size; each ends in a reliable checkpoint. Only the change
    test, one row, comes to the driver.
    """

    def large(e: DataFrame) -> DataFrame:
        e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return e.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.where("u <> v").select("u", "v").distinct())
    seen = mark(now)
    while seen[0]:
        now = cut(small(large(now)))
        after = mark(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
