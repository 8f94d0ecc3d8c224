"""Connected components by repeated minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.snapshots import settled


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node and root (the smallest node that it reaches) for all nodes of the edges a, b, by large and small stars.

    Every round is a minimum and a join on the node, and is settled in the shared folder.
    """
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(max_rounds):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == state or not sign[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = sign
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = settled(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct())
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
