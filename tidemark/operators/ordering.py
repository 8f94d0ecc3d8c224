"""Rows dealt for sorting, and positions in a total order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.snapshots import settled


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over all shuffle partitions. What a window asks for by itself, adaptive execution deals over fewer tasks, by
    its compressed size, and repetitive rows take ten times that to sort."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def global_rank(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """df with the 0-based position of each row: range partitions rank their own rows and add the rows before them."""
    parts = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(F.broadcast(offsets), "_part").withColumn(rank, (own + F.col("_start")).cast("long")).drop("_part", "_start")
