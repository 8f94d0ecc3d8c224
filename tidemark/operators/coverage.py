"""Coverage of time by periods: maximal blocks, gaps, coalescing of equal neighbours, and the gap-free coverage test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_islands(df: DataFrame, keys: list[str], f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """keys, f, u of the maximal blocks that the periods of each key cover; overlapping and adjacent ones are merged.
    Rows with a null boundary or an empty period are skipped."""
    own = Window.partitionBy(*keys).orderBy(f, u)
    reached = F.max(u).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.select(*keys, f, u).where(F.col(f) < F.col(u))
    rows = rows.withColumn("_new", (reached.isNull() | (F.col(f) > reached)).cast("int"))
    rows = rows.withColumn("_block", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_block").agg(F.min(f).alias(f), F.max(u).alias(u)).drop("_block")


def gaps(df: DataFrame, keys: list[str], f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """keys, f, u of the holes between the blocks of each key."""
    following = F.lead(f).over(Window.partitionBy(*keys).orderBy(f))
    blocks = merge_islands(df, keys, f, u).withColumn("_next", following)
    return blocks.where("_next is not null").select(*keys, F.col(u).alias(f), F.col("_next").alias(u))


def coalesce_periods(df: DataFrame, keys: list[str], values: list[str], f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """Adjacent rows of a key with equal values (nulls being equal) as one row. Periods of a key must not overlap."""
    own = Window.partitionBy(*keys).orderBy(f, u)
    same = F.lag(u).over(own) == F.col(f)
    for value in values:
        same = same & F.lag(value).over(own).eqNullSafe(F.col(value))
    rows = df.select(*keys, *values, f, u).withColumn("_new", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("_block", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(*keys, "_block").agg(*[F.first(v).alias(v) for v in values], F.min(f).alias(f), F.max(u).alias(u))
    return found.select(*keys, *values, f, u)


def covers_without_gaps(
    df: DataFrame, keys: list[str], target_from: str, target_until: str, f: str = "valid_from", u: str = "valid_until", bounds: str | None = None, target_bounds: str = "[)"
) -> DataFrame:
    """keys and `covered`: do the periods of a group, in order, cover its target without a gap?

    The first period must not start after the target, and none may start after what is covered so far until the target's
    end is reached; so a hole before the target counts as well. Null and empty periods are skipped; a null target gives
    null, an empty one true, a group without periods null. All rows of a group must have one target, else the query fails.
    bounds: a column with each period's bounds, such as [) or (], for continuous types; two exclusive bounds that meet
    leave a gap.
    """
    opened = F.startswith(F.col(bounds), F.lit("[")) if bounds else F.lit(True)
    closed = F.endswith(F.col(bounds), F.lit("]")) if bounds else F.lit(False)
    rows = df.select(
        *keys, F.col(f).alias("_f"), F.col(u).alias("_u"), F.col(target_from).alias("_tf"), F.col(target_until).alias("_tu"),
        (~opened).alias("_after"), closed.alias("_closed"))
    target_after, target_closed = F.lit(target_bounds[0] == "("), F.lit(target_bounds[1] == "]")
    end, target_end = F.struct("_u", "_closed"), F.struct(F.col("_tu").alias("_u"), target_closed.alias("_closed"))
    valid = F.col("_f").isNotNull() & F.col("_u").isNotNull() & ((F.col("_f") < F.col("_u")) | ((F.col("_f") == F.col("_u")) & ~F.col("_after") & F.col("_closed")))
    own = Window.partitionBy(*keys).orderBy(F.when(valid, 0).otherwise(1), "_f", "_after")
    reached = F.max(F.when(valid, end)).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_valid": valid, "_reached": reached})
    apart = (F.col("_f") > F.col("_reached._u")) | ((F.col("_f") == F.col("_reached._u")) & F.col("_after") & ~F.col("_reached._closed"))
    gap = F.col("_valid") & F.col("_reached").isNotNull() & apart & (F.col("_reached") < target_end)
    start, target_start = F.struct("_f", "_after"), F.struct(F.col("_tf").alias("_f"), target_after.alias("_after"))
    found = rows.groupBy(*keys).agg(
        F.min("_tf").alias("_tf"), F.max("_tf").alias("_tf2"), F.min("_tu").alias("_tu"), F.max("_tu").alias("_tu2"), F.count_if(F.col("_tf").isNull() | F.col("_tu").isNull()).alias("_nulls"),
        F.count_if("_valid").alias("_n"), F.coalesce(F.max(gap), F.lit(False)).alias("_gap"), F.max(F.when(F.col("_valid"), start <= target_start)).alias("_starts"), F.max(F.when(F.col("_valid"), end >= target_end)).alias("_ends"))
    return found.select(*keys, _verdict().alias("covered"))


def _verdict() -> Column:
    changed = (F.col("_tf") != F.col("_tf2")) | (F.col("_tu") != F.col("_tu2"))
    return (
        F.when(changed, F.raise_error(F.lit("the target must be the same in all rows of a group")).cast("boolean"))
        .when(F.col("_nulls") > 0, F.lit(None).cast("boolean"))
        .when(F.col("_tf") >= F.col("_tu"), F.lit(True))
        .when(F.col("_n") == 0, F.lit(None).cast("boolean"))
        .otherwise(F.col("_starts") & F.col("_ends") & ~F.col("_gap"))
    )
