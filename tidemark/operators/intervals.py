"""Point-in-time and range queries over periods, and joins of periods."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.period import contains_point, intersection, overlaps


BACKWARDS = "range lower bound must be less than or equal to range upper bound"


def _value(at: Any) -> Column:
    return at if isinstance(at, Column) else F.lit(at)


def as_of(df: DataFrame, at: Any, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """Rows in force at an instant. The comparisons are on bare columns and reach the scan."""
    return df.where(contains_point(F.col(f), F.col(u), _value(at)))


def between(df: DataFrame, a: Any, b: Any, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """Rows that meet the closed range [a, b]; a must not be after b: plain values are refused at once, columns fail the query."""
    if not isinstance(a, Column) and not isinstance(b, Column):
        if a > b:
            raise ValueError(BACKWARDS)
        return df.where((F.col(f) <= b) & (F.col(u) > a))
    low = F.when(_value(a) > _value(b), F.raise_error(F.lit(BACKWARDS))).otherwise(_value(a))
    return df.where((F.col(f) <= _value(b)) & (F.col(u) > low))


def between_symmetric(df: DataFrame, a: Any, b: Any, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """Rows that meet the closed range between a and b, whichever comes first."""
    low, high = F.least(_value(a), _value(b)), F.greatest(_value(a), _value(b))
    return df.where((F.col(f) <= high) & (F.col(u) > low))


def from_to(df: DataFrame, a: Any, b: Any, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """Rows that meet the half-open range [a, b); none if it is empty."""
    return df.where((F.col(f) < _value(b)) & (F.col(u) > _value(a)) & (_value(a) < _value(b)))


def current(df: DataFrame, now: Any = None, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    return as_of(df, F.current_timestamp() if now is None else now, f, u)


def temporal_join(left: DataFrame, right: DataFrame, on: list[str], f: str = "valid_from", u: str = "valid_until", how: str = "inner") -> DataFrame:
    """Rows of both sides with equal keys and overlapping periods, with the common part as the period.

    An equi-join with the overlap as residual. how="left" keeps left rows without a partner, with their own period.
    """
    r = right.select(*on, *[F.col(c).alias(c if c not in left.columns else f"right_{c}") for c in right.columns if c not in (*on, f, u)], F.col(f).alias("_rf"), F.col(u).alias("_ru"))
    both = left.alias("l").join(r.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in on] + [overlaps(F.col(f"l.{f}"), F.col(f"l.{u}"), F.col("r._rf"), F.col("r._ru"))], how)
    start, end = intersection(F.col(f"l.{f}"), F.col(f"l.{u}"), F.col("r._rf"), F.col("r._ru"))
    others = [F.col(f"l.{c}") for c in left.columns if c not in (f, u)] + [F.col(f"r.{c}") for c in r.columns if c not in (*on, "_rf", "_ru")]
    return both.select(*others, start.alias(f), end.alias(u))


def overlap_join(left: DataFrame, right: DataFrame, width: Any, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """Pairs of overlapping periods of two frames without a common key, columns of the right side prefixed with right_.

    Both sides are dealt into time buckets `width` seconds (or numbers) wide and joined on the bucket; a pair is made only
    in the first bucket that its members share. Choose a width near the usual length of a period. No period is dealt beyond
    the last start of the other side, so open ends cost no more than the others.
    """
    number = lambda c, df: F.unix_seconds(F.col(c).cast("timestamp")) if dict(df.dtypes)[c] in ("date", "timestamp", "timestamp_ntz") else F.col(c)
    started = lambda df: df.withColumn("_b0", F.floor(number(f, df) / width))

    def deal(df: DataFrame, other: DataFrame) -> DataFrame:
        last = other.agg(F.max("_b0").alias("_last"))
        reach = F.greatest("_b0", F.least(F.floor(number(u, df) / width), F.col("_last")))
        return df.where(F.col(f) < F.col(u)).crossJoin(F.broadcast(last)).withColumn("_b", F.explode(F.sequence("_b0", reach))).drop("_last")

    l, r = started(left), started(right)  # noqa: E741
    l, r = deal(l, r), deal(r, l)  # noqa: E741
    r = r.select(*[F.col(c).alias(c if c == "_b" else f"right_{c}") for c in r.columns])
    pairs = l.join(r, "_b").where((F.col("_b") == F.greatest("_b0", "right__b0")) & overlaps(F.col(f), F.col(u), F.col(f"right_{f}"), F.col(f"right_{u}")))
    return pairs.drop("_b", "_b0", "right__b0")


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], at: str, values: list[str], f: str = "valid_from", u: str | None = None) -> DataFrame:
    """left with the values of the right row of its key that is in force at left.at: the last one that starts by then and,
    with u, has not ended. One sort of both sides together, no pairs: the cost does not grow with a key's history."""
    marked = left.withColumns({"_at": F.col(at), "_own": F.lit(True), "_row": F.struct(*left.columns)}).select(*on, "_at", "_own", "_row")
    marked = marked.withColumn("_state", F.lit(None).cast(right.select(F.struct(*values, *([u] if u else [])).alias("s")).schema["s"].dataType))
    states = right.select(*on, F.col(f).alias("_at"), F.lit(False).alias("_own"), F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"), F.struct(*values, *([u] if u else [])).alias("_state"))
    own = Window.partitionBy(*on).orderBy("_at", "_own").rowsBetween(Window.unboundedPreceding, 0)
    filled = states.unionByName(marked).withColumn("_last", F.last("_state", ignorenulls=True).over(own)).where("_own")
    alive = F.col(f"_last.{u}") > F.col("_at") if u else F.lit(True)
    return filled.select("_row.*", *[F.when(alive, F.col(f"_last.{v}")).alias(v if v not in left.columns else f"right_{v}") for v in values])


def allen_pairs(df: DataFrame, keys: list[str], id_col: str, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """For each pair of a key's rows (the smaller id first): keys, id, other_id and the Allen relation."""
    from tidemark.functions.period import allen

    a = df.select(*keys, F.col(id_col).alias("id"), F.col(f).alias("_xf"), F.col(u).alias("_xu"))
    b = df.select(*keys, F.col(id_col).alias("other_id"), F.col(f).alias("_yf"), F.col(u).alias("_yu"))
    pairs = a.join(b, keys).where("id < other_id")
    return pairs.select(*keys, "id", "other_id", allen(F.col("_xf"), F.col("_xu"), F.col("_yf"), F.col("_yu")).alias("relation"))
