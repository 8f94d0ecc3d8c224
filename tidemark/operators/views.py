"""Changes through views: of a portion of time, and of what is current (slowly changing dimensions)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.period import forever, intersection
from tidemark.operators import intervals
from tidemark.operators.merge import TemporalMerge, temporal_merge
from tidemark.operators.ordering import dealt


def _value(x: Any, kind=None) -> Column:
    c = x if isinstance(x, Column) else F.lit(x)
    return c if kind is None else c.cast(kind)


def update_portion(df: DataFrame, identity: list[str], changes: dict[str, Any], start: Any, end: Any, where: Column | None = None, f: str = "valid_from", u: str = "valid_until", ephemeral: tuple[str, ...] = ()) -> TemporalMerge:
    """Set columns for the part of the matching rows' periods that lies in [start, end): one merge for all rows.

    Rows that the range does not touch stay as they are, as do the columns without a change.
    """
    kind = df.schema[f].dataType
    low, high = intersection(F.col(f), F.col(u), _value(start, kind), _value(end, kind))
    rows = df if where is None else df.where(where)
    rows = rows.withColumns({"_low": low, "_high": high}).where("_low < _high")
    types = dict(df.dtypes)
    rows = rows.withColumns({c: _value(v, types[c]) for c, v in changes.items()})
    others = [c for c in df.columns if c not in (f, u)]
    numbered = rows.select(F.xxhash64(*identity, "_low").alias("row_id"), *others, F.col("_low").alias(f), F.col("_high").alias(u))
    return temporal_merge(df, numbered, identity=identity, mode="UPDATE_FOR_PORTION_OF", ephemeral=ephemeral, f=f, u=u, persist=False)


def current_rows(df: DataFrame, now: Any = None, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """The rows in force now. Only date and timestamp periods have a present."""
    if forever(df.schema[f].dataType) is None:
        raise TypeError("a current view needs a date or timestamp period")
    return intervals.current(df, now, f, u)


def current_insert(df: DataFrame, new: DataFrame, identity: list[str], now: Any, row_id: str = "row_id", f: str = "valid_from", u: str = "valid_until", **spec) -> TemporalMerge:
    """Upsert rows (with a row_id) from now on, each new row without an identity being an entity of its own."""
    kind = df.schema[f].dataType
    rows = new.withColumns({f: _value(now, kind), u: forever(kind)})
    return temporal_merge(df, rows, identity=identity, mode="MERGE_ENTITY_UPSERT", row_id=row_id, founding_id=row_id, f=f, u=u, **spec)


def current_update(df: DataFrame, changes: dict[str, Any], where: Column, now: Any, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """Close the open rows that match at `now` and go on from there with the changes; a row that began now is changed in place."""
    kind = df.schema[f].dataType
    hit = F.coalesce(where & (F.col(u) == forever(kind)) & (F.col(f) <= _value(now, kind)), F.lit(False))
    types = dict(df.dtypes)
    # one pass over the table: a row stays as it is (0), or becomes what ends at `now` (1) and what begins then (2)
    parts = F.when(~F.col("_hit"), F.array(F.lit(0))).when(F.col(f) < F.col("_now"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    rows = df.withColumns({"_hit": hit, "_now": _value(now, kind)}).withColumn("_part", F.explode(parts))
    opened = lambda c, new: F.when(F.col("_part") == 2, new).otherwise(F.col(f"`{c}`"))
    rows = rows.withColumn(u, F.when(F.col("_part") == 1, F.col("_now")).otherwise(F.col(u))).withColumn(f, opened(f, F.col("_now")))
    return rows.withColumns({c: opened(c, _value(v, types[c])) for c, v in changes.items()}).select(*df.columns)


def current_end(df: DataFrame, where: Column, now: Any, changes: dict[str, Any] | None = None, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """Soft deletion: the open rows that match end at `now`, with the changes if any; a row that began now is removed."""
    kind = df.schema[f].dataType
    hit = F.coalesce(where & (F.col(u) == forever(kind)), F.lit(False))
    types = dict(df.dtypes)
    marked = df.withColumns({"_hit": hit, "_now": _value(now, kind)})
    ended = marked.where("_hit").where(F.col(f) < F.col("_now")).withColumn(u, F.col("_now")).withColumns({c: _value(v, types[c]) for c, v in (changes or {}).items()})
    return marked.where("not _hit").unionByName(ended).select(*df.columns)


def current_delete(df: DataFrame, where: Column, now: Any, delete_mode: str = "delete_as_cutoff", f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """Deletion from the current view: a cut-off at `now`, or refused where endings must be documented."""
    if delete_mode == "delete_as_documented_ending":
        raise ValueError("deletion is not allowed here; end the rows with current_end() and say why")
    if delete_mode != "delete_as_cutoff":
        raise ValueError(f"unknown delete mode {delete_mode}")
    return current_end(df, where, now, None, f, u)


def slices(df: DataFrame, keys: list[str], at: str, values: list[str], tie: list[str] | None = None, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """A history from events: each row of a key is in force until the next one, the last one for ever. Rows that the next
    one follows at once are dropped."""
    kind = df.schema[at].dataType
    own = Window.partitionBy(*keys).orderBy(at, *(tie or []))
    rows = dealt(df, *keys).select(*keys, *values, F.col(at).alias(f), F.coalesce(F.lead(at).over(own), forever(kind)).alias(u))
    return rows.where(F.col(f) < F.col(u))
