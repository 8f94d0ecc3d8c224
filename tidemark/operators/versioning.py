"""System time: what a table held, and since when, kept by comparing its states."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals

FROM, UNTIL = "system_valid_from", "system_valid_until"


def _time(at: Any) -> Column:
    return (at if isinstance(at, Column) else F.lit(at)).cast("timestamp_ntz")


def stamp(df: DataFrame, at: Any) -> DataFrame:
    """df as of its first state: every row in force from `at` on."""
    at = _time(at)
    return df.withColumn(FROM, at).withColumn(UNTIL, F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz"))


def _changed(columns: list[str], excluded: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for c in columns:
        if c not in excluded:
            out = out | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return out


def record_change(before: DataFrame, after: DataFrame, key: list[str], at: Any, excluded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(the new stamped table, the rows for its history) when a stamped table becomes `after` at one instant.

    before has the stamps, after has not. A row that is new or differs in a column that is not excluded is stamped anew;
    rows that changed or went are closed at `at` in the history, but for those that began at that instant. A row that
    began later fails the query. Both sides are read once and joined on the key.
    """
    at, columns = _time(at), [c for c in after.columns if c not in key]
    joined = before.alias("o").join(after.alias("n").withColumn("_there", F.lit(True)), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full")
    joined = joined.withColumns({"_old": F.col(f"o.{FROM}").isNotNull(), "_new": F.coalesce("_there", F.lit(False)), "_at": at})
    changed = _changed(columns, excluded)
    fresh = ~F.col("_old") | changed
    now = joined.where("_new").select(
        *[F.col(f"n.{c}") for c in after.columns], F.when(fresh, F.col("_at")).otherwise(F.col(f"o.{FROM}")).alias(FROM), F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz").alias(UNTIL))
    late = F.when(F.col(f"o.{FROM}") > F.col("_at"), F.raise_error(F.lit("a row began after the change that closes it")).cast("timestamp_ntz")).otherwise(F.col("_at"))
    closed = joined.where(F.col("_old") & (~F.col("_new") | changed) & (F.col(f"o.{FROM}") != F.col("_at")))
    return now, closed.select(*[F.col(f"o.{c}") for c in after.columns], F.col(f"o.{FROM}"), late.alias(UNTIL))


def with_history(table: DataFrame, history: DataFrame) -> DataFrame:
    return table.unionByName(history)


def state_as_of(both: DataFrame, at: Any) -> DataFrame:
    return intervals.as_of(both, _time(at), FROM, UNTIL)


def states_between(both: DataFrame, a: Any, b: Any) -> DataFrame:
    """Rows in force at some time of [a, b]; the query fails if a is after b."""
    return intervals.between(both, _time(a), _time(b), FROM, UNTIL)


def states_between_symmetric(both: DataFrame, a: Any, b: Any) -> DataFrame:
    return intervals.between_symmetric(both, _time(a), _time(b), FROM, UNTIL)


def states_from_to(both: DataFrame, a: Any, b: Any) -> DataFrame:
    return intervals.from_to(both, _time(a), _time(b), FROM, UNTIL)


def truncated(table: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both emptied."""
    return table.limit(0), history.limit(0)


