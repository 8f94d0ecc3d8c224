"""Temporal unique keys and foreign keys as validators: each returns the rows that break the rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.coverage import merge_islands


def _overlapping(df: DataFrame, keys: list[str], f: str, u: str) -> DataFrame:
    """Rows that start before an earlier row of their key has ended: one sort, no self-join."""
    own = Window.partitionBy(*keys).orderBy(f, u).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_reached", F.max(u).over(own)).where(F.col(f) < F.col("_reached")).drop("_reached")


def unique_key_violations(df: DataFrame, columns: list[str], kind: str = "natural", predicate: str | None = None, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """Rows that break a key, as df's columns and `violation` ("overlap" or "null").

    kind: "primary" (no nulls, no two rows of a key overlap), "natural" (rows with a null in the key never conflict),
    "predicated" (a natural key of the rows that the SQL predicate picks), "exclusive" (keys of which columns may be null
    in turn; nulls are equal).
    """
    if (predicate is not None) != (kind == "predicated"):
        raise ValueError("a predicated key, and only it, has a predicate")
    rows = df if predicate is None else df.where(F.expr(predicate))
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    nulls = None
    if kind == "primary":
        nulls = rows.where(any_null).withColumn("violation", F.lit("null"))
    if kind != "exclusive":
        rows = rows.where(~any_null)
    clashes = _overlapping(rows, columns, f, u).withColumn("violation", F.lit("overlap"))
    return clashes if nulls is None else clashes.unionByName(nulls)


def pk_consistency_violations(df: DataFrame, natural: list[str], primary: list[str], exclusive: bool = False) -> DataFrame:
    """Natural keys that ever belonged to more than one primary key: the key and `owners`. Without exclusive, keys with a
    null are left out; with it, rows are compared by the columns that they have."""
    rows = df if exclusive else df.dropna(subset=natural)
    return rows.groupBy(*natural).agg(F.count_distinct(F.struct(*primary)).alias("owners")).where("owners > 1")


def _matched(child: DataFrame, columns: list[str], match: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is to be looked up, and rows that break the match type on their own."""
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
    if match == "simple":
        return child.where(nulls == 0), child.limit(0)
    if match == "full":
        return child.where(nulls == 0), child.where((nulls > 0) & (nulls < len(columns)))
    raise ValueError("match is simple or full; partial is not implemented")


def temporal_fk_violations(
    child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str] | None = None, f: str = "valid_from", u: str = "valid_until", parent_f: str | None = None,
    parent_u: str | None = None, match: str = "simple",
) -> DataFrame:
    """Child rows whose whole period the parent rows of their key do not cover together.

    The parent's periods are merged into blocks; a child is sound if one block holds its period. An anti-join on the key
    with the containment as residual. Periods of both sides must be of one type.
    """
    parent_columns, pf, pu = parent_columns or columns, parent_f or f, parent_u or u
    if dict(child.dtypes)[f] != dict(parent.dtypes)[pf]:
        raise TypeError("child and parent have periods of different types")
    looked_up, broken = _matched(child, columns, match)
    blocks = merge_islands(parent.dropna(subset=parent_columns), parent_columns, pf, pu)
    blocks = blocks.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(parent_columns)], F.col(pf).alias("_pf"), F.col(pu).alias("_pu"))
    same = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)]
    missing = looked_up.join(blocks, [*same, F.col("_pf") <= F.col(f), F.col("_pu") >= F.col(u)], "left_anti")
    return missing.unionByName(broken)


def regular_fk_violations(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str] | None = None, match: str = "simple") -> DataFrame:
    """Child rows whose key no parent row has at any time."""
    looked_up, broken = _matched(child, columns, match)
    keys = parent.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(parent_columns or columns)]).distinct()
    missing = looked_up.join(keys, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)], "left_anti")
    return missing.unionByName(broken)


def parent_delete_violations(child: DataFrame, parent: DataFrame, deleted: DataFrame, columns: list[str], parent_columns: list[str] | None = None, temporal: bool = True, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """Child rows that deleting parent rows would leave without their parent.

    Temporal: not covered by what is left of the parent. Regular: any child of a deleted row's key, even if other versions
    of the key stay.
    """
    own = parent_columns or columns
    if temporal:
        return temporal_fk_violations(child, parent.exceptAll(deleted.select(*parent.columns)), columns, own, f, u)
    gone = deleted.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(own)]).distinct()
    return child.join(gone, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)], "left_semi")


def parent_update_violations(child: DataFrame, parent: DataFrame, old: DataFrame, new: DataFrame, columns: list[str], parent_columns: list[str] | None = None, f: str = "valid_from", u: str = "valid_until") -> DataFrame:
    """Child rows that are not covered once the old parent rows are replaced by the new ones."""
    after = parent.exceptAll(old.select(*parent.columns)).unionByName(new.select(*parent.columns))
    return temporal_fk_violations(child, after, columns, parent_columns or columns, f, u)
