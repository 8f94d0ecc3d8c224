"""Reading tables, cutting lineage and ordering rows, shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.graph import components
from tidemark.operators.ordering import global_rank
from tidemark.sources.snapshots import shared_dir

__all__ = ["SPACE", "boxed", "columns_apart", "components", "global_rank", "lower_ascii", "new_path", "session_constant", "shared_dir", "stored", "table", "unboxed"]

#: White space of the contracts, as a Java character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "stage") -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_apart(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of the input can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def boxed(df: DataFrame) -> DataFrame:
    """df with each row in one struct column, row: whatever its columns are called, they can't clash with others."""
    return df.select(F.struct("*").alias("row"))


def unboxed(columns: list[str], replaced: dict[str, Column] | None = None) -> list[Column]:
    """The boxed columns again, for a select; those in `replaced` with their new value."""
    return [((replaced or {})[c] if c in (replaced or {}) else F.col("row").getField(c)).alias(c) for c in columns]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def session_constant(one: DataFrame) -> Column:
    """The only value of a one-row, one-column frame as a session variable, which expressions inside array functions can
    read. For values of a bounded size only."""
    spark, name = one.sparkSession, f"constant_{uuid.uuid4().hex}"
    one.createOrReplaceTempView(name)
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name}_value {one.dtypes[0][1]}")
    spark.sql(f"SET VAR {name}_value = (SELECT * FROM {name})")
    spark.catalog.dropTempView(name)
    return F.expr(f"session.{name}_value")
