"""Tables as Parquet snapshots: a folder with numbered snapshots and the number of the current one.

Spark can't overwrite a folder that a query still reads, so a new state is written beside the old one and then named the
current one; readers of the old state are not disturbed.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session gets one of its own; a cluster, whose machines
    don't share such a folder, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, its lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SnapshotTable:
    """A table in a folder. Paths may be of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _markers(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version long, writer string, batch long").json(f"{self.path}/_current/*")
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return None
            raise

    def _versions(self) -> list[int]:
        markers = self._markers()
        return [] if markers is None else sorted(r["version"] for r in markers.collect())

    def last_batch(self, writer: str) -> int | None:
        """The last batch that the table holds of a writer; None if there is none."""
        markers = self._markers()
        return None if markers is None else markers.where(F.col("writer") == writer).agg(F.max("batch")).first()[0]

    def exists(self) -> bool:
        return bool(self._versions())

    def version(self) -> int:
        return self._versions()[-1]

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/snapshot-{self.version() if version is None else version}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None, writer: str | None = None, batch: int | None = None) -> int:
        """Write a new snapshot, then make it the current one, in the name of a writer's batch if that is given. df may read
        older snapshots. Returns its number. A snapshot that was begun but never made the current one is written over."""
        number = (self._versions() or [0])[-1] + 1
        files = (df.write.partitionBy(*partition_by) if partition_by else df.write).mode("overwrite")
        files.parquet(f"{self.path}/snapshot-{number}")
        marker = self.spark.range(1).select(F.lit(number).cast("long").alias("version"), F.lit(writer).alias("writer"), F.lit(batch).cast("long").alias("batch"))
        marker.coalesce(1).write.json(f"{self.path}/_current/{number}")
        return number
