"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z lower-cased; 128 bits of its hash stand for it.
LineRuns keeps, for each key, how many documents hold it and the document that came first. Every run is a table bucketed and
sorted by key, and a batch of documents is brought into the same buckets once: it is merged with the runs bucket by bucket,
without another shuffle of theirs. Keys that the anti-join with all runs leaves over are new and get the batch's document; the
others only add to the count. The batch's keys become a new sorted run on level 0; when a level has `fanout` runs they are
merged into one run of the next level, again bucket by bucket, so a key is rewritten once a level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, columns_apart, new_path, stored, unboxed

KEY = ["h1", "h2"]
STRIPPED = b" \t\n\x0b\x0c\r"
#: Keys that more than this share of all (key, document) pairs fall on are at most as many as its inverse.
HOT_SHARE = 1e-4


def _line_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, positions, h1, h2, firsts = [], [], [], [], [], []
            for doc, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if text is None:
                    continue
                found = set()
                for position, line in enumerate(text.encode().split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(STRIPPED).lower()
                    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
                        continue
                    digest = xxhash.xxh3_128_digest(key)
                    ids.append(doc)
                    hashes.append(text_hash)
                    positions.append(position)
                    h1.append(int.from_bytes(digest[:8], "big", signed=True))
                    h2.append(int.from_bytes(digest[8:], "big", signed=True))
                    firsts.append(digest not in found)
                    found.add(digest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(positions, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(firsts, pa.bool_())],
                ["doc", "text_hash", "position", *KEY, "first"],
            )

    return run


def line_keys(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line with a key of at least min_chars code points: doc, text_hash, position, h1, h2, and whether it is the document's first line with that key."""
    rows = columns_apart(docs, id_col, text_col).toDF("doc", "text").where("doc is not null and text is not null")
    rows = rows.select(F.col("doc").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_line_keys(min_chars), "doc long, text_hash long, position int, h1 long, h2 long, first boolean")


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Scans of tables with one file a bucket give rows in the order in which they were sorted, so that joins merge them."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levelled sorted runs of (key, number of documents, document that came first), one of the rows of a key having the
    document. Tables of the session's catalog with their files in the shared folder; release() drops the tables."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _runs(self) -> list[tuple[str, str]]:
        """(table, path) of all runs, the oldest first."""
        return [run for level in reversed(self.levels) for run in level]

    def _write(self, keys: DataFrame, level: int) -> None:
        path = new_path(self.spark, f"lines-{level}")
        name = f"lines_{uuid.uuid4().hex}"
        with _sorted_scans(self.spark):
            keys.write.option("compression", "zstd").option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    @staticmethod
    def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.alias("o").hint("merge").join(new.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY], "full")
        count = F.coalesce("o.n_docs", F.lit(0)) + F.coalesce("n.n_docs", F.lit(0))
        return both.select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in KEY], count.alias("n_docs"), F.coalesce("o.keeper", "n.keeper").alias("keeper"))

    def entries(self) -> DataFrame:
        """One row for each key over all runs: h1, h2, n_docs, keeper. Read from the files, so release() doesn't end it."""
        schema, paths = "h1 long, h2 long, n_docs long, keeper long", [path for _, path in self._runs()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(*paths)
        return found if len(paths) == 1 else found.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def marked(self, lines: DataFrame) -> DataFrame:
        """The keys of a batch with n_docs (distinct documents), and keeper (the largest) where no run holds the key yet."""
        pairs = lines.where("first").groupBy(*KEY, "doc").agg(F.lit(0).alias("_"))
        own = pairs.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        for name, _ in self._runs():
            known = self.spark.table(name).select(*KEY, F.lit(True).alias("known")).hint("merge")
            own = own.join(known, KEY, "left").select(*KEY, "n_docs", F.when(F.col("known").isNull(), F.col("keeper")).alias("keeper"))
        return own

    def add(self, lines: DataFrame) -> None:
        """Merge-anti-join a batch with the runs, add its keys as a run, and compact levels that are full."""
        self._write(self.marked(lines), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            while len(full) > 1:
                (old, _), (new, _) = full[:2]
                self._write(self._merged(self.spark.table(old), self.spark.table(new)), level + 1)
                for name in (old, new):
                    self.spark.sql(f"DROP TABLE {name}")
                full = [*([self.levels[level + 1].pop()] if len(full) > 2 else []), *full[2:]]
            level += 1

    def release(self) -> None:
        for name, _ in self._runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def fresh(self, lines: DataFrame) -> DataFrame:
        """The batch's lines whose key no run holds yet."""
        return lines.join(self.entries().select(*KEY), KEY, "left_anti")

    def repeated(self, lines: DataFrame, min_docs: int) -> DataFrame:
        """The lines that go: their key is in min_docs documents or more and came first in another document.

        Keys with more than HOT_SHARE of all pairs, at most 1 / HOT_SHARE of them, are joined by broadcast; the rest by a
        shuffle in which no key is large.
        """
        keys = self.entries().where(F.col("n_docs") >= min_docs)
        pairs = self.entries().agg(F.sum("n_docs").alias("n")).first()["n"] or 0
        limit = max(min_docs, int(pairs * HOT_SHARE) + 1)
        hot, cold = F.broadcast(keys.where(F.col("n_docs") >= limit)), keys.where(F.col("n_docs") < limit)
        common = lines.join(hot, KEY)
        rare = lines.join(hot.select(*KEY), KEY, "left_anti").join(cold, KEY)
        return common.unionByName(rare).where("doc <> keeper")


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", batches: int = 4) -> DataFrame:
    """docs without the lines that at least min_docs documents hold, but for those of the largest id that holds them.

    Lines are split at \\n; their keys are those of this module's docstring, and keys under min_chars code points are never
    dropped. The documents go through LineRuns in `batches` batches of descending id. Returns the columns of docs with the
    text replaced, and n_lines (before dropping) and n_dropped; input columns of these two names are replaced.

    A null text counts as empty: one empty line, kept as an empty text. Rows with a null id are not counted and keep
    their lines. Rows that repeat an id are one document for the number of documents, and the largest id keeps the line in
    all its rows. A text of any length is one row's work. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    lines = stored(line_keys(docs, min_chars, id_col, text_col), "line-keys")
    cuts = lines.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)] or [0.5], 1000).alias("cuts")).first()["cuts"] or []
    runs = LineRuns(spark)
    above = None
    for cut in [*sorted(set(cuts if batches > 1 else []), reverse=True), None]:
        batch = lines if cut is None else lines.where(F.col("doc") > cut)
        runs.add(batch if above is None else batch.where(F.col("doc") <= above))
        above = cut
    runs.release()
    gone = runs.repeated(lines, min_docs).groupBy("doc", "text_hash").agg(F.collect_set("position").alias("gone"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = boxed(docs).withColumn("text", F.coalesce(F.col("row").getField(text_col), F.lit("")))
    same = (F.col("row").getField(id_col).cast("long") == F.col("doc")) & (F.xxhash64("text") == F.col("text_hash"))
    joined = rows.join(gone, same, "left").withColumn("parts", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("parts"), i)), "\n"))
    return joined.select(*unboxed(columns, {text_col: kept}), F.size("parts").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
