"""The corpus pipeline: documents through five operators, each stage written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import attach_copies, mix_sources
from tidemark.llm.quality import keep_quality
from tidemark.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labelled ones, doesn't reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), least=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines of 40 characters or more that five documents hold; n_chars is counted anew."""
    done = dedup_lines(docs, min_docs=5, min_chars=40)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more. Texts without words, which
    line dedup makes of copies, are one group."""
    return drop_near_duplicates(docs, similarity=0.8, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size (words), copies and taken (words, repeats counted)."""
    return attach_copies(docs, mix_sources(docs, weights=(5, 2, 1), most=3)).where("copies > 0")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: A trained classifier and SimHash can't be written in SQL; tests/llm/test_pipeline.py compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return docs
