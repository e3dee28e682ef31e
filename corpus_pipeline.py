"""The corpus pipeline: stages applied one after another to ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import copies, langid, mixing, packing, quality
from spindrift.llm.shared import discard, prepare, scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with a probability of a half or more."""
    prepare(spark)
    return langid.keep_identified(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the learned quantile."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    prepare(spark)
    return copies.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a schedule that gives each source its weight.

    The order is that of the rows in the files written: partitions are ranges
    of slots, and rows are sorted within them.
    """
    prepare(spark)
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, in the order of the mixture.

    Within windows of that order documents lie along a Hilbert curve.
    """
    prepare(spark)
    return packing.pack(docs, window=packing.WINDOW)


STAGES = [
    ("language ID", language),
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

#: Models and approximate search are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``.

    What a stage returns is written to the shared folder and read again, so
    no stage is computed twice; it is removed when the next one is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
