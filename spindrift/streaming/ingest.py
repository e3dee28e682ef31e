"""Listings from pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spindrift import schemas
from spindrift.operators.listings import extract_listings


def page_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Pages of Parquet files ``(path, html, fetched)`` that appear in a folder."""
    schema = T.StructType([*schemas.PAGE.fields, T.StructField("fetched", T.TimestampType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def listing_stream(pages: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Records of new pages; a path seen again within ``lateness`` is left out.

    The watermark bounds the state to the paths of that time.
    """
    fresh = pages.withWatermark("fetched", lateness).dropDuplicatesWithinWatermark(["path"])
    return extract_listings(fresh)


def run_to_end(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Take in all that is there, append it to a Parquet table, and stop."""
    query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
