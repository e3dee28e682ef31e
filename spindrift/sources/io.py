"""Reads and writes of pages, listings, articles, crawl files and indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from spindrift import schemas
from spindrift.sources.shared import discard, exists, file_system

#: Tables of tab-separated values, as csv modules read and write them.
TSV = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": True, "maxCharsPerColumn": -1}


def read_pages(spark: SparkSession, *folders: str) -> DataFrame:
    """``(path, html)`` of every file whose name ends in ``.html``, in any case.

    The filter is on names alone, so other files are listed and not read.
    """
    read = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("recursiveFileLookup", True)
    pages = read.option("pathGlobFilter", "*.[hH][tT][mM][lL]").text(list(folders), wholetext=True)
    return pages.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_page(spark: SparkSession, path: str) -> DataFrame:
    """One page; none if it is not there or cannot be read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.PAGE)
    read = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("html"))


def read_tsv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A table with a header, all strings; columns are those of the schema if one is given."""
    read = spark.read.options(**TSV)
    return (read.schema(schema) if schema else read).csv(path)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.LISTING)


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an XML dump; the schema is given, so the dump is read once."""
    return spark.read.schema(schemas.WIKI_DUMP).option("rowTag", "page").format("xml").load(path)


def read_wiki_cities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WIKI_CITY).parquet(path)


def read_crawl_jobs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each job of a JSON file, with the default cap where none is named."""
    jobs = spark.read.schema(schemas.CRAWL_JOBS).option("multiLine", True).json(path)
    each = jobs.select(F.explode("scrape_params").alias("job")).select("job.*")
    return each.fillna({"max_saves": schemas.DEFAULT_SAVES, "validation_pattern": "", "property_url_regex_full": ""})


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a ledger: a JSON array in a file, or lines of JSON in the files of a folder.

    A ledger that is missing or broken has no rows.
    """
    found = _current(spark, path)
    if not found:
        return spark.createDataFrame([], schemas.LEDGER)
    # a file that is no JSON is one record without a URL
    where, files = file_system(spark, found)
    array = files.getFileStatus(where).isFile()
    return spark.read.schema(schemas.LEDGER).option("multiLine", array).option("mode", "PERMISSIVE").json(found).where("property_url is not null")


def write_ledger(rows: DataFrame, path: str) -> None:
    """Put a ledger in the place of the one at ``path``, as lines of JSON in part files.

    ``rows`` may come from the ledger that is replaced.
    """
    _replace(rows.select(*schemas.LEDGER.names), path, lambda out, to: out.json(to))


def append_ledger(rows: DataFrame, path: str) -> DataFrame:
    """Add those rows whose URL the country's ledger does not have, and return the ledger."""
    from spindrift.operators.crawl import append_new

    spark = rows.sparkSession
    write_ledger(append_new(read_ledger(spark, path), rows), path)
    return read_ledger(spark, path)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a JSON array of strings, in their order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("seq", "url"))


def read_crawl_state(spark: SparkSession, path: str) -> DataFrame:
    """The last state that was written whole; none if there is no such state."""
    found = _current(spark, path)
    return spark.read.text(found, wholetext=True) if found else spark.createDataFrame([], "value string")


def write_state_lines(rows: DataFrame, path: str) -> None:
    """Put a state in the place of the one at ``path``, as lines of JSON in part files."""
    _replace(rows, path, lambda out, to: out.json(to))


def read_state_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the last state that was written whole, also of a state in one line; none if there is no such state."""
    found = _current(spark, path)
    return spark.read.schema(schemas.CRAWL_STATE_LINES).json(found) if found else spark.createDataFrame([], schemas.CRAWL_STATE_LINES)


def write_tsv(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """A table with a header; one file only if asked for.

    For one file the finished rows are brought together by a shuffle, so the
    work before it stays spread over all tasks.
    """
    out = rows.repartition(1) if single_file else rows
    out.write.mode("overwrite").options(sep="\t", header=True, quote='"', escape='"').csv(path)


def write_parquet(rows: DataFrame, path: str, *partitions: str) -> None:
    out = rows.write.mode("overwrite")
    (out.partitionBy(*partitions) if partitions else out).parquet(path)


def write_pages(visits: DataFrame, path: str) -> None:
    """Saved pages as a table; small files in numbers are spared."""
    visits.where("saved").select("url", "html").write.mode("overwrite").parquet(path)


def replace_text(rows: DataFrame, path: str) -> None:
    """Put a one-column table in the place of the one at ``path``."""
    _replace(rows.coalesce(1), path, lambda out, to: out.text(to))


def _replace(rows: DataFrame, path: str, write: Callable[[DataFrameWriter, str], None]) -> None:
    """Write a table beside ``path`` and then put it in its place.

    A rename cannot replace a folder, so the old table is first renamed to
    ``path.old`` and removed last. Wherever this stops, ``_current`` finds the
    old table or the new one, whole.
    """
    spark = rows.sparkSession
    fresh, old = f"{path}.tmp", f"{path}.old"
    present = _current(spark, path)
    write(rows.write.mode("overwrite"), fresh)
    if present == path:
        discard(spark, old)
        _rename(spark, path, old)
    _rename(spark, fresh, path)
    discard(spark, old)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    where, files = file_system(spark, source)
    if not files.rename(where, file_system(spark, target)[0]):
        raise OSError(f"cannot put {source} in the place of {target}")


def _current(spark: SparkSession, path: str) -> str | None:
    """Where the last whole table of ``path`` is."""
    return next((p for p in (path, f"{path}.old") if exists(spark, p)), None)


def preview(rows: DataFrame, n: int = 5, width: int = 500) -> list[dict]:
    """The first rows, with long texts cut, for the console."""
    cut = [F.substring(c, 1, width).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes]
    return [r.asDict() for r in rows.select(*cut).limit(n).collect()]
