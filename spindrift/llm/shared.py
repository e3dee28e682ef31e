"""Helpers the corpus operators have in common."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.package import ship
from spindrift.sources.shared import discard as discard
from spindrift.sources.shared import scratch as scratch

#: Rows per Arrow batch; Spark bounds its bytes besides, so neither many nor
#: very long documents outgrow a worker.
BATCH_ROWS = 2000

_holder: list[tuple[str, Callable[[], None]]] = []


def prepare(spark: SparkSession) -> None:
    """Make a session ready for the operators that run in Python workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def claim(name: str, drop: Callable[[], None]) -> None:
    """Let one operator at a time keep a table in a worker that Spark uses again.

    The one before drops what it kept as soon as another begins, so a chain
    of operators needs the memory of its largest and not of all.
    """
    if not _holder or _holder[0][0] != name:
        for _, old in _holder:
            old()
        if _holder:
            _return_memory()
        _holder[:] = [(name, drop)]


def nothing() -> None:
    """What an operator drops that keeps no table."""


def _return_memory() -> None:
    """Give freed memory back to the system, as far as the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the tasks that were
    reading the table. The size of the table is known to the optimizer, so
    small ones are broadcast by its own check and large ones are not.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str | Column = "text") -> Column:
    """The text in UTF-8; a null text is empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(doc_id.cast("string").cast("binary")) % modulus).cast("int")


def held_out(doc_id: str | Column, modulus: int, remainder: int = 2) -> Column:
    """True for rows nothing may be learned from. A null id is held out."""
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(True))
