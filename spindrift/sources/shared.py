"""The folder that driver and executors share, and tables that are built once in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_built: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A local session that names none gets a folder of its own; on a cluster,
    where a folder of one machine is of no use to the others, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = tempfile.mkdtemp(prefix="spindrift-")
        named = _own[application]
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/spindrift/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """A path for the JVM and the file system it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = file_system(spark, path)
    return files.exists(where)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables that no later step reads."""
    for path in paths:
        where, files = file_system(spark, path)
        files.delete(where, True)


def version(spark: SparkSession, path: str) -> tuple:
    """Changes when the files at ``path`` do: their number, bytes and latest change."""
    where, files = file_system(spark, path)
    found = files.listStatus(where)
    latest = max((f.getModificationTime() for f in found), default=0)
    whole = files.getContentSummary(where)
    return whole.getFileCount(), whole.getLength(), latest


def built_once(spark: SparkSession, label: str, source: str, build: Callable[[str], None]) -> str:
    """The path of what ``build`` writes from the files at ``source``.

    It is built once for an application and a version of those files, and opened from then on.
    """
    key = (spark.sparkContext.applicationId, label, source, version(spark, source))
    if key not in _built:
        path = scratch(spark, label)
        build(path)
        _built[key] = path
    return _built[key]
