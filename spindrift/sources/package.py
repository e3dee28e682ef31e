"""Makes this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once for each application.

    Workers that were started elsewhere, or on machines without a copy, can
    then load the functions that columns refer to.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        target = Path(tempfile.mkdtemp(prefix="spindrift-code-")) / "spindrift_code.zip"
        with zipfile.ZipFile(target, "w") as packed:
            for path in sorted(root.rglob("*.py")):
                packed.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
    _shipped.add(context.applicationId)
