"""Sending the package to the executors, so that Python functions find their modules there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


#: Arrow batches between the JVM and Python hold this much, so that long texts do not add up; a session's own setting stays.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "64m", "8m")


def _bytes(setting: str) -> int:
    digits = setting.rstrip("bBkKmMgG")
    return int(digits) << {"k": 10, "m": 20, "g": 30}.get(setting[len(digits) : len(digits) + 1].lower(), 0)


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip, once per application, and bounds the batches that Python gets."""
    key, usual, bound = BATCH
    if _bytes(spark.conf.get(key, bound)) == _bytes(usual):
        spark.conf.set(key, bound)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="ledgerline-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
