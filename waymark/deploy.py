"""Sends the package to the executors and bounds what they hold at once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


#: Bytes of rows that a Python worker gets at a time; texts can be long.
BATCH_BYTES = "8m"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once an application, and bounds the
    batches they get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="waymark-")) / "waymark.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(out))
    _sent.add(context.applicationId)
