"""Puts this package on the Python path of executors that were not started with it."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once in an application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in {".py", ".dl"}:
                z.write(p, p.relative_to(root.parent))
    at = Path(tempfile.mkdtemp(prefix="siltstone-ship-")) / "siltstone_sources.zip"
    at.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(at))  # Spark itself serves the file to the executors
    _sent.add(app)
