"""Sends this package to the Python workers of a cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
#: Applications that have it.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets workers on any machine import the package, wherever the driver found it and whenever the session began: once an
    application, as a file that Spark itself hands out. An installed package (``pyproject.toml``) doesn't need it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="spark-")  # read by tasks as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{ROOT.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in [*ROOT.rglob("*.py"), *ROOT.parent.glob("corpus_pipeline.py")]:
            archive.write(file, file.relative_to(ROOT.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
