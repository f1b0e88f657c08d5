"""Makes this package importable in Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="terravox-")
        shutil.copytree(top, f"{folder}/src/{top.name}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{folder}/{top.name}", "zip", f"{folder}/src"))
        _SHIPPED.add(sc.applicationId)
    return spark
