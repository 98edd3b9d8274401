"""Makes the package importable in Python workers of a session that was started without it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's files, unless workers find it by their PYTHONPATH; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "mossgraph"), "zip", ROOT, "mossgraph")
    context.addPyFile(made)
    _shipped.add(context.applicationId)
