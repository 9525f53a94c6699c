"""Sends this package to the executors, whose Python workers may not find it on their own path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; Spark serves the file to every executor, also to those that start later."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    here = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="foliant-code-")
    atexit.register(shutil.rmtree, folder, True)
    to = Path(folder) / "foliant.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(to))
