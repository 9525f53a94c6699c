"""Where queries that need storage of their own may write."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def local_folder() -> str:
    """A temporary folder of this process, removed at its end."""
    path = tempfile.mkdtemp(prefix="foliant-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def own_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; local sessions without it use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = local_folder()
    return f"{base.rstrip('/')}/index-{uuid.uuid4().hex}"
