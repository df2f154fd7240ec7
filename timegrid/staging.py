"""Places for what a query keeps between steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir; in local mode one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="timegrid-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        at = "file://" + _own[0]
    return f"{at.rstrip('/')}/timegrid-{name}-{uuid.uuid4().hex}"
