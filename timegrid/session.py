"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(**extra: str) -> SparkSession:
    """A session with SETTINGS; anything else, sizes of shuffles above all, is left to the cluster or to `extra`."""
    return SparkSession.builder.config(map=SETTINGS | extra).getOrCreate()
