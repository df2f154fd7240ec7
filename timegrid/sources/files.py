"""Ordinary sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A path's scheme and host.
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
FORMATS = ("parquet", "orc", "json", "csv", "text", "binaryFile")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table of files. csv and json want a schema: inferring one reads everything twice."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind in ("csv", "json") and not schema:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lo: int, hi: int, parts: int, **options: str) -> DataFrame:
    """A database's table, read in ranges of a numeric column."""
    ranges = {"partitionColumn": column, "lowerBound": str(lo), "upperBound": str(hi), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **ranges, **options).load()


def read_kafka(spark: SparkSession, servers: str, topic: str, rows_a_batch: int = 1_000_000) -> DataFrame:
    """A topic as a stream of (key, value, timestamp, ...); needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return reader.option("subscribe", topic).option("maxOffsetsPerTrigger", rows_a_batch).load()


def write_sorted(df: DataFrame, path: str, *by: str, parts: list[str] | None = None, kind: str = "parquet", mode: str = "error") -> None:
    """Files sorted by columns, so that readers skip by statistics; in folders by the columns `parts`, if given."""
    rows = df.repartitionByRange(*by).sortWithinPartitions(*(parts or []), *by)
    rows.write.format(kind).mode(mode).partitionBy(*(parts or [])).save(path)


def list_files(spark: SparkSession, path: str, pattern: str, without: str = "") -> DataFrame:
    """(path, below, length, modificationTime) of files by name, in folders below the path too; `below` is what the file's
    path has beyond `path`. Those whose `below` holds `without` are left out."""
    plain = re.sub(SCHEME, "", path).rstrip("/")
    # the path without its scheme and host, counted from the end of the folder's own
    bare = F.regexp_replace("path", SCHEME, "")
    below = bare.substr(F.locate(plain + "/", bare) + len(plain) + 1, F.length(bare))
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    found = found.select("path", below.alias("below"), "length", "modificationTime")
    return found.filter(~F.col("below").contains(without)) if without else found
