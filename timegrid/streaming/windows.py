"""Windowed aggregations and joins of streams, with watermarks for late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_time(df: DataFrame, column: str, late: str) -> DataFrame:
    """df with the column as a timestamp and a watermark on it (a watermark refuses time without zone)."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling(df: DataFrame, time: str, length: str, *by: str, **aggregates: Column) -> DataFrame:
    return _windowed(df, F.window(time, length), by, aggregates)


def sliding(df: DataFrame, time: str, length: str, step: str, *by: str, **aggregates: Column) -> DataFrame:
    return _windowed(df, F.window(time, length, step), by, aggregates)


def sessions(df: DataFrame, time: str, gap: str, *by: str, **aggregates: Column) -> DataFrame:
    return _windowed(df, F.session_window(time, gap), by, aggregates)


def _windowed(df: DataFrame, window: Column, by: tuple, aggregates: dict[str, Column]) -> DataFrame:
    out = df.groupBy(window.alias("w_"), *by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("w_.start").alias("start"), F.col("w_.end").alias("end"), *by, *aggregates)


def once(df: DataFrame, *key: str) -> DataFrame:
    """The first row of each key, for as long as the watermark remembers it."""
    return df.dropDuplicatesWithinWatermark(list(key))


def within(a: DataFrame, b: DataFrame, key: str, a_time: str, b_time: str, span: str) -> DataFrame:
    """Pairs of rows of two streams with equal keys, b's in [a's time, a's time + span). Both need watermarks.

    Column names must differ but for the key; b's is dropped.
    """
    b = b.withColumnRenamed(key, "k_")
    on = (F.col(key) == F.col("k_")) & (F.col(b_time) >= F.col(a_time)) & (F.col(b_time) < F.col(a_time) + F.expr(f"INTERVAL {span}"))
    return a.join(b, on).drop("k_")


def gated(df: DataFrame, caps: DataFrame, key: str, need: Column) -> DataFrame:
    """Rows of a stream that the capabilities (a static table, read anew by each micro-batch) of their key allow."""
    return df.join(caps, key).filter(need)


def run_available(spark: SparkSession, path: str, schema: StructType, work: str, build: Callable[[DataFrame], DataFrame], mode: str = "append", files: int = 8) -> DataFrame:
    """All that a stream over a folder's Parquet files gives by now. `work` holds its checkpoint and its results, so a
    second call goes on where the first one ended; a lost run repeats no row, as the file sink commits by batch."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    sink = build(source).writeStream.outputMode(mode).format("parquet")
    query = sink.option("checkpointLocation", f"{work}/checkpoint").option("path", f"{work}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{work}/rows")


def fan_out(df: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], work: str):
    """One stream, many consumers: each micro-batch is computed once and handed to all of them."""

    def hand_on(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for sink in sinks.values():
            sink(kept)
        kept.unpersist()

    return df.writeStream.foreachBatch(hand_on).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
