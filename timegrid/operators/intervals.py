"""Joins of points and spans on a timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spans: DataFrame, key: str, time: str, start: str, end: str, width: int) -> DataFrame:
    """Each point with each span [start, end) of its key that holds it. Times are numbers; column names must differ.

    Spans are repeated for each slice of `width` that they touch and joined with points by (key, slice), so a hot key is
    spread over its slices and no inequality join is planned. width should be near the usual length of a span.
    """
    spans = spans.withColumnRenamed(key, "k_").filter(F.col(end) > F.col(start))
    cut = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    spans = spans.withColumn("slice_", F.explode(cut))
    points = points.withColumn("slice_p", F.floor(F.col(time) / width))
    on = (F.col(key) == F.col("k_")) & (F.col("slice_p") == F.col("slice_")) & (F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))
    return points.join(spans, on).drop("k_", "slice_", "slice_p")


def best(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in that order. A total order makes the choice unique."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank_", F.row_number().over(w)).filter("rank_ = 1").drop("rank_")


def frame_at(frames: DataFrame, key: str, order: str, duration: str, asked: DataFrame, offset: str) -> DataFrame:
    """Prefix-sum lookup: each asked (key, offset) with the frame whose cumulative duration covers the offset.

    Offsets beyond the end take the last frame, those below 0 the first. asked has one row a key and offset.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy(key).orderBy(F.desc(order))
    rows = frames.withColumn("from_", F.coalesce(F.sum(duration).over(before), F.lit(0)))
    rows = rows.withColumn("first_", F.col("from_") == 0).withColumn("last_", F.row_number().over(last) == 1)
    asked = asked.withColumnRenamed(key, "k_")
    inside = (F.col(offset) >= F.col("from_")) & ((F.col(offset) < F.col("from_") + F.col(duration)) | F.col("last_"))
    below = (F.col(offset) < 0) & F.col("first_")
    out = asked.join(rows, (F.col("k_") == F.col(key)) & (inside | below))
    return best(out, ["k_", offset], [F.asc(order)]).drop("k_", "first_", "last_")
