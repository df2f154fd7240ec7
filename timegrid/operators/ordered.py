"""Ordered computations on a key's rows: runs, carried values, gaps, predictors, smoothing, segmentation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _over(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def lead_duration(df: DataFrame, key: str, order: str, ticks: Column, last: int, most: int, into: str = "duration") -> DataFrame:
    """How long each row lasts: the next row's ticks less its own, `most` at most; `last` for a key's last row."""
    return df.withColumn(into, F.least(F.lit(most), F.coalesce(F.lead(ticks).over(_over(key, order)) - ticks, F.lit(last))))


def runs(df: DataFrame, key: str, order: str, value: str, *breaks: Column) -> DataFrame:
    """(key, run, value, first, length): maximal stretches of equal values; a true break starts a run as well."""
    w = _over(key, order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.row_number().over(w).__eq__(1)
    for b in breaks:
        new = new | b
    marked = df.withColumn("new_", new.cast("int"))
    marked = marked.withColumn("run", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.count(F.lit(1)).alias("length"))


def split_runs(df: DataFrame, key: str, index: str, changed: Column, width: int, most: int = 255) -> DataFrame:
    """(key, start, length): stretches of changed cells that cross no row of `width` cells and have `most` cells at most."""
    cells = df.filter(changed).select(key, F.col(index).alias("i_"))
    w = _over(key, "i_")
    new = (F.lag("i_").over(w) != F.col("i_") - 1) | (F.col("i_") % width == 0) | F.lag("i_").over(w).isNull()
    cells = cells.withColumn("new_", new.cast("int"))
    cells = cells.withColumn("r_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = cells.withColumn("p_", F.row_number().over(Window.partitionBy(key, "r_").orderBy("i_")) - 1)
    return cells.groupBy(key, "r_", F.floor(F.col("p_") / most).alias("part_")).agg(F.min("i_").alias("start"), F.count(F.lit(1)).alias("length")).drop("r_", "part_")


def fill_forward(df: DataFrame, key: str, order: str, value: Column, into: str) -> DataFrame:
    """The last value that isn't null, up to and with each row."""
    w = _over(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def running(df: DataFrame, key: str, order: str, value: Column, into: str) -> DataFrame:
    """The sum of the values before each row."""
    w = _over(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(into, F.coalesce(F.sum(value).over(w), F.lit(0)))


def holes(df: DataFrame, key: str, order: str, start: Column, end: Column, slop: int) -> DataFrame:
    """Rows that start more than `slop` after the row before ended, with the gap."""
    gap = start - F.lag(end).over(_over(key, order))
    return df.withColumn("gap", gap).filter(F.col("gap") > slop)


def predict(df: DataFrame, key: str, order: str, value: str, match: int, into: str) -> DataFrame:
    """The value, or `match` where it equals the one before; a key's first value stays."""
    same = F.col(value) == F.lag(value).over(_over(key, order))
    return df.withColumn(into, F.when(same, F.lit(match)).otherwise(F.col(value)))


def unpredict(df: DataFrame, key: str, order: str, value: str, match: int, into: str) -> DataFrame:
    """predict() undone."""
    return fill_forward(df, key, order, F.nullif(F.col(value), F.lit(match)), into)


def unchanged(df: DataFrame, key: str, order: str, *content: str, into: str = "repeat") -> DataFrame:
    """Whether a row's content equals that of the row before."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    return df.withColumn(into, F.coalesce(digest == F.lag(digest).over(_over(key, order)), F.lit(False)))


def ema(df: DataFrame, key: str, order: str, value: str, alpha: float, into: str) -> DataFrame:
    """(key, into): the exponential moving average of a key's values after its last row, seeded with the first.

    A fold has no window frame; a key's values are gathered in order. Keys must fit in memory.
    """
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double"))
    got = df.groupBy(key).agg(values.alias("v_"))
    fold = F.aggregate("v_", F.element_at("v_", 1), lambda a, x: a + F.lit(alpha) * (x - a))
    return got.select(key, fold.alias(into))


def segment(df: DataFrame, key: str, order: str, span: str, size: str, most_span: int, most_size: int) -> DataFrame:
    """df with `segment`: a key's rows in order, cut before a row that would take a segment beyond a limit.

    Where a segment begins depends on the one before, so a key is folded in order by one task; parallel across keys.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("segment", T.LongType())])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        out, now, spans, sizes = [], 0, 0, 0
        for a, b in zip(rows[span], rows[size], strict=True):
            if out and (spans + a > most_span or sizes + b > most_size):
                now, spans, sizes = now + 1, 0, 0
            spans, sizes = spans + a, sizes + b
            out.append(now)
        return rows.assign(segment=pd.Series(out, index=rows.index, dtype="int64"))

    return df.groupBy(key).applyInPandas(fold, schema)


def newest(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key in that order. Spark keeps n rows a key and task before the shuffle."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank_") <= n).drop("rank_")
