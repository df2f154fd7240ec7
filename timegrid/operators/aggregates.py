"""Aggregations: moments, masks, entropies, prefix sums over grids, shares."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, by: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """Count, sum of each value, and the sum of all their squares, in one pass that adds up before the shuffle."""
    sums = [F.sum(v).alias(f"sum_{n}") for n, v in values.items()]
    squares = reduce(lambda a, b: a + b, [v * v for v in values.values()])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, F.sum(squares).alias("sum_sq"))


def mask_summary(df: DataFrame, key: str, mask: Column, none: int = 1) -> DataFrame:
    """Union and intersection of bit masks, and whether all have bit 0; `none` stands for an empty intersection."""
    return df.groupBy(key).agg(
        F.bit_or(mask).alias("any_bits"),
        F.coalesce(F.bit_and(mask), F.lit(none)).alias("all_bits"),
        F.coalesce(F.bool_and(mask.bitwiseAND(1) == 1), F.lit(False)).alias("all_first"),
    )


def entropy(df: DataFrame, key: str, value: str, into: str = "bits") -> DataFrame:
    """(key, n, bits): order-0 Shannon entropy of a key's values in bits a row. Two aggregations, no window."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    # -sum p log2 p = log2 n - sum(c log2 c) / n
    out = counts.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return out.select(key, "n", (F.log2("n") - F.col("s") / F.col("n")).alias(into))


def bigram_entropy(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(bits): the entropy of a value given the one before it, over all keys."""
    pairs = df.select(F.lag(value).over(Window.partitionBy(key).orderBy(order)).alias("a"), F.col(value).alias("b"))
    counts = pairs.filter("a is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy("a").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return per.agg((F.sum(F.col("n") * F.log2("n") - F.col("s")) / F.sum("n")).alias("bits"))


def integral(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """(x, y, total): for each cell of the dense grid of small integers x, y from 0, the sum of values at or below it in both.

    Two running sums over grid cells, whose number doesn't grow with the rows.
    """
    cells = df.groupBy(x, y).agg(F.sum(value).alias("v"))
    limits = cells.agg(F.max(x).alias("mx"), F.max(y).alias("my"))
    grid = limits.select(F.explode(F.sequence(F.lit(0), F.col("mx").cast("int"))).alias(x), "my")
    grid = grid.select(x, F.explode(F.sequence(F.lit(0), F.col("my").cast("int"))).alias(y))
    dense = grid.join(cells, [x, y], "left").fillna(0, ["v"])
    row = Window.partitionBy(x).orderBy(y).rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy(y).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("r", F.sum("v").over(row)).select(x, y, F.sum("r").over(column).alias("total"))


def integrals(df: DataFrame, axes: Sequence[str], value: str) -> DataFrame:
    """(axes, total): as integral(), along any number of axes: one running sum for each."""
    out = df.groupBy(*axes).agg(F.sum(value).alias("total"))
    grid = out.agg(*[F.max(a).alias(f"m_{a}") for a in axes])
    for a in axes:
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(f"m_{a}").cast("int"))))
    out = grid.select(*axes).join(out, list(axes), "left").fillna(0, ["total"])
    for a in axes:
        along = Window.partitionBy(*[b for b in axes if b != a]).orderBy(a).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("total", F.sum("total").over(along))
    return out


def boxes(table: DataFrame, axes: Sequence[str], asked: DataFrame) -> DataFrame:
    """asked (box, and for each axis its first and last place, x0, x1 of axis x) with the sum of values inside, from the
    2 ** len(axes) corners of integrals(), by inclusion and exclusion."""
    corners = asked.withColumn("sign", F.lit(1)).select("*", *[F.lit(0).alias(a) for a in axes])
    for a in axes:
        ends = F.array(F.struct(F.col(f"{a}1").alias("at"), F.lit(1).alias("s")), F.struct((F.col(f"{a}0") - 1).alias("at"), F.lit(-1).alias("s")))
        corners = corners.withColumn("end", F.explode(ends)).withColumns({a: F.col("end.at"), "sign": F.col("sign") * F.col("end.s")}).drop("end")
    limits = table.agg(*[F.max(a).alias(f"m_{a}") for a in axes])
    inside = corners.crossJoin(F.broadcast(limits)).withColumns({a: F.least(a, f"m_{a}") for a in axes})
    found = inside.join(table, list(axes), "left")
    return found.groupBy("box").agg(F.coalesce(F.sum(F.col("sign") * F.coalesce("total", F.lit(0))), F.lit(0)).cast("long").alias("inside"))


def box_sum(table: DataFrame, x: str, y: str, boxes: DataFrame) -> DataFrame:
    """boxes (box, x0, y0, x1, y1; ends included) with the sum of values inside, from four corners of integral()."""
    corners = F.array(
        F.struct(F.col("x1").alias("cx"), F.col("y1").alias("cy"), F.lit(1).alias("sign")),
        F.struct((F.col("x0") - 1).alias("cx"), F.col("y1").alias("cy"), F.lit(-1).alias("sign")),
        F.struct(F.col("x1").alias("cx"), (F.col("y0") - 1).alias("cy"), F.lit(-1).alias("sign")),
        F.struct((F.col("x0") - 1).alias("cx"), (F.col("y0") - 1).alias("cy"), F.lit(1).alias("sign")),
    )
    asked = boxes.select("box", F.explode(corners).alias("c")).select("box", "c.*")
    found = asked.join(table, (F.col("cx") == F.col(x)) & (F.col("cy") == F.col(y)))
    return found.groupBy("box").agg(F.sum(F.col("sign") * F.col("total")).alias("inside"))


def exact_shares(df: DataFrame, key: str, symbol: str, count: str, total: int) -> DataFrame:
    """Counts scaled to integers that add up to `total` for each key, each at least 1; most frequent symbols take the rest.

    What is left goes to the most frequent symbols by one each, round by round; a debt is taken back from them the same
    way, but never the last one. Symbols of equal count are ranked by symbol.
    """
    every = Window.partitionBy(key)
    ranked = Window.partitionBy(key).orderBy(F.desc(count), F.asc(symbol))
    out = df.withColumn("f_", F.greatest(F.lit(1), F.floor(F.col(count) * F.lit(float(total)) / F.sum(count).over(every))))
    out = out.withColumn("d_", F.lit(total) - F.sum("f_").over(every)).withColumn("r_", F.row_number().over(ranked) - 1)
    out = out.withColumn("k_", F.count(F.lit(1)).over(every))
    more = F.floor(F.col("d_") / F.col("k_")) + (F.col("r_") < F.pmod("d_", "k_")).cast("long")
    # a debt of D taken one by one from symbols that keep 1: the first L rounds are whole; found from the capacities
    spare = F.transform(F.collect_list("f_").over(every), lambda f: f - 1)
    debt = -F.col("d_")

    def taken(n: Column) -> Column:
        return F.aggregate(spare, F.lit(0).cast("long"), lambda a, s: a + F.least(s.cast("long"), n))

    rounds = F.aggregate(F.sequence(F.lit(11), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), lambda n, b: F.when(taken(n + F.pow(F.lit(2), b).cast("long")) <= debt, n + F.pow(F.lit(2), b).cast("long")).otherwise(n))
    out = out.withColumn("n_", F.when(F.col("d_") < 0, rounds).otherwise(F.lit(0))).withColumn("t_", F.when(F.col("d_") < 0, debt - taken(F.col("n_"))).otherwise(F.lit(0)))
    can = ((F.col("f_") - 1) > F.col("n_")).cast("long")
    before = F.sum(can).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    less = F.least(F.col("f_") - 1, F.col("n_")) + F.when((can == 1) & (before <= F.col("t_")), 1).otherwise(0)
    share = F.when(F.col("d_") >= 0, F.col("f_") + more).otherwise(F.col("f_") - less)
    return out.withColumn("share", share.cast("long")).drop("f_", "d_", "r_", "k_", "n_", "t_")


def share_of(df: DataFrame, by: str, value: Column, into: str = "share") -> DataFrame:
    """(by, total, into): each group's sum and its part of the whole. The whole is added up from the groups."""
    out = df.groupBy(by).agg(F.sum(value).alias("total"))
    whole = out.agg(F.sum("total").alias("w_"))
    return out.crossJoin(F.broadcast(whole)).select(by, "total", (F.col("total") / F.col("w_")).alias(into))
