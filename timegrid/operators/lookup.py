"""Lookups with the meaning of a join: priorities, nearest vectors, pairs, differences, alignment of streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority(left: DataFrame, key: str, choices: DataFrame, rank: str, choice: str, available: DataFrame, fallback: int) -> DataFrame:
    """left with the available choice of the lowest rank for its key, or `fallback` if it has none.

    choices: (key, rank, choice); available: a column `choice`. The best choice is found per key before left is joined.
    """
    some = choices.join(available.select(choice).distinct(), choice, "left_semi")
    best = some.groupBy(key).agg(F.min_by(choice, F.struct(rank, choice)).alias("chosen"))
    return left.join(best, key, "left").withColumn("chosen", F.coalesce("chosen", F.lit(fallback)))


def nearest(rows: DataFrame, vector: str, codes: Sequence[Sequence[float]], k: int = 1) -> DataFrame:
    """rows with `near`: numbers and scores of the k codes of largest q.p - |p|^2 / 2, ties to the lower number.

    The codebook is a small literal, so each row finds its own: no join, no shuffle. It is for tens of codes.
    """
    book = F.array(*[F.struct(F.lit(i).alias("code"), F.array(*[F.lit(float(x)) for x in c]).alias("p"), F.lit(sum(float(x) ** 2 for x in c) / 2).alias("h")) for i, c in enumerate(codes)])

    def score(c: Column) -> Column:
        dot = F.aggregate(F.zip_with(F.col(vector), c["p"], lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        return F.struct((-(dot - c["h"])).alias("cost"), c["code"].alias("code"))

    best = F.slice(F.array_sort(F.transform(book, score)), 1, k)
    return rows.withColumn("near", F.transform(best, lambda x: F.struct(x["code"].alias("code"), (-x["cost"]).alias("score"))))


def unordered_pairs(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, a, b): each pair a < b of a group's items. For small groups only: pairs grow with their square."""
    a, b = df.select(group, F.col(item).alias("a")), df.select(group, F.col(item).alias("b"))
    return a.join(b, group).filter("a < b")


def differences(old: DataFrame, new: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows of new that differ from old's row of the same key in any of cols (nulls are equal), with the names that do."""
    old = old.select(*on, *[F.col(c).alias(f"old_{c}") for c in cols])
    both = new.select(*on, *cols).join(old, list(on))
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(c)) for c in cols]))
    return both.withColumn("changed", changed).filter(F.size("changed") > 0)


def merged(streams: Sequence[DataFrame], time: str, *order: str) -> DataFrame:
    """All streams' rows with `place`, their rank in one order by time. Give a total order to make it unique.

    Ranks of a whole table: the sort is by range, and each range's first rank comes from the counts of those before.
    """
    rows = streams[0]
    for s in streams[1:]:
        rows = rows.unionByName(s)
    day = rows.withColumn("slice_", F.date_trunc("day", F.col(time)))
    counts = day.groupBy("slice_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("slice_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("f_"))
    within = Window.partitionBy("slice_").orderBy(time, *order)
    return day.join(first, "slice_").withColumn("place", F.col("f_") + F.row_number().over(within)).drop("slice_", "f_")


def align(bases: DataFrame, stream: str, base: Column, skew: float) -> DataFrame:
    """(stream, base, offset): streams placed against the earliest base; 0 for all if one is missing or they are more than
    `skew` apart."""
    got = bases.groupBy(stream).agg(F.min(base).alias("base"))
    all_ = got.agg(F.min("base").alias("lo"), F.max("base").alias("hi"), F.count_if(F.col("base").isNull()).alias("gone"))
    trusted = (F.col("gone") == 0) & (F.col("hi") - F.col("lo") <= skew)
    return got.crossJoin(F.broadcast(all_)).select(stream, "base", F.when(trusted, F.col("base") - F.col("lo")).otherwise(F.lit(0)).alias("offset"))


def mask_members(mask: Column, bits: int) -> Column:
    """The numbers of the bits set in a mask, [0] if none is."""
    found = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.getbit(mask, b) == 1)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0)))
