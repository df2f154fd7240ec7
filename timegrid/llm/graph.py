"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import drop_staged, staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, class): for each id in edges (a, b, longs; null ends are left out) the smallest id connected to it; staged.

    Alternates large-star and small-star steps: each id's larger, then smaller, neighbours are linked to its smallest one
    (Kiveris et al., 2014). Edges never multiply, each step shuffles them twice, and the number of steps grows with the
    logarithm of a component's size. Minima are aggregated before their shuffle and staged; so the join deals out both sides
    anew, and Spark's adaptive plan splits a hub's edges over many tasks.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a != b")
    current = staged(edges.distinct(), "edges")

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    mark = sign(current)
    for _ in range(rounds):
        if not mark[0]:
            break
        # large star: neighbours larger than u go to u's smallest neighbour (or u)
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = current.select(F.col("v").alias("w"), F.col("u").alias("x")).join(least.withColumnRenamed("u", "w"), "w")
        large = large.select(F.col("x").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "large")
        drop_staged(least)
        # small star: u and its smaller neighbours go to the smallest of them
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        new = staged(least.select("u", F.col("m").alias("v")).union(small).distinct(), "edges")
        for old in (least, large, current):
            drop_staged(old)
        current, before, mark = new, mark, sign(new)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("class")).union(roots)
