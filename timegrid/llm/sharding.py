"""Weighted rendezvous hashing of stable record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import numbered, spread, staged

BUCKETS = 1024


def _best(weights: Sequence[float], key: Column, first: int, last: int) -> Column:
    """The shard in [first, last) that wins `key`: largest -w / ln(u), u uniform from the hash of (key, shard)."""
    options = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(float(weights[s])).alias("w")) for s in range(first, last)])

    def score(x: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, x["s"]), 11)
        return F.struct((x["w"] / -F.log((bits + F.lit(0.5)) * F.lit(2.0**-53))).alias("v"), (-x["s"]).alias("s"))

    return F.array_max(F.transform(options, score))


def rendezvous(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", into: str = "shard") -> DataFrame:
    """docs with its shard: 0 to len(weights) - 1, each winning a share of the keys in proportion to its weight.

    A key's score on a shard depends on that key, shard and weight alone. So a further shard takes just the keys that it
    now wins, a shard that goes gives up just its own, and a changed weight moves keys to or from that shard only.
    Rows with equal keys share a shard; a null key is a key like any other. Ties go to the lowest shard. No shuffle.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return docs.withColumn(into, -_best(weights, F.col(key), 0, len(weights))["s"])


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs; other columns are ignored.

    size is the UTF-8 bytes of the text plus 16; a null text has no bytes, and its checksum is that of no bytes, 0.
    slot numbers the rows of a shard from 0 without gaps; repeated rows get slots of their own. grown_shard is the shard
    after one shard of grown_weight (default: the last weight) is added. Texts are read once and never shuffled: the
    numbering works on narrow rows, each shard's spread over many tasks. An empty table gives an empty one.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    n, all_weights = len(weights), [*weights, grown_weight or weights[-1]]
    text = F.coalesce(F.col("text"), F.lit(""))
    before = _best(all_weights, F.col("doc_id"), 0, n)
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        before.alias("old"),
    )
    added = _best(all_weights, F.col("doc_id"), n, n + 1)
    rows = rows.select(
        "doc_id", "size", "text_crc32",
        F.lit("key").alias("law"),
        (-F.col("old.s")).cast("int").alias("shard"),
        (-F.greatest(F.col("old"), added)["s"]).cast("int").alias("grown_shard"),
        spread(BUCKETS),
    )
    out = numbered(staged(rows, "shards"), ["shard"], ["doc_id", "text_crc32", "size"], "slot", BUCKETS)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
