"""Blocks of texts that later passes read in place, and names exchanged between them one bucket at a time.

Each pass over the blocks sends sorted names to buckets; a bucket tells each block, with one bit a name, which of them
other blocks sent too. The texts themselves are never shuffled: blocks are a bucketed table, joined with the answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import TEXTS, batches_of, chunks, drop_path, drop_staged, new_path, release, staged

BLOCK_BYTES = 2 << 20
#: A document's number: its block's number times this, plus its place there.
DOCS = 1 << 20
#: Blocks that go to Python at a time.
BLOCKS = 4


def _blocks(it: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of many documents each: (block, doc_ids, sizes, digests, data)."""
    first, n = TaskContext.get().partitionId() << 20, 0
    for batch in chunks(it, limit=block_bytes):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        cols = [
            pa.array([first + n], pa.int64()),
            pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
            pa.array([[xxhash.xxh3_128_digest(t) for t in texts]], pa.list_(pa.binary())),
            pa.array([b"".join(texts)], pa.binary()),
        ]
        n += 1
        yield pa.record_batch(cols, names=["block", "doc_ids", "sizes", "digests", "data"])


def split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of the sorted 64-bit keys begins, and the end."""
    bounds = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def replied(sent: np.ndarray, first: np.ndarray, replies: list[dict] | None) -> np.ndarray:
    out = np.zeros(len(sent), bool)
    for r in replies or ():
        lo, hi = first[r["bucket"]], first[r["bucket"] + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=hi - lo).astype(bool)
    return out


def rows_of(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in it:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
    release()


def sent(block: int, keys: list[bytes], checks: list[bytes] | None) -> pa.RecordBatch:
    some = [b for b, k in enumerate(keys) if k]
    cols = [pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([keys[b] for b in some], pa.binary())]
    cols.append(pa.array([checks[b] if checks else None for b in some], pa.binary()))
    return pa.record_batch(cols, names=["bucket", "block", "keys", "checks"])


def _sort_bucket(table: pa.Table, kind: str) -> pa.Table:
    """For each block that sent keys to this bucket, a bit for each key: whether another block sent it too."""
    keys = np.concatenate([np.frombuffer(k, kind) for k in table["keys"].to_pylist()])
    checks = table["checks"].to_pylist()
    checks = np.concatenate([np.frombuffer(c, "<u2") for c in checks]) if checks[0] is not None else np.zeros(len(keys), np.uint16)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if (checks[order[1:]] != checks[order[:-1]])[same].any():
        order = np.lexsort((checks, keys))
        same = (keys[order[1:]] == keys[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    size = np.array([len(k) for k in table["keys"].to_pylist()]) // np.dtype(kind).itemsize
    parts = np.split(found, np.cumsum(size)[:-1])
    some = pa.array([i for i, p in enumerate(parts) if p.any()], pa.int64())
    cols = [table["bucket"].take(some), table["block"].take(some), pa.array([np.packbits(parts[i]).tobytes() for i in some.to_pylist()], pa.binary())]
    return pa.table(cols, names=["bucket", "block", "bits"])


def stage(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, Callable[[], None]]:
    """(block, doc_ids, sizes, digests, data) of docs as a table bucketed by block; the bytes of all texts; and what drops
    the table once no plan reads it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "block long, doc_ids array<long>, sizes array<long>, digests array<binary>, data binary"
    path = new_path(spark, "blocks")
    name = "timegrid_blocks_" + path[-32:]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = rows.mapInArrow(lambda it: _blocks(it, block_bytes), schema)
    with batches_of(spark, TEXTS):
        made.write.bucketBy(parts, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)

    def close() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(spark, path)

    return blocks, blocks.select(F.explode("sizes").alias("n")).agg(F.sum("n")).first()[0] or 0, close


def copies(blocks: DataFrame, least: int) -> DataFrame:
    """(block, at, lead_block, lead_at) of each text of `least` bytes or more that others equal; staged. The lead is the first."""
    texts = blocks.select("block", F.posexplode("digests").alias("at", "digest"), "sizes")
    texts = staged(texts.filter(F.element_at("sizes", F.col("at") + 1) >= least).select("block", "at", "digest"), "digests")
    first = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("block", "at")).alias("lead")).filter("n > 1")
    # staged, so that the join deals both sides anew and a large group of copies can be split
    first = staged(first, "leads")
    out = texts.join(first, "digest").select("block", "at", F.col("lead.block").alias("lead_block"), F.col("lead.at").alias("lead_at"))
    out = staged(out, "copies")
    drop_staged(texts)
    drop_staged(first)
    return out


def marks(found: DataFrame) -> DataFrame:
    """(block, copies): a block's texts that have copies, and whether each is the lead."""
    lead = (F.col("lead_block") == F.col("block")) & (F.col("lead_at") == F.col("at"))
    return found.groupBy("block").agg(F.collect_list(F.struct("at", lead.alias("first"))).alias("copies"))


SENT = "bucket int, block long, keys binary, checks binary"


def exchange(blocks: DataFrame, send: Callable, kind: str, into: str) -> DataFrame:
    """(block, into): what the buckets answer to the names of dtype `kind` that send() yields; staged."""
    sending = blocks.mapInArrow(send, SENT)
    found = sending.groupBy("bucket").applyInArrow(lambda t: _sort_bucket(t, kind), "bucket int, block long, bits binary")
    return staged(found.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(into)), into, rows=BLOCKS)


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    return blocks.join(answers.hint("merge"), "block", "left")
