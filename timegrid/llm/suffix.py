"""Removal of repeated substrings: suffixes sorted one bucket at a time, pruned by ranks of a difference-cover sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.llm.blocks import BLOCK_BYTES, copies, exchange, marks, replied, rows_of, sent, split, stage, with_answers
from timegrid.llm.common import MULT, mixed

LENGTH = 200
#: A difference cover: any two numbers are brought to members of it, modulo the period, by adding one same number.
COVER, PERIOD = (1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110), 133
#: Suffixes of a bucket, about, if no suffix were pruned; a bucket is sorted in memory.
BUCKET_ROWS = 8 << 20

_BASE, _BASE32 = MULT, np.uint32(0x9E3779B1)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * MULT)


def _powers(base: np.unsignedinteger, n: int, inverse: bool) -> np.ndarray:
    bits = 8 * base.itemsize
    out = np.full(n + 1, pow(int(base), -1, 1 << bits) if inverse else int(base), base.dtype)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any substrings of a byte array: sums of byte numbers times powers of an odd base, shifted to the start."""

    tables: dict = {}

    def __init__(self, data: np.ndarray, base: np.unsignedinteger):
        n = len(data)
        known = Hashes.tables.get(base.dtype, [()])
        if len(known[0]) <= n:
            size = max(n, BLOCK_BYTES + BLOCK_BYTES // 4)
            known = Hashes.tables[base.dtype] = [_powers(base, size, False), _powers(base, size, True)]
        power, self.inverse = known
        byte = _BYTES if base.dtype == np.uint64 else (_BYTES >> np.uint64(32)).astype(np.uint32)
        self.sums = np.zeros(n + 1, base.dtype)
        np.cumsum(byte[data] * power[:n], out=self.sums[1:])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.between(at, at + length)

    def between(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[at]) * self.inverse[at]


@dataclass
class Block:
    """A block's bytes, and what is known of its documents. A later exact copy of a text takes no part in the search."""

    data: np.ndarray
    sizes: np.ndarray
    copy: np.ndarray
    copied: np.ndarray
    length: int

    def __post_init__(self) -> None:
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.left = np.repeat(np.where(self.copy, 0, self.ends), self.sizes) - np.arange(len(self.data))
        self.hashes = Hashes(self.data, _BASE)

    def sample(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the cover sample, and a bucket and 32-bit name of the cover's substring that starts at each."""
        phase = (np.arange(len(self.data)) - np.repeat(self.starts, self.sizes)) % PERIOD
        member = np.zeros(PERIOD, bool)
        member[list(COVER)] = True
        reach = self.length - PERIOD + 1
        at = np.flatnonzero(member[phase] & (self.left >= reach))
        h = mixed(self.hashes.of(at, reach))
        bucket = (h >> np.uint64(32)) * np.uint64(buckets) & ~np.uint64(0xFFFFFFFF)
        return at, bucket | (h & np.uint64(0xFFFFFFFF))

    def survivors(self, at: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Suffixes of `length` bytes or more that have a repeated sample within the period: no other can be repeated."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        doc = np.searchsorted(self.ends, at[repeated], "right")
        np.add.at(edge, np.maximum(at[repeated] - (PERIOD - 1), self.starts[doc]), 1)
        np.add.at(edge, at[repeated] + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= self.length))

    def names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit name of the substring of `length` bytes at each position, and 16 bits of another hash of it."""
        other = Hashes(self.data, _BASE32).of(at, self.length)
        return mixed(self.hashes.of(at, self.length)), ((other * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


class Search:
    """What is done with each block, in three passes: name the sample, name the survivors, remove what is repeated."""

    def __init__(self, length: int, buckets: int):
        self.length, self.buckets = length, buckets

    def _read(self, row: dict) -> Block:
        sizes = np.array(row["sizes"], np.int64)
        copies = {c["at"]: c["first"] for c in row["copies"] or ()}
        copy, copied = np.zeros(len(sizes), bool), np.zeros(len(sizes), bool)
        for at, first in copies.items():
            copied[at] = True
            copy[at] = not first
        return Block(np.frombuffer(row["data"], np.uint8), sizes, copy, copied, self.length)

    def _samples(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at, key = block.sample(self.buckets)
        keys, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        first = np.searchsorted(keys, np.arange(self.buckets + 1, dtype=np.uint64) << np.uint64(32))
        return at, keys, inverse, n, first

    def _survivors(self, block: Block, replies: list[dict] | None) -> tuple:
        at, keys, inverse, n, first = self._samples(block)
        repeated = ((n > 1) | replied(keys, first, replies))[inverse]
        at = block.survivors(at, repeated)
        key, check = block.names(at)
        keys, where, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        # equal names with other checks: kept apart by treating them as not repeated here; the bucket decides
        n = np.where(np.bincount(inverse, check[where][inverse] != check, minlength=len(keys)) > 0, 1, n)
        return at, keys, check[where], inverse, n, split(keys, self.buckets)

    def send_samples(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(it):
            _, keys, _, _, first = self._samples(self._read(row))
            low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
            yield sent(row["block"], [low[first[b] : first[b + 1]].tobytes() for b in range(self.buckets)], None)

    def send_survivors(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(it):
            _, keys, check, _, _, first = self._survivors(self._read(row), row["samples"])
            parts = [slice(first[b], first[b + 1]) for b in range(self.buckets)]
            yield sent(row["block"], [keys[p].astype("<u8").tobytes() for p in parts], [check[p].astype("<u2").tobytes() for p in parts])

    def removed(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(it):
            block = self._read(row)
            at, keys, _, inverse, n, first = self._survivors(block, row["samples"])
            at = at[((n > 1) | replied(keys, first, row["survivors"]))[inverse]]
            edge = np.zeros(len(block.data) + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + self.length, -1)
            for d in np.flatnonzero(block.copied & (block.sizes >= self.length)):
                edge[block.starts[d]] += 1
                edge[block.ends[d]] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            out: tuple[list, list, list] = ([], [], [])
            for lo, hi in zip(block.starts, block.ends, strict=True):
                part = gone[lo:hi]
                turn = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8)))
                out[0].append(turn[::2].tolist())
                out[1].append(turn[1::2].tolist())
                out[2].append(block.data[lo:hi][~part].tobytes())
            cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["sizes"], pa.int64())]
            cols += [pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary())]
            yield pa.record_batch(cols, names=["doc_id", "n_bytes", "starts", "ends", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept) of each row: its text without bytes of substrings that occur elsewhere.

    A byte goes if a substring of `length` bytes that covers it starts anywhere else too, in this or another text; texts
    are UTF-8 bytes, a null one has none. starts and ends are the maximal removed runs, kept the other bytes. Repeated rows
    count as texts of their own, so each loses all if it has `length` bytes. Nothing is judged on what is left.

    Texts are staged in blocks, bucketed by number, so that no pass shuffles them. (1) Of exact copies one goes on. (2) At
    the positions of a difference cover, the prefixes of length - period + 1 bytes are ranked: two repeated substrings
    always have a pair of cover positions at one same distance, whose prefixes lie within them and are equal. So a suffix
    without a repeated rank within the period is pruned (most are). (3) The rest are sorted by the name of their first
    `length` bytes (80 bits), one bucket in memory at a time; a name that two suffixes have is a repeat. Names stand for
    lexicographic ranks, as only equal prefixes matter. A block sends each name of a bucket once, however often it occurs,
    and learns one bit for it; so neither a hot text nor a hot substring gathers, and buckets are bounded by their count,
    which follows the corpus.
    """
    if length < PERIOD + 32:
        raise ValueError(f"length must be {PERIOD + 32} or more")
    blocks, total, _ = stage(docs, block_bytes)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    search = Search(length, max(parts, 1 + total // bucket_rows))
    read = with_answers(blocks.select("block", "doc_ids", "sizes", "data"), marks(copies(blocks, length)))
    read = with_answers(read, exchange(read, search.send_samples, "<u4", "samples"))
    read = with_answers(read, exchange(read, search.send_survivors, "<u8", "survivors"))
    return read.mapInArrow(search.removed, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    return remove_repeats(docs).select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
