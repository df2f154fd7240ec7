"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of passages to test items."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import TEXTS, WordHashes, batches_of, chunks, columns_of, identity, plain_words, shingles, staged, whole_row

SEED = 3
MATCH, MISS, GAP = 2, -1, -1
#: A document holds an item from this share of the item's full alignment score on.
THRESHOLD = 0.6
#: Or from a passage on, whatever its share, that scores as much as an item of so many words does as a whole, when
#: mismatches and gaps cost EDIT: at that price no alignment grows by running through unlike words.
PASSAGE, EDIT = 25, -3
#: Seeds are judged by parts of an item of so many, one of which at least lies within any passage.
PART = (PASSAGE - SEED + 2) // 2
#: A seed is rare if at most this many times as many documents hold it as hold the median seed of its part of the item.
RARE = 4
#: Items whose words are broadcast at a time: a benchmark beyond this many words is taken in blocks.
BLOCK_WORDS = 2_000_000
FILTER_BITS = 22


class Seeds:
    """The items of a block: their words, and their n-grams in order with where they occur.

    Only vars() of it is broadcast, lists and arrays: workers need not have this package.
    """

    @classmethod
    def restored(cls, state: dict) -> Seeds:
        out = cls.__new__(cls)
        vars(out).update(state)
        return out

    def __init__(self, items: list[tuple[int | None, str | None]]):
        hashes = WordHashes()
        words = [(i, hashes.of(plain_words(t))) for i, t in items]
        words = [(i, w) for i, w in words if len(w) >= SEED]
        self.ids = [i for i, _ in words]
        self.words = [w for _, w in words]
        grams = [shingles(w, SEED) for w in self.words]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        self.keys, inverse = np.unique(every, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        self.first = np.searchsorted(inverse[order], np.arange(len(self.keys) + 1))
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.at = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])[order]
        self.quick = np.zeros(1 << FILTER_BITS, bool)
        self.quick[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.longest = max(map(len, self.words), default=0)

    def keep_rare(self, df: np.ndarray) -> None:
        """Drops postings of seeds that are much more frequent than the median seed of their part of the item. Every part
        keeps some, so a passage that many documents hold is found though the rest of its item is rare."""
        each = np.repeat(df, np.diff(self.first))
        most = int(self.at.max(initial=0)) // PART + 1
        _, part = np.unique(self.item * most + self.at // PART, return_inverse=True)
        order = np.lexsort((each, part))
        begin = np.searchsorted(part[order], np.arange(int(part.max(initial=-1)) + 2))
        median = each[order][begin[:-1] + np.diff(begin) // 2]
        rare = each <= RARE * np.maximum(1, median)[part]
        key = np.repeat(np.arange(len(self.keys)), np.diff(self.first))[rare]
        self.item, self.at = self.item[rare], self.at[rare]
        kept, counts = np.unique(key, return_counts=True)
        self.keys, self.first = self.keys[kept], np.concatenate([[0], np.cumsum(counts)])
        self.quick = np.zeros(1 << FILTER_BITS, bool)
        self.quick[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, numbers of keys) of the n-grams that are seeds."""
        at = np.flatnonzero(self.quick[grams >> np.uint64(64 - FILTER_BITS)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.searchsorted(self.keys, grams[at]).clip(max=len(self.keys) - 1)
        true = self.keys[k] == grams[at]
        return at[true], k[true]


def _frequencies(it: Iterator[pa.RecordBatch], seeds: Seeds) -> Iterator[pa.RecordBatch]:
    """(seed, n): how many rows hold each seed."""
    hashes, n = WordHashes(), np.zeros(len(seeds.keys), np.int64)
    for batch in chunks(it):
        for text in batch.column("text").to_pylist():
            _, k = seeds.hits(shingles(hashes.of(plain_words(text)), SEED))
            n[np.unique(k)] += 1
    at = np.flatnonzero(n)
    yield pa.record_batch([pa.array(at), pa.array(n[at])], names=["seed", "n"])


def smith_waterman(items: np.ndarray, passages: np.ndarray, miss: int = MISS, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of rows of word numbers, and where in the passages the alignments end.

    Row r of items is aligned to row r of passages. 0 pads items and 1 pads passages; they match nothing.
    """
    n, width = items.shape
    steps = np.arange(width) * -gap
    h, best, end = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for j in range(passages.shape[1]):
        new = h[:, :-1] + np.where(items == passages[:, j, None], MATCH, miss).astype(np.int32)
        np.maximum(new, h[:, 1:] + gap, out=new)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + steps, axis=1) - steps
        h[:, 1:] = new
        top = new.max(1)
        better = top > best
        best[better], end[better] = top[better], j
    return best, end


def _pad(rows: list[np.ndarray], width: int, by: int) -> np.ndarray:
    out = np.full((len(rows), width), by, np.uint64)
    for r, x in zip(out, rows, strict=True):
        r[: len(x)] = x
    return out


def _leaks(it: Iterator[pa.RecordBatch], seeds: Seeds, threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, item, score, start, end) of each text and item aligned well enough; the best place of each."""
    hashes = WordHashes()
    for batch in chunks(it):
        texts, places = [], []
        for r, text in enumerate(batch.column("text").to_pylist()):
            words = hashes.of(plain_words(text))
            texts.append(words)
            at, k = seeds.hits(shingles(words, SEED))
            if not len(at):
                continue
            n = seeds.first[k + 1] - seeds.first[k]
            post = np.repeat(seeds.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = seeds.item[post]
            size = np.array([len(seeds.words[i]) for i in item])
            step = np.maximum(4, size // 2)
            # places of one item whose alignments start within a step of each other share a window
            bin_ = (np.repeat(at, n) - seeds.at[post]) // step
            for i, b, s, m in np.unique(np.stack([item, bin_, step, size]), axis=1).T.tolist():
                start = max(0, b * s - s)
                places.append((r, i, start, words[start : (b + 2) * s + m]))
        found: dict[tuple[int, int], tuple] = {}
        by_size: dict[int, list] = {}
        for p in places:
            by_size.setdefault(len(seeds.words[p[1]]).bit_length(), []).append(p)
        for group in by_size.values():
            for lo in range(0, len(group), 2048):
                part = group[lo : lo + 2048]
                width = max(len(seeds.words[p[1]]) for p in part)
                items = _pad([seeds.words[p[1]] for p in part], width, 0)
                best, end = smith_waterman(items, _pad([p[3] for p in part], max(len(p[3]) for p in part), 1))
                for (r, i, start, passage), score, last in zip(part, best.tolist(), end.tolist(), strict=True):
                    share, gap = score / (MATCH * len(seeds.words[i])), GAP
                    if share < threshold and score >= MATCH * PASSAGE:
                        # the place and share of the passage by itself
                        strict, at = smith_waterman(seeds.words[i][None], passage[None], EDIT, EDIT)
                        if strict[0] < MATCH * PASSAGE:
                            continue
                        last, gap = int(at[0]), EDIT
                    elif share < threshold:
                        continue
                    if share > found.get((r, i), (0,))[0]:
                        back, first = smith_waterman(seeds.words[i][None, ::-1], passage[None, last::-1], min(gap, MISS), gap)
                        found[r, i] = (share, start + last - int(first[0]), start + last + 1)
        if found:
            ids = batch.column("id").to_pylist()
            cols = list(zip(*[(ids[r], seeds.ids[i], *v) for (r, i), v in found.items()], strict=True))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "item_id", "score", "start", "end"])


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, start, end): documents that hold a passage of a benchmark item, and its words' range.

    Words: see plain_words. The items' 3-grams are seeds; how many documents hold each is counted over all documents, and
    an item's rare ones (those not much more frequent than the median one of their part of it, so an item or a passage that
    a third of all documents hold keeps its seeds) mark where it may be. Each such window is aligned to the item with Smith-Waterman (match 2, mismatch
    and gap -1); score is the best one's share of the item's full score. Rows of the result have a score of `threshold`
    or more, or hold a passage of the item that by itself scores as much as PASSAGE words do (mismatch and gap EDIT); a row of docs and an item give one at most. Items of fewer than 3 words, nulls among them, are not sought.
    The benchmark is broadcast in blocks of about block_words words, and documents are read twice for each block; they
    are never shuffled. Repeated rows, null ids and empty tables need no care: each row is judged for itself.
    """
    spark, rows = docs.sparkSession, docs.select(F.col("doc_id").alias("id"), "text")
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // (4 * block_words)
    found = []
    for block in range(blocks):
        part = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        seeds = Seeds([tuple(r) for r in part.collect()])
        if not seeds.ids:
            continue
        sent = spark.sparkContext.broadcast(vars(seeds))
        counts = rows.select("text").mapInArrow(lambda it, sent=sent: _frequencies(it, Seeds.restored(sent.value)), "seed long, n long")
        with batches_of(spark, TEXTS):
            counts = counts.groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
        df = np.zeros(len(seeds.keys), np.int64)
        df[np.asarray(counts["seed"], dtype=np.int64)] = np.asarray(counts["n"])
        seeds.keep_rare(df)
        sent = spark.sparkContext.broadcast(vars(seeds))
        found.append(rows.mapInArrow(lambda it, sent=sent: _leaks(it, Seeds.restored(sent.value), threshold), "id long, item_id long, score double, start long, end long"))
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, start long, end long")
    return reduce(DataFrame.unionAll, found).withColumnRenamed("id", "doc_id")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold a benchmark passage. Rows with one doc_id go or stay together;
    a row without a doc_id is told by its text. All columns come back as they were, whatever their names."""
    rows = docs.select(identity().alias("id"), whole_row(docs))
    number = docs.select(identity().alias("doc_id"), "text")
    bad = staged(leaks(number, benchmark, threshold).select(F.col("doc_id").alias("id")).distinct(), "leaks", rows=TEXTS)
    return columns_of(rows.join(bad.hint("merge"), "id", "left_anti"), docs)
