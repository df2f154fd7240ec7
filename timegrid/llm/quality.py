"""Hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timegrid.llm.common import WordHashes, chunks, drop_path, mixed, shingles, staged

BITS = 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: The labelled rows that are learned from, at most: those whose ids have the smallest hashes.
TRAIN_ROWS = 8192
#: Examples that the driver learns from at a time.
PART = 1024
THRESHOLD = 0.3
SCALE = 8.0


class Shapes(WordHashes):
    """token -> a hash of its shape: other characters as they are, words by case and digits."""

    def __missing__(self, token: str) -> int:
        kind = token[0]
        if kind.isalnum() or kind == "_":
            kind = "0" if token.isdigit() else "A" if token.isupper() and len(token) > 1 else "Aa" if kind.isupper() else "a"
        else:
            kind = token[:3]
        if len(self) >= self.limit:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(kind, 1)
        return h


def features(text: str, hashes: WordHashes, shapes: Shapes) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams of words and of word shapes, and of whether a word follows itself."""
    tokens = TOKEN.findall(text)
    w, s = hashes.of(tokens), shapes.of(tokens)
    same = np.array([11, 12], np.uint64)[(w[1:] == w[:-1]).astype(int)]
    grams = [mixed(w), shingles(w, 2), mixed(s), shingles(s, 2), mixed(same)]
    return np.concatenate(grams) >> np.uint64(64 - BITS)


@dataclass
class Ftrl:
    """Follow the regularised leader, proximal, with a learning rate for each coordinate."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.05

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """One update; `at` has no index twice."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _examples(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features of each text and their shares, as bytes."""
    hashes, shapes = WordHashes(), Shapes()
    for batch in chunks(it):
        ats, xs = [], []
        for text in batch.column("text").to_pylist():
            got = features(text or "", hashes, shapes)
            at, n = np.unique(got, return_counts=True)
            ats.append(at.astype("<u4").tobytes())
            xs.append((n * (SCALE / max(1, len(got)))).astype("<f4").tobytes())
        cols = [batch.column("part"), batch.column("number"), batch.column("label"), pa.array(ats, pa.binary()), pa.array(xs, pa.binary())]
        yield pa.record_batch(cols, names=["part", "number", "label", "at", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = 3) -> np.ndarray:
    """Weights (the last: the bias) learned from up to `rows` labelled documents, in the order of their ids' hashes.

    A document labelled both ways counts as bad; null labels and ids count not at all. Of rows of docs with one doc_id the
    text with the smallest hash is learned from, so there are `rows` examples at most. The sample's ids are broadcast (at
    most `rows` numbers), so no text is shuffled but the sample's. Examples are numbered and staged once in parts of PART;
    the driver holds one part at a time, at most PART times the 2^BITS features that an example can have.
    """
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = chosen.select(F.col("doc_id").alias("id"), "label", (F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) - 1).alias("number"))
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")
    texts = texts.groupBy("number", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    texts = texts.select(F.floor(F.col("number") / PART).cast("int").alias("part"), "number", "label", "text")
    found = texts.repartitionByRange("part").mapInArrow(_examples, "part int, number int, label int, at binary, x binary")
    found = staged(found, "examples", ["part"])
    model, bias = Ftrl(), np.array([1 << BITS])
    parts = sorted(r["part"] for r in found.select("part").distinct().collect())
    for _ in range(epochs):
        for part in parts:
            got = found.filter(F.col("part") == part).select("number", "label", "at", "x").toArrow().sort_by("number")
            for label, where, share in zip(*(got[c].to_pylist() for c in ("label", "at", "x")), strict=True):
                at = np.concatenate([np.frombuffer(where, "<u4").astype(np.int64), bias])
                model.learn(at, np.concatenate([np.frombuffer(share, "<f4").astype(float), [1.0]]), int(label > 0))
    if parts:
        drop_path(docs.sparkSession, found.inputFiles()[0].rsplit("/", 2)[0])
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, predicted) of each row: the sparse dot product of its features and the weights, as a probability.

    Texts that are null, empty or without any token get the bias alone. Only the text counts; the rows are not shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hashes, shapes = sent.value.astype(float), WordHashes(), Shapes()
        for batch in chunks(it):
            out = []
            for text in batch.column("text").to_pylist():
                got = features(text or "", hashes, shapes)
                out.append(w[-1] + (SCALE * float(w[got].mean()) if len(got) else 0.0))
            p = 1 / (1 + np.exp(-np.clip(np.array(out), -35, 35)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double, predicted int")


def held_out(part: int = 5, rest: int = 0):
    """Whether a row is kept from learning: the checksum of its id, as text, leaves that rest."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % part == rest


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, learned from labelled rows that aren't held out.

    Without any label the score is 0.5. An empty table gives an empty one.
    """
    out = score(docs, train(docs, labels.filter(~held_out()), rows))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
