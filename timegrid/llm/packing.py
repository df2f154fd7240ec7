"""Vector best-fit packing of tokenized documents into sequences."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import TEXTS, chunks, numbered, spread, staged

END_ID = 0
BUCKETS = 1024

#: The vocabulary's split of lower-case text into pieces, for characters up to U+00FF, where Python's classes agree.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿªµº]+|[0-9²³¹¼½¾]|[^\sa-zß-öø-ÿªµº0-9²³¹¼½¾]+"
#: Characters that make a text not plain; < may begin a special token.
ODD = r"[^\t\n\r\x20-\x3b\x3d-\x7e\xc0-\xff]"


class Memo(dict):
    """What `compute` gave for the keys used last: two generations of `limit` keys at most. A generation that is full becomes
    the old one, whose entries come back when used."""

    def __init__(self, compute: Callable[[str], bytes], limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        if (out := self.old.get(key)) is None:
            out = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class TokenIds:
    """Texts' token ids as little-endian 32-bit bytes.

    The tokenizer splits at white space and normalises no character across it, so a text's ids are those of its words. A
    text of plain characters is split into pieces here, and its pieces go to the vocabulary's model as they are, which
    spares the tokenizer's own normalising and splitting; of any other text each word goes through all of the tokenizer.
    Pieces and words used last are kept: some 150 MB at most.
    """

    def __init__(self, path: str, limit: int = 300_000):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split, self.odd = re.compile(PIECE).findall, re.compile(ODD).search
        # the vocabulary writes each byte as a character: visible ones as they are, the others from U+0100 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.characters = {b: 256 + n for n, b in enumerate(hidden)}
        self.pieces, self.words = Memo(self._piece, limit), Memo(self._word, limit // 6)

    def _word(self, word: str) -> bytes:
        return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.characters)
        return self._bytes([token.id for token in self.model.tokenize(piece)])

    def _bytes(self, numbers: list[int]) -> bytes:
        ids = array("I", numbers)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def of(self, text: str) -> bytes:
        if self.odd(text):
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.pieces.__getitem__, self.split(text.lower())))


def token_ids(path: str) -> TokenIds:
    """One TokenIds for a Python worker and file, kept from task to task: beside sys, as the package travels by value, so that
    each task has new globals of its own."""
    kept = vars(sys).setdefault("_timegrid_token_ids", {})
    if path not in kept:
        kept[path] = TokenIds(path)
    return kept[path]


def _pieces(it: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    memo, end = token_ids(path), END_ID.to_bytes(4, "little")
    for batch in chunks(it):
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = memo.of(text or "") + end
            for k, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size]
                for col, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    col.append(v)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. Attention cost: the sum of length squared over its pieces."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048


def best_fit(counts: dict[int, int], limits: Limits, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> np.ndarray:
    """Placements of counts[length] pieces of each length, as rows (length, rank, n, sequence, offset).

    Piece number rank + i of that length, i < n, goes to sequence + i at that offset. Lengths go from long to short. Each
    next piece goes to the open sequence, of those that have room in tokens, documents and attention cost, that the rule
    prefers: `norm` the least weighted norm of what would be left of the three, `dot` the largest weighted dot-product of
    what is left and the piece's needs, each as shares of a sequence's limits; a tie goes to the fewest tokens left. None
    has room: a new one is opened. Equal sequences are handled together, as ranges of their numbers, and equal pieces as
    ranges of ranks, so time and space depend on the number of lengths (tokens at most), not on that of documents.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    whole = np.array([limits.tokens, limits.documents, limits.cost], np.int64)
    scale, w = whole.astype(float), np.array(weights)
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, need = counts[length], 0, np.array([length, 1, length * length], np.int64)
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's limits")

        def place(state: tuple[int, int, int], first: int, n: int, each: int) -> None:
            nonlocal rank, left
            for j in range(each):
                rows.append((length, rank, n, first, limits.tokens - state[0] + j * length))
                rank += n
            left -= n * each
            after = tuple(int(s - each * d) for s, d in zip(state, need, strict=True))
            if after[0] and after[1] and after[2]:
                states[after].append((first, n))

        while left:
            keys = np.array(list(states), np.int64).reshape(-1, 3)
            fits = (keys >= need).all(1)
            if fits.any():
                open_, share = keys[fits], need / scale
                if rule == "norm":
                    score = (w * ((open_ - need) / scale) ** 2).sum(1)
                else:
                    score = -(w * (open_ / scale) * share).sum(1)
                state = tuple(int(x) for x in open_[np.lexsort((open_[:, 0], score))[0]])
                first, n = states[state].pop()
                if not states[state]:
                    del states[state]
            else:
                state, first, n = tuple(int(x) for x in whole), opened, None
            each = min(int(s // d) for s, d in zip(state, need, strict=True))
            full = left // each if n is None else min(n, left // each)
            short = left - full * each if (n is None or full < n) else 0
            if n is None:
                n = full + bool(short)
                opened += n
            if full:
                place(state, first, full, each)
            if short:
                place(state, first + full, 1, short)
            if (rest := n - full - bool(short)) > 0:
                states[state].append((first + full + bool(short), rest))
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): each document's pieces and their places.

    A document is its text's token ids (a null text has none) and then id 0. Documents longer than limits.tokens are cut
    into pieces of that many; the last may be shorter. `tokenizer` is the vocabulary file's path on every machine.
    Rows are packed each for itself, whatever their doc_id; an empty table gives an empty one.

    Best-fit looks at lengths only, so the driver packs the histogram of lengths (limits.tokens numbers at most) and each
    piece finds its place by its rank among the pieces of its length. Ranks are dealt over many tasks, ties included.
    """
    size = limits.tokens
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda it: _pieces(it, tokenizer, size), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    rows = staged(rows.select("*", spread(BUCKETS)), "pieces", rows=TEXTS)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = best_fit(counts, limits, weights, rule)
    places = places[np.lexsort((places[:, 1], places[:, 0]))]
    sent = docs.sparkSession.sparkContext.broadcast((places[:, 0] << 44 | places[:, 1], places[:, 3] - places[:, 1], places[:, 4]))

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, shift, offset = sent.value
        for batch in it:
            if not batch.num_rows:
                continue
            rank = np.asarray(batch.column("rank"))
            k = np.searchsorted(starts, np.asarray(batch.column("length")) << 44 | rank, "right") - 1
            cols = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.record_batch([*cols, pa.array(rank + shift[k]), pa.array(offset[k])], names=names)

    ranked = numbered(rows, ["length"], ["doc_id", "piece", "ids_crc32", "start"], "rank", BUCKETS)
    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
