"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted text against the raw corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timegrid.llm.common import TEXTS, WordHashes, batches_of, chunks, columns_of, drop_staged, mixed, shingles, staged, whole_row

BITS = 17
TOKEN = re.compile(r"\w+|[^\w\s]+")
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Counts added to a bucket on either side, so that rare n-grams say little.
SMOOTH = 10.0
#: From so many trusted n-grams on SMOOTH holds; of fewer each counts for less in proportion.
ENOUGH = 1_000_000
#: Bits of the filter that spares texts without a trusted id the shuffle.
FILTER_BITS = 24
#: A document is kept at this mean log-likelihood ratio of its n-grams or more.
THRESHOLD = -0.05


def ngram_buckets(text: str, hashes: WordHashes) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams. Tokens are runs of word characters and runs of other printable ones."""
    words = hashes.of(TOKEN.findall(text))
    return np.concatenate([mixed(words), shingles(words, 2)]) >> np.uint64(64 - BITS)


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of a partition."""
    hashes, sums = WordHashes(), np.zeros(1 << BITS, np.int64)
    for batch in chunks(it):
        found = [ngram_buckets(text, hashes) for text in batch.column("text").to_pylist() if text]
        if found:
            sums += np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(sums)
    if len(at):
        yield pa.record_batch([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])


def _summed(texts: DataFrame) -> np.ndarray:
    """How often each of 2^BITS buckets occurs in a column `text`: added up per partition before a shuffle of at most 2^BITS
    rows from each; the driver gets 2^BITS sums, whatever the corpus."""
    sums = texts.mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    with batches_of(texts.sparkSession, TEXTS):
        got = sums.toArrow()
    out = np.zeros(1 << BITS)
    out[np.asarray(got["bucket"])] = np.asarray(got["n"])
    return out


def _place(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_.cast("long")), F.lit(1 << FILTER_BITS))


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of the rows (id, text) whose id is in `ids` (id; distinct, none null).

    Only rows that pass a Bloom filter of the ids (one hash, 2^FILTER_BITS bits, built in parts) are shuffled to meet them.
    """
    place = ids.select(_place(F.col("id")).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 32).cast("int"))
    words = place.groupBy(F.floor(F.col("p") / 32).cast("long").alias("w")).agg(F.bit_or(bit).alias("bits"))
    got = words.toArrow()
    bits = np.zeros(1 << FILTER_BITS >> 5, np.uint32)
    bits[np.asarray(got["w"])] = np.asarray(got["bits"]).astype(np.uint32)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def likely(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            p = np.asarray(batch.column("p"))
            yield batch.select(["id", "text"]).filter(pa.array((sent.value[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1))

    some = rows.filter("id is not null").select("id", "text", _place(F.col("id")).alias("p")).mapInArrow(likely, rows.schema)
    return some.join(ids.hint("merge"), "id", "left_semi")


def ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log p(bucket | trusted) / p(bucket | raw) for each of 2^BITS buckets, counted over all documents.

    trusted: a column doc_id, which may grow with the corpus, so it is never broadcast. Raw counts take no shuffle of
    texts, and of the others only those move that are trusted or look so. Raw counts are scaled to the trusted total, then
    both are smoothed by the same pseudo-counts: SMOOTH, and more while fewer than ENOUGH trusted n-grams are known, so
    that what a small sample lacks by chance says little.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("id")).dropna().distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    raw = _summed(docs.select("text"))
    with batches_of(docs.sparkSession, TEXTS):
        some = staged(_among(rows, ids).select("text"), "trusted")
    target = _summed(some)
    drop_staged(some)
    total = target.sum()
    if not total:
        return np.zeros(1 << BITS)
    smooth = SMOOTH * max(1.0, ENOUGH / total)
    return np.log((target + smooth) / (raw * (total / raw.sum()) + smooth))


def repeated_words(words: np.ndarray) -> int:
    """How many words lie in windows of WINDOW words that the text holds twice or more."""
    grams = shingles(words, WINDOW)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(grams)] += twice
    edge[WINDOW : WINDOW + len(grams)] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _judged(it: Iterator[pa.RecordBatch], table: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    words_of, tokens_of = WordHashes(), WordHashes()
    for batch in chunks(it):
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            words = words_of.of(text.encode().split())
            lines, dup = set(), 0
            for line in text.split("\n"):
                if line.strip(SPACE):
                    dup += line in lines
                    lines.add(line)
            n, repeats = len(words), repeated_words(words)
            grams = ngram_buckets(text, tokens_of)
            score = float(table[grams].mean()) if len(grams) else 0.0
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
            chars = len(text) - sum(map(text.count, SPACE))
            rows.append((n, chars, sum(map(text.count, SYMBOLS)), dup, repeats, failed, not failed and score >= threshold, score))
        types = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64())
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.record_batch([batch.column("row"), *cols, batch.column("text")], names=["row", *NAMES, "text"])


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
KINDS = (*["long"] * 5, "boolean", "boolean", "double")


def _with_verdicts(docs: DataFrame, trusted: DataFrame, row: Column, threshold: float) -> DataFrame:
    """(row, NAMES, text) of each row of docs: one more pass over the texts, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios(docs, trusted))
    rows = docs.select(row.alias("row"), "text")
    schema = StructType([rows.schema["row"]])
    for name, kind in zip(NAMES, KINDS, strict=True):
        schema.add(name, kind)
    return rows.mapInArrow(lambda it: _judged(it, sent.value, threshold), schema.add("text", "string"))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, llr) for each row of docs; its other columns play no part.

    Words are runs of bytes other than 20, 09-0D hex; a null text has none. base_failed: under 20 words, or over 30 % of
    them in 8-word windows that the text repeats. llr: the mean over the text's unigrams and bigrams of their hashed
    log-likelihood ratio, trusted against all text; 0 with none. kept: not base_failed and llr >= threshold, for any row,
    repeated or not. Without trusted rows every llr is 0. trusted may hold null, unknown or repeated ids.
    """
    return _with_verdicts(docs, trusted, F.struct("doc_id"), threshold).select("row.doc_id", *NAMES)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The documents labelled good, and never bad."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that judge() doesn't keep. All columns come back as they were, whatever their names."""
    kept = _with_verdicts(docs, trusted_ids(labels), whole_row(docs, "text"), THRESHOLD).filter("kept")
    return columns_of(kept, docs, text=F.col("text"))
