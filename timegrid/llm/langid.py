"""Language identification by multilingual mixture inference over character n-grams."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import TEXTS, batches_of, chunks

BITS = 16
#: Numbers that are no letters and no decimal digits: fractions, Roman numerals, digits in circles and the like.
NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
#: What is no letter (Unicode category L). Characters above U+FFFF in a set are tried one by one, so only texts that hold
#: some are searched with these.
NOT_LETTER = re.compile(rf"[\W\d_{NUMBERS}]+")
NOT_LETTER_BELOW = re.compile(rf"[\W\d_{''.join(c for c in NUMBERS if c <= chr(0xFFFF))}]+")
ABOVE = re.compile(f"[{chr(0x10000)}-{chr(sys.maxunicode)}]")
#: Pseudo-counts of a bucket, EM rounds, and nats of log-likelihood that a further language must bring per log(words).
SMOOTH, ROUNDS, PENALTY = 0.5, 12, 3.0
UNKNOWN = "und"
#: Languages that are learned at most, those of the most documents; bounds what is collected and broadcast.
LANGUAGES = 128


def _letters(text: str | None) -> str:
    """A text's words, runs of letters in lower case, parted by single blanks."""
    text = (text or "").lower()
    return (NOT_LETTER if ABOVE.search(text) else NOT_LETTER_BELOW).sub(" ", text).strip()


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram that starts at each letter or before a word; where words start; words of each text).

    A text is its words in lower case, each with a blank before; a trigram may reach over a word's end into a blank.
    """
    cleaned = [_letters(t) for t in texts]
    n_words = np.array([c.count(" ") + 1 if c else 0 for c in cleaned], np.int64)
    code = np.frombuffer((" " + " ".join(c for c in cleaned if c) + "   ").encode("utf-32-le"), "<u4")
    x = code.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77) + np.uint32(0x165667B1))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + x[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39)
    n = len(x) - 3
    starts = np.flatnonzero(x[:n] == 32)
    total = int(n_words.sum())
    return (h[:n] >> np.uint32(32 - BITS)).astype(np.int64), starts[:total], n_words


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in chunks(it):
        by: dict[str, list] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            got, starts, _ = _grams(texts)
            if len(starts):
                sums[lang] = sums.get(lang, 0) + np.bincount(got, minlength=1 << BITS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])


def learn(docs: DataFrame, most: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log p(trigram bucket | language) for each, counted over all rows of docs with a lang.

    Of more than `most` values of lang, those of the most rows are languages (of equals the first in order): a column full
    of stray values can't make the table grow, which has 2^BITS numbers a language.
    """
    rows = docs.filter("lang is not null and text is not null").select("text", "lang")
    common = docs.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).select("lang")
    rows = rows.join(F.broadcast(common), "lang", "left_semi")
    sums = rows.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    with batches_of(docs.sparkSession, TEXTS):
        got = sums.toArrow()
    names = np.array(got["lang"].to_pylist(), dtype=object)
    langs = sorted(set(names))
    n = np.zeros((len(langs), 1 << BITS))
    n[np.searchsorted(langs, names) if langs else [], np.asarray(got["bucket"], dtype=np.int64)] = np.asarray(got["n"])
    return langs, np.log((n + SMOOTH) / (n + SMOOTH).sum(1, keepdims=True)).astype(np.float32)


def _em(like: np.ndarray, seg: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages in each text and log-likelihoods, from likelihoods of words (scaled per word).

    seg: each word's text; first: each text's first word; share: where to start; a language at 0 stays out.
    """
    n = np.diff(np.append(first, len(seg)))[:, None]
    for _ in range(rounds):
        joint = like * share[seg]
        joint /= joint.sum(1, keepdims=True)
        new = np.add.reduceat(joint, first) / n
        moved, share = np.abs(new - share).max(initial=0), new
        if moved < 1e-3:
            break
    return share, np.add.reduceat(np.log((like * share[seg]).sum(1) + 1e-300), first)


def mixture(words: np.ndarray, first: np.ndarray, max_languages: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages in each text, and posteriors of the single languages, from log-likelihoods of words.

    EM over all languages ranks them for each text. Then the set grows in that order as long as the penalised likelihood
    does: each language more must bring PENALTY times log(words) nats. max_languages bounds the set.
    """
    seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    top = words.max(1, keepdims=True)
    like = np.exp(np.maximum(words - top, -60.0)).astype(np.float64)
    n = np.diff(np.append(first, len(words)))
    total = np.add.reduceat((words - top).astype(np.float64), first)
    post = np.exp(total - total.max(1, keepdims=True))
    post /= post.sum(1, keepdims=True)
    k = words.shape[1]
    full, _ = _em(like, seg, first, np.full((len(first), k), 1 / k), ROUNDS)
    # the first language is the best single one, the others follow by their shares
    rank_by = full + 2.0 * (np.arange(k) == total.argmax(1)[:, None])
    order = np.argsort(-rank_by, axis=1, kind="stable")
    best = np.zeros_like(full)
    best[np.arange(len(first)), order[:, 0]] = 1.0
    value = total[np.arange(len(first)), order[:, 0]]
    open_ = np.ones(len(first), bool)
    for size in range(2, min(k, max_languages) + 1):
        # no set of `size` can beat taking each word's best language: a bound that spares most texts the rounds
        open_ &= -value > PENALTY * np.log(n + 1)
        if not open_.any():
            break
        mask = np.zeros_like(full)
        np.put_along_axis(mask, order[:, :size], 1.0, 1)
        rows = np.flatnonzero(open_)
        sub = open_[seg]
        start = np.concatenate([[0], np.cumsum(n[rows])[:-1]])
        share, like_sum = _em(like[sub], np.repeat(np.arange(len(rows)), n[rows]), start, (full[rows] + 1e-3) * mask[rows], ROUNDS)
        gain = like_sum - value[rows] > PENALTY * np.log(n[rows] + 1)
        best[rows[gain]], value[rows[gain]] = share[gain], like_sum[gain]
        open_[rows[~gain]] = False
    return best, post


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, max_languages: int = 4) -> DataFrame:
    """(doc_id, lang_pred, score, langs, shares) of each row: the language with the largest share, and the mixture.

    score is that share in a mixture, and the language's posterior where it stands alone. A text that is null or has no letter is
    `und` with score 0 and no languages; so is every text when nothing was learned. Only the text counts. No shuffle; the
    table that is broadcast has 2^BITS numbers a language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))

    def guessed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = sent.value
        for batch in chunks(it, limit=1 << 20):
            grams, starts, n_words = _grams(batch.column("text").to_pylist())
            out: list[tuple] = [(UNKNOWN, 0.0, [], [])] * len(n_words)
            if len(starts) and langs:
                has = np.flatnonzero(n_words)
                first = np.concatenate([[0], np.cumsum(n_words[has])[:-1]])
                share, post = mixture(np.add.reduceat(logp[grams], starts), first, max_languages)
                for i, s, p in zip(has, share, post, strict=True):
                    k = int(s.argmax())
                    some = [int(j) for j in np.argsort(-s, kind="stable") if s[j] > 0]
                    out[i] = (langs[k], float(np.clip(s[k] if len(some) > 1 else p[k], 0, 1)), [langs[j] for j in some], [float(s[j]) for j in some])
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), *cols], names=["doc_id", "lang_pred", "score", "langs", "shares"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(guessed, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, langs, shares): learned from the rows that aren't held out."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    langs, table = learn(docs.filter(~out))
    return predict(docs, langs, table).select("doc_id", out.alias("held_out"), "lang_pred", "score", "langs", "shares")
