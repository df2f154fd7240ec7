"""What several corpus operators share: staged tables, gapless numbering, batches of texts and word hashes."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Odd multipliers of the hash functions below.
MULT = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Text bytes that a Python worker handles at a time; bounds its arrays whatever the Arrow batch.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local mode only) one of our own."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="timegrid-")
        atexit.register(shutil.rmtree, shared_dir.own, ignore_errors=True)
    return "file://" + shared_dir.own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/timegrid-{name}-{uuid.uuid4().hex}"


@contextmanager
def configured(spark: SparkSession, **values: object) -> Iterator[None]:
    """While this holds, the session's settings spark.sql.(name, with _ for .) are these; None: as the session has it."""
    keys = {f"spark.sql.{name.replace('_', '.')}": v for name, v in values.items() if v is not None}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, str(v).lower())
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """While this holds, at most so many rows go to Python at a time: few if they are long. None: as the session has it."""
    most = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    with configured(spark, execution_arrow_maxRecordsPerBatch=rows and (min(rows, most) if most > 0 else rows)):
        yield


#: Rows of texts that go to Python at a time.
TEXTS = 1000


def staged(df: DataFrame, name: str, partition_by: Sequence[str] = (), rows: int | None = None, size: int | None = None) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again: lineage ends there, nothing is computed twice.

    rows, size: how many rows, or about how many bytes, go to Python at a time meanwhile. Shuffle files of the write are
    removed when it ends, as no later plan can read them."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    clean = {"classic_shuffleDependency_fileCleanup_enabled": True, "execution_arrow_maxBytesPerBatch": size}
    with batches_of(spark, rows), configured(spark, **clean):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, at)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, buckets: int = 1024) -> DataFrame:
    """df (a staged table with a long column `bucket` below `buckets`) with `name`: 0, 1, ... within each group.

    A group of any size is numbered by up to `buckets` tasks: counts of each (group, bucket) give each bucket's first
    number, and a window numbers the rows of a bucket. df must be a staged table, as it is read twice.
    """
    counts = df.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*group, "bucket", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("first_"))
    within = Window.partitionBy(*group, "bucket").orderBy(*order)
    return (
        df.join(first, [*group, "bucket"])
        .withColumn(name, F.col("first_") + F.row_number().over(within) - 1)
        .drop("first_", "bucket")
    )


def identity() -> Column:
    """A document's number: its doc_id, or for a row without one a negative number from its text."""
    return F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(F.xxhash64("text"), 1))


def whole_row(docs: DataFrame, *without: str) -> Column:
    """All columns of docs (but those) as one, `row`: beside it an operator's own columns can clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias("row")


def columns_of(rows: DataFrame, docs: DataFrame, **instead: Column) -> DataFrame:
    """The columns of docs, in order, from the column `row` of rows, or from what is given instead."""
    return rows.select(*[instead[c].alias(c) if c in instead else F.col("row").getField(c).alias(c) for c in docs.columns])


def spread(buckets: int):
    """A column that deals rows over buckets evenly, whatever their keys. Stage it before it is used twice."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).alias("bucket")


def release() -> None:
    """Gives memory that a task has freed back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(it: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `limit` bytes of text each (one row at least)."""
    for batch in it:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        width = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
        ends, at = np.cumsum(width, dtype=np.int64), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


class WordHashes(dict):
    """word -> its 64-bit hash, kept for the words seen lately; `limit` words at most."""

    limit = 100_000

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: Sequence[str | bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: ASCII letters, digits, _ and the bytes of other characters stay; everything else parts words.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
_ASCII = bytes(c + 32 if 65 <= c <= 90 else _WORDS[c] for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Words for comparing texts: runs of letters, digits and _ in lower case, in UTF-8; ASCII punctuation parts them."""
    if not text:
        return []
    return text.encode().translate(_ASCII).split() if text.isascii() else text.lower().encode().translate(_WORDS).split()


def plain_bytes(data: bytes) -> bytes:
    """A text's UTF-8 bytes with blanks between and around its plain_words(), all else as they are."""
    return data.translate(_ASCII) if data.isascii() else data.decode().lower().encode().translate(_WORDS)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that changes about half of the bits (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of an array of word hashes (empty when it has fewer words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= MULT
        out += words[j : n + j]
    return mixed(out)


def as_long(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed longs."""
    return x.view(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
