"""Line deduplication against levelled sorted runs of line hashes (a log-structured merge index)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timegrid.llm.common import TEXTS, chunks, columns_of, drop_path, drop_staged, new_path, staged, whole_row

#: White space of a key's ends, and A-Z to a-z.
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIN_CHARS = 10
#: Numbers of rows without a doc_id lie below this, above all doc_ids.
NO_ID = (1 << 63) - 1


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(LOWER)


def _line_keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key hash) of the distinct keys of each text that are long enough."""
    for batch in chunks(it):
        ids, keys = [], []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = {k for line in (text or "").split("\n") if len(k := line_key(line)) >= MIN_CHARS}
            keys += [xxhash.xxh3_128_digest(k) for k in found]
            ids += [doc] * len(found)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc", "key"])


def _without(it: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Each text without the lines whose keys are in its row's list."""
    for batch in chunks(it):
        texts, lines, dropped = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            parts = (text or "").split("\n")
            kept = parts
            if gone:
                gone = set(gone)
                kept = [x for x in parts if len(k := line_key(x)) < MIN_CHARS or xxhash.xxh3_128_digest(k) not in gone]
            out = text if len(kept) == len(parts) else "\n".join(kept)
            texts.append(hashlib.sha256((out or "").encode()).hexdigest() if digest else out)
            lines.append(len(parts))
            dropped.append(len(parts) - len(kept))
        new = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())]
        yield pa.record_batch([batch.column("row"), *new], names=["row", "n_lines", "n_dropped", "text"])


class LineIndex:
    """Sorted runs of (key, own) in levels. A batch is joined with each run, then its new keys become a run of level 0.

    Once a level has `fanout` runs, they are merged into one of the next level, so n batches leave O(log n) runs and each
    key is rewritten O(log n) times. Runs are tables bucketed and sorted by key, with as many buckets as a shuffle has
    partitions, so a batch is shuffled once, by key, and met by the runs' buckets where they lie. Runs are disjoint; an
    owner is the smallest document of the first batch that held the key.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made: list[tuple[str, str]] = []

    def _saved(self, run: DataFrame) -> DataFrame:
        path = new_path(self.spark, "run")
        name = "timegrid_run_" + path[-32:]
        run.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self.made.append((name, path))
        return self.spark.table(name)

    def joined(self, keys: DataFrame) -> DataFrame:
        """(key, own, last, old): a batch's distinct keys, their first and last documents, and the owner in an older run."""
        own = keys.groupBy("key").agg(F.min("doc").alias("own"), F.max("doc").alias("last"))
        runs = [run for level in self.levels for run in level]
        old = [F.col(f"old{i}") for i in range(len(runs))]
        for i, run in enumerate(runs):
            # never broadcast: a run grows with the corpus
            own = own.join(run.filter("old is null").select("key", F.col("own").alias(f"old{i}")).hint("merge"), "key", "left")
        return own.select("key", "own", "last", F.coalesce(*old, F.lit(None).cast("long")).alias("old"))

    def add(self, keys: DataFrame) -> DataFrame:
        """Takes a batch's (doc, key); gives the staged (doc, key) to drop: those whose owner is another document.

        Owners stay right only if each batch's documents are above those of the batches before.
        """
        # its rows without an older owner are the run
        own = self._saved(self.joined(keys))
        self.levels[0].append(own)
        shared = own.select("key", F.coalesce("old", "own").alias("owner"), "last").filter("last > owner").select("key", "owner")
        # staged, so that the join deals both sides anew and a line that very many hold can be split
        shared = staged(shared, "shared")
        out = staged(keys.join(shared, "key").filter("doc != owner").select("doc", "key"), "repeats")
        drop_staged(shared)
        self._compact()
        return out

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = reduce(DataFrame.unionAll, [run.filter("old is null").select("key", "own") for run in level])
                # the runs are disjoint, so this only brings their equal buckets together, without a shuffle
                merged = merged.groupBy("key").agg(F.min("own").alias("own")).withColumn("old", F.lit(None).cast("long"))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._saved(merged))
                self.levels[k] = []

    def close(self) -> None:
        """Drops all runs."""
        for name, path in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, path)
        self.made, self.levels = [], [[]]


def number() -> Column:
    """A document's number: its doc_id; for a row without one a number above all, from its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) - F.shiftrightunsigned(F.xxhash64("text"), 2))


def _repeats(docs: DataFrame, batches: int) -> DataFrame:
    """(doc, gone): the keys that a document loses."""
    spark = docs.sparkSession
    rows = docs.select(number().alias("doc"), "text")
    cuts = []
    if batches > 1:
        cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 1000)).first()[0]
        cuts = sorted(set(cuts or []))
    keys = rows.mapInArrow(_line_keys, "doc long, key binary")
    batch = reduce(lambda a, c: a + (F.col("doc") > F.lit(int(c))).cast("int"), cuts, F.lit(0))
    keys = staged(keys.withColumn("batch", batch), "keys", ["batch"], TEXTS)
    index, found = LineIndex(spark), []
    for i in range(len(cuts) + 1):
        found.append(index.add(keys.filter(F.col("batch") == i).select("doc", "key")))
    index.close()
    drop_staged(keys)
    return reduce(DataFrame.unionAll, found).groupBy("doc").agg(F.collect_set("key").alias("gone"))


def _cleaned(docs: DataFrame, batches: int, digest: bool) -> DataFrame:
    """(row, n_lines, n_dropped, text): each row's other columns, or its doc_id only, and what is left of its text, or the
    digest of that."""
    gone = _repeats(docs, batches)
    row = F.struct("doc_id").alias("row") if digest else whole_row(docs, "text")
    rows = docs.select(number().alias("doc"), row, "text").join(gone, "doc", "left").select("row", "text", "gone")
    schema = StructType([rows.schema["row"]]).add("n_lines", "long").add("n_dropped", "long").add("text", "string")
    return rows.mapInArrow(lambda it: _without(it, digest), schema)


def dedup_lines(docs: DataFrame, batches: int = 4) -> DataFrame:
    """docs without lines that a document of smaller doc_id holds too. All other columns come back as they were, whatever
    their names.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of 10 code points or more that
    two documents hold lose all their lines but those of the smallest doc_id. Rows with one doc_id are one document; a row
    without one is a document by its text, after all others. Null and empty texts are one empty line; a text that loses
    nothing stays as it is, null included. A document may lose all its lines and is then the empty string.
    """
    return columns_of(_cleaned(docs, batches, False), docs, text=F.col("text"))


def line_digests(docs: DataFrame, batches: int = 4) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each row, as dedup_lines leaves its text."""
    return _cleaned(docs, batches, True).select("row.doc_id", "n_lines", "n_dropped", F.col("text").alias("kept_sha256"))
