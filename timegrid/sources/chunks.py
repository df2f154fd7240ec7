"""Files of timestamped chunks: reading by chaining or from split points, and writing in time order."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from timegrid.model import CHUNK, MAX_PAYLOAD, MAX_PTS

HEAD, MARK = 12, 0x43
FAILFAST, PERMISSIVE = "FAILFAST", "PERMISSIVE"
#: Chunks that must chain for a place in the middle of a file to count as a chunk's start.
LINKS = 3


def write_chunk(pts: int, kind: int, payload: bytes, compression: int = 0) -> bytes:
    """A chunk's bytes; ValueError if a number has no room in its field."""
    if not 0 <= pts <= MAX_PTS or len(payload) > MAX_PAYLOAD or not 0 <= kind < 256 or not 0 <= compression < 256:
        raise ValueError("a field is out of range")
    return bytes([MARK]) + pts.to_bytes(6, "little") + len(payload).to_bytes(3, "little") + bytes([kind, compression]) + payload


def read_head(head: bytes) -> tuple[int, int, int, int]:
    """(pts, payload length, type, compression) of a chunk's first bytes."""
    if len(head) < HEAD or head[0] != MARK:
        raise ValueError("no chunk starts here")
    return int.from_bytes(head[1:7], "little"), int.from_bytes(head[7:10], "little"), head[10], head[11]


def scan(data: bytes, at: int = 0, end: int | None = None, mode: str = FAILFAST, payloads: bool = True) -> Iterator[tuple]:
    """(off, pts, plen, ctype, comp, payload) of the chunks from a start on, up to those that start before `end`.

    FAILFAST raises ValueError at damage or a cut-off chunk; PERMISSIVE ends there.
    """
    end = len(data) if end is None else end
    while at < end:
        try:
            pts, size, kind, comp = read_head(data[at : at + HEAD])
            if at + HEAD + size > len(data):
                raise ValueError("the last chunk is cut off")
        except ValueError as e:
            if mode == FAILFAST:
                raise ValueError(f"at byte {at}: {e}") from e
            return
        yield at, pts, size, kind, comp, data[at + HEAD : at + HEAD + size] if payloads else None
        at += HEAD + size


def chains(data: bytes, at: int, links: int = LINKS) -> bool:
    """Whether `links` chunks follow one another from here, or fewer that end with the data."""
    for _ in range(links):
        if at == len(data):
            return True
        if at + HEAD > len(data) or data[at] != MARK:
            return False
        at += HEAD + int.from_bytes(data[at + 7 : at + 10], "little")
    return at <= len(data)


def covers_chain(data: bytes, at: int) -> bool:
    """Whether chunks that chain up to the end of the chunk at `at` lie within it: then its marker is a false one, whose
    length happens to lead to a true chunk."""
    end = at + HEAD + int.from_bytes(data[at + 7 : at + 10], "little")
    if at + HEAD > len(data) or end > len(data):
        return False
    seen = set()  # places whose chains miss the end
    while 0 <= (at := data.find(MARK, at + 1, end)):
        k = at
        while k + HEAD <= end and data[k] == MARK and k not in seen:
            seen.add(k)
            k += HEAD + int.from_bytes(data[k + 7 : k + 10], "little")
        if k == end:
            return True
    return False


def resync(data: bytes, at: int, links: int = LINKS) -> int | None:
    """The first place from `at` on where chunks chain, but for false markers that cover such chunks."""
    while (at := data.find(MARK, at)) >= 0:
        if chains(data, at, links) and not covers_chain(data, at):
            return at
        at += 1
    return None


def tail(data: bytes, window: int = 4096) -> list[tuple]:
    """The chunks of the longest trailing chain that a growing window at the end finds."""
    while True:
        start = max(0, len(data) - window)
        at = 0 if start == 0 and chains(data, 0) else resync(data, start)
        if at is not None and at < len(data):
            return list(scan(data, at, mode=PERMISSIVE, payloads=False))
        if start == 0:
            return []
        window *= 4


def read_chunks(spark: SparkSession, path: str, mode: str = FAILFAST, payloads: bool = True) -> DataFrame:
    """The chunks of all files of a path, on any file system that Spark reads; unknown types are rows like all others.

    Files are read whole, one a task at a time; for files larger than memory see ChunkSource.
    """

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(file, *r) for r in scan(content, 0, None, mode, payloads)]
                if rows:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=CHUNK.names), schema=ARROW, preserve_index=False)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, CHUNK)


ARROW = pa.schema([("file", pa.string()), ("off", pa.int64()), ("pts", pa.int64()), ("plen", pa.int32()), ("ctype", pa.int16()), ("comp", pa.int16()), ("payload", pa.binary())])


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ChunkReader(DataSourceReader):
    """Reads a file in splits: each finds its first chunk by chaining, and reads those that start before its end."""

    def __init__(self, options: dict):
        path = options["path"].removeprefix("file:")
        self.files = sorted(os.path.join(path, f) for f in os.listdir(path)) if os.path.isdir(path) else [path]
        self.split, self.mode = int(options.get("splitbytes", 64 << 20)), options.get("mode", FAILFAST).upper()
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.least, self.most = 0, MAX_PTS

    def pushFilters(self, filters):
        for f in filters:
            taken = False
            if getattr(f, "attribute", None) == ("pts",) and isinstance(getattr(f, "value", None), int):
                taken = True
                if isinstance(f, GreaterThanOrEqual):
                    self.least = max(self.least, f.value)
                elif isinstance(f, GreaterThan):
                    self.least = max(self.least, f.value + 1)
                elif isinstance(f, LessThanOrEqual):
                    self.most = min(self.most, f.value)
                elif isinstance(f, LessThan):
                    self.most = min(self.most, f.value - 1)
                else:
                    taken = False
            if not taken:
                yield f

    def partitions(self):
        return [Split(f, at, at + self.split) for f in self.files for at in range(0, max(1, os.path.getsize(f)), self.split)]

    def read(self, part: Split):
        size = os.path.getsize(part.path)
        with open(part.path, "rb") as file:
            at = part.start
            if at:
                # a chunk may start anywhere in the split; its chain may reach beyond it
                step = 1 << 16
                while at < min(part.end, size):
                    file.seek(at)
                    window = file.read(step + LINKS * (HEAD + MAX_PAYLOAD))
                    rest = at + len(window) == size
                    found = next((k for k in _marks(window, step) if (chains(window, k) if rest else _chains_on(window, k)) and not covers_chain(window, k)), None)
                    if found is not None:
                        at += found
                        break
                    at += step
            while at < min(part.end, size):
                file.seek(at)
                try:
                    pts, n, kind, comp = read_head(file.read(HEAD))
                    if at + HEAD + n > size:
                        raise ValueError("the last chunk is cut off")
                except ValueError as e:
                    if self.mode == FAILFAST:
                        raise ValueError(f"{part.path}, byte {at}: {e}") from e
                    return
                if self.least <= pts <= self.most:
                    yield part.path, at, pts, n, kind, comp, file.read(n) if self.payloads else None
                at += HEAD + n


def _marks(window: bytes, step: int) -> Iterator[int]:
    at = window.find(MARK)
    while 0 <= at < step:
        yield at
        at = window.find(MARK, at + 1)


def _chains_on(window: bytes, at: int) -> bool:
    """chains() in a window that ends before the file does."""
    for _ in range(LINKS):
        if at >= len(window) or window[at] != MARK:
            return False
        if at + HEAD > len(window):
            return True
        at += HEAD + int.from_bytes(window[at + 7 : at + 10], "little")
        if at >= len(window):
            return True
    return True


class ChunkSource(DataSource):
    """spark.read.format("chunks"): options path, splitBytes, mode, payloads. For paths that every machine can open."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self):
        return CHUNK

    def reader(self, schema):
        return ChunkReader(self.options)


def write_chunks(df: DataFrame, path: str) -> DataFrame:
    """Writes the chunks of df (pts, ctype, comp, payload; ties in order of ctype and payload) as files in time order.

    Each of Spark's range partitions becomes one file named by its place, complete or absent: it is written beside its
    place and renamed. The files' names in order give the whole. Returns (file, chunks, bytes). For paths that every
    machine can open.
    """
    root = path.removeprefix("file:")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = posixpath.join(root, f"part-{TaskContext.get().partitionId():05d}.chunks")
        part, n, size = f"{name}.{uuid.uuid4().hex}", 0, 0
        os.makedirs(root, exist_ok=True)
        with open(part, "wb") as out:
            for batch in it:
                for row in batch.to_pylist():
                    data = write_chunk(row["pts"], row["ctype"], row["payload"] or b"", row["comp"])
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if n:
            os.replace(part, name)
            yield pa.record_batch([pa.array([name]), pa.array([n]), pa.array([size])], names=["file", "chunks", "bytes"])
        else:
            os.remove(part)

    rows = df.select("pts", "ctype", "comp", "payload").orderBy("pts", "ctype", "payload")
    return rows.mapInArrow(write, "file string, chunks long, bytes long")


def header_index(chunks: DataFrame) -> DataFrame:
    """(file, off, pts, plen, ctype, comp): what random access needs; write it sorted by pts and Parquet's statistics skip."""
    return chunks.select("file", "off", "pts", "plen", "ctype", "comp")


def fixed_records(df: DataFrame, content: str, size: int) -> DataFrame:
    """(.., record, bytes): content cut into records of `size` bytes; a rest is left out."""
    n = F.floor(F.octet_length(content) / size)
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(content), i * size + 1, F.lit(size)))
    rows = df.withColumn("cut_", F.when(n > 0, cut)).select("*", F.posexplode("cut_").alias("record", "bytes"))
    return rows.drop("cut_", content)
