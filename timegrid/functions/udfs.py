"""The codecs as vectorised functions for DataFrames and SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timegrid.codecs import audio, entropy, gop, onebit, pack, payload
from timegrid.model import UNIT
from timegrid.sources import chunks


def _binary(f):
    return F.pandas_udf(f, T.BinaryType())


def _each(f, *cols: pd.Series) -> pd.Series:
    """f of each row; a row with a null gives null."""
    return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*cols, strict=True)], dtype=object)


@_binary
def compress(data: pd.Series, how: pd.Series) -> pd.Series:
    return _each(lambda d, h: payload.compress(bytes(d), int(h)), data, how)


@_binary
def decompress(data: pd.Series, how: pd.Series) -> pd.Series:
    return _each(lambda d, h: payload.decompress(bytes(d), int(h)), data, how)


@_binary
def onebit_encode(data: pd.Series) -> pd.Series:
    return _each(lambda d: onebit.encode(bytes(d)), data)


@_binary
def onebit_decode(data: pd.Series) -> pd.Series:
    return _each(lambda d: onebit.decode(bytes(d)), data)


@_binary
def plane_encode(data: pd.Series, symbols: pd.Series, width: pd.Series) -> pd.Series:
    import numpy as np

    return _each(lambda d, s, w: entropy.encode_plane(np.frombuffer(bytes(d), np.uint8), int(s), int(w)), data, symbols, width)


@_binary
def plane_decode(data: pd.Series, n: pd.Series, symbols: pd.Series, width: pd.Series) -> pd.Series:
    return _each(lambda d, n, s, w: entropy.decode_plane(bytes(d), 0, int(n), int(s), int(w))[0].tobytes(), data, n, symbols, width)


@_binary
def pack_bits(data: pd.Series, bits: pd.Series) -> pd.Series:
    import numpy as np

    return _each(lambda d, b: pack.pack(np.frombuffer(bytes(d), np.uint8), int(b), 8 if b == 5 else 2), data, bits)


@_binary
def unpack_bits(data: pd.Series, bits: pd.Series, n: pd.Series) -> pd.Series:
    return _each(lambda d, b, n: pack.unpack(bytes(d), int(b), int(n)).tobytes(), data, bits, n)


AUDIO = T.StructType([T.StructField("role", T.IntegerType()), T.StructField("codec", T.IntegerType()), T.StructField("samples", T.BinaryType())])


@F.pandas_udf(AUDIO)
def audio_parse(data: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 3 if d is None else audio.parse(bytes(d)) for d in data]
    return pd.DataFrame(rows, columns=AUDIO.names)


@F.udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), *UNIT.fields]))
class UnitsOf:
    """The units of a decompressed video payload, in order: LATERAL units_of(payload)."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        for i, unit in enumerate(gop.units(bytes(data)) if data is not None else ()):
            yield (i, *[unit[n] for n in UNIT.names])


FRAME = "place int, duration int, palette binary, glyph binary, fg binary, bg binary"


@F.udtf(returnType=FRAME)
class FramesOf:
    """The frames in effect of a decompressed video payload: LATERAL frames_of(payload)."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        for i, f in enumerate(gop.decode(bytes(data)) if data is not None else ()):
            yield i, f.duration, f.palette, f.glyph.tobytes(), f.fg.tobytes(), f.bg.tobytes()


@F.udtf(returnType="off long, pts long, plen int, ctype int, comp int, payload binary")
class ChunksOf:
    """The chunks of a file's bytes: LATERAL chunks_of(content)."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        if data is not None:
            yield from chunks.scan(bytes(data), mode=chunks.PERMISSIVE)


@F.udtf(returnType="box string, at long, size long")
class BoxesOf:
    """Top-level boxes (32-bit big-endian size, four letters) of a file's head, as far as their heads are there."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        at, data = 0, bytes(data or b"")
        while at + 8 <= len(data):
            size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            if size == 1 and at + 16 <= len(data):
                size = int.from_bytes(data[at + 8 : at + 16], "big")
            yield name.decode("latin-1"), at, size
            if size < 8:
                return
            at += size


def index_first(head: bytes, index: bytes = b"moov", data: bytes = b"mdat") -> bool | None:
    """Whether the index box comes before the data box in a file's head; None if the head doesn't tell."""
    at = 0
    while at + 8 <= len(head):
        size, name = int.from_bytes(head[at : at + 4], "big"), head[at + 4 : at + 8]
        if name in (index, data):
            return name == index
        if size == 1:
            size = int.from_bytes(head[at + 8 : at + 16], "big")
        if size < 8:
            return None
        at += size
    return None


FUNCTIONS = {
    "tg_compress": compress, "tg_decompress": decompress, "tg_onebit_encode": onebit_encode, "tg_onebit_decode": onebit_decode,
    "tg_plane_encode": plane_encode, "tg_plane_decode": plane_decode, "tg_pack": pack_bits, "tg_unpack": unpack_bits, "tg_audio": audio_parse,
}
TABLES = {"units_of": UnitsOf, "frames_of": FramesOf, "chunks_of": ChunksOf, "boxes_of": BoxesOf}


def register(spark: SparkSession) -> None:
    """Makes all functions, table functions and the chunk source known to a session's SQL."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    for name, f in TABLES.items():
        spark.udtf.register(name, f)
    spark.dataSource.register(chunks.ChunkSource)
