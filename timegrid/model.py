"""Schemas and constants of the timeline data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Ticks of the shared timeline in a second.
RATE = 48_000
MAX_PTS, MAX_PAYLOAD, MAX_DURATION = (1 << 48) - 1, (1 << 24) - 1, 65_535
VIDEO, AUDIO = 0, 1
#: Compression numbers of a payload.
NONE, LZ4, BROTLI, BZIP2 = 0, 2, 4, 5
GLYPHS, COLOURS = 32, 16

CHUNK = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("off", T.LongType()),
    T.StructField("pts", T.LongType()),
    T.StructField("plen", T.IntegerType()),
    T.StructField("ctype", T.ShortType()),
    T.StructField("comp", T.ShortType()),
    T.StructField("payload", T.BinaryType()),
])

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("cells", T.BinaryType())])
UNIT = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("duration", T.IntegerType()),
    T.StructField("palette", T.BinaryType()),
    T.StructField("glyph", T.BinaryType()),
    T.StructField("fg", T.BinaryType()),
    T.StructField("bg", T.BinaryType()),
    T.StructField("spans", T.ArrayType(SPAN)),
])
