"""Frames and samples to chunks and back: encoding by stream, decoding, seeking, pulling samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.codecs import audio, cells, gop, payload
from timegrid.functions.udfs import FRAME, FramesOf, audio_parse, decompress
from timegrid.model import AUDIO, LZ4, NONE, RATE, VIDEO
from timegrid.operators.intervals import best, frame_at, interval_join

CHUNKS = "stream string, pts long, ctype int, comp int, payload binary"
#: A segment ends before it would last longer or hold more bytes; a cut of the scene starts a new palette.
SPAN, BYTES, CUT = 2 * RATE, 96 << 10, 24.0


def encode_video(frames: DataFrame, width: int, height: int, comp: int = LZ4, coded: bool = False, span: int = SPAN, most: int = BYTES) -> DataFrame:
    """Chunks (stream, pts, ctype, comp, payload) of pictures (stream, pts, rgb: height * 3 by width * 2 pixels of 3 bytes).

    Each chunk stands for itself: a palette, a keyframe, then what changes. A chunk ends before it would span more than
    `span` or hold more than `most` bytes. A picture that differs from the one before by CUT or more on average gets a
    palette of its own; others keep the chunk's. A frame lasts until the next, the last one as long as the one before.
    Where a chunk begins depends on the one before, so a stream is one task's; streams run side by side.
    """

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pts", kind="stable")
        pts = rows["pts"].to_numpy(np.int64)
        step = np.diff(pts)
        lasts = np.append(step, step[-1] if len(step) else 2000)
        out, open_, start, size, before, palette = [], [], 0, 0, None, None

        def flush() -> None:
            nonlocal open_, size
            if open_:
                data = gop.encode(open_, width, height, coded)
                how = NONE if coded else comp
                out.append((key[0], int(start), VIDEO, how, payload.compress(data, how)))
            open_, size = [], 0

        for at, last, raw in zip(pts, lasts, rows["rgb"], strict=True):
            picture = np.frombuffer(raw, np.uint8).reshape(height * 3, width * 2, 3)
            cut = before is None or np.abs(picture.astype(int) - before).mean() >= CUT
            frame_bytes = len(gop.pack.pack_planes(*[np.zeros(width * height, np.uint8)] * 3))
            if open_ and (at - start + last > span or size + frame_bytes > most):
                flush()
            if cut or not open_:
                palette = cells.palette_of(picture)
            if not open_:
                start = at
            planes = cells.encode_cells(picture, palette)
            open_.append(gop.Frame(*planes, palette.tobytes(), int(last)))
            if len(open_) == 1:
                size = frame_bytes
            else:
                size += min(frame_bytes, sum(3 + 2 * n for _, n in gop.spans(open_[-2], open_[-1], width)) + 53)
            before = picture
        flush()
        return pd.DataFrame(out, columns=["stream", "pts", "ctype", "comp", "payload"])

    return frames.groupBy("stream").applyInPandas(fold, CHUNKS)


def decode_video(chunks: DataFrame) -> DataFrame:
    """(stream, pts, place, duration, palette, glyph, fg, bg) of every frame in video chunks; pts is the frame's own."""
    video = chunks.filter(F.col("ctype") == VIDEO).select("stream", F.col("pts").alias("chunk"), decompress("payload", "comp").alias("data"))
    names = [x.split()[0] for x in FRAME.split(", ")]
    found = video.lateralJoin(FramesOf(F.col("data").outer())).select("stream", "chunk", *names)
    before = F.sum("duration").over(_in_chunk()) - F.col("duration")
    return found.withColumn("pts", F.col("chunk") + before).select("stream", "pts", *names)


def _in_chunk():
    from pyspark.sql import Window

    return Window.partitionBy("stream", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)


def frame_on_screen(frames: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (stream, offset) the frame of the stream that shows at that time since its first."""
    return frame_at(frames, "stream", "pts", "duration", asked, "offset")


def encode_audio(samples: DataFrame, channels: int, roles: int, codec: int = audio.PCM8, span: int = SPAN) -> DataFrame:
    """Chunks of interleaved 8-bit samples (stream, pts, pcm): one for each role of the mask and each `span` of a row.

    A role is cut from the channel that stands for it, or is the downmix; equal bytes are encoded once. Rows are
    independent, so nothing is shuffled.
    """

    def cut(it):
        for rows in it:
            out = []
            for stream, pts, pcm in zip(rows["stream"], rows["pts"], rows["pcm"], strict=True):
                whole = np.frombuffer(pcm or b"", np.uint8)
                whole = whole[: len(whole) // channels * channels].reshape(-1, channels)
                for at in range(0, len(whole), span):
                    done: dict[bytes, bytes] = {}
                    for role, data in audio.cut_roles(whole[at : at + span], roles).items():
                        raw = data.tobytes()
                        if raw not in done:
                            done[raw] = audio.payload(0, codec, raw)[1:]
                        out.append((stream, pts + at, AUDIO, NONE, bytes([codec << 4 | role]) + done[raw]))
            yield pd.DataFrame(out, columns=["stream", "pts", "ctype", "comp", "payload"])

    return samples.select("stream", "pts", "pcm").mapInPandas(cut, CHUNKS)


def decode_audio(chunks: DataFrame) -> DataFrame:
    """(stream, pts, role, codec, samples) of audio chunks."""
    sound = chunks.filter(F.col("ctype") == AUDIO)
    parsed = sound.withColumn("a", audio_parse(decompress("payload", "comp")))
    return parsed.select("stream", "pts", "a.role", "a.codec", "a.samples")


def samples_at(sound: DataFrame, asked: DataFrame, width: int = SPAN) -> DataFrame:
    """For each asked (stream, at) and role the sample that sounds then, from the latest chunk that holds it."""
    spans = sound.withColumn("until", F.col("pts") + F.octet_length("samples")).withColumnRenamed("stream", "s_")
    found = interval_join(asked, spans.withColumnRenamed("s_", "stream"), "stream", "at", "pts", "until", width)
    found = best(found, ["stream", "at", "role"], [F.desc("pts"), F.asc("samples")])
    value = F.conv(F.hex(F.substring("samples", F.col("at") - F.col("pts") + 1, F.lit(1))), 16, 10).cast("int")
    return found.select("stream", "at", "role", value.alias("sample"))


def facts(chunks: DataFrame) -> DataFrame:
    """(stream, first, last, video, audio, size): what a player wants to know before it starts, from heads only."""
    kind = F.col("ctype")
    return chunks.groupBy("stream").agg(
        F.min("pts").alias("first"), F.max("pts").alias("last"), F.count_if(kind == VIDEO).alias("video"), F.count_if(kind == AUDIO).alias("audio"),
        F.min_by(F.when((kind == VIDEO) & (F.col("comp") == NONE), F.hex(F.substring("payload", 1, 4))), F.when(kind == VIDEO, F.col("pts"))).alias("size"),
    )
