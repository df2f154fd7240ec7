"""Control frames, and frames and samples through chunks and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timegrid.codecs import audio, cells, control, gop
from timegrid.operators import media


def test_control_frames():
    room = control.Room("http://a/ü", 5, None, True, True)
    caps = control.Caps(True, False, 1, 3, 0b111, 0b110101, 82, 41, 24)
    assert control.parse(control.frame(control.ROOM, room.pack())) == {"kind": "room", "url": "http://a/ü", "start": 5, "end": None, "loop": True, "sync": True}
    assert control.Caps.parse(caps.pack()) == caps and len(caps.pack()) == 11
    assert control.parse(control.status(control.PLAYING, 77)) == {"kind": "status", "state": 1, "origin": 77}
    assert control.status(control.ENDED) == b"\x07\x01\x00\x02"
    assert control.parse(control.frame(control.ERROR, control.printable("é\n€")))["text"] == "é??"
    for bad in (b"", b"\x01", b"\x01\x05\x00ab", control.frame(control.CAPS, b"\x00"), b"\x63\x00\x00"):
        with pytest.raises(ValueError):
            control.parse(bad)
    with pytest.raises(ValueError):
        control.status(control.PLAYING)
    with pytest.raises(ValueError):
        control.frame(67)


def test_rooms_agree():
    a, b = control.Caps(video=1, channels=0b11, compress=0b110101), control.Caps(video=0, channels=0b101, compress=0b101)
    assert control.agreed([a]) == {"roles": 3, "coded": True, "compress_0": 4, "compress_1": 5}
    assert control.agreed([a, b]) == {"roles": 7, "coded": False, "compress_0": 2, "compress_1": 2}
    assert control.agreed([]) == {"roles": 0, "coded": False, "compress_0": 0, "compress_1": 0}


def pictures(n, seed):
    r = np.random.default_rng(seed)
    still = r.integers(0, 256, (4, 3)).astype(np.uint8)[r.integers(0, 4, (9, 16))]
    out = [still.copy() for _ in range(n)]
    for k in range(1, n):
        out[k] = out[k - 1].copy()
        if k % 3 == 0:
            out[k][:3, :2] = out[k][3:6, 4:6]
        if k == 7:
            out[k] = 255 - out[k]
    return out


def test_video_round_trip(spark):
    rows = [(s, k * 2000, p.tobytes()) for s, seed in (("a", 1), ("b", 2)) for k, p in enumerate(pictures(60, seed))]
    df = spark.createDataFrame(rows, "stream string, pts long, rgb binary").repartition(3)
    for coded in (False, True):
        chunks = media.encode_video(df, 8, 3, coded=coded)
        made = chunks.collect()
        assert sorted(r["pts"] for r in made if r["stream"] == "a") == [0, 96000]
        assert all(control.carries_coded(r["ctype"], r["comp"], r["payload"]) == coded for r in made)
        frames = media.decode_video(chunks).collect()
        assert len(frames) == 120
        by = {(f["stream"], f["pts"]): f for f in frames}
        for s, pts, rgb in rows:
            f = by[s, pts]
            planes = [np.frombuffer(f[k], np.uint8) for k in ("glyph", "fg", "bg")]
            shown = cells.render_cells(*planes, np.frombuffer(f["palette"], np.uint8).reshape(16, 3), 8)
            assert np.abs(shown.astype(int) - np.frombuffer(rgb, np.uint8).reshape(9, 16, 3)).mean() < 60
    asked = spark.createDataFrame([("a", 0), ("a", 5000), ("b", 10**9)], "stream string, offset long")
    got = {(r["stream"], r["offset"]): r["pts"] for r in media.frame_on_screen(media.decode_video(chunks), asked).collect()}
    assert got == {("a", 0): 0, ("a", 5000): 4000, ("b", 10**9): 59 * 2000}


def test_segments_keep_to_their_bytes(spark):
    r = np.random.default_rng(5)
    rows = [("a", k * 2000, r.integers(0, 256, (9, 16, 3)).astype(np.uint8).tobytes()) for k in range(20)]
    chunks = media.encode_video(spark.createDataFrame(rows, "stream string, pts long, rgb binary"), 8, 3, comp=0, most=200).collect()
    assert len(chunks) >= 4 and sum(len(gop.decode(c["payload"])) for c in chunks) == 20


def test_audio_round_trip(spark):
    r = np.random.default_rng(3)
    pcm = r.integers(0, 256, (1000, 6)).astype(np.uint8)
    df = spark.createDataFrame([("a", 500, pcm.tobytes()), ("b", 0, None)], "stream string, pts long, pcm binary")
    chunks = media.encode_audio(df, 6, 0b11, span=400)
    sound = media.decode_audio(chunks)
    got = sorted((x["pts"], x["role"], x["samples"]) for x in sound.collect())
    assert [g[:2] for g in got] == [(500, 0), (500, 1), (900, 0), (900, 1), (1300, 0), (1300, 1)]
    assert got[3][2] == pcm[400:800, 0].tobytes() and got[0][2] == audio.downmix(pcm[:400]).tobytes()
    asked = spark.createDataFrame([("a", 500), ("a", 1234), ("a", 1500)], "stream string, at long")
    values = {(x["at"], x["role"]): x["sample"] for x in media.samples_at(sound, asked).collect()}
    assert values == {(500, 1): int(pcm[0, 0]), (1234, 1): int(pcm[734, 0]), (500, 0): int(audio.downmix(pcm)[0]), (1234, 0): int(audio.downmix(pcm)[734])}
    assert media.facts(chunks.withColumn("comp", F.lit(0))).first()["audio"] == 6
