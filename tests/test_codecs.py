"""Codecs: round trips over seeded inputs, damage, hand-made bytes, and agreement of SQL forms with plain ones."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timegrid.codecs import audio, cells, entropy, gop, onebit, pack, payload
from timegrid.functions import udfs

RNG = np.random.default_rng(7)


@given(st.binary(max_size=400), st.sampled_from([0, 2, 5]))
@settings(max_examples=60, deadline=None)
def test_payload_round_trip(data, how):
    assert payload.decompress(payload.compress(data * 3, how), how) == data * 3


def test_lz4_known_block_and_damage():
    # a literal a, then a match of 9 at offset 1, then five literals
    block = bytes([0x15, ord("a"), 1, 0, 0x50]) + b"bcdef"
    assert payload.unlz4_block(block, 15) == b"a" * 10 + b"bcdef"
    for bad in (block[:-1], b"\x15a\x02\x00", b"\xf0", block + b"\x00\x00"):
        with pytest.raises(ValueError):
            payload.unlz4_block(bad, 15)
    assert len(payload.lz4_block(b"abcd" * 4000)) < 200


@pytest.mark.parametrize("bits,group", [(5, 8), (4, 2)])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 100])
def test_pack_round_trip(bits, group, n):
    v = RNG.integers(0, 1 << bits, n)
    data = pack.pack(v, bits, group)
    assert len(data) == -(-n // group) * group * bits // 8
    assert pack.unpack(data, bits, n).tolist() == v.tolist()


def test_pack_is_high_bits_first():
    assert pack.pack_colours(np.array([1, 2, 3])) == b"\x12\x30"
    assert pack.pack_glyphs(np.array([31, 0, 0, 0, 0, 0, 0, 1])) == b"\xf8\x00\x00\x00\x01"


PLANES = {
    "uniform": np.full(400, 3), "noise": RNG.integers(0, 32, 4000), "skewed": np.where(RNG.random(5000) < 0.9, 1, RNG.integers(0, 16, 5000)),
    "rows": np.repeat(RNG.integers(0, 16, 50), 40), "columns": np.tile(RNG.integers(0, 16, 40), 50), "run": np.full(65535, 9), "single": np.array([5]),
}


@pytest.mark.parametrize("name", PLANES)
@pytest.mark.parametrize("width", [0, 40])
def test_plane_round_trip(name, width):
    plane = PLANES[name].astype(np.uint8)
    width = width if len(plane) % 40 == 0 else 0
    data = entropy.encode_plane(plane, 32, width)
    got, end = entropy.decode_plane(b"xx" + data + b"yy", 2, len(plane), 32, width)
    assert end == 2 + len(data) and got.tolist() == plane.tolist()
    if name == "skewed":
        assert len(data) < entropy.entropy_bits(plane) / 8 * 1.05 + 100


def test_shares_add_up():
    for counts in ([1], [5, 5], [1] * 300, [10**6] + [1] * 200, [0, 3, 0, 1]):
        f = entropy.shares(np.array(counts))
        assert f.sum() == 4096 and ((f > 0) == (np.array(counts) > 0)).all()


def test_plane_damage():
    data = entropy.encode_plane(PLANES["noise"], 32)
    for cut in (1, 4, 40, len(data) // 2):
        with pytest.raises(ValueError):
            entropy.decode_plane(data[:cut], 0, 4000, 32)


def test_onebit_follows_a_sine():
    t = np.arange(48000) / 48000
    pcm = (128 + 100 * np.sin(2 * np.pi * 440 * t)).astype(np.uint8)
    data = onebit.encode(pcm.tobytes())
    back = np.frombuffer(onebit.decode(data), np.uint8)
    assert len(data) == 6000 and np.corrcoef(pcm, back)[0, 1] > 0.95
    assert len(onebit.encode(b"\x80" * 9)) == 2


def test_audio_roles():
    six = np.tile(np.arange(10, 70, 10, dtype=np.uint8), (4, 1))
    got = audio.cut_roles(six, 0b110011111)
    assert {r: int(v[0]) for r, v in got.items()} == {0: 34, 1: 10, 2: 20, 3: 30, 4: 40, 7: 50, 8: 60}
    assert {r: int(v[0]) for r, v in audio.cut_roles(six[:, :1], 0b1010).items()} == {1: 10, 3: 10}
    assert audio.parse(audio.payload(3, 0, b"abc")) == (3, 0, b"abc")
    assert list(audio.cut_roles(six, 0)) == [0]


def frame(seed, n=12, palette=b"\x01" * 48, duration=2000):
    r = np.random.default_rng(seed)
    return gop.Frame(*(r.integers(0, m, n).astype(np.uint8) for m in (32, 16, 16)), palette, duration)


@pytest.mark.parametrize("coded", [False, True])
def test_gop_round_trip(coded):
    a = frame(1)
    b = gop.Frame(a.glyph.copy(), a.fg, a.bg, a.palette, 70000)
    b.glyph[5] = (b.glyph[5] + 1) % 32
    c = gop.Frame(b.glyph, b.fg, b.bg, b"\x02" * 48, 10)
    data = gop.encode([a, b, c, frame(9, palette=c.palette)], 4, 3, coded)
    got = gop.decode(data)
    assert [f.duration for f in got] == [2000, 65535, 4465, 10, 2000]
    assert [f.palette[0] for f in got] == [1, 1, 1, 2, 2]
    assert (got[1].glyph == b.glyph).all() and (got[4].bg == frame(9).bg).all()
    kinds = [u["kind"] for u in gop.units(data)]
    assert kinds == ["palette", "coded" if coded else "raw", "delta", "repeat", "palette", "repeat", "raw"]


def test_gop_rejects_damage():
    good = gop.encode([frame(1)], 4, 3)
    head, palette, raw = good[:4], good[4:53], good[53:]
    bad = {
        "ends early": good[:-1], "a frame without palette": head + raw, "no keyframe": head + palette, "a palette ends": good + palette,
        "a palette follows": head + palette + palette + raw, "unknown encoding": good + b"\xf0\x00\x00", "crosses a row": good + b"\x90\x01\x00\x01\x00\x03\x00\x02" + b"\x80\x00" * 2,
        "a change before": head + palette + b"\xa0\x01\x00",
    }
    for text, data in bad.items():
        with pytest.raises(ValueError, match=text):
            gop.units(data)
    assert len(gop.decode(head + palette + palette + raw + palette, strict=False)) == 1


def test_cells_render_what_they_can_show():
    palette = np.array([[k * 16, 255 - k * 16, k * 8] for k in range(16)], np.uint8)
    g, f, b = RNG.integers(0, 32, 12), RNG.integers(0, 16, 12), RNG.integers(0, 16, 12)
    picture = cells.render_cells(g, f, b, palette, 4)
    assert picture.shape == (9, 8, 3)
    again = cells.render_cells(*cells.encode_cells(picture, palette), palette, 4)
    assert (again == picture).all()
    assert cells.mean_difference(picture, again) == 0 < cells.mean_difference(picture, picture[::-1])


def test_palette_of_few_colours_is_exact():
    few = np.array([[0, 0, 0], [255, 0, 0], [0, 200, 30], [90, 90, 255]], np.uint8)
    picture = few[RNG.integers(0, 4, (30, 20))]
    found = {tuple(c) for c in cells.palette_of(picture).tolist()}
    assert found == {tuple(c) for c in few.tolist()}
    many = RNG.integers(0, 256, (60, 60, 3)).astype(np.uint8)
    one, more = (np.abs(many[:, :, None] - cells.palette_of(many, n)[None, None].astype(int)).sum(-1).min(-1).mean() for n in (1, 16))
    assert more < one * 0.7


def test_functions_in_sql(spark):
    udfs.register(spark)
    spark.createDataFrame([(bytes(range(32)) * 20,), (None,), (b"",)], "d binary").createOrReplaceTempView("blobs")
    got = spark.sql("SELECT d, tg_decompress(tg_compress(d, 2), 2) AS e, length(tg_onebit_encode(d)) AS n FROM blobs").collect()
    assert all(r["d"] == r["e"] for r in got) and sorted((r["n"] for r in got), key=str) == [0, 80, None]
    spark.createDataFrame([(gop.encode([frame(1), frame(2)], 4, 3),)], "p binary").createOrReplaceTempView("gops")
    units = spark.sql("SELECT u.place, u.kind, u.duration FROM gops, LATERAL units_of(p) u ORDER BY 1").collect()
    assert [tuple(r) for r in units] == [(0, "palette", None), (1, "raw", 2000), (2, "raw", 2000)]
    frames = spark.sql("SELECT f.* FROM gops, LATERAL frames_of(p) f ORDER BY place").collect()
    assert frames[1]["glyph"] == frame(2).glyph.tobytes()
    assert udfs.index_first(b"\x00\x00\x00\x08ftyp\x00\x00\x00\x10moov") is True
    assert udfs.index_first(b"\x00\x00\x00\x09mdatx") is False and udfs.index_first(b"\x00\x00") is None
