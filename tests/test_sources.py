"""Chunk files: scanning, resync, splits, pushdown, writing; ordinary formats; streams."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from timegrid.sources import chunks, files
from timegrid.streaming import pacer, windows


def made(n=300, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i * 1000, int(r.integers(0, 3)), bytes(r.integers(0, 256, int(r.integers(0, 200)), dtype=np.uint8))) for i in range(n)]
    rows[5] = (5000, 0, b"C" * 120)  # marks that start no chunk
    return rows, b"".join(chunks.write_chunk(p, k, d) for p, k, d in rows)


def test_scan_and_modes():
    rows, data = made()
    assert [(p, k, d) for _, p, _, k, _, d in chunks.scan(data)] == rows
    with pytest.raises(ValueError, match="cut off"):
        list(chunks.scan(data[:-1]))
    assert len(list(chunks.scan(data[:-1], mode=chunks.PERMISSIVE))) == 299
    with pytest.raises(ValueError, match="at byte 0"):
        list(chunks.scan(b"x" + data))
    with pytest.raises(ValueError):
        chunks.write_chunk(1 << 48, 0, b"")


def test_resync_and_tail():
    rows, data = made()
    starts = [r[0] for r in chunks.scan(data)]
    for at in (1, starts[5] + 20, starts[100] + 1):
        assert chunks.resync(data, at) == next(s for s in starts if s >= at)
    got = chunks.tail(data, 64)
    assert got and got[-1][1] == rows[-1][0] and got[0][0] in starts


def test_resync_passes_false_markers_that_lead_to_chunks():
    rows, data = made()
    starts = [r[0] for r in chunks.scan(data)]
    for k in (1, 2, 150, 298):
        # a marker whose length leads over k chunks to the next
        false = bytes([chunks.MARK]) + bytes(6) + starts[k].to_bytes(3, "little") + bytes(2)
        assert chunks.chains(false + data, 0)
        assert chunks.resync(false + data, 0) == len(false)
        assert len(list(chunks.scan(false + data, chunks.resync(false + data, 0)))) == 300
    payload = os.urandom(4000)
    whole = chunks.write_chunk(5, 0, payload + b"C" * 500) + data
    assert chunks.resync(whole, 0) == 0


def test_splits_pass_false_markers_that_lead_to_chunks(spark, tmp_path):
    rows, data = made()
    starts = [r[0] for r in chunks.scan(data)]
    # a first chunk whose payload ends with such a marker; the second split begins at that marker
    false = bytes([chunks.MARK]) + bytes(6) + starts[100].to_bytes(3, "little") + bytes(2)
    first = chunks.write_chunk(1, 0, b"x" * 1000 + false)
    (tmp_path / "a.chunks").write_bytes(first + data)
    spark.dataSource.register(chunks.ChunkSource)
    got = spark.read.format("chunks").option("path", str(tmp_path)).option("splitBytes", len(first) - len(false)).load()
    assert got.count() == 301
    assert got.agg(F.sum("plen")).first()[0] == sum(len(d) for _, _, d in rows) + 1000 + len(false)


def test_splits_cover_every_chunk_once(spark, tmp_path):
    rows, data = made()
    for i in range(2):
        (tmp_path / f"{i}.chunks").write_bytes(data)
    spark.dataSource.register(chunks.ChunkSource)
    reader = spark.read.format("chunks").option("path", str(tmp_path)).option("splitBytes", 1500)
    got = reader.load()
    assert got.rdd.getNumPartitions() > 10
    assert sorted((r["pts"], r["payload"]) for r in got.filter(F.col("file").endswith("0.chunks")).collect()) == [(p, d) for p, _, d in rows]
    assert got.filter("pts >= 10000 and pts < 20000").count() == 20
    whole = chunks.read_chunks(spark, f"{tmp_path}/*.chunks")
    assert whole.count() == 600 and whole.filter("ctype = 2").count() == 2 * sum(k == 2 for _, k, _ in rows)


def test_write_in_time_order(spark, tmp_path):
    rows, _ = made()
    df = spark.createDataFrame([(p, k, 0, d) for p, k, d in reversed(rows)], "pts long, ctype int, comp int, payload binary")
    out = chunks.write_chunks(df, str(tmp_path / "out")).collect()
    assert sum(r["chunks"] for r in out) == 300
    names = sorted(os.listdir(tmp_path / "out"))
    data = b"".join((tmp_path / "out" / n).read_bytes() for n in names)
    assert [p for _, p, *_ in chunks.scan(data)] == [p for p, *_ in rows]
    assert all(n.endswith(".chunks") for n in names)


def test_fixed_records(spark):
    df = spark.createDataFrame([(1, b"abcdefg"), (2, b"ab"), (3, None)], "id int, d binary")
    got = [(r["id"], r["record"], bytes(r["bytes"])) for r in chunks.fixed_records(df, "d", 3).collect()]
    assert sorted(got) == [(1, 0, b"abc"), (1, 1, b"def")]


def test_formats(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    for kind in ("parquet", "orc", "json", "csv"):
        files.write_sorted(df, str(tmp_path / kind), "id", parts=["g"], kind=kind)
        got = files.read(spark, str(tmp_path / kind), kind, "id long" if kind in ("json", "csv") else None)
        assert got.count() == 100
    plan = files.read(spark, str(tmp_path / "parquet")).filter("g = 1 and id > 50").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(g" in plan and "PushedFilters: [IsNotNull(id), GreaterThan(id,50)]" in plan
    with pytest.raises(ValueError):
        files.read(spark, "x", "csv")


def test_pacer_plays_pauses_and_skips():
    p = pacer.Pacer(pacer.Rules(prebuffer=2, lead=0, grace=2, dry=1))
    assert list(p.feed(0, 10)) == [] and list(p.feed(1, 11)) == []
    assert list(p.feed(2, 12)) == [("play", 10), ("release", 10)]
    assert list(p.feed(4, None)) == [("release", 11), ("release", 12)]
    assert list(p.feed(5.5, None)) == [("pause", None)]
    assert list(p.feed(6, 13)) == [] and list(p.feed(6, 15)) == [("play", 13), ("release", 13)]
    assert list(p.feed(7, 9)) == [("drop", 9)]
    live = pacer.Pacer(pacer.Rules(live=True, max_items=2, prebuffer=1, lead=0, skip=2))
    list(live.feed(0, 0)), list(live.feed(0, 1))
    assert [a for a, _ in live.feed(0.1, 9)] == [] and list(live.feed(0.2, 10)) == [("evict", 1), ("skip", 9), ("release", 9)]
    full = pacer.Pacer(pacer.Rules(max_items=1))
    assert list(full.feed(0, 1)) == [] and list(full.feed(0, 2)) == [("refuse", 2)]


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = spark.range(600).select(F.concat(F.lit("s"), F.col("id") % 3).alias("stream"), (F.col("id") / 10).alias("at"), (F.col("id") / 8).alias("pts"))
    src = str(tmp_path / "in")
    for i in range(3):
        rows.filter(f"at >= {i * 20} and at < {i * 20 + 20}").coalesce(1).write.mode("append").parquet(src)
    batch = pacer.pace(rows)
    stream = windows.run_available(spark, src, rows.schema, str(tmp_path / "a"), pacer.pace_stream, files=1)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(stream) == key(batch) and batch.count() > 400
    again = windows.run_available(spark, src, rows.schema, str(tmp_path / "a"), pacer.pace_stream, files=1)
    assert key(again) == key(batch)


def test_stream_join_within(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "2024-01-01 00:00:00"), (1, "y", "2024-01-01 00:00:30"), (1, "y", "2024-01-01 00:02:00")], "k int, v string, ts string")
    src = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(src)

    def build(df):
        df = windows.event_time(df, "ts", "1 hour")
        a = df.filter("v = 'x'").select("k", F.col("ts").alias("t"))
        b = df.filter("v = 'y'").select("k", F.col("ts").alias("u"))
        return windows.within(a, b, "k", "t", "u", "1 MINUTE")

    got = windows.run_available(spark, src, rows.schema, str(tmp_path / "w"), build)
    assert got.count() == 1


def test_stream_segments_equal_a_batch(spark, tmp_path):
    from timegrid.operators.ordered import segment
    from timegrid.streaming.segments import segment_stream

    rows = spark.range(300).select(F.concat(F.lit("s"), F.col("id") % 2).alias("stream"), "id", F.lit(1).cast("long").alias("span"), (F.col("id") * 37 % 50).alias("size"))
    src = str(tmp_path / "in")
    for i in range(3):
        rows.filter(f"id >= {i * 100} and id < {i * 100 + 100}").coalesce(1).write.mode("append").parquet(src)
    got = windows.run_available(spark, src, rows.schema, str(tmp_path / "g"), lambda df: segment_stream(df, 5, 90), files=1)
    want = segment(rows, "stream", "id", "span", "size", 5, 90).select("stream", "id", "segment")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
