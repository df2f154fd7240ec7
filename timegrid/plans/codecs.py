"""Codecs and streams as queries: round trips give back what went in, streams what a batch gives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from timegrid.codecs import cells
from timegrid.functions import udfs
from timegrid.operators import aggregates
from timegrid.plans.registry import QUERIES, query
from timegrid.plans.timeline import micros
from timegrid.sources import chunks
from timegrid.staging import new_path
from timegrid.streaming import pacer, windows


def _round_trip(t, how: int):
    rows = t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_name", "p_type", "p_name").cast("binary").alias("d"))
    data = udfs.decompress(udfs.compress("d", F.lit(how)), F.lit(how))
    return rows.select("p_partkey", F.sha2(data, 256).alias("digest"))


SAME = "SELECT p_partkey, sha256(concat_ws(' ', p_name, p_name, p_type, p_name)) AS digest FROM part"


@query("codec_lz4", SAME)
def codec_lz4(t):
    return _round_trip(t, 2)


@query("codec_bzip2", SAME)
def codec_bzip2(t):
    return _round_trip(t, 5)


def _planes(t, modulus: int):
    """Each order's line quantities as a plane of small numbers."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % modulus).alias("q"))
    cell = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))), lambda x: F.lpad(F.hex(x["q"]), 2, "0"))
    return rows.groupBy("l_orderkey").agg(F.unhex(F.concat_ws("", cell)).alias("plane"), F.count(F.lit(1)).cast("int").alias("n"))


PLANES = """SELECT l_orderkey, string_agg(lpad(hex(q), 2, '0'), '' ORDER BY l_linenumber, q) AS plane
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % {m} AS q FROM lineitem) GROUP BY l_orderkey"""


@query("codec_plane", PLANES.format(m=64))
def codec_plane(t):
    coded = udfs.plane_encode("plane", F.lit(64), F.lit(0))
    rows = _planes(t, 64).withColumn("coded", coded)
    return rows.select("l_orderkey", F.hex(udfs.plane_decode("coded", "n", F.lit(64), F.lit(0))).alias("plane"))


@query("codec_pack", PLANES.format(m=32))
def codec_pack(t):
    rows = _planes(t, 32)
    rows = rows.withColumn("packed", udfs.pack_bits("plane", F.lit(5)))
    return rows.select("l_orderkey", F.hex(udfs.unpack_bits("packed", F.lit(5), "n")).alias("plane"))


@query("codec_onebit", "SELECT page_id, CAST((strlen(html) + 7) // 8 * 8 AS INT) AS samples FROM pages")
def codec_onebit(t):
    rows = t("pages").select("page_id", F.col("html").cast("binary").alias("pcm"))
    return rows.select("page_id", F.octet_length(udfs.onebit_decode(udfs.onebit_encode("pcm"))).alias("samples"))


@query("adaptive_palette")
def adaptive_palette(t):
    """Sixteen colours that stand for all events' colours: the histogram is Spark's, its 4096 cells are the driver's."""
    i = F.col("event_id")
    rgb = t("events").select((i * 7 % 256).alias("r"), (i * 13 % 256).alias("g"), (F.col("value") * 10 % 256).cast("long").alias("b"))
    by = [F.shiftright(c, 4).alias(f"c{c}") for c in ("r", "g", "b")]
    h = aggregates.moments(rgb, by, {c: F.col(c) for c in ("r", "g", "b")}).toPandas().sort_values(["cr", "cg", "cb"])
    sums = h[["sum_r", "sum_g", "sum_b"]].to_numpy()
    palette = cells.split_palette(h[["cr", "cg", "cb"]].to_numpy(), h["n"].to_numpy(), sums, h["sum_sq"].to_numpy())
    rows = [(k, *map(int, c)) for k, c in enumerate(palette)]
    return t("region").sparkSession.createDataFrame(rows, "k int, r int, g int, b int")


@query("chunk_scan", "SELECT epoch_us(ts) * 48 // 1000 AS pts, CAST(user_id % 2 AS INT) AS ctype, sha256(event_type) AS digest FROM events")
def chunk_scan(t):
    """Events written as chunks by group and read back by chaining."""
    rows = t("events").select(F.expr("unix_micros(cast(ts as timestamp)) * 48 div 1000").alias("pts"), (F.col("user_id") % 2).cast("int").alias("ctype"), F.lit(0).alias("comp"), F.col("event_type").cast("binary").alias("payload"), (F.col("event_id") % 16).alias("g"))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pts", "ctype"])
        data = b"".join(chunks.write_chunk(int(p), int(k), bytes(d), int(c)) for p, k, c, d in zip(frame.pts, frame.ctype, frame.comp, frame.payload, strict=True))
        return pd.DataFrame({"g": [key[0]], "content": [data]})

    files = rows.groupBy("g").applyInPandas(build, "g long, content binary")
    spark = files.sparkSession
    udfs.register(spark)
    found = files.lateralJoin(udfs.ChunksOf(F.col("content").outer()))
    return found.select("pts", "ctype", F.sha2("payload", 256).alias("digest"))


def _stream(name: str, sql: str | None, build):
    def run(spark, sf_dir: str):
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        # a pattern, as a stream takes no single file
        return windows.run_available(spark, f"{sf_dir}/event[s].parquet", schema, new_path(spark, name), build)

    QUERIES[name] = run
    if sql:
        from timegrid.plans.registry import ORACLE

        ORACLE[name] = sql


def _tumbling(df):
    rows = windows.event_time(df, "ts", "60 days")
    return rows.select("event_id", "user_id", micros().alias("us"))


# What a watermark still holds back never leaves a file sink, so the stream keeps rows and the window is the reader's.
_stream("stream_once", "SELECT DISTINCT user_id, event_type FROM events", lambda df: windows.once(windows.event_time(df, "ts", "60 days"), "user_id", "event_type").select("user_id", "event_type"))
_stream("stream_project", "SELECT event_id, user_id, epoch_us(ts) AS us FROM events", _tumbling)
_stream("stream_tumbling", """SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
    lambda df: windows.tumbling(windows.event_time(df, "ts", "1 hour"), "ts", "1 day", "event_type", n=F.count(F.lit(1))).select(F.unix_micros("start").alias("start"), "event_type", "n"))
_stream("stream_pacer", None, lambda df: pacer.pace_stream(df.select(F.col("user_id").cast("string").alias("stream"), (micros() / 1e6).alias("at"), (F.col("event_id") / 100).alias("pts"))))


@query("pacer_batch")
def pacer_batch(t):
    return pacer.pace(t("events").select(F.col("user_id").cast("string").alias("stream"), (micros() / 1e6).alias("at"), (F.col("event_id") / 100).alias("pts")))
