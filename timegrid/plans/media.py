"""Chunks, segments, pictures, sound and messages as queries: what is written is read back, and SQL tells what was written."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.codecs import audio, cells, control, gop, onebit
from timegrid.functions import udfs
from timegrid.functions.udfs import index_first
from timegrid.model import COLOURS, GLYPHS
from timegrid.operators import aggregates, media
from timegrid.plans.codecs import PLANES, _planes
from timegrid.plans.registry import ORACLE, QUERIES, query
from timegrid.sources import chunks, files
from timegrid.staging import new_path
from timegrid.streaming import segments, windows

GROUPS = 16


def _by_group(rows: DataFrame, schema: str, made: Callable[[pd.DataFrame], list[tuple]]) -> DataFrame:
    """made() of each group `g` of rows, in order of pts and ctype."""

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(made(frame.sort_values(["pts", "ctype", "payload"])), columns=[c.split()[0] for c in schema.split(", ")])

    return rows.groupBy("g").applyInPandas(fold, schema)


def _chunk_rows(t) -> DataFrame:
    pts = F.expr("unix_micros(cast(ts as timestamp)) * 48 div 1000")
    return t("events").select((F.col("event_id") % GROUPS).alias("g"), pts.alias("pts"), (F.col("user_id") % 2).cast("int").alias("ctype"), F.col("event_type").cast("binary").alias("payload"))


def _written(frame: pd.DataFrame) -> bytes:
    return b"".join(chunks.write_chunk(int(p), int(c), bytes(d)) for p, c, d in zip(frame.pts, frame.ctype, frame.payload, strict=True))


@query("chunk_headers", "SELECT epoch_us(ts) * 48 // 1000 AS pts, CAST(length(event_type) AS INT) AS plen, CAST(user_id % 2 AS INT) AS ctype FROM events")
def chunk_headers(t):
    """Heads only: payloads are skipped, not read."""

    def made(frame: pd.DataFrame) -> list[tuple]:
        return [(pts, size, kind) for _, pts, size, kind, _, _ in chunks.scan(_written(frame), payloads=False)]

    return _by_group(_chunk_rows(t), "pts long, plen int, ctype int", made)


@query("chunk_resync", f"""SELECT event_id % {GROUPS} AS g, count(*) AS n, max(epoch_us(ts) * 48 // 1000) AS last FROM events GROUP BY g""")
def chunk_resync(t):
    """Files that begin with false markers: reading starts where chunks chain, and a small tail tells the last time."""

    def made(frame: pd.DataFrame) -> list[tuple]:
        data = b"CCCCCCC\xff\xff\xff" + _written(frame)
        at = chunks.resync(data, 0)
        return [(int(frame.g.iloc[0]), sum(1 for _ in chunks.scan(data, at)), chunks.tail(data, 64)[-1][1])]

    return _by_group(_chunk_rows(t), "g long, n long, last long", made)


def _each_row(rows: DataFrame, schema: str, made: Callable[..., tuple]) -> DataFrame:
    """made() of each row, in batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it):
        for frame in it:
            yield pd.DataFrame([made(*r) for r in frame.itertuples(index=False, name=None)], columns=names)

    return rows.mapInPandas(run, schema)


@query("control_frames", """SELECT event_id, 'http://host/' || event_type AS url, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS start, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id + 1000 END AS stop,
    event_id % 2 = 1 AS loop, event_id % 7 = 0 AS sync, user_id % 256 AS video, event_id % 512 AS channels, event_id % 2048 AS width, CAST(event_id % 3 AS BIGINT) AS state, CASE WHEN event_id % 3 = 1 THEN event_id * 48 END AS origin FROM events""")
def control_frames(t):
    """Requests, capabilities and status written as frames and parsed."""

    def made(event: int, user: int, kind: str) -> tuple:
        room = control.Room("http://host/" + kind, event if event % 3 else None, event + 1000 if event % 5 else None, event % 2 == 1, event % 7 == 0)
        caps = control.Caps(video=user % 256, channels=event % 512, width=event % 2048)
        r = control.parse(control.frame(control.ROOM, room.pack()))
        c = control.parse(control.frame(control.CAPS, caps.pack()))
        s = control.parse(control.status(event % 3, event * 48 if event % 3 == control.PLAYING else None))
        return event, r["url"], r["start"], r["end"], r["loop"], r["sync"], c["video"], c["channels"], c["width"], s["state"], s["origin"]

    schema = "event_id long, url string, start long, stop long, loop boolean, sync boolean, video long, channels long, width long, state long, origin long"
    rows = t("events").select("event_id", "user_id", "event_type")
    typed = _each_row(rows, schema.replace("start long", "start string").replace("stop long", "stop string").replace("origin long", "origin string"), lambda *r: tuple(str(x) if i in (2, 3, 10) and x is not None else x for i, x in enumerate(made(*r))))
    return typed.withColumns({c: F.col(c).cast("long") for c in ("start", "stop", "origin")})


#: A grid of 4 x 2 cells, of whose glyphs and colours SQL can tell each.
WIDTH, HEIGHT = 4, 2
FRAME_SQL = f"""SELECT event_id, user_id, event_id % 1000 + 1 AS duration,
    lpad(hex(event_id % {GLYPHS}), 2, '0') || repeat(lpad(hex(user_id % {GLYPHS}), 2, '0'), 7) AS glyph,
    lpad(hex(event_id % {COLOURS}), 2, '0') || repeat(lpad(hex(user_id % {COLOURS}), 2, '0'), 7) AS fg FROM events"""


def _frame(event: int, user: int) -> gop.Frame:
    plane = lambda n: np.array([event % n] + [user % n] * 7, np.uint8)
    return gop.Frame(plane(GLYPHS), plane(COLOURS), np.zeros(8, np.uint8), bytes([user % 256]) * gop.PALETTE_BYTES, event % 1000 + 1)


def _segments(t, coded: bool) -> DataFrame:
    """Each user's events as frames of one segment, encoded, decoded and told by place."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        events = sorted(map(int, rows.event_id))
        found = gop.decode(gop.encode([_frame(e, int(key[0])) for e in events], WIDTH, HEIGHT, coded))
        out = [(e, key[0], f.duration, f.glyph.tobytes().hex().upper(), f.fg.tobytes().hex().upper()) for e, f in zip(events, found, strict=True)]
        return pd.DataFrame(out, columns=["event_id", "user_id", "duration", "glyph", "fg"])

    return t("events").select("event_id", "user_id").groupBy("user_id").applyInPandas(fold, "event_id long, user_id long, duration long, glyph string, fg string")


@query("gop_raw", FRAME_SQL)
def gop_raw(t):
    return _segments(t, False)


@query("gop_coded", FRAME_SQL)
def gop_coded(t):
    return _segments(t, True)


@query("gop_spans", f"""WITH f AS (SELECT user_id, event_id, event_id % {GLYPHS} AS g, event_id % {COLOURS} AS c, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT event_id, CASE WHEN before % {GLYPHS} <> g OR before % {COLOURS} <> c THEN 1 ELSE 0 END AS spans FROM f WHERE before IS NOT NULL""")
def gop_spans(t):
    """How many stretches of cells each frame changes."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        events = sorted(map(int, rows.event_id))
        made = [_frame(e, int(key[0])) for e in events]
        out = [(e, len(gop.spans(a, b, WIDTH))) for e, a, b in zip(events[1:], made, made[1:], strict=False)]
        return pd.DataFrame(out, columns=["event_id", "spans"])

    return t("events").select("event_id", "user_id").groupBy("user_id").applyInPandas(fold, "event_id long, spans int")


@query("coded_peek", "SELECT event_id, event_id % 2 = 1 AS coded FROM events")
def coded_peek(t):
    """Whether a chunk's keyframe is entropy coded, from its first bytes."""

    def made(event: int, user: int) -> tuple:
        return event, control.carries_coded(0, 0, gop.encode([_frame(event, user)], WIDTH, HEIGHT, event % 2 == 1))

    return _each_row(t("events").select("event_id", "user_id"), "event_id long, coded boolean", made)


@query("cells_shown", f"SELECT event_id, event_id % {COLOURS} * 16 AS r, event_id % {COLOURS} * 7 AS g, user_id % 2 * 255 AS b FROM events")
def cells_shown(t):
    """Pictures of one colour of the palette, as cells and as pixels again."""

    def run(it):
        for rows in it:
            out = []
            for odd in (0, 1):
                some = rows[rows.user_id % 2 == odd]
                if not len(some):
                    continue
                palette = np.array([(k * 16, k * 7, odd * 255) for k in range(COLOURS)], np.uint8)
                rgb = np.repeat(np.repeat(palette[some.event_id.to_numpy() % COLOURS][None], 2, 1), 3, 0)
                shown = cells.render_cells(*cells.encode_cells(rgb, palette), palette, len(some))
                assert (shown == shown[:1]).all()
                out.append(pd.DataFrame({"event_id": some.event_id.to_numpy(), **{c: shown[0, ::2, k].astype(np.int64) for k, c in enumerate("rgb")}}))
            yield pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("event_id", "r", "g", "b")})

    return t("events").select("event_id", "user_id").mapInPandas(run, "event_id long, r long, g long, b long")


@query("nibble_pack", PLANES.format(m=16))
def nibble_pack(t):
    rows = _planes(t, 16).withColumn("packed", udfs.pack_bits("plane", F.lit(4)))
    return rows.select("l_orderkey", F.hex(udfs.unpack_bits("packed", F.lit(4), "n")).alias("plane"))


@query("codec_plane_rows", """SELECT o_orderkey, upper(string_agg(lpad(hex(CASE WHEN o_orderkey % 2 = 0 THEN i % 8 ELSE i // 8 END), 2, '0'), '' ORDER BY i)) AS plane, true AS small
    FROM orders, (SELECT unnest(range(64)) AS i) GROUP BY o_orderkey""")
def codec_plane_rows(t):
    """Planes of 8 x 8 whose rows, or columns, are alike: the predictors make them small."""
    i = F.sequence(F.lit(0), F.lit(63))
    cell = F.when(F.col("o_orderkey") % 2 == 0, F.transform(i, lambda x: F.lpad(F.hex(x % 8), 2, "0"))).otherwise(F.transform(i, lambda x: F.lpad(F.hex(F.floor(x / 8)), 2, "0")))
    rows = t("orders").select("o_orderkey", F.unhex(F.concat_ws("", cell)).alias("plane"))
    rows = rows.withColumn("coded", udfs.plane_encode("plane", F.lit(GLYPHS), F.lit(8)))
    back = udfs.plane_decode("coded", F.lit(64), F.lit(GLYPHS), F.lit(8))
    return rows.select("o_orderkey", F.hex(back).alias("plane"), (F.octet_length("coded") < 48).alias("small"))


@query("onebit_tone", "SELECT page_id, CAST(4800 AS BIGINT) AS samples, true AS alike FROM pages")
def onebit_tone(t):
    """A tone for each page, as one bit a sample and back: alike if the correlation is above 0.95."""

    def made(page: int) -> tuple:
        tone = np.round(128 + 100 * np.sin(2 * np.pi * (300 + page % 200) * np.arange(4800) / 48000)).astype(np.uint8)
        back = np.frombuffer(onebit.decode(onebit.encode(tone.tobytes())), np.uint8)
        # the low-pass delays by a few samples
        return page, len(back), bool(max(np.corrcoef(tone[: 4800 - d], back[d:])[0, 1] for d in range(8)) > 0.95)

    return _each_row(t("pages").select("page_id"), "page_id long, samples long, alike boolean", made)


@query("audio_roles", """WITH s AS (SELECT event_id, event_id % 200 AS left_, user_id % 200 AS right_ FROM events)
    SELECT event_id AS stream, CAST(role AS INT) AS role, CASE role WHEN 0 THEN (left_ + right_ + 1) // 2 WHEN 1 THEN left_ ELSE right_ END AS sample FROM s, (VALUES (0), (1), (2)) r(role)""")
def audio_roles(t):
    """Interleaved stereo cut into mono, left and right, as chunks and back."""
    pcm = F.unhex(F.repeat(F.concat(F.lpad(F.hex(F.col("event_id") % 200), 2, "0"), F.lpad(F.hex(F.col("user_id") % 200), 2, "0")), 4))
    rows = t("events").select(F.col("event_id").cast("string").alias("stream"), F.lit(0).cast("long").alias("pts"), pcm.alias("pcm"))
    sound = media.decode_audio(media.encode_audio(rows, 2, 0b111, audio.PCM8))
    value = F.conv(F.hex(F.substring("samples", 4, 1)), 16, 10).cast("long")
    return sound.select(F.col("stream").cast("long").alias("stream"), F.col("role").cast("int").alias("role"), value.alias("sample"))


@query("index_probe", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS index_first FROM events")
def index_probe(t):
    """Files whose index box comes first, or last, or doesn't show in their heads."""

    def box(name: bytes) -> bytes:
        return (12).to_bytes(4, "big") + name + b"body"

    heads = {0: box(b"ftyp") + box(b"moov"), 1: box(b"ftyp") + box(b"mdat"), 2: box(b"ftyp") + box(b"free")}
    return _each_row(t("events").select("event_id"), "event_id long, index_first boolean", lambda e: (e, index_first(heads[e % 3])))


BOXES = [(1, 2, 1, 0, 5, 4, 1), (2, 0, 0, 1, 3, 3, 3), (3, 4, 5, 2, 10, 10, 6)]


@query("box_sum_3d", f"""WITH c AS (SELECT CAST(l_quantity AS INT) // 5 AS x, CAST(floor(l_discount * 100 + 0.5) AS INT) AS y, l_linenumber - 1 AS z FROM lineitem)
    SELECT box, count(x) AS inside FROM (VALUES {", ".join(map(str, BOXES))}) b(box, x0, y0, z0, x1, y1, z1) LEFT JOIN c ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1 GROUP BY box""")
def box_sum_3d(t):
    """Sums of boxes from eight corners of a table of sums along three axes."""
    rows = t("lineitem").select(F.expr("cast(l_quantity as int) div 5").cast("int").alias("x"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("y"), (F.col("l_linenumber") - 1).alias("z"), F.lit(1).cast("long").alias("one"))
    boxes = t("region").sparkSession.createDataFrame(BOXES, "box int, x0 int, y0 int, z0 int, x1 int, y1 int, z1 int")
    axes = ("x", "y", "z")
    return aggregates.boxes(aggregates.integrals(rows, axes, "one"), axes, boxes)


@query("approx_distinct_near", "SELECT event_type, true AS near FROM events GROUP BY event_type")
def approx_distinct_near(t):
    """Whether the approximate count of distinct users lies within three times its standard error of the exact one."""
    got = t("events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("n"))
    return got.select("event_type", (F.abs(F.col("a") - F.col("n")) <= 0.06 * F.col("n") + 1).alias("near"))


@query("role_names", """WITH n(name, bit) AS (VALUES ('mono', 0), ('left', 1), ('right', 2), ('centre', 3), ('low', 4)),
    w AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'stereo' WHEN 1 THEN 'mono,low' WHEN 2 THEN 'left, nowhere' ELSE 'all' END AS names FROM customer),
    p AS (SELECT c_custkey, trim(unnest(string_split(replace(replace(names, 'stereo', 'left,right'), 'all', 'mono,left,right,centre,low'), ','))) AS name FROM w)
    SELECT c_custkey, CASE WHEN count(bit) = count(*) THEN CAST(sum(1 << bit) AS BIGINT) END AS mask, string_agg(name, ',' ORDER BY name) FILTER (bit IS NULL) AS unknown FROM p LEFT JOIN n USING (name) GROUP BY c_custkey""")
def role_names(t):
    """Lists of names and presets as masks; a list with an unknown name has no mask, and the name is told."""
    key = F.col("c_custkey") % 4
    names = F.when(key == 0, "stereo").when(key == 1, "mono,low").when(key == 2, "left, nowhere").otherwise("all")
    presets = {"stereo": "left,right", "all": "mono,left,right,centre,low"}
    for short, whole in presets.items():
        names = F.replace(names, F.lit(short), F.lit(whole))
    bits = F.create_map(*[F.lit(x) for pair in zip(("mono", "left", "right", "centre", "low"), range(5), strict=True) for x in pair])
    rows = t("customer").select("c_custkey", F.explode(F.split(names, ",")).alias("name")).select("c_custkey", F.trim("name").alias("name"))
    rows = rows.withColumn("bit", bits[F.col("name")])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    unknown = F.array_join(F.array_sort(F.collect_list(F.when(F.col("bit").isNull(), F.col("name")))), ",")
    got = rows.groupBy("c_custkey").agg(F.bit_or(one).alias("m"), (F.count("bit") == F.count(F.lit(1))).alias("known"), unknown.alias("unknown"))
    return got.select("c_custkey", F.when(F.col("known"), F.col("m")).alias("mask"), F.when(~F.col("known"), F.col("unknown")).alias("unknown"))


@query("padded_means", """WITH m AS (SELECT p_brand, CAST(round_even(sum(p_size) / count(*), 0) AS BIGINT) AS mean FROM part GROUP BY p_brand),
    r AS (SELECT mean, row_number() OVER (ORDER BY p_brand) - 1 AS place, count(*) OVER () AS n FROM m)
    SELECT CAST(i AS BIGINT) AS place, mean FROM (SELECT unnest(range(32)) AS i) JOIN r ON place = least(i, n - 1)""")
def padded_means(t):
    """The mean of each box, and the last one over again up to 32."""
    mean = F.bround(F.sum("p_size") / F.count(F.lit(1))).cast("long")
    every = t("part").groupBy("p_brand").agg(mean.alias("mean")).agg(F.array_sort(F.collect_list(F.struct("p_brand", "mean"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.element_at("m", F.least(i + 1, F.size("m")))["mean"])
    return every.select(F.posexplode(full).alias("place", "mean")).select(F.col("place").cast("long").alias("place"), "mean")


def _formats(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_retailprice")
    found = []
    for kind in ("csv", "json", "orc"):
        at = new_path(spark, kind)
        rows.write.format(kind).save(at)
        found.append(files.read(spark, at, kind, "p_partkey long, p_name string, p_retailprice double").withColumn("kind", F.lit(kind)))
    return found[0].unionByName(found[1]).unionByName(found[2])


QUERIES["formats"] = _formats
ORACLE["formats"] = "SELECT p_partkey, p_name, p_retailprice, kind FROM part, (VALUES ('csv'), ('json'), ('orc')) k(kind)"


def _fan_out(spark, sf_dir: str) -> DataFrame:
    """A stream handed to two consumers, each with files of its own."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    work = new_path(spark, "fan")
    sinks = {k: (lambda batch, k=k: batch.select("event_id", F.lit(k).alias("sink")).write.mode("append").parquet(f"{work}/{k}")) for k in ("first", "second")}
    windows.fan_out(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"), sinks, work).awaitTermination()
    return spark.read.parquet(f"{work}/first").unionAll(spark.read.parquet(f"{work}/second"))


QUERIES["fan_out"] = _fan_out
ORACLE["fan_out"] = "SELECT event_id, sink FROM events, (VALUES ('first'), ('second')) s(sink)"


def _gated(spark, sf_dir: str) -> DataFrame:
    """A stream's rows that the capabilities of their user allow."""
    events = f"{sf_dir}/events.parquet"
    caps = spark.read.parquet(events).groupBy("user_id").agg(F.bit_or(F.col("event_id") % 4).alias("caps"))
    need = F.col("caps").bitwiseAND(F.col("event_id") % 4 + 1) > 0
    build = lambda df: windows.gated(df.select("event_id", "user_id"), caps, "user_id", need).select("event_id")
    return windows.run_available(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(events).schema, new_path(spark, "gated"), build)


QUERIES["stream_gated"] = _gated
ORACLE["stream_gated"] = "SELECT event_id FROM events JOIN (SELECT user_id, bit_or(event_id % 4) AS caps FROM events GROUP BY user_id) c USING (user_id) WHERE caps & (event_id % 4 + 1) > 0"


def _segmented(spark, sf_dir: str) -> DataFrame:
    """A stream's rows in segments of at most ten rows' span, by state."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    build = lambda df: segments.segment_stream(df.select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("id"), F.lit(1).cast("long").alias("span"), F.lit(0).cast("long").alias("size")), 10, 1 << 20)
    out = windows.run_available(spark, f"{sf_dir}/event[s].parquet", schema, new_path(spark, "segments"), build)
    return out.select("stream", "id", "segment")


QUERIES["stream_segments"] = _segmented
ORACLE["stream_segments"] = "SELECT CAST(user_id AS VARCHAR) AS stream, event_id AS id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS segment FROM events"


def _listed(spark, sf_dir: str) -> DataFrame:
    """The tables of the data folder by name, each a Parquet file or a folder of such, without pages."""
    found = files.list_files(spark, sf_dir, "*.parquet", "pages.parquet")
    return found.select(F.regexp_extract("below", "^([^/]+)[.]parquet(/|$)", 1).alias("name")).filter("name != ''").distinct()


QUERIES["listed_files"] = _listed
ORACLE["listed_files"] = "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'benchmark', 'labels', 'conversations']) AS name"
