"""Queries on records, strings, arrays, maps and small searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from timegrid.functions import scalars as S
from timegrid.plans.registry import query
from timegrid.sources.chunks import fixed_records


@query("fixed_records", "SELECT page_id, CAST(i AS INT) AS record, substr(url, CAST(i * 8 + 1 AS BIGINT), 8) AS piece FROM (SELECT page_id, url, unnest(range(length(url) // 8)) AS i FROM pages)")
def fixed_pieces(t):
    rows = fixed_records(t("pages").select("page_id", F.col("url").cast("binary").alias("d")), "d", 8)
    return rows.select("page_id", "record", F.col("bytes").cast("string").alias("piece"))


@query("format_gate", "SELECT page_id, regexp_extract(url, '([a-z]+)/', 1) IN ('http', 'ftp') AS staged FROM pages")
def format_gate(t):
    return t("pages").select("page_id", F.regexp_extract("url", "([a-z]+)/", 1).isin("http", "ftp").alias("staged"))


@query("layered_probe", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN CAST(props ->> '$.k' AS BIGINT) END, CASE WHEN event_id % 3 = 1 THEN event_id % 8 END, 2) AS channels FROM events")
def layered_probe(t):
    i = F.col("event_id")
    first = F.when(i % 3 == 0, F.get_json_object("props", "$.k").cast("long"))
    return t("events").select("event_id", F.coalesce(first, F.when(i % 3 == 1, i % 8), F.lit(2)).alias("channels"))


@query("sample_rows", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 64")
def sample_rows(t):
    return t("events").orderBy(F.desc("value"), "event_id").limit(64).select("event_id", "value")


@query("stream_types", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events WHERE event_type <> 'signup' GROUP BY user_id")
def stream_types(t):
    kinds = F.collect_set(F.when(F.col("event_type") != "signup", F.col("event_type")))
    rows = t("events").filter("event_type != 'signup'")
    return rows.groupBy("user_id").agg(F.concat_ws(",", F.array_sort(kinds)).alias("types"))


@query("grid_solver", """SELECT p_partkey, CAST(floor(p_size * s + 0.5) AS BIGINT) AS w, CAST(floor(p_size * 3 * s / 2 + 0.5) AS BIGINT) AS h
    FROM (SELECT *, least(335.0::DOUBLE / p_size, 123.0::DOUBLE * 2 / (p_size * 3)) AS s FROM part)""")
def grid_solver(t):
    s = F.least(335.0 / F.col("p_size"), 123.0 * 2 / (F.col("p_size") * 3))
    return t("part").select("p_partkey", F.floor(F.col("p_size") * s + 0.5).alias("w"), F.floor(F.col("p_size") * 3 * s / 2 + 0.5).alias("h"))


@query("size_names", """WITH p(name, w, h) AS (VALUES ('small', 51, 19), ('large', 164, 81)), r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'large' WHEN 2 THEN CAST(event_id % 90 + 1 AS VARCHAR) || 'x' || CAST(event_id % 40 AS VARCHAR) ELSE 'bad' END AS s FROM events)
    SELECT event_id, coalesce(w, TRY_CAST(nullif(regexp_extract(s, '^(\\d+)x(\\d+)$', 1), '') AS INT)) AS w, coalesce(h, TRY_CAST(nullif(regexp_extract(s, '^(\\d+)x(\\d+)$', 2), '') AS INT)) AS h FROM r LEFT JOIN p ON name = s""".replace("\\\\", "\\"))
def size_names(t):
    i = F.col("event_id")
    name = F.when(i % 4 == 0, "small").when(i % 4 == 1, "large").when(i % 4 == 2, F.concat((i % 90 + 1).cast("string"), F.lit("x"), (i % 40).cast("string"))).otherwise("bad")
    w, h = S.size(name, {"small": (51, 19), "large": (164, 81)})
    return t("events").select("event_id", w.alias("w"), h.alias("h"))


@query("template", "SELECT c_custkey, replace(replace('ws://{host}/{path}', '{host}', lower(c_mktsegment)), '{path}', c_name) AS address FROM customer")
def template(t):
    return t("customer").select("c_custkey", S.filled("ws://{host}/{path}", host=F.lower("c_mktsegment"), path=F.col("c_name")).alias("address"))


@query("config_literal", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(props ->> '$.k' AS BIGINT) END AS k FROM events")
def config_literal(t):
    damaged = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return t("events").select("event_id", F.from_json(damaged, "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("map_lookup", "SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS number FROM events")
def map_lookup(t):
    names = F.create_map(*[x for k, v in {"view": 0, "click": 1, "purchase": 2}.items() for x in (F.lit(k), F.lit(v))])
    return t("events").select("event_id", F.coalesce(names[F.col("event_type")], F.lit(-1)).alias("number"))


@query("signature", "SELECT user_id, count(DISTINCT event_type || ':' || CAST(event_id % 3 AS VARCHAR)) = 1 AS same FROM events GROUP BY user_id")
def signature(t):
    sign = F.xxhash64("event_type", F.col("event_id") % 3)
    return t("events").groupBy("user_id").agg((F.min(sign) == F.max(sign)).alias("same"))


@query("padded_arrays", """SELECT l_orderkey, array_to_string(list_resize(v, ((len(v) + 7) // 8) * 8, 0), ',') AS padded, array_to_string(v[3:], ',') AS trimmed FROM (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS v FROM lineitem GROUP BY l_orderkey)""")
def padded_arrays(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("v"))
    n = F.size("v")
    zeros = F.array_repeat(F.lit(0), F.pmod(-n, F.lit(8)))
    trimmed = F.when(n > 2, F.slice("v", F.lit(3), n)).otherwise(F.array().cast("array<int>"))
    text = lambda x: F.concat_ws(",", F.transform(x, lambda y: y.cast("string")))
    return rows.select("l_orderkey", text(F.concat("v", zeros)).alias("padded"), text(trimmed).alias("trimmed"))


@query("convolution", """SELECT event_id, round(0.25 * coalesce(lag(value) OVER w, value) + 0.5 * value + 0.25 * coalesce(lead(value) OVER w, value), 6) AS smooth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def convolution(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t("events").select("event_id", F.round(S.convolved("value", [0.25, 0.5, 0.25], w), 6).alias("smooth"))


@query("least_cost_pair", """WITH p AS (SELECT i, j, row_number() OVER (ORDER BY i, j) AS n FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) WHERE i < j),
    c AS (SELECT event_id, n, i, j, CAST(abs(event_id % 50 - (i * 17 + j * 5) % 50) AS BIGINT) AS cost FROM events, p)
    SELECT event_id, i, j, cost FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY cost, n) = 1""")
def least_cost_pair(t):
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    e = F.col("event_id") % 50
    options = F.array(*[F.struct(F.abs(e - (i * 17 + j * 5) % 50).alias("cost"), F.lit(n).alias("n"), F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for n, (i, j) in enumerate(pairs)])
    best = F.array_min(options)
    return t("events").select("event_id", best["i"].alias("i"), best["j"].alias("j"), best["cost"].alias("cost"))


@query("symbol_order", "SELECT event_type, count(*) AS f, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS BIGINT) AS place, CAST(sum(count(*)) OVER (ORDER BY count(*) DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) AS BIGINT) AS start FROM events GROUP BY event_type")
def symbol_order(t):
    # a handful of symbols: one window over their counts
    counts = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("f"))
    w = Window.orderBy(F.desc("f"), "event_type")
    start = F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("f")
    return counts.select("event_type", "f", F.row_number().over(w).cast("long").alias("place"), start.alias("start"))


@query("little_endian_pack", "SELECT event_id, lpad(hex(event_id % 256), 2, '0') || lpad(hex(event_id // 256 % 256), 2, '0') AS u16 FROM events")
def little_endian_pack(t):
    return t("events").select("event_id", F.hex(S.packed(F.col("event_id"), 2)).alias("u16"))


@query("forwarded_host", "SELECT page_id, trim(split_part(replace(url, '/', ', '), ',', 3)) AS item FROM pages")
def forwarded_host(t):
    return t("pages").select("page_id", F.trim(F.split_part(F.regexp_replace("url", "/", ", "), F.lit(","), F.lit(3))).alias("item"))
