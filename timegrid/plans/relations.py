"""Aggregations, lookups, set operations, negotiation and scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from timegrid.functions import scalars as S
from timegrid.operators import aggregates, lookup
from timegrid.plans.registry import query
from timegrid.plans.timeline import micros

# --- aggregations ---------------------------------------------------------------------------------------------------


@query("moments_hist", """SELECT CAST(l_quantity AS INT) // 16 AS q, CAST(floor(l_discount * 100 + 0.5) AS INT) // 4 AS d, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS sum_q,
    CAST(sum(CAST(floor(l_tax * 100 + 0.5) AS BIGINT)) AS BIGINT) AS sum_t, CAST(sum(CAST(l_quantity AS BIGINT) ** 2 + CAST(floor(l_tax * 100 + 0.5) AS BIGINT) ** 2) AS BIGINT) AS sum_sq FROM lineitem GROUP BY ALL""")
def moments_hist(t):
    q, x = F.col("l_quantity").cast("long"), F.floor(F.col("l_tax") * 100 + 0.5)
    by = [F.shiftright(F.col("l_quantity").cast("int"), 4).alias("q"), F.shiftright(F.floor(F.col("l_discount") * 100 + 0.5).cast("int"), 2).alias("d")]
    return aggregates.moments(t("lineitem"), by, {"q": q, "t": x})


@query("integral_sum", """WITH c AS (SELECT CAST(l_quantity AS INT) // 5 AS x, CAST(floor(l_discount * 100 + 0.5) AS INT) AS y, count(*) AS v FROM lineitem GROUP BY ALL),
    g AS (SELECT x, y, coalesce(v, 0) AS v FROM ((SELECT unnest(range((SELECT max(x) FROM c) + 1)) AS x) CROSS JOIN (SELECT unnest(range((SELECT max(y) FROM c) + 1)) AS y)) LEFT JOIN c USING (x, y))
    SELECT CAST(a.x AS INT) AS x, CAST(a.y AS INT) AS y, CAST(sum(b.v) AS BIGINT) AS total FROM g a JOIN g b ON b.x <= a.x AND b.y <= a.y GROUP BY a.x, a.y""")
def integral_sum(t):
    rows = t("lineitem").select(F.expr("cast(l_quantity as int) div 5").cast("int").alias("x"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("y"), F.lit(1).cast("long").alias("one"))
    return aggregates.integral(rows, "x", "y", "one")


@query("box_sum", """WITH c AS (SELECT CAST(l_quantity AS INT) // 5 AS x, CAST(floor(l_discount * 100 + 0.5) AS INT) AS y FROM lineitem)
    SELECT box, count(*) AS inside FROM (VALUES (1, 2, 1, 5, 4), (2, 0, 0, 3, 3), (3, 4, 5, 10, 10)) b(box, x0, y0, x1, y1) JOIN c ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY box""")
def box_sum(t):
    spark = t("region").sparkSession
    boxes = spark.createDataFrame([(1, 2, 1, 5, 4), (2, 0, 0, 3, 3), (3, 4, 5, 10, 10)], "box int, x0 int, y0 int, x1 int, y1 int")
    return aggregates.box_sum(integral_sum(t), "x", "y", boxes)


@query("bitmask_union_intersect", """SELECT user_id, bit_or(CAST(event_id % 9 AS BIGINT)) AS any_bits, bit_and(CAST(event_id % 9 AS BIGINT)) AS all_bits, bool_and((event_id % 9) & 1 = 1) AS all_first FROM events GROUP BY user_id""")
def bitmask_union_intersect(t):
    return aggregates.mask_summary(t("events"), "user_id", F.col("event_id") % 9)


@query("empty_intersection", """SELECT c_custkey, coalesce(bit_and(o_orderkey % 16), 1) AS all_bits, coalesce(bool_and(o_orderkey % 2 = 1), false) AS all_first FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY c_custkey""")
def empty_intersection(t):
    rows = t("customer").join(t("orders").filter("o_totalprice > 100000"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return aggregates.mask_summary(rows, "c_custkey", F.col("o_orderkey") % 16).select("c_custkey", "all_bits", "all_first")


@query("bit_assemble", "SELECT user_id, CAST(sum(DISTINCT 1 << CAST(event_id % 5 AS INT)) AS BIGINT) AS mask, CAST(31 - sum(DISTINCT 1 << CAST(event_id % 5 AS INT)) AS BIGINT) AS inverted FROM events GROUP BY user_id")
def bit_assemble(t):
    bit = F.expr("shiftleft(1L, cast(event_id % 5 as int))")
    return t("events").groupBy("user_id").agg(F.bit_or(bit).alias("mask")).withColumn("inverted", 31 - F.col("mask"))


@query("entropy_order0", """WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c)
    SELECT user_id, CAST(sum(c) AS BIGINT) AS n, round(-sum(p * log2(p)), 6) + 0.0 AS bits FROM p GROUP BY user_id""")
def entropy_order0(t):
    return aggregates.entropy(t("events"), "user_id", "event_type").withColumn("bits", F.round("bits", 6) + 0.0)


@query("bigram_entropy", """WITH b AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS a, event_type AS b FROM events), c AS (SELECT a, b, count(*) AS c FROM b WHERE a IS NOT NULL GROUP BY ALL),
    p AS (SELECT *, sum(c) OVER (PARTITION BY a) AS n, sum(c) OVER () AS t FROM c) SELECT round(-sum(c / t * log2(c / n)), 6) AS bits FROM p""")
def bigram_entropy(t):
    return aggregates.bigram_entropy(t("events"), "user_id", "event_id", "event_type").select(F.round("bits", 6).alias("bits"))


@query("exact_shares", """WITH RECURSIVE c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL),
    f AS (SELECT *, CAST(greatest(1, floor(c * 64.0 / sum(c) OVER (PARTITION BY user_id))) AS BIGINT) AS f, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS k FROM c),
    d AS (SELECT *, 64 - CAST(sum(f) OVER (PARTITION BY user_id) AS BIGINT) AS d FROM f)
    SELECT user_id, event_type, c, f + d // k + CASE WHEN r < d % k THEN 1 ELSE 0 END AS share FROM d""")
def exact_shares(t):
    counts = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    return aggregates.exact_shares(counts, "user_id", "event_type", "c", 64)


@query("quantiles", "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def quantiles(t):
    return t("events").groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(p / 100)), 6).alias(f"p{p}") for p in (10, 50, 90)])


@query("ratio_rollup", """WITH s AS (SELECT p_type, sum(p_size) AS n FROM part GROUP BY p_type)
    SELECT p_type, CAST(n AS BIGINT) AS total, round(100.0 * n / sum(n) OVER (), 6) AS percent, round(n / max(CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN n END) OVER (), 6) AS vs_base FROM s""")
def ratio_rollup(t):
    shares = aggregates.share_of(t("part"), "p_type", F.col("p_size"))
    base = shares.agg(F.min_by("total", "p_type").alias("b"))
    out = shares.crossJoin(F.broadcast(base))
    return out.select("p_type", "total", F.round(100 * F.col("share"), 6).alias("percent"), F.round(F.col("total") / F.col("b"), 6).alias("vs_base"))


@query("timings", "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, round(median(value), 6) AS middle, round(avg(CAST(value > 50 AS INT)), 6) AS above FROM events GROUP BY event_type")
def timings(t):
    return t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.round(F.median("value"), 6).alias("middle"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("above"))


@query("psnr", """SELECT l_returnflag, round(CASE WHEN avg((l_quantity - l_linenumber) ** 2) = 0 THEN CAST('inf' AS DOUBLE) ELSE 10 * log10(255.0 * 255.0 / avg((l_quantity - l_linenumber) ** 2)) END, 6) AS psnr FROM lineitem GROUP BY l_returnflag""")
def psnr(t):
    mse = F.avg(F.pow(F.col("l_quantity") - F.col("l_linenumber"), 2))
    return t("lineitem").groupBy("l_returnflag").agg(F.round(S.psnr(mse), 6).alias("psnr"))


@query("unit_counts", """SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS paid FROM events GROUP BY user_id""")
def unit_counts(t):
    kind = F.col("event_type")
    return t("events").groupBy("user_id").agg(F.count_if(kind == "view").alias("views"), F.count_if(kind == "click").alias("clicks"), F.round(F.coalesce(F.sum(F.when(kind == "purchase", F.col("value"))), F.lit(0.0)), 4).alias("paid"))


@query("distinct_memo", "SELECT l_orderkey, l_linenumber, upper(l_returnflag || l_linestatus) AS code FROM lineitem")
def distinct_memo(t):
    codes = t("lineitem").select("l_returnflag", "l_linestatus").distinct().withColumn("code", F.upper(F.concat("l_returnflag", "l_linestatus")))
    return t("lineitem").join(codes, ["l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber", "code")


@query("device_dedup", "SELECT c_mktsegment, c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL")
def device_dedup(t):
    return t("customer").groupBy("c_mktsegment", "c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))


@query("mean_abs_difference", """SELECT a.user_id % 10 AS g, round(avg(abs(a.value - b.value)), 6) AS score FROM events a JOIN events b ON b.event_id = a.event_id + 1 GROUP BY g""")
def mean_abs_difference(t):
    a = t("events").select("event_id", "user_id", "value")
    b = t("events").select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("other"))
    return a.join(b, "event_id").groupBy((F.col("user_id") % 10).alias("g")).agg(F.round(F.avg(F.abs(F.col("value") - F.col("other"))), 6).alias("score"))


@query("cube_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("rollup_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("l_linestatus").cast("long").alias("g"))


@query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(t):
    out = t("orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority")
    return out.agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("approx_distinct")
def approx_distinct(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


# --- joins and lookups ------------------------------------------------------------------------------------------------


@query("priority_lookup", """WITH s AS (SELECT s_nationkey, min(s_suppkey) AS first FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey),
    r AS (SELECT c_mktsegment, n_nationkey, (n_nationkey * 7 + length(c_mktsegment)) % 25 AS prio FROM (SELECT DISTINCT c_mktsegment FROM customer), nation WHERE (n_nationkey + length(c_mktsegment)) % 3 = 0)
    SELECT c_custkey, coalesce((SELECT arg_min(n_nationkey, prio * 100 + n_nationkey) FROM r WHERE r.c_mktsegment = customer.c_mktsegment AND n_nationkey IN (SELECT s_nationkey FROM s)), -1) AS chosen FROM customer""")
def priority_lookup(t):
    segments, nations = t("customer").select("c_mktsegment").distinct(), t("nation").select("n_nationkey")
    choices = segments.crossJoin(F.broadcast(nations)).filter((F.col("n_nationkey") + F.length("c_mktsegment")) % 3 == 0)
    choices = choices.withColumn("prio", (F.col("n_nationkey") * 7 + F.length("c_mktsegment")) % 25)
    available = t("supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return lookup.priority(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", choices, "prio", "n_nationkey", available, -1).select("c_custkey", "chosen")


@query("nearest_k", """WITH p AS (SELECT vec_id AS code, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 16), s AS (SELECT e.vec_id, code,
    list_dot_product(CAST(e.embedding AS DOUBLE[]), v) - list_dot_product(v, v) / 2 AS score FROM embeddings e, p)
    SELECT vec_id, code, round(score, 5) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, code) AS place FROM s QUALIFY place <= 4""")
def nearest_k(t):
    book = [r["embedding"] for r in t("embeddings").filter("vec_id < 16").orderBy("vec_id").collect()]
    found = lookup.nearest(t("embeddings"), "embedding", book, 4).select("vec_id", F.posexplode("near").alias("at", "n"))
    return found.select("vec_id", F.col("n.code").cast("long").alias("code"), F.round("n.score", 5).alias("score"), (F.col("at") + 1).cast("long").alias("place"))


@query("pair_self_join", "SELECT a.n_regionkey, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def pair_self_join(t):
    return lookup.unordered_pairs(t("nation"), "n_regionkey", "n_nationkey")


@query("diff_join", """SELECT a.l_orderkey, a.l_linenumber, array_to_string(list_filter([CASE WHEN a.l_returnflag IS DISTINCT FROM b.l_returnflag THEN 'l_returnflag' END,
    CASE WHEN a.l_linestatus IS DISTINCT FROM b.l_linestatus THEN 'l_linestatus' END, CASE WHEN a.l_quantity IS DISTINCT FROM b.l_quantity THEN 'l_quantity' END], lambda x: x IS NOT NULL), ',') AS changed
    FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey + 1 AND b.l_linenumber = a.l_linenumber
    WHERE a.l_returnflag IS DISTINCT FROM b.l_returnflag OR a.l_linestatus IS DISTINCT FROM b.l_linestatus OR a.l_quantity IS DISTINCT FROM b.l_quantity""")
def diff_join(t):
    cols = ["l_returnflag", "l_linestatus", "l_quantity"]
    old = t("lineitem").withColumn("l_orderkey", F.col("l_orderkey") - 1)
    out = lookup.differences(old, t("lineitem"), ["l_orderkey", "l_linenumber"], cols)
    return out.select("l_orderkey", "l_linenumber", F.concat_ws(",", "changed").alias("changed"))


@query("dimension_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(t):
    dims = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("role_fallback", """WITH h AS (SELECT s_nationkey, avg(s_acctbal) AS own FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1), n AS (SELECT n_nationkey, n_regionkey, own FROM nation LEFT JOIN h ON s_nationkey = n_nationkey)
    SELECT n_nationkey, round(coalesce(own, avg(own) OVER (PARTITION BY n_regionkey), 0), 4) AS level FROM n""")
def role_fallback(t):
    own = t("supplier").filter("s_suppkey % 4 = 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.avg("s_acctbal").alias("own"))
    rows = t("nation").join(own, "n_nationkey", "left")
    around = F.avg("own").over(Window.partitionBy("n_regionkey"))
    return rows.select("n_nationkey", F.round(F.coalesce("own", around, F.lit(0.0)), 4).alias("level"))


@query("registry_join", """SELECT c.c_custkey, c.c_nationkey = f.nation AS admitted FROM customer c JOIN (SELECT c_mktsegment, arg_min(c_nationkey, c_custkey) AS nation FROM customer GROUP BY 1) f USING (c_mktsegment)""")
def registry_join(t):
    first = t("customer").groupBy("c_mktsegment").agg(F.min_by("c_nationkey", "c_custkey").alias("nation"))
    return t("customer").join(first, "c_mktsegment").select("c_custkey", (F.col("c_nationkey") == F.col("nation")).alias("admitted"))


BIG = "(SELECT * FROM orders WHERE o_totalprice > 200000)"


@query("semi_join", f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {BIG})")
def semi_join(t):
    big = t("orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("anti_join", f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM {BIG})")
def anti_join(t):
    big = t("orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(big, "c_custkey", "left_anti").select("c_custkey")


@query("outer_join", f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) FULL JOIN {BIG} o ON o_custkey = c_custkey")
def outer_join(t):
    a, b = t("customer").filter("c_acctbal > 5000"), t("orders").filter("o_totalprice > 200000")
    return a.join(b, F.col("o_custkey") == F.col("c_custkey"), "full").select("c_custkey", "o_orderkey")


# --- sets, masks, negotiation ---------------------------------------------------------------------------------------


@query("set_diff", """SELECT 'added' AS side, s_nationkey AS k FROM (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)
    UNION ALL SELECT 'removed', c_nationkey FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def set_diff(t):
    new = t("supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    old = t("customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"))
    return new.subtract(old).select(F.lit("added").alias("side"), "k").union(old.subtract(new).select(F.lit("removed").alias("side"), "k"))


@query("set_union_all", "SELECT 'c' AS side, c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY s_nationkey")
def set_union_all(t):
    a = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("c"))
    b = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("s"))
    return a.unionByName(b).select("side", "k", "n")


@query("set_intersect_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def set_intersect_all(t):
    both = t("customer").select(F.col("c_nationkey").alias("k")).intersectAll(t("supplier").select(F.col("s_nationkey").alias("k")))
    return both.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("mask_members", """SELECT event_id, array_to_string(CASE WHEN event_id % 512 = 0 THEN [0] ELSE list_filter(range(9), lambda b: (event_id % 512) >> b & 1 = 1) END, ',') AS roles FROM events""")
def mask_members(t):
    found = lookup.mask_members((F.col("event_id") % 512).cast("int"), 9)
    return t("events").select("event_id", F.concat_ws(",", found.cast("array<string>")).alias("roles"))


@query("preference_choice", """SELECT user_id, CASE WHEN bit_and(m) & 4 > 0 THEN 4 WHEN bit_and(m) & 2 > 0 THEN 2 ELSE 0 END AS algorithm FROM (SELECT user_id, event_id % 8 | (user_id % 8) AS m FROM events) GROUP BY user_id""")
def preference_choice(t):
    mask = (F.col("event_id") % 8).bitwiseOR(F.col("user_id") % 8)
    got = t("events").groupBy("user_id").agg(F.bit_and(mask).alias("m"))
    return got.select("user_id", S.preferred(F.col("m"), [(4, 4), (2, 2)], 0).alias("algorithm"))


@query("deliverable", """SELECT e.event_id FROM events e JOIN (SELECT user_id, bit_and(event_id % 8 | user_id % 8) AS caps FROM events GROUP BY user_id) c USING (user_id) WHERE e.event_id % 4 = 0 OR (caps >> (e.event_id % 3)) & 1 = 1""")
def deliverable(t):
    caps = t("events").groupBy("user_id").agg(F.bit_and((F.col("event_id") % 8).bitwiseOR(F.col("user_id") % 8)).alias("caps"))
    kept = F.expr("event_id % 4 = 0 or bit_get(caps, cast(event_id % 3 as int)) = 1")
    return t("events").join(caps, "user_id").filter(kept).select("event_id")


@query("negotiate", """WITH r AS (SELECT c_custkey, CAST(floor(c_acctbal) AS INT) % 400 AS w, CAST(c_custkey % 300 AS INT) AS h, CAST(c_custkey % 40 AS INT) AS fps FROM customer),
    s AS (SELECT c_custkey, CASE WHEN w = 0 THEN 82 ELSE greatest(1, least(w, 335)) END AS width, CASE WHEN h = 0 THEN 41 ELSE greatest(1, least(h, 255)) END AS height, CASE WHEN fps = 0 THEN 20 ELSE greatest(1, least(fps, 30)) END AS fps FROM r)
    SELECT c_custkey, width, height, fps, width * height <= 65535 AS admitted FROM s""")
def negotiate(t):
    rows = t("customer").select("c_custkey", F.expr("cast(floor(c_acctbal) as int) % 400").alias("w"), (F.col("c_custkey") % 300).cast("int").alias("h"), (F.col("c_custkey") % 40).cast("int").alias("f"))
    out = rows.select("c_custkey", S.clamp(F.col("w"), 1, 335, 82).alias("width"), S.clamp(F.col("h"), 1, 255, 41).alias("height"), S.clamp(F.col("f"), 1, 30, 20).alias("fps"))
    return out.withColumn("admitted", F.col("width") * F.col("height") <= 65535)


@query("structural_checks", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 0 THEN 'empty' WHEN l_orderkey % 41 + l_quantity > 41 THEN 'crosses row' WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 'delta first' ELSE NULL END AS fault FROM lineitem""")
def structural_checks(t):
    fault = S.first_fault([(F.col("l_quantity") <= 0, "empty"), (F.col("l_orderkey") % 41 + F.col("l_quantity") > 41, "crosses row"), ((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R"), "delta first")])
    return t("lineitem").select("l_orderkey", "l_linenumber", fault.alias("fault"))


# --- scalars ----------------------------------------------------------------------------------------------------------


@query("json_scalar", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_scalar(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("timecode", """SELECT event_id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
    ELSE CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS code FROM (SELECT event_id, CAST(event_id * 37 % 9000 AS BIGINT) AS s FROM events)""")
def timecode(t):
    return t("events").select("event_id", S.timecode(F.col("event_id") * 37 % 9000).alias("code"))


@query("parse_duration", """WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 90 AS VARCHAR) WHEN 1 THEN CAST(event_id % 90 AS VARCHAR) || 's' WHEN 2 THEN '1m' || CAST(event_id % 60 AS VARCHAR) || 's'
    WHEN 3 THEN CAST(event_id % 4 AS VARCHAR) || 'h2m' ELSE 'x' || CAST(event_id AS VARCHAR) END AS s, event_id % 5 AS k FROM events)
    SELECT event_id, nullif(CASE k WHEN 0 THEN event_id % 90 * 1000 WHEN 1 THEN event_id % 90 * 1000 WHEN 2 THEN 60000 + event_id % 60 * 1000 WHEN 3 THEN event_id % 4 * 3600000 + 120000 END, 0) AS ms FROM x""")
def parse_duration(t):
    i = F.col("event_id")
    text = (
        F.when(i % 5 == 0, (i % 90).cast("string")).when(i % 5 == 1, F.concat((i % 90).cast("string"), F.lit("s")))
        .when(i % 5 == 2, F.concat(F.lit("1m"), (i % 60).cast("string"), F.lit("s"))).when(i % 5 == 3, F.concat((i % 4).cast("string"), F.lit("h2m")))
        .otherwise(F.concat(F.lit("x"), i.cast("string")))
    )
    return t("events").select("event_id", S.parse_duration(text).alias("ms"))


@query("sanitize", r"""SELECT page_id, left(trim(regexp_replace(url, '[<>:"/\\|?*]+', '_', 'g')), 120) AS name FROM pages""")
def sanitize(t):
    return t("pages").select("page_id", S.sanitize(F.col("url")).alias("name"))


@query("printable_whole", "SELECT doc_id, regexp_replace(text, '[^\\x20-\\x7E\\xA0-\\xFF]', '?', 'g') AS shown FROM documents")
def printable_whole(t):
    return t("documents").select("doc_id", S.printable(F.col("text")).alias("shown"))


@query("first_item", "SELECT page_id, trim(split_part(url, '/', 3)) AS host FROM pages")
def first_item(t):
    return t("pages").select("page_id", F.trim(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"))


@query("downmix", """SELECT l_orderkey, CAST((sum(CAST(l_quantity AS BIGINT)) + count(*) // 2) // count(*) AS BIGINT) AS mixed FROM lineitem WHERE l_linenumber <> 4 GROUP BY l_orderkey""")
def downmix(t):
    return t("lineitem").filter("l_linenumber != 4").groupBy("l_orderkey").agg(S.rounded_mean(F.col("l_quantity").cast("long")).alias("mixed"))


@query("truncating_mean", "SELECT event_type, CAST(trunc(sum(CAST(event_id % 201 AS BIGINT) - 120) / count(*)) AS BIGINT) AS mixed FROM events GROUP BY event_type")
def truncating_mean(t):
    return t("events").groupBy("event_type").agg(S.truncated_mean(F.col("event_id") % 201 - 120).alias("mixed"))


@query("weighted_box_mean", "SELECT p_brand, CAST(round_even(sum(p_size) / count(*), 0) AS BIGINT) AS mean FROM part GROUP BY p_brand")
def weighted_box_mean(t):
    return t("part").groupBy("p_brand").agg(F.bround(F.sum("p_size") / F.count(F.lit(1))).cast("long").alias("mean"))


@query("colour_math", """WITH c AS (SELECT event_id, (event_id % 256) / 255.0::DOUBLE AS r, (event_id * 7 % 256) / 255.0::DOUBLE AS g, (event_id * 13 % 256) / 255.0::DOUBLE AS b FROM events),
    l AS (SELECT event_id, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE ((r + 0.055) / 1.055) ** 2.4 END AS r, CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE ((g + 0.055) / 1.055) ** 2.4 END AS g, CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE ((b + 0.055) / 1.055) ** 2.4 END AS b FROM c),
    m AS (SELECT event_id, cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b) AS l, cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b) AS m, cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b) AS s FROM l)
    SELECT event_id, round(0.2104542553 * l + 0.7936177850 * m - 0.0040720468 * s, 5) AS ok_l, round(1.9779984951 * l - 2.4285922050 * m + 0.4505937099 * s, 5) AS ok_a, round(0.0259040371 * l + 0.7827717662 * m - 0.8086757660 * s, 5) AS ok_b FROM m""")
def colour_math(t):
    i = F.col("event_id")
    lab = S.oklab(i % 256, i * 7 % 256, i * 13 % 256)
    return t("events").select("event_id", *[F.round(lab[k], 5).alias(f"ok_{k}") for k in ("l", "a", "b")])


@query("noise_threshold", "SELECT event_id, round(v - floor(v), 4) AS threshold FROM (SELECT event_id, 52.9829189::DOUBLE * (u - floor(u)) AS v FROM (SELECT event_id, 0.06711056::DOUBLE * (event_id % 82) + 0.00583715::DOUBLE * (event_id // 82) AS u FROM events))")
def noise_threshold(t):
    i = F.col("event_id")
    return t("events").select("event_id", F.round(S.noise(i % 82, F.floor(i / 82)), 4).alias("threshold"))


@query("byte_reader", "SELECT page_id, ascii(url) + 256 * ascii(substr(url, 2)) + 65536 * ascii(substr(url, 3)) AS value FROM pages")
def byte_reader(t):
    return t("pages").select("page_id", S.little_endian(F.col("url").cast("binary"), 0, 3).alias("value"))


@query("plane_bytes", "SELECT event_id, (event_id + 7) // 8 * 5 + 2 * ((event_id + 1) // 2) AS n FROM events")
def plane_bytes(t):
    return t("events").select("event_id", S.plane_bytes(F.col("event_id")).alias("n"))


@query("shed_stride", "SELECT event_id, CAST(greatest(1, least(24, ceil(value / 1000 * 24 * 1.15))) AS INT) AS stride FROM events")
def shed_stride(t):
    return t("events").select("event_id", S.stride(F.col("value") / 1000, 24).alias("stride"))


@query("sample_scaling", "SELECT event_id, (event_id % 256 - 128) * 256 AS pcm, event_id * 48 AS samples, least(greatest(event_id / 5000.0::DOUBLE, 0), 1) AS fraction FROM events")
def sample_scaling(t):
    i = F.col("event_id")
    return t("events").select("event_id", ((i % 256 - 128) * 256).alias("pcm"), (i * 48).alias("samples"), S.fraction(i, F.lit(5000)).alias("fraction"))


@query("trust_positive", """SELECT page_id, CASE WHEN regexp_full_match(d, '[0-9]+') AND TRY_CAST(d AS BIGINT) >= 1 THEN CAST(d AS BIGINT) END AS n FROM (SELECT page_id, regexp_extract(url, '[0-9]+$') AS d FROM pages)""")
def trust_positive(t):
    return t("pages").select("page_id", S.positive_integer(F.regexp_extract("url", "([0-9]+)$", 1)).alias("n"))


@query("palette_sample", "SELECT event_id FROM events WHERE (event_id % 82) % 3 = 0 AND (event_id // 82) % 3 = 0")
def palette_sample(t):
    i = F.col("event_id")
    return t("events").filter((i % 82 % 3 == 0) & (F.floor(i / 82) % 3 == 0)).select("event_id")


@query("cell_regroup", "SELECT event_id // 82 // 3 AS y, event_id % 82 // 2 AS x, count(*) AS n, CAST(sum((event_id % 256) >> 2) AS BIGINT) AS low FROM events GROUP BY ALL")
def cell_regroup(t):
    i = F.col("event_id")
    by = [F.floor(F.floor(i / 82) / 3).alias("y"), F.floor(i % 82 / 2).alias("x")]
    return t("events").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(i % 256, 2)).alias("low"))


@query("aspect_fit", "SELECT p_partkey, CAST(greatest(1, least(164, floor(p_size * 123 / p_retailprice))) AS INT) AS w, CAST(greatest(1, least(123, floor(p_retailprice * 164 / (p_size * 100)))) AS INT) AS h FROM part")
def aspect_fit(t):
    w = F.floor(F.col("p_size") * 123 / F.col("p_retailprice"))
    h = F.floor(F.col("p_retailprice") * 164 / (F.col("p_size") * 100))
    return t("part").select("p_partkey", F.greatest(F.lit(1), F.least(F.lit(164), w)).cast("int").alias("w"), F.greatest(F.lit(1), F.least(F.lit(123), h)).cast("int").alias("h"))


@query("first_report", "SELECT user_id, first(CASE WHEN event_id % 11 = 0 THEN NULL ELSE epoch_us(ts) / 1e6 END ORDER BY event_id) AS base FROM events GROUP BY user_id")
def first_report(t):
    value = F.when(F.col("event_id") % 11 != 0, micros() / 1e6)
    return t("events").groupBy("user_id").agg(F.min_by(F.struct(value.alias("base")), "event_id")["base"].alias("base"))
