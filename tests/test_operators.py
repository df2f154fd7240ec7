"""Operators on small hand-made inputs: ties, nulls, empty tables, plans."""

import random

from pyspark.sql import functions as F

from timegrid.operators import aggregates, asof, intervals, lookup, ordered
from timegrid.plans import QUERIES


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_asof_ties_and_misses(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 1), (4, None, 7)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 9, 3), ("b", 2, 4)], "k string, u int, v int")
    for width in (None, 4):
        got = asof.asof_join(left, right, "k", "t", "u", ["v"], tie="v", width=width)
        assert rows(got.select("id", "v")) == [(1, 2), (2, 3), (3, None), (4, None)]
    strict = asof.asof_join(left, right, "k", "t", "u", ["v"], tie="v", strict=True)
    assert rows(strict.select("id", "v")) == [(1, None), (2, 3), (3, None), (4, None)]
    for width in (None, 4):
        ahead = asof.asof_join(left, right, "k", "t", "u", ["v"], tie="v", forward=True, width=width)
        assert rows(ahead.select("id", "v")) == [(1, 1), (2, None), (3, 4), (4, None)]
    first = asof.asof_or_first(left, right, "k", "t", "u", ["v"], tie="v")
    assert rows(first.select("id", "v")) == [(1, 2), (2, 3), (3, 4), (4, None)]


def test_asof_plans_no_pairs(spark):
    left = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("t"))
    right = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("u"), F.col("id").alias("v"))
    plan = asof.asof_join(left, right, "k", "t", "u", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interval_join_is_an_equi_join(spark):
    points = spark.createDataFrame([("a", 0), ("a", 9), ("a", 10), ("b", 3)], "k string, t long")
    spans = spark.createDataFrame([("a", 0, 10, 1), ("a", 9, 30, 2), ("b", 4, 4, 3), (None, 0, 9, 4)], "k string, s long, e long, n int")
    got = intervals.interval_join(points, spans, "k", "t", "s", "e", 7)
    assert rows(got.select("t", "n")) == [(0, 1), (10, 2), (9, 1), (9, 2)]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_frame_at_clamps(spark):
    frames = spark.createDataFrame([("a", 1, 10), ("a", 2, 5), ("a", 3, 20)], "k string, n int, d long")
    asked = spark.createDataFrame([("a", -1), ("a", 0), ("a", 10), ("a", 14), ("a", 99)], "k string, o long")
    got = intervals.frame_at(frames, "k", "n", "d", asked, "o")
    assert rows(got.select("o", "n")) == [(-1, 1), (0, 1), (10, 2), (14, 2), (99, 3)]


def test_runs_keep_nulls_apart(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x")], "k string, i int, v string")
    got = ordered.runs(df, "k", "i", "v")
    assert rows(got.select("run", "v", "first", "length")) == [(1, "x", 1, 2), (2, None, 3, 2), (3, "x", 5, 1)]


def test_segment_resets_on_either_limit(spark):
    df = spark.createDataFrame([("a", i, 1, s) for i, s in enumerate([5, 5, 5, 50, 1, 1, 1, 1])], "k string, i int, n long, s long")
    got = ordered.segment(df, "k", "i", "n", "s", 3, 12)
    assert rows(got.select("i", "segment")) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 3), (6, 3), (7, 4)]


def test_exact_shares_with_surplus_and_debt(spark):
    counts = {"many": [1] * 3 + [1000] * 2, "debt": [100000] + [1] * 60, "one": [7]}
    df = spark.createDataFrame([(k, i, c) for k, cs in counts.items() for i, c in enumerate(cs)], "k string, s int, c long")
    got = aggregates.exact_shares(df, "k", "s", "c", 64)
    assert rows(got.groupBy("k").agg(F.sum("share").cast("int"), F.min("share").cast("int"))) == [("debt", 64, 1), ("many", 64, 1), ("one", 64, 64)]
    big = {r["s"]: r["share"] for r in got.filter("k = 'debt'").collect()}
    assert big[0] == 4


def test_box_sum_equals_direct_sum(spark):
    df = spark.range(500).select((F.col("id") % 7).cast("int").alias("x"), (F.col("id") % 11).cast("int").alias("y"), F.col("id").alias("v"))
    boxes = spark.createDataFrame([(1, 0, 0, 6, 10), (2, 2, 3, 4, 5), (3, 6, 10, 6, 10)], "box int, x0 int, y0 int, x1 int, y1 int")
    got = dict(rows(aggregates.box_sum(aggregates.integral(df, "x", "y", "v"), "x", "y", boxes)))
    for box, x0, y0, x1, y1 in rows(boxes):
        want = df.filter(f"x between {x0} and {x1} and y between {y0} and {y1}").agg(F.sum("v")).first()[0]
        assert got[box] == want


def test_mask_summary_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 3), ("b", 5)], "k string, m long")
    assert rows(aggregates.mask_summary(df, "k", F.col("m"))) == [("a", None, 1, False), ("b", 7, 1, True)]


def test_nearest_ties_to_the_lower_number(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id int, v array<float>")
    got = lookup.nearest(df, "v", [[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]], 2).first()["near"]
    assert [(n["code"], n["score"]) for n in got] == [(1, 0.5), (2, 0.5)]


def test_align_falls_back(spark):
    near = spark.createDataFrame([("a", 10.0), ("b", 12.5)], "s string, t double")
    assert rows(lookup.align(near, "s", F.col("t"), 30).select("s", "offset")) == [("a", 0.0), ("b", 2.5)]
    for other in (("b", 99.0), ("b", None)):
        far = spark.createDataFrame([("a", 10.0), other], "s string, t double")
        assert rows(lookup.align(far, "s", F.col("t"), 30).select("s", "offset")) == [("a", 0.0), ("b", 0.0)]


def test_empty_tables(spark):
    events = spark.createDataFrame([], "k string, i int, v string")
    assert ordered.runs(events, "k", "i", "v").count() == 0
    assert aggregates.entropy(events, "k", "v").count() == 0
    assert asof.asof_join(events, events.select("k", F.col("i").alias("u"), F.col("v").alias("w")), "k", "i", "u", ["w"]).count() == 0


def test_replay_gives_each_cell_at_each_frame(spark):
    rng = random.Random(5)
    writes = [(rng.randrange(3), rng.randrange(4), at, float(at) if at % 7 else None) for at in rng.sample(range(400), 300)] + [(0, 9, None, 1.0), (None, 1, 5, 1.0)]
    frames = [(g, t) for g in (0, 1, 3, None) for t in rng.sample(range(-5, 405), 60)] + [(0, None), (1, 50), (1, 50)]
    want = set()
    for g, t in frames:
        for cell in {c for k, c, _, _ in writes if k == g and g is not None}:
            before = [(at, v) for k, c, at, v in writes if (k, c) == (g, cell) and at is not None and t is not None and at <= t]
            want.add((g, t, cell, max(before)[1] if before else None))
    for block in (1, 7, 1024):
        got = asof.replay(spark.createDataFrame(frames, "g int, t int"), spark.createDataFrame(writes, "g int, c int, at int, v double"), "g", "t", "c", "at", ["v"], block)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_replay_shuffles_no_pairs(spark, tmp_path):
    spark.range(6000).selectExpr("id event_id", "id % 500 * 8 user_id", "if(id % 2 = 0, 'signup', 'view') event_type", "double(id) value").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["delta_replay_whole"](spark, str(tmp_path))
    assert out.count() == 3000 * 500
    # frames times cells are made above the last shuffle
    text = out._jdf.queryExecution().executedPlan().toString()
    assert 0 <= text.find("explode(slice(") < text.index("Exchange")
