"""What Catalyst makes of the queries: filters and columns reach the scan, joins are equi-joins, no row-at-a-time Python."""

import re

import pytest

from tests.oracle import DATA
from timegrid.plans import QUERIES

#: Queries that cross a table with one row of totals, or a handful of rows.
TOTALS = {"priority_lookup"}
PYTHON = {n for n in QUERIES if n.startswith(("codec", "stream", "pacer", "chunk_scan", "adaptive"))} | {"gop_segment"}
#: Codecs and streams of plans/media.py.
PYTHON |= {"audio_roles", "cells_shown", "chunk_headers", "chunk_resync", "coded_peek", "control_frames", "fan_out", "gop_coded", "gop_raw", "gop_spans", "index_probe", "nibble_pack", "onebit_tone"}


def plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "range_pushdown")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", text)
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>", text)
    text = plan(spark, "quantiles")
    assert "ReadSchema: struct<event_type:string,value:double>" in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON))
def test_plans_stay_in_the_jvm_and_make_no_pairs(spark, name):
    text = plan(spark, name)
    assert not re.search("Python|Pandas|Arrow", text)
    assert "CartesianProduct" not in text
    # a nested loop joins a broadcast table of totals only
    if name not in TOTALS:
        assert len(re.findall("BroadcastNestedLoopJoin", text)) <= len(re.findall(r"BroadcastExchange IdentityBroadcastMode", text))


@pytest.mark.parametrize("name", ["moments_hist", "entropy_order0", "bitmask_union_intersect", "cube_counts", "unit_counts"])
def test_aggregates_add_up_before_the_shuffle(spark, name):
    assert "partial_" in plan(spark, name)
