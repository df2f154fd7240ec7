"""Every registered query runs; those with SQL give DuckDB's rows."""

import datetime
import os
import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from tests import oracle
from timegrid.plans import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    oracle.compare(QUERIES[name](spark, oracle.DATA), ORACLE[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_gives_rows(spark, name):
    assert QUERIES[name](spark, oracle.DATA).count() > 0


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["event_id", "user_id", "signup_id"]


def test_whole_texts_are_shown(spark):
    got = {r["doc_id"]: r["shown"] for r in QUERIES["printable_whole"](spark, oracle.DATA).collect()}
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect()}
    assert all(len(got[i]) == len(t) for i, t in given.items() if t) and max(map(len, filter(None, got.values()))) > 200


def test_a_first_report_without_a_time_stays_null(spark):
    events = spark.read.parquet(f"{oracle.DATA}/events.parquet").select("user_id", "event_id").collect()
    first = {}
    for r in events:
        first[r["user_id"]] = min(r["event_id"], first.get(r["user_id"], r["event_id"]))
    got = {r["user_id"]: r["base"] for r in QUERIES["first_report"](spark, oracle.DATA).collect()}
    assert {u for u, base in got.items() if base is None} == {u for u, i in first.items() if i % 11 == 0} != set()


def test_every_frame_is_replayed(spark):
    events = spark.read.parquet(f"{oracle.DATA}/events.parquet")
    frames = {r["frame"] for r in QUERIES["delta_replay_whole"](spark, oracle.DATA).select("frame").distinct().collect()}
    assert frames == {r["event_id"] for r in events.filter("event_type = 'signup'").collect()}


def moments(spark, folder, *times):
    """An events table of one user and type with these times; and DuckDB with that table."""
    rows = [(i, datetime.datetime.fromisoformat(t) if t else None, 1, "view") for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return con


def test_range_frame_rounds_to_the_nearest_second(spark, tmp_path):
    # a day less 0.3 s, a day and 0.2 s, and a day and 0.7 s apart; halves; no time
    con = moments(spark, tmp_path, "2024-01-01 00:00:00.600", "2024-01-02 00:00:00.300", "2024-01-02 00:00:00.800", "2024-01-02 00:00:01.300", "2024-01-03 00:00:02.500", "2024-01-04 00:00:03.500", None)
    oracle.compare(QUERIES["range_frame"](spark, str(tmp_path)), ORACLE["range_frame"], con)


def test_sliding_windows_round_to_the_nearest_second(spark, tmp_path):
    # just before and at a window's start, halves at its start, before 1970, no time
    con = moments(spark, tmp_path, "2024-01-01 11:59:59.700", "2024-01-01 12:00:00", "2024-01-01 23:59:59.400", "2024-01-01 23:59:59.500", "2024-01-02 11:59:58.500", "1969-12-31 23:00:00", None)
    oracle.compare(QUERIES["sliding_batch"](spark, str(tmp_path)), ORACLE["sliding_batch"], con)


def test_listed_files_are_tables(spark, con, tmp_path):
    # tables as files and as folders of files, below a folder whose own name holds that of the table left out
    folder = tmp_path / "pages.parquet" / "x"
    folder.mkdir(parents=True)
    for i, name in enumerate(sorted(os.listdir(oracle.DATA))):
        if i % 2:
            shutil.copy(f"{oracle.DATA}/{name}", folder / name)
        else:
            (folder / name).mkdir()
            for k in range(2):
                shutil.copy(f"{oracle.DATA}/{name}", folder / name / f"part-{k}.parquet")
    for path in (str(folder), f"{folder}/", f"file://{folder}", f"file:{folder}"):
        oracle.compare(QUERIES["listed_files"](spark, path), ORACLE["listed_files"], con)
