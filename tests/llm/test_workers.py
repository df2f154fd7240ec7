"""All queries where workers can't import the package; columns that clash; very long texts."""

import os
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from timegrid.llm import decontam, langid, lines, omh, packing, quality, rules, sharding, suffix, windows
from timegrid.llm.queries import TOKENIZER

from .conftest import DATA, hand_made

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BARE = """
import sys
sys.path.insert(0, {root!r})
from timegrid.session import session
spark = session(**{{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": "warehouse"}})
spark.sparkContext.setLogLevel("ERROR")

def there(it):
    import importlib.util
    for batch in it:
        yield batch.assign(id=int(importlib.util.find_spec("timegrid") is not None))

assert spark.range(1).mapInPandas(there, "id long").first()[0] == 0, "workers can import the package"
import corpus_pipeline
from timegrid.llm.queries import queries
for name, query in [*queries().items(), ("pipeline", corpus_pipeline.run)]:
    print(name, query(spark, {data!r}).count(), flush=True)
"""


def test_workers_need_not_have_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONSAFEPATH": "1"}
    got = subprocess.run([sys.executable, "-c", BARE.format(root=ROOT, data=DATA)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert got.returncode == 0, got.stderr[-2000:]
    assert len(re.findall(r"^(?:op\d+_\w+|pipeline) \d+$", got.stdout, re.M)) == 11


def test_no_column_is_overwritten(spark, tables):
    names = "id_ doc_ text_ gone_ out_ kept_ id doc key row n gone kept class n_words n_lines text_crc32".split()
    rows = [(i, t, *[f"{c} {k}" for c in names]) for k, (i, t, *_) in enumerate(hand_made())]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{c} string" for c in names]]))
    given = {tuple(r) for r in rows}
    for out in (omh.drop_near_copies(docs), decontam.drop_leaks(docs, tables("benchmark")), rules.filter_quality(docs, tables("labels")), lines.dedup_lines(docs)):
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and {(r[0], *r[2:]) for r in got} <= {(r[0], *r[2:]) for r in given}
    assert {tuple(r) for r in omh.drop_near_copies(docs).collect()} <= given


def test_a_text_of_several_megabytes(spark, tables):
    r = np.random.default_rng(3)
    long = " ".join(f"w{x}" for x in r.integers(0, 50_000, 500_000)) + "\n" + "q" * 500_000
    docs = spark.createDataFrame([(1, long, "en"), (2, "a short text of several words " * 3, "en"), (3, None, None)], "doc_id long, text string, lang string")
    assert len(long) > 3_000_000
    for out in (
        sharding.shard_documents(docs, [1.0] * 3), langid.identify(docs), omh.near_copies(docs), quality.classify(docs, tables("labels")),
        rules.judge(docs, rules.trusted_ids(tables("labels"))), suffix.digests(docs), lines.line_digests(docs),
    ):
        assert {x["doc_id"] for x in out.select("doc_id").collect()} == {1, 2, 3}
    pieces = packing.pack(docs, TOKENIZER).filter("doc_id = 1").agg(F.sum("length"), F.count("*")).first()
    assert pieces[0] > 1_000_000 and pieces[1] == -(-pieces[0] // 2048)
    assert windows.near_passages(docs).count() == decontam.leaks(docs, tables("benchmark")).count() == 0


def test_runs_of_lines_are_met_without_a_shuffle(spark):
    index = lines.LineIndex(spark)
    keys = spark.range(100).select(F.col("id").alias("doc"), F.col("id").cast("string").cast("binary").alias("key"))
    for _ in range(2):
        index.add(keys)
    plan = index.joined(keys)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and plan.count("Bucketed: true") == 2
    index.close()


@pytest.mark.parametrize("text", ["½ ² ¾", "Ⅷ ⅓ ①", "12 34", "_ - !", " ", ""])
def test_texts_without_a_letter(spark, docs, text):
    langs, table = langid.learn(docs)
    got = langid.predict(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), langs, table).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2


def test_learned_languages_are_bounded(spark):
    rows = [(i, "some words here", f"stray{i}") for i in range(40)] + [(100 + i, "other words there", "en") for i in range(5)]
    langs, table = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3)
    assert langs == ["en", "stray0", "stray1"] and table.shape == (3, 1 << langid.BITS)
