"""The pipeline's stages in turn, against what each should keep, and the registered queries."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from timegrid.llm import decontam, lines, omh, rules
from timegrid.llm.common import staged
from tests import oracle

from .conftest import DATA, hand_made
from .test_exact import check_packing, line_rows
from .test_similar import brute_classes


def test_stages_one_by_one(spark, docs, tables):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        out = staged(stage(spark, now, DATA), "test")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert len(after) == out.count()
        if name == "quality rules":
            kept = {r["doc_id"] for r in rules.judge(now, rules.trusted_ids(tables("labels"))).filter("kept_").collect()}
            assert set(after) == kept
            good = {r["doc_id"] for r in tables("labels").filter("quality = 1").collect()}
            long = {i for i in good if i in before and len(before[i].split()) >= 20}
            assert long <= kept
        elif name == "line dedup":
            assert after == {i: t for i, _, _, t in line_rows(list(before.items()))}
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "minhash near-dedup":
            assert set(after) == set(brute_classes(list(before.items())).values())
        else:
            bad = {r["doc_id"] for r in decontam.leaks(now, tables("benchmark")).collect()}
            assert set(after) == set(before) - bad
        assert all(before[i] == t for i, t in after.items()) or name == "line dedup"
        now = out
    check_packing(corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect(), [(r["doc_id"], r["text"]) for r in now.collect()])


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 50


def test_stages_bear_odd_rows(spark, odd_docs, no_docs):
    for df, n in ((odd_docs, len(hand_made())), (no_docs, 0)):
        now = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = staged(stage(spark, now, DATA), "odd")
            assert now.columns == df.columns and now.count() <= n
        assert corpus_pipeline.STAGES[-1][1](spark, now, DATA).count() >= now.count()


def test_single_stages_on_odd_rows(spark, odd_docs):
    assert omh.drop_near_copies(odd_docs).columns == odd_docs.columns
    assert lines.dedup_lines(odd_docs).count() == odd_docs.count()


def test_line_query_equals_sql(spark):
    oracle.compare(entry.queries()["op10_line_dedup"](spark, DATA), entry.oracle_sql()["op10_line_dedup"], oracle.connect())


@pytest.mark.parametrize("n", range(1, 11))
def test_each_operator_has_one_query(spark, n):
    names = [k for k in entry.queries() if k.startswith(f"op{n}_")]
    assert len(names) == 1
    out = entry.queries()[names[0]](spark, DATA)
    assert "doc_id" in out.columns and out.count() > 0
