"""The corpus operators as registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timegrid.llm import decontam, langid, lines, omh, packing, quality, rules, sharding, suffix, windows
from timegrid.llm.common import table

SHARDS = 40
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_copies(table(spark, sf_dir, "documents"))


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.near_passages(table(spark, sf_dir, "documents"))


def op6_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), rules.trusted_ids(table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


ORACLE = {
    "op10_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
        owners AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key),
        marked AS (SELECT l.*, coalesce(owner <> doc_id, false) AS gone FROM l LEFT JOIN owners USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
