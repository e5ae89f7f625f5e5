"""A training corpus from `documents`: clean, deduplicated, without benchmark texts, mixed, and written as token files.

Each stage takes what its predecessor kept.  Toxic documents go, of each group of near copies one document stays, documents
with a benchmark window go, sources are mixed so that every document comes at least once and small sources again, and the
last stage writes the token files and reports on them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import decontaminate, mixing, near_dup, token_files, toxicity
from holdfast.llm.common import table, written

ENTROPY = 0.95
REPEATS = 4.0


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_learned(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.dedup(docs, size=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.filter("size(hits) = 0").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, budget_share=None, entropy=ENTROPY, repeats=REPEATS).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix_sources", mix_stage),
    ("token_files", token_stage),
]

#: Scores, signatures and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
