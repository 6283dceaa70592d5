"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, source mix, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.bpe import bpe_stage
from palimpsest.llm.minhash import one_of_each
from palimpsest.llm.mixing import mixing_stage
from palimpsest.llm.rules import rules_stage
from palimpsest.llm.store import written
from palimpsest.llm.suffix import without_repeats

STAGES = [
    ("quality rules", rules_stage),
    ("near duplicates", one_of_each),
    ("repeated passages", without_repeats),
    ("source mix", mixing_stage),
    ("token ids", bpe_stage),
]
# MinHash, maximal repeats and BPE can't be put in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, tokens, round_trip) of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
