"""Corpus pipeline: language ID, near-dedup, mixing to target weights, packing; the stages are in ``quillgraph.llm.stages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import store, table
from quillgraph.llm.stages import language_stage, mixing_stage, near_dedup_stage, packing_stage

STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express trained models and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after another over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
