"""Corpus pipeline: stages over ``documents``, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalframe.llm import bpe_tree, language_id, mixing, near_dedup, pii_surrogates
from vitalframe.llm.common import keep, read_table

STAGES = [
    ("language_id", language_id.keep_identified),
    ("near_dedup", near_dedup.keep_one),
    ("pii", pii_surrogates.replaced),
    ("mixing", mixing.mixed),
    ("bpe", bpe_tree.encoded),
]

#: Language labelling, hashing and tokenizing are beyond SQL; tests/llm compares with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
