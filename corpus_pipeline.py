"""The corpus pipeline: documents in, token ids of clean documents out.

Each stage reads what the one before has written; its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waypoint.llm import bpe, decontam, exact_dedup, near_dedup, quality
from waypoint.llm.common import stage, table, tokenizer

# BPE encoding cannot be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score >= 0.7); those without an id are judged alike."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, weights)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.kept_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words, similarity 0.8 or more."""
    return near_dedup.kept_rows(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item."""
    return decontam.kept_rows(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed 32-bit integers) and their digests."""
    kept = docs.select("doc_id", "lang", "source", "text")
    return bpe.tokenize(kept, *tokenizer(), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
