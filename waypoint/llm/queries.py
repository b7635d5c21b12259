"""The registered queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, chat, decontam, exact_dedup, fingerprints, near_dedup, pii, quality, search, secrets, shards, trie, twins, url_filter
from .common import table, tokenizer

SHARDS = 8


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.tokenize(docs, *tokenizer(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return rows.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("key").alias("doc_id"), "item_id", F.round("score", 6).alias("score"), "end_word")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return rows.select(F.col("key").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_filter.judge(table(spark, sf_dir, "pages"))
    return rows.select(F.col("key").alias("page_id"), "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=4, percent=80)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_url_filter": op7_url_filter,
    "op8_pii": op8_pii,
    "op9_near_dedup": op9_near_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_fingerprints": op12_fingerprints,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": corpus_pipeline.run,
}
#: Fitted models, merges and alignment cannot be said in SQL; tests hold those queries against plain versions.
SQL: dict[str, str] = {
    "op3_sharding": twins.OP3,
    "op5_exact_dedup": twins.OP5,
    "op6_chat_format": twins.OP6,
    "op9_near_dedup": twins.OP9,
    "op11_conversation_trie": twins.OP11,
    "op13_lexical_search": twins.OP13,
}
