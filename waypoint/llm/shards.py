"""Sharding by weighted rendezvous hashing, in DataFrame operations only.

Every shard draws a number for every key, -weight / ln(u) with u a hash of
(key, shard) in (0, 1); the highest draw wins. A draw depends on nothing but
key, shard and weight, so a new shard takes rows only into itself and a
removed one gives up only its own.

Defined cases: a null key hashes as the text "null" and so has a home of its
own; a null text has size 1 and checksum 0; repeated rows get the same shard
and different slots; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

BUCKETS = 4096  # 16^3
BLOCK = 65536


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The shard's number for the key; 52 hash bits, never 0 or 1."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return F.lit(-float(weight)) / F.ln((bits + 0.5) / float(1 << 52))


def home(key: Column, weights: list[float]) -> Column:
    """Index of the shard with the highest draw; the lower index wins a tie."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive and at least one")
    draws = F.array(*[draw(key, i, w) for i, w in enumerate(weights)])
    return (F.array_position(draws, F.array_max(draws)) - 1).cast("int")


def number_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Adds ``slot``: gapless from 0 within each shard, in the order of a hash of the first column.

    Equal rows are counted first. The first three digits of the hash cut each
    shard into BUCKETS buckets; a table of one count per (shard, bucket), of
    fixed size, gives the bucket's first slot, and rows are numbered within
    buckets only. Repeated rows come back from their counts in blocks, dealt
    over all tasks.
    """
    keys = [shard, *order]
    mark = F.md5(F.concat(F.coalesce(F.col(order[0]).cast("string"), F.lit("null")), F.lit(":slot")))
    counted = stage(rows.groupBy(*keys).agg(F.count("*").alias("_count")).withColumn("_mark", mark).withColumn("_bucket", F.conv(F.substring("_mark", 1, 3), 16, 10).cast("int")), "slots")
    sizes = counted.groupBy(shard, "_bucket").agg(F.sum("_count").alias("_size"))
    before = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(shard, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(shard, "_bucket").orderBy("_mark", *[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_count").over(inside), F.lit(0))).join(F.broadcast(starts), [shard, "_bucket"])
    first = placed.select(*keys, (F.col("_start") + F.col("_before")).alias("_first"), "_count")
    single = first.where("_count = 1").select(*keys, F.col("_first").alias("slot"))
    many = first.where("_count > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1, F.lit(BLOCK).cast("long"))).alias("_block"))
    many = many.repartition(*[F.col(c) for c in order], F.col("_block"))
    last = F.least(F.col("_block") + (BLOCK - 1), F.col("_count") - 1)
    spread = many.select(*keys, "_first", F.explode(F.sequence(F.col("_block"), last)).alias("_i"))
    return single.unionByName(spread.select(*keys, (F.col("_first") + F.col("_i")).alias("slot")))


def shard_documents(docs: DataFrame, weights: list[float], new_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, shard, slot, grown_shard (with one more shard of ``new_weight``)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    placed = rows.withColumn("shard", home(F.col("key"), weights)).withColumn("grown_shard", home(F.col("key"), [*weights, new_weight]))
    return number_slots(placed, "shard", ["key", "size", "text_crc32", "grown_shard"])
