"""Helpers of this subpackage: shared staging, fixed-size bitmaps, row filters."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return _local.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="waypoint-llm-"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write rows once to the shared folder and read them back: cuts the lineage.

    The files outlive lost executors and go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rank file of the default tokenizer.
TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also when the body is a loop."""
    return F.transform(F.array(value), body)[0]


_kept: list[dict] = []


def kept_table() -> dict:
    """A dict that a Python worker keeps from task to task; see ``hold``."""
    table: dict = {}
    _kept.append(table)
    return table


def hold(table: dict) -> None:
    """Empties all kept tables but this one: a worker holds the tables of one operator at a time."""
    for other in _kept:
        if other is not table:
            other.clear()
    pa.default_memory_pool().release_unused()


def columns_of(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a result of fixed size on the driver, through Arrow and without pandas."""
    found = df.toArrow()
    return {name: found[name].to_numpy() for name in found.column_names}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, so that long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


# A bitmap over hashed keys: 2^bits bits as rows (word, mask), so at most
# 2^(bits-6) rows whatever the number of keys. It tells "surely absent" from
# "maybe present"; an exact join follows for the rest. Where rows are dropped, its
# size follows the counted keys, eight bits a key, between 2^BITS and 2^MOST_BITS bits (two
# million rows of 12 bytes); with far more keys than that the exact join does
# all the work.

BITS, MOST_BITS = 23, 27


def bits_for(keys: DataFrame) -> int:
    """Size of the bitmap of a written table of keys."""
    return min(MOST_BITS, max(BITS, (8 * keys.count()).bit_length()))


def _slot(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits))


def bitmap(df: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """(word, mask) rows of the keys' hashes; equal hashes are merged before the shuffle."""
    slots = df.select(_slot([F.col(k) for k in keys], bits).alias("slot"))
    marks = slots.select(F.shiftright("slot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    return marks.groupBy("word").agg(F.bit_or("bit").alias("mask"))


#: Working columns of the lookup; no input should use these names.
SLOT, WORD, MASK, MAYBE = "_waypoint_slot", "_waypoint_word", "_waypoint_mask", "_waypoint_maybe"


def mark_maybe(df: DataFrame, keys: list[str], words: DataFrame, name: str = MAYBE, bits: int = BITS) -> DataFrame:
    """Adds the boolean column ``name``: false where the key is surely not in the bitmap."""
    marked = df.withColumn(SLOT, _slot([F.col(k) for k in keys], bits)).withColumn(WORD, F.shiftright(SLOT, 6).cast("int"))
    # at most 2^(bits-6) rows of 12 bytes, so the broadcast has a fixed bound
    joined = marked.join(F.broadcast(words.select(F.col("word").alias(WORD), F.col("mask").alias(MASK))), WORD, "left")
    hit = F.expr(f"coalesce({MASK}, 0L) & shiftleft(1L, cast({SLOT} % 64 as int))") != 0
    return joined.withColumn(name, hit).drop(SLOT, WORD, MASK)


def drop_keys(df: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not among ``dropped`` (null keys stay).

    Rows that the bitmap clears never move; only the others are shuffled for
    the exact anti-join.
    """
    keys = stage(dropped.select(key).distinct(), "dropped-keys")
    bits = bits_for(keys)
    marked = mark_maybe(df, [key], stage(bitmap(keys, [key], bits), "dropped-bits"), bits=bits)
    clear = marked.where(~F.col(MAYBE)).select(*df.columns)
    rest = marked.where(F.col(MAYBE)).select(*df.columns).join(keys, key, "left_anti")
    return clear.unionByName(rest.select(*df.columns))


def keep_keys(df: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is among ``kept``; rows that the bitmap clears are not moved."""
    marked = mark_maybe(df, [key], stage(bitmap(kept, [key]), "kept-bits"))
    return marked.where(F.col(MAYBE)).select(*df.columns).join(kept.select(key).distinct(), key, "left_semi").select(*df.columns)


#: Keys that ``attach`` may broadcast, at most.
HOT_KEYS = 10_000
#: Rows that a key must have, at least, to be met by broadcast.
HOT_ROWS = 100_000


def attach(rows: DataFrame, known: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined to ``known``, one row per key, whose ``weight`` is the key's number of ``rows``.

    Keys above a HOT_KEYS-th of all rows are looked up by broadcast, so at most
    HOT_KEYS rows are; the other keys are joined by a shuffle. ``weight`` is dropped.
    """
    total = known.agg(F.sum(weight)).first()[0] or 0
    bound = max(HOT_ROWS, total // HOT_KEYS)
    if known.where(F.col(weight) > bound).isEmpty():
        return rows.join(known.drop(weight), keys)
    hot = F.broadcast(known.where(F.col(weight) > bound).drop(weight))
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(known.where(F.col(weight) <= bound).drop(weight), keys))
