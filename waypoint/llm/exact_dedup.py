"""Exact dedup by progressive refinement, in DataFrame operations only.

Rows are grouped by length, then by a hash of the first characters, and only
the rows of groups that still have company get a hash of the whole text. The
surviving groups are kept as a bitmap of fixed size, so the second pass over
the texts is a broadcast lookup and moves no text; neither does the settling of
rows that share a key.

Defined cases: a null text counts as empty; a null key loses ties against any
key; of equal texts that also share the key all rows carry ``kept``, and
``kept_rows`` leaves one of them; an empty table gives an empty result;
further columns of the input are ignored by ``exact_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bitmap, drop_keys, mark_maybe, stage

#: The characters [\\x20\\x09-\\x0D] that do not count.
BLANKS = " \t\n\x0b\x0c\r"
PREFIX = 64


def normal_text(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def refine(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """One narrow row per document: key, n (code points), length, prefix, digest.

    ``digest`` is null where length or prefix already tell the text apart from
    all others, unless ``digest_all`` asks for it everywhere.
    """
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_norm", normal_text(F.col("_text")))
    coarse = texts.select(F.length("_norm").alias("_length"), F.xxhash64(F.substring("_norm", 1, PREFIX)).alias("_prefix"))
    # lengths and prefix hashes are counted together: both are read from the text in the same pass
    company = coarse.groupBy("_length", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1")
    words = stage(bitmap(company, ["_length", "_prefix"]), "company")
    rows = texts.withColumn("_length", F.length("_norm")).withColumn("_prefix", F.xxhash64(F.substring("_norm", 1, PREFIX)))
    rows = mark_maybe(rows, ["_length", "_prefix"], words, "_company")
    full = F.sha2(F.col("_norm"), 256)
    return rows.select(
        F.col("_key").alias("key"),
        F.length("_text").alias("n"),
        F.col("_length").alias("length"),
        F.col("_prefix").alias("prefix"),
        (full if digest_all else F.when(F.col("_company"), full)).alias("digest"),
        F.col("_company").alias("company"),
    )


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """Per document: key, keep, group_size, kept, digest.

    ``keep`` is the key of the row with the most code points, then the smallest
    key. Groups are reduced before the shuffle, so a group with a third of all
    rows costs one row per task; only rows of groups above one are joined back.
    """
    rows = stage(refine(docs, key, text, digest_all), "digests")
    groups = (
        rows.where("company")
        .groupBy("length", "prefix", "digest")
        .agg(F.count("*").alias("group_size"), F.max("n").alias("n"))
        .where("group_size > 1")
    )
    # smallest key among the longest: a second small aggregate keeps both hashed
    longest = rows.where("company").groupBy("length", "prefix", "digest", "n").agg(F.min("key").alias("keep"))
    chosen = groups.join(longest, ["length", "prefix", "digest", "n"]).select("length", "prefix", "digest", "group_size", "keep")
    joined = rows.where("company").join(chosen, ["length", "prefix", "digest"], "left")
    alone = rows.where("not company").withColumn("group_size", F.lit(None).cast("long")).withColumn("keep", F.col("key"))
    out = joined.select("key", "digest", "group_size", "keep").unionByName(alone.select("key", "digest", "group_size", "keep"))
    return out.select(
        "key",
        F.when(F.col("group_size").isNull(), F.col("key")).otherwise(F.col("keep")).alias("keep"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("key").eqNullSafe(F.col("keep"))).alias("kept"),
        "digest",
    )


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, all columns; one row of every group of equal texts."""
    decided = stage(exact_groups(docs, key, text), "exact")
    dropped = decided.where("not kept").select(F.col("key").alias(key)).where(F.col(key).isNotNull())
    # a key that is kept for one text and dropped for another, or kept twice, is settled on its rows; texts without a copy count too
    counted = decided.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.col("kept").cast("long")).alias("stays"), F.max("group_size").alias("most"))
    unclear = counted.where("most > 1 and (rows > 1 and stays > 0 or key is null)")
    unclear = stage(unclear.select(F.col("key").alias(key)), "unclear")
    if unclear.isEmpty():
        return drop_keys(docs, key, dropped)
    return settle(docs, key, text)


def settle(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same decision for tables with repeated or missing keys: rows get numbers and are judged by these.

    Digests and numbers are shuffled, texts are not. Of rows equal in text, key
    and length the one with the smallest number stays.
    """
    columns, row = docs.columns, "_waypoint_row"
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    place = F.struct((-F.length(F.coalesce(F.col(text), F.lit("")))).alias("n"), F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row"))
    narrow = stage(rows.select(F.sha2(normal_text(F.col(text)), 256).alias("_waypoint_digest"), place.alias("_waypoint_place")), "numbered-digests")
    best = narrow.groupBy("_waypoint_digest").agg(F.min("_waypoint_place").alias("_waypoint_best"), F.count("*").alias("_waypoint_size"))
    groups = stage(best.where("_waypoint_size > 1"), "numbered-groups")
    again = attach(narrow, groups, ["_waypoint_digest"], "_waypoint_size").where("_waypoint_place > _waypoint_best")
    return drop_keys(rows, row, stage(again.select(F.col("_waypoint_place.row").alias(row)), "numbered-dropped")).select(*columns)
