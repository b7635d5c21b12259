"""Join helpers around plain equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join bringing only the columns the left side lacks; of several right rows the smallest one."""
    new = [c for c in right.columns if c not in left.columns]
    one = right.groupBy(*keys).agg(F.min(F.struct(*new)).alias("_one")) if new else right.select(*keys).distinct()
    return left.join(one, keys, "left").select(*left.columns, *[F.col("_one")[c].alias(c) for c in new])


def duplicate_equivalence(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows and distinct values per column for every key.

    Values are made distinct per (key, column) before they are counted, so a hot
    key is reduced on the map side.
    """
    long = df.groupBy(key, *columns).agg(F.count("*").alias("_n"))
    rows = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v")) for c in columns])
    values = long.select(key, F.inline(rows)).where(F.col("_v").isNotNull()).distinct()
    wide = values.groupBy(key).agg(*[F.sum((F.col("_c") == c).cast("bigint")).alias(f"d_{c}") for c in columns])
    return long.groupBy(key).agg(F.sum("_n").alias("n_rows")).join(wide, key, "left")
