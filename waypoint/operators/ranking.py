"""Rank-based columns and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import prefix


def rank_quartile(df: DataFrame, value: str, unique: str, name: str = "quartile") -> DataFrame:
    """Quartile by rank with ties broken by ``unique``; missing values stay MISSING."""
    placed = prefix(df.where(F.col(value).isNotNull()), [F.col(value), F.col(unique)])
    n = placed.agg(F.max("rank")).scalar()
    cut = F.greatest(F.lit(1), F.ceil(F.lit(4) * (F.col("rank") - 1) / (n - 1)))
    label = F.when(cut <= 1, "Q1_LOWEST").when(cut == 2, "Q2").when(cut == 3, "Q3").otherwise("Q4_HIGHEST")
    placed = placed.withColumn(name, label).drop("rank")
    missing = df.where(F.col(value).isNull()).withColumn(name, F.lit("MISSING"))
    return placed.unionByName(missing)


def best_row(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each group; the limit of one row is applied before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
