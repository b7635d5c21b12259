"""Result-table reshaping for reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_true
from .ordered import count_if


def wide_intervals(intervals: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """One row per policy with mean and bounds of each metric side by side."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    return intervals.groupBy(*by).agg(*[pick(m, c) for m in metrics for c in ("mean", "lower", "upper")])


def component_effects(contrasts: DataFrame, components: dict[str, tuple[str, bool]]) -> DataFrame:
    """Named contrasts; a flipped one changes sign and swaps its bounds."""
    out = None
    for name, (comparison, flip) in components.items():
        c = contrasts.where(F.col("comparison") == comparison)
        lo, hi = (-F.col("upper"), -F.col("lower")) if flip else (F.col("lower"), F.col("upper"))
        part = c.select(F.lit(name).alias("component"), "comparison", (-F.col("estimate") if flip else F.col("estimate")).alias("estimate"), lo.alias("lower"), hi.alias("upper"))
        out = part if out is None else out.unionByName(part)
    return out


def split_gap_summary(df: DataFrame, group: str, value: Column, seeds: list[str], train: float = 0.7) -> DataFrame:
    """Test minus train mean under several group-disjoint hash splits, summarised over splits."""
    per = df.select(group, value.alias("x")).groupBy(group).agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    rows = per.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    u = F.conv(F.substring(F.sha2(F.concat("seed", F.col(group).cast("string")), 256), 1, 12), 16, 10).cast("bigint") / F.lit(float(16**12))
    tr = u < train
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("x"))), F.sum(F.when(c, F.col("n"))).cast("double"))
    gap = rows.groupBy("seed").agg((mean(~tr) - mean(tr)).alias("gap"))
    return gap.agg(F.count("*").alias("splits"), F.percentile("gap", F.lit(0.5)).alias("gap_median"), F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"), count_if(F.col("gap") > 0).alias("positive_splits"))


def same_table(new: DataFrame, old: DataFrame, keys: list[str], values: list[str], rtol: float = 1e-9) -> DataFrame:
    """Key-by-key comparison of two result tables."""
    a = new.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(True).alias("_in_a"))
    b = old.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(True).alias("_in_b"))
    j = a.join(b, keys, "full")
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    differ = F.lit(False)
    for v in values:
        x, y = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        differ = differ | (x.isNull() != y.isNull()) | is_true(F.abs(x - y) > rtol * F.greatest(F.abs(x), F.abs(y)))
    return j.agg(F.count("*").alias("n_rows"), count_if(~both).alias("only_in_one"), count_if(both & differ).alias("different"))
