"""Leakage-safe train / calibration / test assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_unit, is_true
from .ordered import count_if, hash_ranks, percentiles, prefix

PARTS = ("train", "calibration", "test")


def case_table(episodes: DataFrame, case: str, time: str, stratum: str) -> DataFrame:
    """One row per case; ``n_strata`` above 1 marks a case whose stratum is not constant."""
    s = F.col(stratum)
    differs = is_true(F.min(s) != F.max(s)) | ((F.count(s) > 0) & (F.count(s) < F.count("*")))
    return episodes.groupBy(case).agg(
        F.min(time).alias("decision_time"), F.min(s).alias(stratum), F.when(differs, 2).otherwise(1).alias("n_strata"))


def by_rank(rank: Column, n: Column, train: float, calibration: float) -> Column:
    return (
        F.when(rank <= F.floor(n * F.lit(train)), PARTS[0])
        .when(rank <= F.floor(n * F.lit(train + calibration)), PARTS[1])
        .otherwise(PARTS[2])
    )


def random_split(cases: DataFrame, case: str, seed: str, train: float = 0.7, calibration: float = 0.15, name: str = "split") -> DataFrame:
    """Exact share of cases per part in seeded hash order."""
    n = cases.agg(F.count("*")).scalar()
    ranked = hash_ranks(cases, F.sha2(F.concat(F.lit(seed), F.col(case).cast("string")), 256), case)
    return ranked.withColumn(name, by_rank(F.col("rank"), n, train, calibration)).drop("rank")


def temporal_split(cases: DataFrame, case: str, time: str, train: float = 0.7, calibration: float = 0.15, name: str = "split") -> DataFrame:
    n = cases.agg(F.count("*")).scalar()
    ranked = prefix(cases, [F.col(time).asc_nulls_last(), F.col(case)])
    return ranked.withColumn(name, by_rank(F.col("rank"), n, train, calibration)).drop("rank")


def hash_split(key: Column, seed: str, train: float = 0.7, calibration: float = 0.15) -> Column:
    """Threshold on a uniform hash of the group key, so no group crosses parts."""
    u = hash_unit(key, seed)
    return F.when(u < train, PARTS[0]).when(u < train + calibration, PARTS[1]).otherwise(PARTS[2])


def exposure_split(df: DataFrame, value: str, base: Column, cut: float = 0.99) -> Column:
    """The top of the exposure range is held out; the rest keeps its split."""
    top = percentiles(df, F.abs(value), {"cut": cut}).scalar()
    return F.when(F.abs(value) > top, "ood_test").when(base == "test", "id_test").otherwise(base)


def split_map(episodes: DataFrame, case: str, columns: list[str]) -> DataFrame:
    """Collapse variants to one row per case, counting disagreeing assignments."""
    aggs = []
    for c in columns:
        x = F.col(c)
        bad = is_true(F.min(x) != F.max(x)) | ((F.count(x) > 0) & (F.count(x) < F.count("*")))
        aggs += [F.min(x).alias(c), bad.cast("int").alias(f"_bad_{c}")]
    out = episodes.groupBy(case).agg(*aggs)
    total = sum((F.col(f"_bad_{c}") for c in columns[1:]), F.col(f"_bad_{columns[0]}"))
    return out.withColumn("conflicts", total).drop(*[f"_bad_{c}" for c in columns])


def leaking_cases(episodes: DataFrame, case: str, split: str) -> DataFrame:
    x = F.col(split)
    return episodes.groupBy(case).agg(F.min(x).alias("_a"), F.max(x).alias("_b")).where(~F.col("_a").eqNullSafe(F.col("_b"))).select(case)


def split_summary(episodes: DataFrame, case: str, split: str) -> DataFrame:
    """Episodes and cases per part; cases are counted from per-case rows, not a wide distinct."""
    per_case = episodes.groupBy(split, case).agg(F.count("*").alias("_e"))
    per = per_case.groupBy(split).agg(F.sum("_e").alias("episodes"), F.count("*").alias("cases"))
    totals = per.agg(F.sum("episodes").alias("e"), F.sum("cases").alias("c")).select(F.struct("e", "c")).scalar()
    return per.select(split, "episodes", "cases", (F.col("episodes") / totals["e"]).alias("episode_share"), (F.col("cases") / totals["c"]).alias("case_share"))


def part_distribution(episodes: DataFrame, splits: list[str], column: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("regime"), F.col(s).alias("part")) for s in splits])
    return episodes.groupBy(*splits, column).agg(F.count("*").alias("_n")).select(column, "_n", F.inline(rows)).groupBy(
        "regime", "part", column).agg(F.sum("_n").alias("n"))


def cut_times(df: DataFrame, split: str, time: str) -> DataFrame:
    return df.groupBy(split).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def group_overlap(df: DataFrame, group: str, split: str) -> DataFrame:
    """Test cases and groups that also appear in train."""
    per = df.groupBy(group).agg(count_if(F.col(split) == "test").alias("t"), count_if(F.col(split) == "train").alias("r"))
    both = (F.col("t") > 0) & (F.col("r") > 0)
    return per.agg(
        F.sum("t").alias("test_cases"), F.sum(F.when(both, F.col("t")).otherwise(0)).alias("test_cases_with_group_in_train"),
        count_if(F.col("t") > 0).alias("test_groups"), count_if(both).alias("shared_groups"))


def cohort_table(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), count_if(F.col("known")).alias("resolved"), count_if(~F.col("known")).alias("ambiguous"),
        count_if(F.col("complete")).alias("complete"), F.min("decision_time").alias("decision_min"), F.max("decision_time").alias("decision_max"))
