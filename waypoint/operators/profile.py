"""Counts, shares and distribution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import AMBIGUOUS, SAFE, UNSAFE, is_true
from .ordered import count_if, percentiles, small, with_totals


def unpivot_flags(df: DataFrame, flags: list[str], keep: list[str] | None = None, name: str = "signal", value: str = "on") -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias(name), is_true(F.col(f)).alias(value)) for f in flags])
    return df.select(*(keep or []), F.inline(rows))


def share_rows(df: DataFrame, conditions: dict[str, Column], name: str = "metric") -> DataFrame:
    """One row per condition: rows meeting it and their share of all rows."""
    one = df.agg(F.count("*").alias("_total"), *[count_if(c).alias(n) for n, c in conditions.items()])
    rows = F.array(*[F.struct(F.lit(n).alias(name), F.col(n).alias("n")) for n in conditions])
    return one.select("_total", F.inline(rows)).select(name, "n", (F.col("n") / F.col("_total") * 100).alias("pct"))


def flag_prevalence(df: DataFrame, flags: list[str], by: list[str] | None = None) -> DataFrame:
    by = by or []
    sums = df.groupBy(*by).agg(F.count("*").alias("_n"), *[count_if(F.col(f)).alias(f) for f in flags])
    rows = F.array(*[F.struct(F.lit(f).alias("signal"), F.col(f).alias("n_true")) for f in flags])
    return sums.select(*by, "_n", F.inline(rows)).select(*by, "signal", "n_true", (F.col("n_true") / F.col("_n") * 100).alias("pct_true"))


def overlap(df: DataFrame, flags: list[str]) -> DataFrame:
    """Co-occurrence counts for every pair of flags, from the counts of each flag pattern.

    At most 2^k patterns leave the first aggregate; no row is paired with another.
    """
    patterns = df.groupBy(*[is_true(F.col(f)).alias(f) for f in flags]).agg(F.count("*").alias("_n"))
    pairs = [F.struct(F.lit(a).alias("sig_a"), F.lit(b).alias("sig_b"), (F.col(a) & F.col(b)).cast("bigint").alias("hit"))
             for a in flags for b in flags]
    return patterns.select("_n", F.inline(F.array(*pairs))).groupBy("sig_a", "sig_b").agg(F.sum(F.col("hit") * F.col("_n")).alias("n"))


def conflict_table(df: DataFrame, flags: list[str], clearing: str) -> DataFrame:
    both = unpivot_flags(df, flags, [clearing])
    hit = F.col("on") & is_true(F.col(clearing))
    return both.groupBy("signal").agg(
        count_if(F.col("on")).alias("signal_count"), count_if(hit).alias("both_count"),
        (count_if(hit) / F.greatest(count_if(F.col("on")), F.lit(1)) * 100).alias("pct_signal"),
        (count_if(hit) / F.count("*") * 100).alias("pct_all"))


def label_balance(df: DataFrame, definitions: list[str]) -> DataFrame:
    counts = df.groupBy(*definitions).agg(F.count("*").alias("k"))
    long = counts.select("k", F.inline(F.array(*[F.struct(F.lit(d).alias("definition"), F.col(d).alias("label")) for d in definitions])))
    n = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    lab = F.col("label")
    res, uns = n(lab != AMBIGUOUS), n(lab == UNSAFE)
    return long.groupBy("definition").agg(
        res.alias("resolved"), (res / F.sum("k") * 100).alias("resolved_pct"), n(lab == SAFE).alias("safe"), uns.alias("unsafe"),
        n(lab == AMBIGUOUS).alias("ambiguous"), F.try_divide(uns * 100, res).alias("unsafe_pct_resolved"))


def resolved_summary(df: DataFrame, label: str) -> DataFrame:
    one = df.agg(F.count("*").alias("all_cases"), count_if(F.col(label) != AMBIGUOUS).alias("resolved"), count_if(F.col(label) == UNSAFE).alias("unsafe"))
    one = one.withColumns({
        "ambiguous_pct": F.try_divide((F.col("all_cases") - F.col("resolved")) * 100, F.col("all_cases")),
        "unsafe_pct": F.try_divide(F.col("unsafe") * 100, F.col("resolved"))})
    return one.withColumn("verdict", F.when(F.col("ambiguous_pct") > 10, "TOO_AMBIGUOUS").when(
        F.col("unsafe_pct").between(1, 40), "VIABLE").otherwise("IMBALANCED"))


def counts_with_share(df: DataFrame, keys: list[str], within: list[str] | None = None, name: str = "n") -> DataFrame:
    """Counts and percent of all rows, or of the rows sharing ``within``. Null groups stay."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(name))
    totals = with_totals(counts, within or [], {"_total": F.sum(name)})
    return totals.select(*keys, name, (F.col(name) / F.col("_total") * 100).alias("pct"))


def numeric_summary(df: DataFrame, value: str, by: list[str], probs: dict[str, float], stats: list[str]) -> DataFrame:
    """Chosen statistics per group; percentiles are exact and interpolated."""
    x = F.col(value)
    known = {
        "n": F.count("*"), "non_null": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x),
        "sum": F.sum(x), "zero": count_if(x == 0), "negative": count_if(x < 0),
    }
    base = df.groupBy(*by).agg(*[known[s].alias(s) for s in stats])
    if not probs:
        return base
    p = percentiles(df, value, probs, by)
    if not by:
        return base.select("*", *[p.select(F.struct(*p.columns)).scalar()[n].alias(n) for n in probs])
    p = p.select(*[F.col(b).alias(f"_k_{b}") for b in by], *probs)
    match = None
    for b in by:
        m = base[b].eqNullSafe(p[f"_k_{b}"])
        match = m if match is None else match & m
    return base.join(p, match, "left").drop(*[f"_k_{b}" for b in by])


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Non-null count, missing percent and distinct values per column.

    Exact distinct counts go through distinct (column, value) pairs, which are
    reduced before the shuffle; ``exact=False`` uses a sketch in the same pass.
    """
    cols = df.columns
    base = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"nn_{c}") for c in cols],
                  *([] if exact else [F.approx_count_distinct(c).alias(f"d_{c}") for c in cols]))
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"nn_{c}").alias("non_null"),
                              *([] if exact else [F.col(f"d_{c}").alias("distinct_values")])) for c in cols])
    out = base.select("_n", F.inline(rows)).withColumn("missing_pct", (F.col("_n") - F.col("non_null")) / F.col("_n") * 100).drop("_n")
    if not exact:
        return out
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v")) for c in cols])))
    d = long.where(F.col("_v").isNotNull()).distinct().groupBy("_c").agg(F.count("*").alias("distinct_values"))
    return out.join(d, F.col("column_name") == F.col("_c"), "left").drop("_c")


def funnel(events: DataFrame, case: str, inside: Column, activity: Column) -> DataFrame:
    """Cases and events left after the category filter and the activity requirement."""
    per = events.groupBy(case).agg(F.count("*").alias("e0"), count_if(inside).alias("e1"), F.max(is_true(inside & activity)).alias("has"))
    one = per.agg(F.count("*").alias("c0"), F.sum("e0").alias("e0"), count_if(F.col("e1") > 0).alias("c1"), F.sum("e1").alias("e1"),
                  count_if(F.col("has")).alias("c2"), F.sum(F.when(F.col("has"), F.col("e1")).otherwise(0)).alias("e2"))
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"c{i}").alias("cases"), F.col(f"e{i}").alias("events"))
                     for i, n in enumerate(["all", "category", "with_activity"])])
    return one.select("c0", F.inline(rows)).select("stage", "cases", "events", (F.col("cases") / F.col("c0") * 100).alias("retention_pct"))


def bucket_counts(df: DataFrame, x: Column, edges: list[float], labels: list[str], name: str) -> DataFrame:
    """Counts per right-closed bucket; empty buckets stay with zero."""
    from ..functions.scalars import right_closed_bin

    one = df.select(right_closed_bin(x, edges, labels).alias("_b")).agg(*[count_if(F.col("_b") == b).alias(f"b{i}") for i, b in enumerate(labels)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(b).alias(name), F.col(f"b{i}").alias("n")) for i, b in enumerate(labels)])))


def quantile_bins(df: DataFrame, value: str, by: list[str], probs: list[float]) -> DataFrame:
    """Right-closed bins at the group's own quantiles; the lowest value is included."""
    names = {f"_q{i}": p for i, p in enumerate(probs)}
    p = small(percentiles(df, value, names, by))
    j = df.join(p, by, "left")
    out = F.when(F.col(value) <= F.col("_q0"), "Q1")
    for i in range(1, len(probs)):
        out = out.when(F.col(value) <= F.col(f"_q{i}"), f"Q{i + 1}")
    return j.withColumn("bin", F.when(F.col(value).isNotNull(), out.otherwise(f"Q{len(probs) + 1}"))).drop(*names)


def train_references(df: DataFrame, case: str, order: str, value: str, part: str = "part") -> DataFrame:
    """Train-only percentiles with one value per source case."""
    per = df.where(F.col(part) == "train").groupBy(case).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_v"))
    p = percentiles(per, "_v", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return p.select(per.agg(F.count("*")).scalar().alias("train_cases"), "*")
