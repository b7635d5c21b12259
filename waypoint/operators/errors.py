"""Tables of executed mistakes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_true
from .ordered import at_thresholds, count_if


def error_flags(df: DataFrame, score: str, action: str = "action", unsafe: str = "unsafe") -> DataFrame:
    executed = is_true(F.col(action) == "EXECUTE")
    return df.withColumns({
        "executed": executed,
        "unsafe_executed": executed & is_true(F.col(unsafe)),
        "confident_but_unsafe": is_true((F.col(score) >= 0.95) & F.col(unsafe)),
    })


def confident_false_safe(df: DataFrame, score: str, thresholds: list[float], by: list[str]) -> DataFrame:
    bad = is_true(F.col("unsafe"))
    t = at_thresholds(df, F.col(score), thresholds, {
        "high": F.lit(1).cast("bigint"), "high_unsafe": bad.cast("bigint"),
        "high_unsafe_executed": (bad & is_true(F.col("action") == "EXECUTE")).cast("bigint")}, by)
    return t.select(*by, "threshold", F.col("all_high").alias("episodes"), "high", "high_unsafe", "high_unsafe_executed",
                    F.try_divide(F.col("high_unsafe").cast("double"), F.col("high").cast("double")).alias("unsafe_rate"))


def evidence_outcomes(df: DataFrame, by: list[str], gathered: Column | None = None) -> DataFrame:
    """What happened after evidence was gathered; unresolved labels are left out of the rate."""
    from ..functions.scalars import AMBIGUOUS, UNSAFE

    g = df.where(F.col("action") == "GATHER" if gathered is None else gathered)
    ex = F.col("after") == "EXECUTE"
    known, bad = ex & (F.col("y_t1") != AMBIGUOUS), ex & (F.col("y_t1") == UNSAFE)
    return g.groupBy(*by).agg(
        F.count("*").alias("gathered"), count_if(ex).alias("post_execute"), count_if(F.col("after") == "ESCALATE").alias("post_escalate"),
        count_if(F.col("after") == "ABSTAIN").alias("post_abstain"), count_if(known).alias("known"), count_if(bad).alias("post_unsafe"),
        F.try_divide(count_if(bad).cast("double"), count_if(known).cast("double")).alias("post_unsafe_rate"))
