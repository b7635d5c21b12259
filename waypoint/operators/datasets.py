"""Assembling the inputs of the decision policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_true, upper_text
from .checks import assert_empty, checked_join, missing_keys
from .ordered import scalars


def eligibility_reason(available: Column, reference: Column, synthetic: Column) -> Column:
    return (
        F.when(~is_true(available), "NO_REAL_T1_TRANSITION").when(upper_text(reference) != "GATHER", "REFERENCE_NOT_GATHER")
        .when(is_true(synthetic), "SYNTHETIC_EPISODE_EXCLUDED_PRIMARY").otherwise("ELIGIBLE")
    )


def first_policy_dataset(episodes: DataFrame, t1_scores: DataFrame, key: str) -> DataFrame:
    """Episodes with their second-cut score; only natural delayed-evidence cases may use it."""
    d = checked_join(episodes, t1_scores, [key], "many_to_one", marker="transition_available")
    d = d.withColumn("reason", eligibility_reason(F.col("transition_available"), F.col("expected_action_reference"), F.col("synthetic")))
    return d.withColumns({
        "gather_policy_eligible": F.col("reason") == "ELIGIBLE",
        "p_safe_t1_primary": F.when(F.col("reason") == "ELIGIBLE", F.col("p_safe_t1")),
        "p_nonexecute": 1 - F.col("p_cal_execute"),
    })


def policy_dataset(episodes: DataFrame, safety: DataFrame, gate: DataFrame, key: str, refs: DataFrame) -> DataFrame:
    """Episodes + safety score + gate state + train references, each join checked one to one."""
    for name, other in (("safety score", safety), ("gate state", gate)):
        assert_empty(missing_keys(episodes, other, [key]), f"episodes without a {name}")
    d = checked_join(checked_join(episodes, safety, [key], "one_to_one"), gate, [key], "one_to_one")
    return d.withColumn("_r", scalars(refs)).withColumns({
        "gate_valid": F.col("gate") == "VALID", "execute_risk": 1 - F.col("p_safe_t0_cal"),
        **{f"train_{p}": F.col(f"_r.{p}") for p in ("p50", "p90", "p99")},
    }).drop("_r")
