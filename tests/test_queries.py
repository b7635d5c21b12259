"""A cross-section of the registered queries against their SQL twins.

``python tests/oracle.py 0.01`` runs all of them.
"""

import pytest

from oracle import DATA, compare, duck
from waypoint.plans import all_queries

SAMPLE = [
    "p14_reason_flags", "p22_exposure_quartile", "l13_a38_gate_by_delta", "e13_case_state", "e18_e04_transition_state", "e22_horizon_outcomes",
    "x01_random_split", "x04_exposure_split", "b02_b08_benchmark_copies", "a26_policy_metrics", "d15_j14_s12_frontier", "w01_risk_curve",
    "m15_m16_auroc_ap", "r05_fixed_sequence", "q04_q05_intervals",
    "b09_benchmark_invariants", "b10_b12_stress_arms", "v01_metric_identities", "v03_restriction_monotonicity", "v05_same_as_archived", "v06_case_invariants",
    "r13_exact_interval", "w07_rank_agreement", "q01_bootstrap_weights",
    "e12_future_preview", "m01_level_dictionary", "b13_permutation_placebo", "q09_paired_auroc", "a51_human_cost_grid", "r08_eight_starts",
]


@pytest.fixture(scope="session")
def con():
    return duck(f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    builds, sql = all_queries()
    why = compare(spark, con, f"{DATA}/sf0.001", name, builds[name], sql[name])
    assert why is None, why


def test_every_query_but_the_fitted_ones_has_sql():
    builds, sql = all_queries()
    assert {n for n in builds if n not in sql} == {
        "m02_m05_action_scores", "m03_m06_m08_safety_scores", "m04_boosted_comparison", "m08_t1_scores",
        "m17_action_ablation", "m17_m19_feature_ablation", "m22_mismatch_sensitivity", "m23_corrected_action_model"}
