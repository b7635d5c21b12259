"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from waypoint.operators import resample as Q  # noqa: E402
from waypoint.operators.metrics import RATES  # noqa: E402
from waypoint.plans import all_queries  # noqa: E402
from waypoint.session import build_session  # noqa: E402


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(f"local[{cpus}]", partitions=int(cpus), name="bench")
    builds, _ = all_queries()
    from waypoint.plans.curve_queries import ruled
    from waypoint.plans.selection_queries import replicates

    def loss_intervals(s, d):
        return Q.intervals(replicates(s, d, 2000), RATES, ["policy"])

    def auroc_intervals(s, d):
        from pyspark.sql import functions as F

        return Q.paired_curves(ruled(s, d).withColumn("safe", ~F.col("u")), "group_id", "p_safe_t0_raw", "s", "safe", 2000, "bench")

    jobs = {
        "case_state": builds["e13_case_state"],
        "fixed_horizon": builds["e22_horizon_outcomes"],
        "transition_state": builds["e18_e04_transition_state"],
        "benchmark_copies": builds["b02_b08_benchmark_copies"],
        "policy_metrics": builds["a26_policy_metrics"],
        "frontier_320_points": builds["d15_j14_s12_frontier"],
        "risk_coverage": builds["w05_curve_summary"],
        "graph_selection": builds["r07_w10_graph_selection"],
        "bootstrap_2000_policies": loss_intervals,
        "bootstrap_2000_auroc": auroc_intervals,
        "safety_model_fit_score": builds["m03_m06_m08_safety_scores"],
    }
    builds["s04_load_by_suffix"](spark, sf_dir).collect()  # start the JVM side before timing
    times = {}
    for name, build in jobs.items():
        start = time.perf_counter()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
