"""Steps that must not grow with copies of a row."""

import pytest
from pyspark.sql import functions as F

from waypoint.functions import policy as D
from waypoint.operators import ordered as O
from waypoint.operators import policy as PO
from waypoint.operators import selection as Z


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_arms_share_the_hashes_of_a_row(spark):
    rows = [(f"c{i}", arm, i % 10 / 10, 0.05 * (i % 7 + arm), None if i % 11 == 0 else i % 3 > 0, None if i % 13 == 0 else i % 4 == 0) for i in range(120) for arm in (0, 1)]
    d = spark.createDataFrame(rows, "k string, arm int, s double, c double, g boolean, u boolean")
    seeds, taus, betas = ["a", "b"], [0.3, 0.7], [0.05, 0.1]
    held = d.withColumn("halves", Z.seed_bits("k", seeds)).localCheckpoint()
    got = Z.seed_node_counts(held, "k", seeds, ["arm"], taus, betas, halves="halves")
    assert "sha2" not in plan(got)
    copies = Z.by_seed(d, "k", seeds).where("half = 1")
    want = {}
    for r in copies.collect():
        for t in taus:
            for b in betas:
                n, u = want.get((r["arm"], r["seed"], t, b), (0, 0))
                hit = bool(r["g"]) and r["s"] >= t and (1 - r["s"]) * r["c"] <= min(b, 0.1)
                want[r["arm"], r["seed"], t, b] = (n + hit, u + (hit and bool(r["u"])))
    assert {(r["arm"], r["seed"], r["tau"], r["beta"]): (r["n"], r["u"]) for r in got.collect()} == want


def test_convention_means_equal_means_over_copies(spark):
    p = D.Params(c_g=0.02, c_h=0.1, c_a=0.118, rho_h=0.02, tau0=0.8, beta0=0.2, tau1=0.7, beta1=0.3)
    cell = lambda i, n, xs: None if i % n == 0 else xs[i % len(xs)]
    rows = [(i % 2, cell(i, 17, [0.1, 0.4, 1.0, 2.5]), cell(i, 13, ["VALID", "CONTRADICTORY", "INCOMPLETE"]), cell(i, 19, [True, False]), cell(i, 11, ["SAFE_TO_EXECUTE", "NOT_SAFE_TO_EXECUTE", "AMBIGUOUS"]),
             cell(i, 7, ["EXECUTE", " gather", "ESCALATE", "ABSTAIN", "OTHER"]), (i * 37 % 100) / 100, (i * 53 % 100) / 100, cell(i, 3, [0.75, 0.9, 0.95, 0.2]), cell(i, 23, [True, True, False])) for i in range(400)]
    d = spark.createDataFrame(rows, "mode int, c double, gate string, unsafe boolean, y_t1 string, predicted_action string, p_cal_execute double, p_safe_t0_cal double, p_safe_t1_primary double, gather_policy_eligible boolean")
    means = PO.convention_means(PO.with_actions(d, p), p, ["mode"])
    got = {(r["policy"], r["mode"]): r for r in means.collect()}
    a, u, c = F.col("action"), F.col("unsafe"), F.col("c")
    after, _ = D.continuation(F.col("p_safe_t1_primary"), c, p)
    long = PO.decisions_long(d, p, ["mode", "c", "unsafe", "y_t1", "p_safe_t1_primary"]).select("policy", "mode", D.loss_a(a, u, c, p).alias("a"), D.loss_b(a, u, c, p).alias("b"), D.loss_c(a, u, after, F.col("y_t1"), c, p).alias("e"))
    want = long.groupBy("policy", "mode").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg("e").alias("e"), F.sum(F.col("e").isNull().cast("int")).alias("unknown")).collect()
    assert len(want) == len(got) == 16 and any(r["unknown"] for r in want)
    for r in want:
        g = got[r["policy"], r["mode"]]
        assert g["unknown"] == r["unknown"]
        assert (g["loss_a"], g["loss_b"], g["loss_c"]) == pytest.approx((r["a"], r["b"], r["e"]), abs=1e-12)


def test_first_rows_of_groups_shuffle_no_other_buckets(spark):
    d = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), F.lit("x" * 50).alias("wide"))
    key = F.sha2(F.concat(F.coalesce(F.col("g").cast("string"), F.lit("")), F.lit(":"), F.col("k")), 256)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = O.hash_ranks(d, key, "k", ["g"], "rank", limit=4)
        assert "BroadcastHashJoin" in plan(got) and "SortMergeJoin" not in plan(got)
        rows = {(r["g"], r["rank"]): r["k"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    groups = {}
    for r in d.withColumn("h", key).collect():
        groups.setdefault(r["g"], []).append((r["h"], r["k"]))
    assert rows == {(g, i + 1): k for g, x in groups.items() for i, (_, k) in enumerate(sorted(x)[:4])}
