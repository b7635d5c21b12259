"""Distributed operators against brute force on small inputs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from waypoint.functions import policy as D
from waypoint.functions import stats
from waypoint.operators import models as M
from waypoint.operators import ordered as O
from waypoint.operators import resample as Q
from waypoint.operators import selection as Z


def brute_tail(u, n, a):
    return sum(math.comb(n, k) * a**k * (1 - a) ** (n - k) for k in range(u + 1)) if n else 1.0


def test_binomial_tail_and_bounds():
    cases = [(0, 10, 0.05), (3, 40, 0.1), (40, 40, 0.3), (7, 500, 0.02), (0, 0, 0.1), (60, 200, 0.3)]
    u, n, a = (np.array(x) for x in zip(*cases))
    assert np.allclose(stats.lower_tail(u, n, a), [brute_tail(*c) for c in cases], atol=1e-12)
    big = stats.lower_tail(np.array([900_000]), np.array([30_000_000]), np.array([0.03]))
    assert abs(big[0] - 0.5) < 1e-3
    hi = stats.exact_bound(np.array([3, 0, 5]), np.array([40, 20, 5]), 0.05, True)
    assert abs(brute_tail(3, 40, hi[0]) - 0.025) < 1e-9 and hi[2] == 1.0
    lo = stats.exact_bound(np.array([3, 0]), np.array([40, 20]), 0.05, False)
    assert abs(1 - brute_tail(2, 40, lo[0]) - 0.025) < 1e-9 and lo[1] == 0.0


def test_prefix_and_percentiles_with_a_hot_value_and_null_group(spark):
    random.seed(1)
    rows = [(random.choice(["a", None]), 5.0 if random.random() < 0.4 else round(random.random() * 9, 2), i) for i in range(700)]
    d = spark.createDataFrame(rows, "g string, x double, i int").repartition(6)
    p = O.prefix(d, [F.col("x").desc(), F.col("i")], by=["g"], sums=["x"]).collect()
    for g in ("a", None):
        want = sorted([(x, i) for gg, x, i in rows if gg == g], key=lambda t: (-t[0], t[1]))
        got = sorted([(r["rank"], r["x"], r["i"], r["cum_x"]) for r in p if r["g"] == g])
        assert [(x, i) for _, x, i, _ in got] == want and got[-1][0] == len(want)
        assert np.allclose([c for *_, c in got], np.cumsum([x for x, _ in want]))
    q = {r["g"]: r for r in O.percentiles(d, "x", {"lo": 0.03, "mid": 0.5, "hi": 0.987}, ["g"]).collect()}
    for g in ("a", None):
        x = [x for gg, x, _ in rows if gg == g]
        assert np.allclose([q[g]["lo"], q[g]["mid"], q[g]["hi"]], np.quantile(x, [0.03, 0.5, 0.987]))


def test_hash_ranks_are_a_full_order(spark):
    d = spark.range(3000).withColumnRenamed("id", "k")
    key = F.sha2(F.concat(F.lit("s"), F.col("k").cast("string")), 256)
    r = O.hash_ranks(d, key, "k").withColumn("h", key).orderBy("rank").collect()
    assert [x["rank"] for x in r] == list(range(1, 3001)) and [x["h"] for x in r] == sorted(x["h"] for x in r)
    top = O.hash_ranks(d, key, "k", limit=40).collect()
    assert sorted(x["k"] for x in top) == sorted(x["k"] for x in r[:40])


def test_auroc_replicates_with_one_score_held_by_many_rows(spark):
    random.seed(2)
    rows = [(i % 40, 0.5 if random.random() < 0.4 else random.random(), random.random() < 0.4) for i in range(900)]
    d = spark.createDataFrame(rows, "c int, s double, y boolean").repartition(5)
    reps, seed = 7, "z"
    got = {r["rep"]: r["auroc"] for r in Q.auroc_replicates(d, "c", "s", "y", reps, seed).collect()}
    w = {(r["c"], r["rep"]): r["weight"] for r in Q.weight_table(d.select("c").distinct(), "c", reps, seed).collect()}
    for rep in range(-1, reps):
        ws = np.array([1 if rep < 0 else w[(c, rep)] for c, _, _ in rows], dtype=float)
        s, y = np.array([x for _, x, _ in rows]), np.array([x for _, _, x in rows])
        gt = (s[y][:, None] > s[~y][None, :]) + 0.5 * (s[y][:, None] == s[~y][None, :])
        want = (ws[y][:, None] * ws[~y][None, :] * gt).sum() / (ws[y].sum() * ws[~y].sum())
        assert abs(got[rep] - want) < 1e-9


def test_poisson_weights_have_unit_mean_and_variance(spark):
    w = [r["weight"] for r in Q.weight_table(spark.range(400).withColumnRenamed("id", "k"), "k", 100, "m").collect()]
    assert abs(np.mean(w) - 1) < 0.02 and abs(np.var(w) - 1) < 0.05


def test_isotonic_matches_pool_adjacent_violators(spark):
    random.seed(3)
    rows = [(round(random.random(), 2), random.random() < 0.5) for _ in range(400)]
    d = spark.createDataFrame(rows, "s double, y boolean")
    cal = M.fit_isotonic(d, "s", F.col("y"))
    blocks = []
    for s in sorted({s for s, _ in rows}):
        ys = [float(y) for x, y in rows if x == s]
        blocks.append([sum(ys), len(ys), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    want = {s: t / n for t, n, ss in blocks for s in ss}
    for r in cal.apply(d, "s", "p").collect():
        assert abs(r["p"] - want[r["s"]]) < 1e-9


def test_zero_calibrated_row_falls_back_to_raw(spark):
    fit = spark.createDataFrame([(0.1, 0.9, "B"), (0.9, 0.1, "A"), (0.2, 0.8, "B"), (0.8, 0.2, "A")], "p_raw_A double, p_raw_B double, y string")
    t = spark.createDataFrame([(0.1, 0.1, "A")], "p_raw_A double, p_raw_B double, y string")
    r = M.calibrate_classes(fit, t, ["A", "B"], "y").first()
    assert (r.p_cal_A, r.p_cal_B) == (0.1, 0.1)


def test_rare_and_unknown_levels(spark):
    train = spark.createDataFrame([("a", 1.0)] * 6 + [("b", 2.0)] * 2 + [(None, None)] * 5, "k string, x double")
    f = M.fit_features(train, ["x"], ["k"])
    new = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("zzz", None), (None, 1.0)], "k string, x double")
    rows = f.transform(new).collect()
    size = rows[0]["features"].size
    hot = {r["k"]: [i for i, v in enumerate(r["features"].toArray()) if i > 0 and v] for r in rows}
    assert size == 4 and hot["zzz"] == [] and len({hot["a"][0], hot["b"][0], hot[None][0]}) == 3


def test_tie_orders_of_equal_losses(spark):
    p = D.Params(c_g=0.0, c_h=0.1, c_a=0.1, tau0=0.0, beta0=1.0, tau1=0.0, beta1=1.0)
    d = spark.createDataFrame([(0.9, 0.9)], "p0 double, p1 double")
    one = F.lit(1.0)
    v2 = D.decide(F.round(F.col("p0"), 1), F.lit(None).cast("double"), one, p.but(c_h=0.5, c_a=0.5), F.lit(False))[0]
    tie_v2 = D.least_loss([("EXECUTE", F.lit(0.1)), ("GATHER", F.lit(0.1)), ("ESCALATE", F.lit(0.1))])[0]
    gather = D.first_policy("FULL", F.lit(0.0), F.lit(0.0), F.lit(0.1), p.but(beta0=0.0), F.lit(True))[0]
    assert tuple(d.select(v2, tie_v2, gather).first()) == ("EXECUTE", "EXECUTE", "ESCALATE")


def test_unresolved_execution_after_evidence_stays_unknown(spark):
    p = D.Params()
    args = [F.lit("GATHER"), F.lit(True), F.lit("EXECUTE")]
    d = spark.range(1).select(D.loss_c(*args, F.lit("AMBIGUOUS"), F.lit(1.0), p).alias("c"), D.loss_c(*args, F.lit("NOT_SAFE_TO_EXECUTE"), F.lit(1.0), p).alias("u"),
                              D.loss_v1(F.lit("GATHER"), F.lit("EXECUTE"), F.lit("GATHER"), F.lit("AMBIGUOUS"), F.lit(1.0), p).alias("v"))
    r = d.first()
    assert r.c is None and abs(r.u - 1.02) < 1e-12 and abs(r.v - 1.02) < 1e-12


def test_nothing_executed_gives_null_rates(spark):
    from waypoint.operators.rules import threshold_table

    d = spark.createDataFrame([(0.1, True), (0.2, False)], "s double, u boolean")
    r = threshold_table(d, "s", "u", [0.9], []).first()
    assert r.selected == 0 and r.coverage == 0.0 and r.unsafe_rate is None


def test_tightening_never_adds_executions(spark):
    random.seed(4)
    d = spark.createDataFrame([(random.random(), True, random.random() < 0.2, random.random() * 2) for _ in range(300)], "s double, g boolean, u boolean, c double")
    n = {(r["tau"], r["beta"]): r["n"] for r in Z.node_counts(d, []).collect()}
    for i, t in enumerate(Z.TAUS):
        for j, b in enumerate(Z.BETAS):
            assert i == 0 or n[(t, b)] <= n[(Z.TAUS[i - 1], b)]
            assert j == 0 or n[(t, b)] >= n[(t, Z.BETAS[j - 1])]


def test_future_columns_are_refused():
    import pytest

    with pytest.raises(ValueError):
        M.check_inputs(["n_goods_receipts_before_t0", "events_total_case"])


def test_a_bad_consequence_reference_is_an_error(spark):
    from waypoint.functions import scalars as S

    assert spark.range(1).select(S.consequence(F.lit(1.0), F.lit(1.0))).first()[0] == 1.0
    for bad in (0.0, -1.0, None):
        try:
            spark.range(1).select(S.consequence(F.lit(1.0), F.lit(bad).cast("double"))).collect()
        except Exception as error:
            assert "must be positive" in str(error)
        else:
            raise AssertionError(bad)
