"""The distributed mechanisms against plain versions, with hot groups and forced splits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypoint.operators import cases as C
from waypoint.operators import isotonic as I
from waypoint.operators import models as M
from waypoint.operators import policy as PO
from waypoint.operators import resample as Q
from waypoint.operators import selection as Z


def pooled(rows):
    """Plain pool-adjacent-violators over (score, label): score -> value."""
    blocks = []
    for s in sorted({s for s, _ in rows}):
        ys = [y for x, y in rows if x == s]
        blocks.append([sum(ys), len(ys), [s]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    return {s: t / n for t, n, ss in blocks for s in ss}


@pytest.mark.parametrize("task_rows, trend", [(7, 1.0), (7, -1.0), (200_000, 1.0)])
def test_isotonic_blocks_pooled_over_many_tasks(spark, monkeypatch, task_rows, trend):
    rng = random.Random(11)
    rows = [(g, s, float(rng.random() < 0.5 + trend * (s - 0.5) / 2)) for g in (0, 1) for s in (round(rng.random(), 3) for _ in range(150))]
    rows += [(1, 0.5, float(i % 3 == 0)) for i in range(400)]  # one score that most rows share
    monkeypatch.setattr(I, "CUTS", 5)
    d = spark.createDataFrame(rows, "g int, s double, y double").repartition(3)
    maps = I.fit(d, {0: "s", 1: "s"}, {0: F.col("y") == 1, 1: F.col("y") == 1}, F.col("g"), task_rows)
    want = {g: pooled([(s, y) for k, s, y in rows if k == g]) for g in (0, 1)}
    for r in maps.apply(d, {0: "s", 1: "s"}, {0: "p", 1: "p"}, F.col("g")).collect():
        assert abs(r["p"] - want[r["g"]][r["s"]]) < 1e-12
    edges = spark.createDataFrame([(0, -5.0), (1, 5.0), (2, None), (3, float("nan"))], "i int, s double")
    low, high, none, nan = [r["p"] for r in sorted(maps.apply(edges, {0: "s"}, {0: "p"}).collect(), key=lambda r: r["i"])]
    assert none is None and nan is None and low == min(want[0].values()) and high == max(want[0].values())


def test_between_two_blocks_the_map_is_a_line(spark):
    d = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "s double, y double")
    m = M.fit_isotonic(d, "s", F.col("y") == 1)
    assert [r["p"] for r in m.apply(spark.createDataFrame([(0.25,), (1.0,)], "s double"), "s", "p").collect()] == [0.25, 1.0]


def test_a_fit_without_rows_gives_no_values(spark):
    d = spark.createDataFrame([(None, 1.0)], "s double, y double")
    out = M.fit_isotonic(d, "s", F.col("y") == 1).apply(spark.createDataFrame([(0.3,)], "s double"), "s", "p").collect()
    assert [r["p"] for r in out] == [None]


def curves(s, y, w):
    order = sorted(set(s), reverse=True)
    p = n = area = precision = 0.0
    for x in order:
        gp = sum(wi for si, yi, wi in zip(s, y, w) if si == x and yi)
        gn = sum(wi for si, yi, wi in zip(s, y, w) if si == x and not yi)
        area += gn * (p + gp / 2)
        p, n = p + gp, n + gn
        precision += gp * p / (p + n) if p + n else 0.0
    return (area / (p * n), precision / p) if p and n else (None, None)


def test_curve_replicates_match_weighted_curves_with_a_hot_score(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 7)
    rng = random.Random(4)
    rows = [(i % 40, rng.choice([0.5, 0.5, round(rng.random(), 2)]), round(rng.random(), 1), rng.random() < 0.4) for i in range(300)]
    d = spark.createDataFrame(rows, "c long, a double, b double, y boolean").repartition(5)
    reps, seed = 6, "t"
    weight = {(r["c"], r["rep"]): r["weight"] for r in Q.weight_table(d.select("c").distinct(), "c", reps, seed).collect()}
    got = {(r["which"], r["rep"]): (r["auroc"], r["average_precision"]) for r in Q.curve_replicates(d, "c", {"a": "a", "b": "b"}, "y", reps, seed).collect()}
    assert len(got) == 2 * (reps + 1)
    for (which, rep), values in got.items():
        w = [1 if rep < 0 else weight[(c, rep)] for c, *_ in rows]
        want = curves([r[1] if which == "a" else r[2] for r in rows], [r[3] for r in rows], w)
        assert np.allclose(values, want, atol=1e-9)


def test_score_orders_are_walked_in_pieces_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(Q, "PIECE_BITS", 3)
    rng = random.Random(5)
    rows = [(i % 40, rng.choice([0.5, 0.5, round(rng.random(), 2)]), rng.random(), rng.random() < 0.4) for i in range(300)]
    d = spark.createDataFrame(rows, "c long, a double, b double, y boolean").coalesce(1)
    sizes = [r["count"] for r in Q._ranked_cells(d, "c", {"a": "a", "b": "b"}, "y").groupBy("_part", "which").count().collect()]
    assert max(sizes) <= 8
    weight = {(r["c"], r["rep"]): r["weight"] for r in Q.weight_table(d.select("c").distinct(), "c", 3, "t").collect()}
    for r in Q.curve_replicates(d, "c", {"a": "a", "b": "b"}, "y", 3, "t").collect():
        w = [1 if r["rep"] < 0 else weight[(c, r["rep"])] for c, *_ in rows]
        want = curves([x[1] if r["which"] == "a" else x[2] for x in rows], [x[3] for x in rows], w)
        assert np.allclose((r["auroc"], r["average_precision"]), want, atol=1e-9)


def test_weights_equal_the_plain_remainder():
    m, steps = Q.multipliers("s", 50), Q.poisson_steps()
    m[:, 0], m[:, 1] = Q.PRIME - 1, 1
    k1, k2 = np.random.default_rng(3).integers(1, Q.PRIME, (2, 300))
    k1[:3], k2[:3] = [1, Q.PRIME - 1, Q.PRIME - 1], [1, Q.PRIME - 1, 1]
    x = (k1[:, None] * m[0] + k2[:, None] * m[1]) % Q.PRIME / float(Q.PRIME)
    assert (Q.weights(k1, k2, m, steps) == (x[:, :, None] >= steps).sum(2)).all()
    # a cluster without a key weighs nothing
    missing = Q.weights(np.append(k1[:5].astype(float), np.nan), np.append(k2[:5].astype(float), np.nan), m, steps)
    assert missing.shape == (6, 50) and not missing[5].any() and missing[:5].any()


def test_seed_counts_equal_counts_of_copies(spark):
    rows = [(f"c{i}", i % 4, i % 3 == 0) for i in range(200)]
    d = spark.createDataFrame(rows, "k string, cell int, u boolean")
    seeds = ["a", "b", "c"]
    got = {(r["seed"], r["half"], r["cell"]): (r["n"], r["m"]) for r in Z.seed_counts(d, "k", seeds, ["cell"], {"n": F.lit(True), "m": F.col("u")}).collect()}
    copies = Z.by_seed(d, "k", seeds).groupBy("seed", "half", "cell").agg(F.count("*").alias("n"), F.sum(F.col("u").cast("bigint")).alias("m"))
    assert got == {(r["seed"], r["half"], r["cell"]): (r["n"], r["m"]) for r in copies.collect()}


@pytest.mark.parametrize("size", [1, 2, 3, 64, 997])
def test_the_keyed_permutation_is_a_bijection(spark, size):
    d = spark.range(size).select(F.col("id").alias("x"))
    to = [r["y"] for r in d.select(Z.keyed_place(F.col("x"), F.lit(size).cast("bigint"), "seed").alias("y")).collect()]
    assert sorted(to) == list(range(size))
    other = [r["y"] for r in d.select(Z.keyed_place(F.col("x"), F.lit(size).cast("bigint"), "other").alias("y")).collect()]
    if size > 50:
        assert to != other and sum(a == i for i, a in enumerate(to)) < 10


def test_permuted_values_keep_their_margins(spark):
    d = spark.createDataFrame([(f"k{i}", i % 2, float(i)) for i in range(101)], "k string, g int, v double")
    out = Z.permuted_all(d, "k", "v", ["s1", "s2"], "w", ["g"]).collect()
    for g in (0, 1):
        for s in ("s1", "s2"):
            assert sorted(r["w"] for r in out if r["g"] == g and r["permutation"] == s) == [float(i) for i in range(101) if i % 2 == g]
    assert sum(r["v"] != r["w"] for r in out) > 150


def test_skyline_equals_the_pairwise_front(spark):
    rng = random.Random(8)
    rows = [(g, rng.randint(0, 12) / 12, rng.choice([None, *(x / 8 for x in range(9))]), rng.randint(0, 10) / 10) for g in ("p", None) for _ in range(300)]
    rows += rows[:5]
    cols = "g string, autonomous_execution_coverage double, unsafe_execution_rate double, mean_realized_normalized_loss double"
    got = PO.pareto(spark.createDataFrame(rows, cols).repartition(4), ["g"])
    beats = lambda a, b: a[0] == b[0] and a[1] >= b[1] and (a[2] or 0) <= (b[2] or 0) and a[3] <= b[3] and (a[1] > b[1] or (a[2] or 0) < (b[2] or 0) or a[3] < b[3])
    want = [b for b in rows if not any(beats(a, b) for a in rows)]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_skyline_of_many_points_forms_no_pairs(spark):
    d = spark.range(400_000).select((F.rand(1) * 0 + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)).alias("autonomous_execution_coverage"), (F.pmod(F.xxhash64(F.col("id") + 7), F.lit(1 << 20)) / (1 << 20)).alias("unsafe_execution_rate"))
    d = d.withColumn("mean_realized_normalized_loss", 1 - (F.col("autonomous_execution_coverage") + F.col("unsafe_execution_rate")) / 2)
    front = PO.pareto(d, [])
    assert "NestedLoop" not in front._jdf.queryExecution().toString()
    assert 1 <= front.count() < 400_000


def log(spark, rows):
    data = spark.createDataFrame(rows, "case string, act string, ts string, ord long, v double, vendor string, item string")
    return data.withColumn("ts", F.col("ts").cast("timestamp_ntz")), C.Log(case="case", activity="act", ts="ts", order="ord", value="v", attributes={"vendor": "vendor_id", "item": "item_id"}, flags={})


def test_attributes_come_from_the_first_row_that_has_them(spark):
    act = C.ACTIVITIES["invoice_receipt"]
    rows = [
        ("a", "x", "2024-01-01 00:00:00", 1, 1.0, "v1", "yes"), ("a", act, "2024-01-02 00:00:00", 2, 2.0, "v2", "no"),
        ("b", "x", "2024-01-01 00:00:00", 2, 1.0, None, "no"), ("b", "y", "2024-01-01 00:00:00", 1, 1.0, None, None), ("b", act, "2024-01-03 00:00:00", 3, None, "late", "yes"),
        ("c", act, "2024-01-03 00:00:00", 3, 5.0, None, None), ("c", "x", None, 1, 5.0, "undated", None),
    ]
    events, own = log(spark, rows)
    got = {r["case_id"]: (r["vendor_id"], r["item_id"], r["events_available_at_t0"]) for r in C.case_state(events, own).collect()}
    assert got == {"a": ("v1", "yes", 2), "b": ("late", "no", 3), "c": ("undated", None, 1)}


def test_case_state_aggregates_by_hash(spark):
    events, own = log(spark, [("a", C.ACTIVITIES["invoice_receipt"], "2024-01-02 00:00:00", 2, 2.0, "v2", "no")])
    state = C.combine(C.attach(own.normal(events), C.cut_points(own.normal(events), own.is_role("invoice_receipt"))), {"v": C.first_row_value(C.past()), "o": C.first_order(C.past())}, C.CUT)
    assert "SortAggregate" not in state._jdf.queryExecution().executedPlan().toString()


def test_a_hot_case_keeps_its_state_and_preview(spark, monkeypatch):
    act = C.ACTIVITIES["invoice_receipt"]
    rows = [("h", "start", "2024-01-01 00:00:00", 0, 0.0, "v", "yes"), ("h", act, "2024-01-01 00:00:01", 1, 7.0, "v", "yes")]
    rows += [("h", f"e{i}", "2024-01-02 00:00:00", 10 + i, float(i), "v", "yes") for i in range(200)]
    events, own = log(spark, rows)
    plain = C.case_state(events, own).collect(), C.future_preview(events, own).collect()
    hot = C.attach.__defaults__
    monkeypatch.setattr(C.attach, "__defaults__", (5,))
    try:
        split = C.case_state(events, own).collect(), C.future_preview(events, own).collect()
    finally:
        monkeypatch.setattr(C.attach, "__defaults__", hot)
    assert plain == split and plain[1][0]["future_sequence_preview"] == C.ARROW.join(f"e{i}" for i in range(12))


def test_large_dictionaries_are_joined_without_gathering_hot_levels(spark, monkeypatch):
    rows = [("hot", 1.0)] * 300 + [(f"l{i % 40}", 1.0) for i in range(400)] + [("once", 1.0), (None, 1.0)]
    d = spark.createDataFrame(rows, "k string, x double")
    new = d.distinct().unionByName(spark.createDataFrame([("unseen", 1.0)], d.schema))
    slots = lambda f: {r["k"]: [i for i, v in enumerate(r["features"].toArray()) if i and v] for r in f.transform(new).collect()}
    small = M.fit_features(d, ["x"], ["k"])
    want = slots(small)
    monkeypatch.setattr(M, "SMALL_ROWS", 3)
    monkeypatch.setattr(M, "HOT_LEVELS", 10)
    large = M.fit_features(d, ["x"], ["k"])
    assert slots(large) == want and want["unseen"] == [] and large.sizes == small.sizes
    assert want["once"] == want[None] and len({tuple(v) for v in want.values()}) == 43


def test_score_equations_hold_at_the_optimum_only(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(float(rng.gauss(0, 1)), rng.choice("abc"), rng.choice(["SAFE_TO_EXECUTE", "NOT_SAFE_TO_EXECUTE"])) for _ in range(400)], "x double, k string, y string")
    m = M.fit_safety(d, d, "y", ["x"], ["k"])
    gaps = m.equations().collect()
    assert {(r["feature"], r["level"]) for r in gaps} == {("x", None), ("k", "a"), ("k", "b"), ("k", "c")} and max(abs(r["gap"]) for r in gaps) < 1e-4
    worse = M.logistic(400, max_iter=1).fit(m.prepared)
    assert max(abs(x) for x in M.score_gaps(worse, m.prepared)[1]) > 1e-4
    with pytest.raises(RuntimeError):
        M.converged(M.logistic(400, max_iter=1), m.prepared)


def test_numeric_stats_count_equal_values_once(spark, monkeypatch):
    rows = [(float(i % 3), None if i % 4 == 0 else 7.0, None, float("nan") if i % 5 == 0 else float(i)) for i in range(300)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    written, keep = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df: written.append(keep(df)) or written[-1])
    got = {r["feature"]: (r["median"], r["mean"], r["spread"]) for r in M.numeric_stats(d, ["a", "b", "c", "d"]).collect()}
    # 3 values of a, 7 and NULL of b, NULL of c, 240 values and NULL of d
    assert [w.count() for w in written] == [3 + 2 + 1 + 241]
    for i, c in enumerate("abcd"):
        x = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        median = float(np.median(x)) if x else 0.0
        filled = [r[i] if r[i] is not None and r[i] == r[i] else median for r in rows]
        assert np.allclose(got[c], (median, np.mean(filled), np.std(filled)), atol=1e-9)


def test_model_queries_write_only_what_they_read(spark, monkeypatch):
    from waypoint.plans import model_queries as MQ

    wide = ["p_cal_execute", "predicted_action", "w_e", "p_safe_t1", "outcome_future_gr"]
    monkeypatch.setattr(MQ, "episodes", lambda spark, sf: spark.range(3).select(*[F.col("id").alias(c) for c in [*MQ.COLUMNS, *wide]]))
    assert MQ.table(spark, "").columns == MQ.COLUMNS
