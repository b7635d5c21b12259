"""Softmax fits of several training and input sets against MLlib, one by one."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from waypoint.operators import models as M
from waypoint.operators import softmax as X

NUM, SETS = ["a", "b", "same", "flat"], {"all": ["a", "b", "same", "flat", "k"], "some": ["a", "k"]}
TRAIN = {"low": "u < 0.6", "high": "u >= 0.3", "pair": "u < 0.5 AND y <> 1"}


def rows(spark):
    rng = random.Random(7)
    out = []
    for i in range(600):
        a, k, u = rng.gauss(2, 3), rng.choice("aaabbc"), rng.random()
        y = None if i % 29 == 0 else max(0, min(2, round(a / 3 + (k == "b") + rng.gauss(0, 0.8))))
        out.append((i, a if i % 7 else None, float("nan") if i % 11 == 0 else rng.expovariate(0.1), a if i % 7 else None, 4.0, "late" if u > 0.9 else k if i % 13 else None, u, y))
    return spark.createDataFrame(out, "id int, a double, b double, same double, flat double, k string, u double, y int").repartition(3).localCheckpoint()


def study(d, classes=3):
    return X.prepare(d, F.col("y").cast("double"), classes, {n: F.expr(c) for n, c in TRAIN.items()}, SETS, NUM, ["k"], ["id", "u", "y"])


def test_models_of_one_table_equal_single_fits(spark, monkeypatch):
    d, passes, one = rows(spark), [], X.Study._passed
    s = study(d)
    monkeypatch.setattr(X, "BLOCK", 64)
    monkeypatch.setattr(X.Study, "_passed", lambda self, *a: passes.append(1) or one(self, *a))
    gaps = s.fit(100)
    assert len(s.models) == 6 and len(passes) < 20  # for all models together; a first-order fit takes more for one
    assert max(gaps) < 1e-4
    got = {r["id"]: r for r in s.scored({"low": F.expr("u >= 0.6"), "high": F.expr("u < 0.3"), "pair": F.expr("u >= 0.5")}, ["id"]).collect()}
    tests = {"low": "u >= 0.6", "high": "u < 0.3", "pair": "u >= 0.5"}
    assert sorted(got) == sorted(r["id"] for r in d.where("u >= 0.5 OR u < 0.3").collect())
    for t, where in list(TRAIN.items())[:2]:
        m = M.matrix(d, F.expr(where), NUM, ["k"], ["id", "u", "y"])
        for name, inputs in SETS.items():
            model, scored, audit = M.fit_masked(m, F.col("y").cast("double"), F.expr(where), inputs, "multinomial", 2000)
            i = next(i for i, x in enumerate(s.models) if (x.training, x.inputs) == (t, name))
            own = s.audit(i, 100)
            assert {k: own[k] for k in ("training_rows", "converged", "falling")} == {k: audit[k] for k in ("training_rows", "converged", "falling")}
            assert own["inputs"] == model.numFeatures and own["first_objective"] == pytest.approx(audit["first_objective"], abs=1e-4)
            assert audit["last_objective"] - 1e-4 < own["last_objective"] < audit["last_objective"] + 1e-9
            want = {r["id"]: r["p"] for r in scored.where(tests[t]).select("id", vector_to_array("_prob").alias("p")).collect()}
            assert {k for k, r in got.items() if r[f"_prob_{i}"] is not None} == set(want)
            assert max(np.abs(np.subtract(got[k][f"_prob_{i}"], p)).max() for k, p in want.items()) < 0.02


def test_a_class_without_training_rows_has_no_share(spark):
    s = study(rows(spark))
    gaps = s.fit(100)
    pair = [i for i, m in enumerate(s.models) if m.training == "pair"]
    assert [s.models[i].live for i in pair] == [[0, 2]] * 2 and max(gaps[i] for i in pair) < 1e-4
    for r in s.scored({"low": F.lit(False), "high": F.lit(None), "pair": F.lit(True)}, ["id"]).collect():
        p = r[f"_prob_{pair[0]}"]
        assert p[1] == 0.0 and sum(p) == pytest.approx(1.0, abs=1e-12) and r["_prob_0"] is None


def test_a_fit_at_its_limit_and_an_empty_training_set_raise(spark):
    d = rows(spark)
    with pytest.raises(RuntimeError):
        study(d).fit(1)
    with pytest.raises((ValueError, KeyError)):
        X.prepare(d, F.col("y").cast("double"), 3, {"none": F.expr("u > 2")}, SETS, NUM, ["k"], ["id"])


def test_statistics_of_training_sets_come_from_one_count(spark, monkeypatch):
    d, written, keep = rows(spark), [], M.materialize
    single = {n: M.numeric_stats(d.where(c), ["a", "b", "flat"]).collect() for n, c in TRAIN.items()}
    monkeypatch.setattr(M, "materialize", lambda df: written.append(df.columns) or keep(df))
    both = M.training_stats(d, ["a", "b", "flat"], {n: F.expr(c) for n, c in TRAIN.items()})
    assert sum("x" in c for c in written) == 1
    for n, want in single.items():
        got = {r["feature"]: tuple(r)[1:] for r in both[n].collect()}
        assert set(got) == {"a", "b", "flat"}
        for r in want:
            assert np.allclose(got[r["feature"]], tuple(r)[1:], atol=1e-9)


def test_action_models_of_many_levels_are_fitted_one_by_one(spark, monkeypatch):
    from waypoint.plans import model_queries as MQ

    rng = random.Random(3)
    d = spark.range(400).select(*[F.lit(None).cast("string").alias(c) for c in ("case_id", "family", "target")], F.lit(0.5).alias("p_safe_t0_raw"),
        F.expr("CASE WHEN id % 4 = 0 THEN 'test' ELSE 'train' END").alias("part"), F.lit("early").alias("regime"), F.concat(F.lit("c"), F.col("id") % 5).alias("item_category"),
        F.element_at(F.array(*[F.lit(c) for c in MQ.CLS]), (F.abs(F.hash("id")) % 4 + 1).cast("int")).alias("expected_action_reference"),
        *[((F.col("id") * rng.randrange(3, 999)) % 31).cast("double").alias(c) for c in MQ.NUM]).select(*MQ.COLUMNS)
    monkeypatch.setattr(MQ, "table", lambda spark, sf: d)
    monkeypatch.setattr(MQ, "REGIMES", {"iid": MQ.REGIMES["iid"]})
    monkeypatch.setattr(M, "FEATURE_SETS", {"PROCESS_ONLY": M.PROCESS_FEATURES[:4]})
    show = lambda: [(r, n, {k: a[k] for k in ("inputs", "training_rows", "converged", "falling")}, round(a["largest_gap"], 3), s.count(), sorted(map(str, s.select("expected_action_reference").distinct().collect()))) for r, n, a, s in MQ.action_fits(spark, "")]
    together = show()
    monkeypatch.setattr(X, "MAX_PARAMETERS", 10)
    assert show() == together and together[0][3] == 0 and together[0][4] == 100
