"""Boosted trees against MLlib's, and cut points against a plain walk over the sorted values."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from waypoint.functions.scalars import SAFE, UNSAFE
from waypoint.operators import boosting as B
from waypoint.operators import models as M


def rows(spark, n=900):
    rng = random.Random(11)
    out = []
    for i in range(n):
        a, b, k = rng.gauss(0, 2), rng.expovariate(0.2), rng.choice("aaaabbbcc")
        c = 0.0 if rng.random() < 0.5 else rng.random()
        y = SAFE if a + (k == "b") * 2 + 3 * c + rng.gauss(0, 1) > 1 else UNSAFE
        out.append((i, a if i % 7 else None, b if i % 9 else float("nan"), c, float(rng.randrange(4)), 1.5, "late" if i >= 700 and i % 5 == 0 else k if i % 13 else None, y))
    return spark.createDataFrame(out, "id int, a double, b double, c double, d double, flat double, k string, y string").repartition(3, "id").localCheckpoint()


NUM = ["a", "b", "c", "d", "flat"]


def test_trees_are_those_of_mllib(spark):
    d = rows(spark)
    train, test = d.where("id < 700"), d.where("id >= 700")
    m = M.fit_safety(train, test, "y", NUM, ["k"], "boosted", rounds=12)
    assert isinstance(m.model, B.Boosted) and len(m.model.trees) == 12 and m.audit()["iterations"] == 12 and m.rows == 700
    want = GBTClassifier(maxIter=12, stepSize=0.05, maxBins=255, minInstancesPerNode=30, seed=1).fit(
        m.features.transform(train.withColumn("label", (F.col("y") == SAFE).cast("double"))).select("features", "label"))
    for part in (train, test):
        p = {r["id"]: r["p"] for r in want.transform(m.features.transform(part)).select("id", vector_to_array("probability")[1].alias("p")).collect()}
        got = {r["id"]: r for r in m.score(part).collect()}
        assert set(got) == set(p) and max(abs(got[i]["p_safe_raw"] - p[i]) for i in p) < 1e-6
        assert len(set(p.values())) > 20 and all(0 <= r["p_safe_cal"] <= 1 for r in got.values())


def test_trees_do_not_depend_on_the_dealing_of_rows(spark, monkeypatch):
    f = M.fit_features(rows(spark), NUM, ["k"])
    numbers, slots = [f"_n_{c}" for c in NUM], [("_i_k", f.sizes["k"][0])]
    plain = f.plain(rows(spark).withColumn("label", (F.col("y") == SAFE).cast("double"))).select("id", "label", *numbers, "_i_k")
    one = B.fit(plain.repartition(1).localCheckpoint(), numbers, slots, rounds=5)
    monkeypatch.setattr(B, "BLOCK", 40)
    monkeypatch.setattr(B, "ANEW", 2)
    monkeypatch.setattr(B, "DIRECT", 2)
    other = B.fit(plain.repartition(6, "id").localCheckpoint(), numbers, slots, rounds=5)
    for x, y in zip(one.trees, other.trees, strict=True):
        assert x.inputs.tolist() == y.inputs.tolist() and x.places.tolist() == y.places.tolist() and x.values.tolist() == y.values.tolist()


def test_rows_without_a_split_get_one_leaf(spark):
    d = spark.range(50).select((F.col("id") % 2).cast("double").alias("label"), F.lit(1.0).alias("x"), F.lit(0.0).alias("s")).localCheckpoint()
    m = B.fit(d, ["x"], [("s", 1)], rounds=3)
    assert all((t.inputs < 0).all() and t.values[0] == 0 for t in m.trees)
    assert {r["q"] for r in m.probabilities(d, ["label"], ["p", "q"]).collect()} == {0.5}


def plain_cuts(values, bins):
    seen, n = np.unique(values, return_counts=True)
    bins = min(bins, len(values))
    if len(seen) <= bins:
        return (seen[:-1] + seen[1:]) / 2
    out, count, stride = [], n[0], len(values) / bins
    target = stride
    for i in range(1, len(seen)):
        before, count = count, count + n[i]
        if abs(before - target) < abs(count - target):
            out.append((seen[i - 1] + seen[i]) / 2)
            target += stride
    return np.array(out)


@pytest.mark.parametrize("bins", [4, 17, 60, 5000])
def test_cut_points_are_those_of_a_walk(spark, bins):
    rng = np.random.default_rng(5)
    table = {"even": np.arange(1020.0), "heavy": np.where(rng.random(1020) < 0.6, 3.0, np.arange(1020.0) / 100), "few": rng.integers(0, 9, 1020).astype(float),
             "last": np.where(np.arange(1020) < 200, np.arange(1020.0), 999.0), "same": np.full(1020, 2.0)}
    d = spark.createDataFrame(list(zip(*[x.tolist() for x in table.values()])), ", ".join(f"{n} double" for n in table)).repartition(3).localCheckpoint()
    for found, (n, x) in zip(B.cut_points(d, list(table), bins), table.items(), strict=True):
        assert found.tolist() == pytest.approx(plain_cuts(x, bins).tolist()), n
