import json

import pytest
from pyspark.sql import functions as F

from waypoint.operators.checks import checked_join
from waypoint.sources import spec as P
from waypoint.sources import tables as T
from waypoint.sources.xes import read_log

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log>
<trace><string key="concept:name" value="c1"/><string key="Vendor" value="v1"/><boolean key="Goods Receipt" value="true"/>
<event><string key="concept:name" value="Create Purchase Order Item"/><date key="time:timestamp" value="2018-01-02T10:00:00.000+00:00"/><float key="Cumulative net worth (EUR)" value="12.5"/><string key="User" value="u1"/></event>
<event><string key="concept:name" value="Record Invoice Receipt"/><date key="time:timestamp" value="2018-01-05T10:00:00.000+00:00"/><float key="Cumulative net worth (EUR)" value="13"/></event></trace>
<trace><string key="concept:name" value="c2"/><event><string key="concept:name" value="Clear Invoice"/><date key="time:timestamp" value="not a date"/></event></trace>
</log>"""


def test_xes_log(spark, tmp_path):
    path = tmp_path / "log.xes"
    path.write_text(XES)
    rows = read_log(spark, str(path), ["Vendor", "Goods Receipt"], ["User"]).orderBy("case:concept:name", "ord").collect()
    assert [(r["case:concept:name"], r["ord"], r["concept:name"]) for r in rows] == [("c1", 0, "Create Purchase Order Item"), ("c1", 1, "Record Invoice Receipt"), ("c2", 0, "Clear Invoice")]
    assert rows[0]["Cumulative net worth (EUR)"] == 12.5 and rows[0]["case:Vendor"] == "v1" and rows[0]["User"] == "u1"
    assert rows[1]["time:timestamp"].day == 5 and rows[2]["time:timestamp"] is None and rows[2]["case:Vendor"] is None


def test_xes_log_feeds_the_case_state(spark, tmp_path):
    from waypoint.operators.cases import Log, case_state

    path = tmp_path / "log.xes"
    path.write_text(XES)
    log = read_log(spark, str(path)).withColumn("time:timestamp", F.col("`time:timestamp`").cast("timestamp_ntz"))
    r = case_state(log, Log()).collect()
    assert len(r) == 1 and r[0].vendor_id == "v1" and r[0].goods_receipt_required is True and r[0].po_to_invoice_days == 3.0


def test_csv_keeps_ids_as_text_and_nan_is_missing(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,x\n007,NaN\n008,1.5\n")
    d = T.load_table(spark, str(tmp_path / "t.csv"), "id string, x double").orderBy("id").collect()
    assert [tuple(r) for r in d] == [("007", None), ("008", 1.5)]
    with pytest.raises(ValueError):
        T.load_table(spark, str(tmp_path / "t.txt"))


def test_regime_partition_is_pruned(spark, tmp_path):
    path = str(tmp_path / "scores")
    T.write_table(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "regime string, x int"), path, ["regime"])
    d = T.read_regime(spark, path, "b")
    assert d.count() == 2 and "PartitionFilters: [isnotnull(regime" in d._jdf.queryExecution().executedPlan().toString()


def test_replace_table_reads_its_own_target(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    assert T.replace_table(spark.read.parquet(path).where("id < 4"), path) == 4
    assert spark.read.parquet(path).count() == 4


def test_spec_and_grids(spark, tmp_path):
    body = {"status": "FROZEN", "gate_delta": 0.05, "costs": {"c_G": 0.02, "c_H": 0.1, "c_A": 0.5, "rho_H": 0.0},
            "risk": {"tau0": 0.95, "beta0": 0.05, "tau1": 0.95, "beta1": 0.05},
            "grid": {"tau0": [0.9, 0.95, 0.97, 0.99], "beta0": [0.01, 0.02, 0.05, 0.1, 0.2], "tau1": [0.9, 0.95, 0.97, 0.99], "beta1": [0.01, 0.02, 0.05, 0.1]}}
    path = tmp_path / "spec.json"
    path.write_text(json.dumps(body))
    s = P.read_spec(spark, str(path))
    assert P.frontier_grid(s).count() == 320 and P.reference_params(s).tau0 == 0.95
    path.write_text(json.dumps({**body, "gate_delta": 0.1}))
    with pytest.raises(ValueError):
        P.read_spec(spark, str(path))
    pts = P.cost_points([0.01, 0.1], [0.05, 0.1], [0.2, 0.08])
    assert pts == [(0.01, 0.05, 0.2), (0.01, 0.05, 0.08), (0.01, 0.1, 0.2)]


def test_checked_join_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(1, "y"), (1, "z")], "k int, b string")
    with pytest.raises(ValueError):
        checked_join(a, b, ["k"], "many_to_one")
    assert checked_join(b, a, ["k"], "many_to_one", marker="hit").where("hit").count() == 2
