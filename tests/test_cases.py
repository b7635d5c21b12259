"""Hand-written event tables for the traps of case reconstruction."""

from datetime import datetime

from pyspark.sql import functions as F

from waypoint.operators import cases as C

ROLES = dict(C.ACTIVITIES)
LOG = C.Log(case="c", activity="a", ts="t", order="o", value="v", attributes={"k": "vendor_id"}, flags={"f": "goods_receipt_required"})
INV, GR, PO, CLEAR, CANCEL = (ROLES[r] for r in ("invoice_receipt", "goods_receipt", "create_po", "clear_invoice", "cancel_invoice"))


def day(n, h=0):
    return datetime(2024, 1, n, h)


def events(spark, rows):
    full = [(c, a, t, o, v, f"k{c}", "true") for c, a, t, o, v in rows]
    return spark.createDataFrame(full, "c string, a string, t timestamp_ntz, o int, v double, k string, f string")


def state(spark, rows):
    return {r["case_id"]: r for r in C.case_state(events(spark, rows), LOG).collect()}


def test_ties_at_the_decision_use_file_order(spark):
    rows = [("x", GR, day(1), 0, 5.0), ("x", INV, day(1), 1, 7.0), ("x", GR, day(1), 2, 9.0), ("x", CLEAR, day(2), 3, None)]
    r = state(spark, rows)["x"]
    assert (r.events_available_at_t0, r.events_future_after_t0) == (2, 2)
    assert r.latest_gr_value_before_t0_eur == 5.0 and r.first_future_gr_value_eur == 9.0
    assert r.n_invoice_receipts_at_t0_history == 1 and r.outcome_eventually_cleared


def test_first_value_skips_missing_but_first_row_does_not(spark):
    rows = [("x", PO, day(1), 0, None), ("x", PO, day(2), 1, 5.0), ("x", INV, day(3), 2, 6.0), ("x", GR, day(4), 3, None), ("x", GR, day(5), 4, 8.0)]
    r = state(spark, rows)["x"]
    assert r.po_value_initial_eur == 5.0
    assert r.first_future_gr_value_eur is None and r.latest_future_gr_value_eur == 8.0
    assert r.gather_gr_possible and not r.gather_gr_has_value
    assert abs(r.inv_po_abs_rel_diff - 0.2) < 1e-12


def test_undated_events_are_in_neither_past_nor_future(spark):
    rows = [("x", PO, None, 0, 1.0), ("x", INV, day(2), 1, 1.0), ("y", INV, None, 0, 1.0)]
    s = state(spark, rows)
    assert set(s) == {"x"}
    r = s["x"]
    assert (r.events_total_case, r.events_available_at_t0, r.events_future_after_t0) == (2, 1, 0)
    assert not r.po_created_at_t0


def test_zero_base_gives_no_ratio(spark):
    r = state(spark, [("x", PO, day(1), 0, 0.0), ("x", INV, day(2), 1, 3.0)])["x"]
    assert r.inv_po_abs_rel_diff is None


def test_later_events_never_change_the_past(spark):
    base = [("x", PO, day(1), 0, 4.0), ("x", GR, day(2), 1, 4.0), ("x", INV, day(3), 2, 4.0)]
    a, b = state(spark, base)["x"], state(spark, [*base, ("x", CANCEL, day(4), 3, 1.0), ("x", GR, day(5), 4, 2.0)])["x"]
    past = [c for c in a.asDict() if c.endswith(("before_t0", "at_t0", "_t0_eur", "at_t0_history")) or c.startswith("had_")]
    assert past and all(a[c] == b[c] for c in past)


def test_horizon_is_strict_in_time_and_closed_at_the_end(spark):
    rows = [("x", INV, day(1), 0, 1.0), ("x", CANCEL, day(1), 1, 1.0), ("x", CLEAR, day(3), 2, 1.0)]
    h = {r.horizon_days: r for r in C.horizon_outcomes(events(spark, rows), LOG, ["cancel_invoice"], ["clear_invoice"], [1, 2]).collect()}
    assert not h[1].adverse and not h[1].cleared
    assert not h[2].adverse and h[2].cleared


def test_hot_cases_are_salted_with_the_same_result(spark):
    rows = [("hot", PO, day(1), 0, 3.0)] + [("hot", GR, day(2), i, float(i)) for i in range(1, 60)] + [("hot", INV, day(3), 60, 3.0)]
    rows += [("hot", GR, day(4), i, float(i)) for i in range(61, 120)] + [("cold", INV, day(1), 0, 1.0)]
    n = LOG.normal(events(spark, rows))
    cuts = C.cut_points(n, LOG.is_role("invoice_receipt"))
    parts = {"past": C.count_where(C.past()), "last": C.last_value(C.past() & LOG.is_role("goods_receipt")), "next": C.first_row_value(C.future())}
    salted = C.attach(n, cuts, hot_rows=10)
    assert salted.where("case_id = 'hot'").select("_salt").distinct().count() > 3
    a = C.combine(salted, parts).orderBy("case_id").collect()
    b = C.combine(C.attach(n, cuts), parts).orderBy("case_id").collect()
    assert a == b and a[1].past == 61 and a[1].last == 59.0 and a[1].next == 61.0


def test_second_cut_and_preview(spark):
    rows = [("x", INV, day(1), 0, 4.0), ("x", CANCEL, day(2), 1, 1.0), ("x", GR, day(2), 2, 5.0), ("x", CLEAR, day(3), 3, None)]
    t = C.transition_state(events(spark, rows), LOG).first()
    assert (t.events_between_t0_t1_inclusive_t1, t.events_after_t1) == (2, 1)
    assert t.between_any_non_gr_event and t.after_t1_eventually_cleared and not t.after_t1_invoice_cancelled
    assert C.future_preview(events(spark, rows), LOG, 2).first().future_sequence_preview == f"{CANCEL} -> {GR}"


def test_null_flags_read_as_false(spark):
    from waypoint.functions.scalars import any_of, truthy

    d = spark.createDataFrame([(None, "yes"), ("false", "0"), ("T", None)], "a string, b string")
    got = [tuple(r) for r in d.select(truthy("a"), truthy("b"), any_of([F.col("a") == "T"])).collect()]
    assert got == [(False, True, False), (False, False, False), (True, False, True)]
