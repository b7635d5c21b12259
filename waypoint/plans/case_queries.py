"""Case reconstruction from the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scalars as S
from ..operators import cases as C
from ..operators import ordered as O
from ..sources.tables import table
from .registry import query, r, rounded, rs
from .tables import EV, LOG, ROLES, event_log

D = "86400000000.0"


def us(name: str):
    return F.unix_micros(F.col(name).cast("timestamp")).alias(f"{name}_us")


def is_sql(*roles: str) -> str:
    return "event_type IN (" + ", ".join(f"'{ROLES[x]}'" for x in roles) + ")"


def any_sql(cond: str) -> str:
    return f"coalesce(bool_or({cond}), false)"


def n_sql(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def days_sql(a: str, b: str) -> str:
    return rs(f"(epoch_us({b}) - epoch_us({a})) / {D}")


def gap_sql(a: str, b: str) -> str:
    return rs(f"abs({a} - {b}) / CASE WHEN abs({b}) > 1e-12 THEN abs({b}) END")


@query("e01_j05_cases_with_activity", f"WITH {EV} SELECT case_id, count(*) AS n FROM ev WHERE case_id IN (SELECT case_id FROM ev WHERE event_type = 'purchase') GROUP BY 1")
def _(spark, sf):
    return C.cases_with_activity(event_log(spark, sf), LOG, "invoice_receipt").groupBy("case_id").agg(F.count("*").alias("n"))


@query("e02_decision_point", f"WITH {EV} SELECT case_id, epoch_us(t0) AS t0_us, ord0 FROM t0")
def _(spark, sf):
    rows = LOG.normal(event_log(spark, sf))
    cut = C.cut_points(rows, LOG.is_role("invoice_receipt"))
    return cut.select("case_id", F.unix_micros(F.col("cut_ts").cast("timestamp")).alias("t0_us"), F.col("cut_ord").alias("ord0"))


@query("e03_j10_split_at_event", f"WITH {EV} SELECT case_id, count(*) FILTER (WHERE past) AS n_past, count(*) FILTER (WHERE fut) AS n_future FROM ex GROUP BY 1")
def _(spark, sf):
    salted, _ = C.prepared(event_log(spark, sf), LOG)
    return C.combine(salted, {"n_past": C.count_where(C.past()), "n_future": C.count_where(C.future())})


STATIC = {"vendor_id": "user_id::VARCHAR", "sub_spend_area": "arg_min(props, k)"}
T0_SQL: dict[str, str] = {
    "vendor_id": "any_value(user_id)::VARCHAR", "sub_spend_area": "arg_min(props, k)",
    "goods_receipt_required": "CASE any_value(flag_text) WHEN 'yes' THEN true WHEN 'N' THEN false END",
    "events_total_case": "count(*)", "events_available_at_t0": n_sql("past"), "events_future_after_t0": n_sql("fut"),
    "po_value_initial_eur": f"arg_min(value, k) FILTER (WHERE past AND {is_sql('create_po')})",
    "invoice_value_t0_eur": "arg_min_null(value, k) FILTER (WHERE k = k0)",
    "latest_gr_value_before_t0_eur": f"arg_max(value, k) FILTER (WHERE past AND {is_sql('goods_receipt')})",
    "gr_available_at_t0": any_sql(f"past AND {is_sql('goods_receipt')}"),
    "vendor_invoice_seen_at_t0": any_sql(f"past AND {is_sql('vendor_invoice')}"),
    "po_created_at_t0": any_sql(f"past AND {is_sql('create_po')}"),
}
for _n, _r in C.HISTORY.items():
    T0_SQL[f"n_{_n}_{'at_t0_history' if _r == 'invoice_receipt' else 'before_t0'}"] = n_sql(f"past AND {is_sql(_r)}")
for _n, _rs in C.HISTORY_FLAGS.items():
    T0_SQL[f"had_{_n}_before_t0"] = any_sql(f"past AND {is_sql(*_rs)}")
OUTCOMES = {
    "outcome_eventually_cleared": "clear_invoice", "outcome_invoice_cancelled_after_t0": "cancel_invoice",
    "outcome_payment_block_removed_after_t0": "remove_payment_block", "outcome_payment_block_set_after_t0": "set_payment_block",
    "outcome_future_gr": "goods_receipt", "outcome_future_gr_cancel": "cancel_gr", "outcome_future_price_change": "price_change",
    "outcome_future_quantity_change": "quantity_change", "outcome_subsequent_invoice": "subsequent_invoice",
    "outcome_additional_invoice_receipt": "invoice_receipt", "outcome_future_service_entry": "service_entry",
}
for _n, _r in OUTCOMES.items():
    T0_SQL[_n] = any_sql(f"fut AND {is_sql(_r)}")
EXC = [n for n in OUTCOMES if n not in ("outcome_eventually_cleared", "outcome_future_gr", "outcome_additional_invoice_receipt", "outcome_future_service_entry")]
T0_SQL |= {
    "n_future_goods_receipts": n_sql(f"fut AND {is_sql('goods_receipt')}"),
    "first_future_gr_value_eur": f"arg_min_null(value, k) FILTER (WHERE fut AND {is_sql('goods_receipt')})",
    "latest_future_gr_value_eur": f"arg_max_null(value, k) FILTER (WHERE fut AND {is_sql('goods_receipt')})",
    "first_cancel_invoice_value_eur": f"arg_min_null(value, k) FILTER (WHERE fut AND {is_sql('cancel_invoice')})",
    "first_additional_invoice_value_eur": f"arg_min_null(value, k) FILTER (WHERE fut AND {is_sql('invoice_receipt')})",
    "first_subsequent_invoice_value_eur": f"arg_min_null(value, k) FILTER (WHERE fut AND {is_sql('subsequent_invoice')})",
}
T0_TIMES = {
    "decision_time": "any_value(t0)", "case_start_time": "min(ts)", "case_end_time": "max(ts)",
    "first_future_gr_time": f"min(ts) FILTER (WHERE fut AND {is_sql('goods_receipt')})",
    "last_future_gr_time": f"max(ts) FILTER (WHERE fut AND {is_sql('goods_receipt')})",
    "first_clear_time": f"min(ts) FILTER (WHERE fut AND {is_sql('clear_invoice')})",
    "first_payment_block_removal_time": f"min(ts) FILTER (WHERE fut AND {is_sql('remove_payment_block')})",
    "first_payment_block_set_time": f"min(ts) FILTER (WHERE fut AND {is_sql('set_payment_block')})",
    "first_invoice_cancel_time": f"min(ts) FILTER (WHERE fut AND {is_sql('cancel_invoice')})",
    "first_additional_invoice_time": f"min(ts) FILTER (WHERE fut AND {is_sql('invoice_receipt')})",
    "first_subsequent_invoice_time": f"min(ts) FILTER (WHERE fut AND {is_sql('subsequent_invoice')})",
    "first_future_price_change_time": f"min(ts) FILTER (WHERE fut AND {is_sql('price_change')})",
    "first_future_quantity_change_time": f"min(ts) FILTER (WHERE fut AND {is_sql('quantity_change')})",
}
T0_MORE = {
    "_po": f"min(ts) FILTER (WHERE past AND {is_sql('create_po')})",
    "_vi": f"min(ts) FILTER (WHERE past AND {is_sql('vendor_invoice')})",
    "_gr": f"max(ts) FILTER (WHERE past AND {is_sql('goods_receipt')})",
}
STATE = f"""WITH {EV}, cs AS (SELECT case_id, {', '.join(f'{e} AS {n}' for n, e in {**T0_SQL, **T0_TIMES, **T0_MORE}.items())} FROM ex GROUP BY case_id)"""
T0_DERIVED = {
    "inv_po_abs_rel_diff": gap_sql("invoice_value_t0_eur", "po_value_initial_eur"),
    "inv_gr_abs_rel_diff": gap_sql("invoice_value_t0_eur", "latest_gr_value_before_t0_eur"),
    "po_to_invoice_days": days_sql("_po", "decision_time"), "vendor_invoice_to_recorded_invoice_days": days_sql("_vi", "decision_time"),
    "last_gr_to_invoice_days": days_sql("_gr", "decision_time"), "time_to_clear_days": days_sql("decision_time", "first_clear_time"),
    "time_to_first_future_gr_days": days_sql("decision_time", "first_future_gr_time"), "gather_gr_possible": "outcome_future_gr",
    "gather_gr_has_value": "first_future_gr_value_eur IS NOT NULL", "outcome_any_post_t0_exception": " OR ".join(EXC),
    "post_gather_inv_first_gr_abs_rel_diff": gap_sql("invoice_value_t0_eur", "first_future_gr_value_eur"),
    "post_gather_inv_latest_gr_abs_rel_diff": gap_sql("invoice_value_t0_eur", "latest_future_gr_value_eur"),
    "transaction_exposure_eur": "abs(po_value_initial_eur)", "decision_year": "year(decision_time)::INT",
    "decision_month": "strftime(decision_time, '%Y-%m')", "decision_activity": "'purchase'",
}


def state_out(df):
    times = [n for n, t in df.dtypes if t == "timestamp_ntz"]
    rest = [n for n in df.columns if n not in times]
    return rounded(df.select(*rest, *[us(n) for n in times]))


@query("e13_case_state", f"""{STATE} SELECT case_id, {', '.join(T0_SQL)}, {', '.join(f'epoch_us({n}) AS {n}_us' for n in T0_TIMES)},
 {', '.join(f'({e}) AS {n}' for n, e in T0_DERIVED.items())} FROM cs""")
def _(spark, sf):
    return state_out(C.case_state(event_log(spark, sf), LOG))


@query("e07_e08_value_reads", f"""WITH {EV} SELECT case_id,
 arg_min(value, k) FILTER (WHERE past) AS first_value, arg_max(value, k) FILTER (WHERE past) AS last_value,
 arg_min_null(value, k) FILTER (WHERE past) AS value_at_first, arg_max_null(value, k) FILTER (WHERE past) AS value_at_last,
 epoch_us(min(ts) FILTER (WHERE fut)) AS first_us, epoch_us(max(ts) FILTER (WHERE fut)) AS last_us,
 arg_min(event_id, k) FILTER (WHERE {is_sql('goods_receipt')}) AS first_order FROM ex GROUP BY 1""")
def _(spark, sf):
    salted, _ = C.prepared(event_log(spark, sf), LOG)
    d = C.combine(salted, {
        "first_value": C.first_value(C.past()), "last_value": C.last_value(C.past()),
        "value_at_first": C.first_row_value(C.past()), "value_at_last": C.last_row_value(C.past()),
        "first": C.first_time(C.future()), "last": C.last_time(C.future()), "first_order": C.first_order(LOG.is_role("goods_receipt"))})
    return d.select("*", us("first"), us("last")).drop("first", "last")


PREVIEW = """pv AS (SELECT case_id, string_agg(event_type, ' -> ' ORDER BY k) AS preview FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY k) AS pos FROM ex WHERE fut) WHERE pos <= 12 GROUP BY 1)"""


@query("e12_future_preview", f"WITH {EV}, {PREVIEW} SELECT case_id, coalesce(preview, '') AS future_sequence_preview FROM t0 LEFT JOIN pv USING (case_id)")
def _(spark, sf):
    return C.future_preview(event_log(spark, sf), LOG)


@query("e17_evidence_episodes", f"""{STATE} SELECT case_id, first_future_gr_value_eur, n_future_goods_receipts, {days_sql('decision_time', 'first_future_gr_time')} AS wait_days,
 outcome_eventually_cleared FROM cs WHERE outcome_future_gr""")
def _(spark, sf):
    s = C.case_state(event_log(spark, sf), LOG).where("gather_gr_possible")
    return s.select("case_id", "first_future_gr_value_eur", "n_future_goods_receipts", r("time_to_first_future_gr_days").alias("wait_days"), "outcome_eventually_cleared")


T1 = f"""tt AS (SELECT case_id, min(k) AS k1, min(ts) AS t1, arg_min(event_id, k) AS ord1 FROM ex WHERE fut AND {is_sql('goods_receipt')} GROUP BY 1),
e1 AS (SELECT ex.*, k1, t1, ord1, k <= k1 AS by1, (k > k0 AND k <= k1) AS btw, k > k1 AS aft FROM ex JOIN tt USING (case_id))"""
T1_SQL: dict[str, str] = {
    "t0_event_order": "any_value(ord0)", "t1_event_order": "any_value(ord1)", "events_total_case": "count(*)",
    "events_available_at_t0_exact": n_sql("past"), "events_between_t0_t1_inclusive_t1": n_sql("btw"),
    "events_available_at_t1_exact": n_sql("by1"), "events_after_t1": n_sql("aft"),
    "po_value_initial_eur": f"arg_min(value, k) FILTER (WHERE by1 AND {is_sql('create_po')})",
    "invoice_value_t0_eur": "arg_min_null(value, k) FILTER (WHERE k = k0)",
    "latest_gr_value_at_t1_eur": f"arg_max(value, k) FILTER (WHERE by1 AND {is_sql('goods_receipt')})",
    "first_gr_value_at_t1_eur": "arg_min_null(value, k) FILTER (WHERE k = k1)",
    "gr_available_at_t1": any_sql(f"by1 AND {is_sql('goods_receipt')}"),
    "vendor_invoice_seen_at_t1": any_sql(f"by1 AND {is_sql('vendor_invoice')}"),
    "po_created_at_t1": any_sql(f"by1 AND {is_sql('create_po')}"),
    "between_any_non_gr_event": any_sql(f"btw AND NOT {is_sql('goods_receipt')}"),
}
for _n, _r in C.HISTORY.items():
    T1_SQL[f"n_{_n}_by_t1"] = n_sql(f"by1 AND {is_sql(_r)}")
    T1_SQL[f"between_n_{_n}"] = n_sql(f"btw AND {is_sql(_r)}")
for _n, _rs in C.HISTORY_FLAGS.items():
    T1_SQL[f"had_{_n}_by_t1"] = any_sql(f"by1 AND {is_sql(*_rs)}")
AFTER = {
    "eventually_cleared": "clear_invoice", "invoice_cancelled": "cancel_invoice", "payment_block_removed": "remove_payment_block",
    "payment_block_set": "set_payment_block", "future_gr": "goods_receipt", "gr_cancel": "cancel_gr", "price_change": "price_change",
    "quantity_change": "quantity_change", "subsequent_invoice": "subsequent_invoice", "additional_invoice": "invoice_receipt", "service_entry": "service_entry",
}
for _n, _r in AFTER.items():
    T1_SQL[f"after_t1_{_n}"] = any_sql(f"aft AND {is_sql(_r)}")
T1_MORE = {
    "t0_time": "any_value(t0)", "t1_time": "any_value(t1)", "_po": f"min(ts) FILTER (WHERE by1 AND {is_sql('create_po')})",
    "_vi": f"min(ts) FILTER (WHERE by1 AND {is_sql('vendor_invoice')})", "_gr": f"max(ts) FILTER (WHERE by1 AND {is_sql('goods_receipt')})",
    "_cl": f"min(ts) FILTER (WHERE aft AND {is_sql('clear_invoice')})",
}
T1_STATE = f"WITH {EV}, {T1}, s1 AS (SELECT case_id, {', '.join(f'{e} AS {n}' for n, e in {**T1_SQL, **T1_MORE}.items())} FROM e1 GROUP BY case_id)"
T1_DERIVED = {
    "t0_time_us": "epoch_us(t0_time)", "t1_time_us": "epoch_us(t1_time)", "t1_same_timestamp_as_t0": "t0_time = t1_time",
    "elapsed_t0_to_t1_days": days_sql("t0_time", "t1_time"), "po_to_t1_days": days_sql("_po", "t1_time"),
    "vendor_invoice_to_t1_days": days_sql("_vi", "t1_time"), "last_gr_to_t1_days": days_sql("_gr", "t1_time"),
    "time_t1_to_clear_days": days_sql("t1_time", "_cl"),
    "after_t1_any_selected_exception": " OR ".join(f"after_t1_{n}" for n in ("invoice_cancelled", "payment_block_set", "gr_cancel", "price_change", "quantity_change", "subsequent_invoice")),
    "diag_inv_po_abs_rel_diff_t1": gap_sql("invoice_value_t0_eur", "po_value_initial_eur"),
    "diag_inv_gr_abs_rel_diff_t1": gap_sql("invoice_value_t0_eur", "latest_gr_value_at_t1_eur"),
}


@query("e18_e04_transition_state", f"{T1_STATE} SELECT case_id, {', '.join(T1_SQL)}, {', '.join(f'({e}) AS {n}' for n, e in T1_DERIVED.items())} FROM s1")
def _(spark, sf):
    return state_out(C.transition_state(event_log(spark, sf), LOG).drop("vendor_id", "sub_spend_area", "goods_receipt_required"))


CAND = f"""{STATE}, cand AS (SELECT *, first_future_gr_time AS t1 FROM cs WHERE NOT gr_available_at_t0 AND outcome_future_gr AND first_future_gr_value_eur IS NOT NULL)"""
BEF = " OR ".join(f"coalesce({c} < t1, false)" for c in C.TIMED_EVENTS.values())
SAM = " OR ".join(f"coalesce({c} = t1, false)" for c in C.TIMED_EVENTS.values())


@query("e19_transition_candidates", f"""{CAND} SELECT case_id, {', '.join(f'coalesce({c} < t1, false) AS {n}_before_t1' for n, c in C.TIMED_EVENTS.items())},
 {BEF} AS selected_intervening_event_before_t1, {SAM} AS selected_same_timestamp_order_ambiguity, t1 > decision_time AS t1_after_t0 FROM cand""")
def _(spark, sf):
    c = C.transition_candidates(C.case_state(event_log(spark, sf), LOG))
    return c.select("case_id", *[f"{n}_before_t1" for n in C.TIMED_EVENTS], "selected_intervening_event_before_t1", "selected_same_timestamp_order_ambiguity", "t1_after_t0")


@query("e20_timing_table", f"""{CAND} SELECT event, count(x) AS observed, count(*) FILTER (WHERE x < t1) AS before_t1, count(*) FILTER (WHERE x = t1) AS same_timestamp_as_t1,
 count(*) FILTER (WHERE x > t1) AS after_t1, {rs("100.0 * count(*) FILTER (WHERE x < t1) / count(*)")} AS pct_before_t1 FROM (
 {' UNION ALL '.join(f"SELECT '{n}' AS event, {c} AS x, t1 FROM cand" for n, c in C.TIMED_EVENTS.items())}) GROUP BY 1""")
def _(spark, sf):
    return rounded(C.timing_table(C.transition_candidates(C.case_state(event_log(spark, sf), LOG))))


@query("e21_transition_audit", f"""{CAND}, {T1}, a AS (SELECT cand.case_id, cand.t1 AS st, tt.t1 AS et, tt.t1 = cand.decision_time AS same FROM cand LEFT JOIN tt USING (case_id))
SELECT 'candidate_cases' AS "check", count(*) AS value FROM a UNION ALL SELECT 'exact_transition_rows', count(et) FROM a
UNION ALL SELECT 'candidate_t1_time_match', count(*) FILTER (WHERE et = st) FROM a UNION ALL SELECT 'candidate_t1_time_mismatch', count(*) FILTER (WHERE et <> st) FROM a
UNION ALL SELECT 'same_timestamp_t0_t1', count(*) FILTER (WHERE same) FROM a UNION ALL SELECT 'gr_available_at_t1_false', count(*) FROM tt LEFT JOIN ex USING (case_id) WHERE ex.case_id IS NULL""")
def _(spark, sf):
    ev = event_log(spark, sf)
    return C.transition_audit(C.transition_state(ev, LOG), C.transition_candidates(C.case_state(ev, LOG)))


HOR = [1, 2, 3]
HZ = f"""hz AS (SELECT case_id, any_value(t0) AS t0, {any_sql(f"past AND {is_sql('goods_receipt')}")} AS evidence_at_t0,
 {', '.join(f"{any_sql(f'''ts > t0 AND ts <= t0 + INTERVAL {h} DAY AND event_type = 'error' ''')} AS a{h}, {any_sql(f'''ts > t0 AND ts <= t0 + INTERVAL {h} DAY AND event_type = 'signup' ''')} AS c{h}" for h in HOR)}
 FROM ex GROUP BY case_id),
hl AS ({' UNION ALL '.join(f"SELECT case_id, t0, evidence_at_t0, {h} AS horizon_days, a{h} AS adverse, c{h} AS cleared FROM hz" for h in HOR)}),
ht AS (SELECT *, CASE WHEN NOT evidence_at_t0 OR adverse THEN 'NOT_SAFE_TO_EXECUTE' WHEN cleared THEN 'SAFE_TO_EXECUTE' ELSE 'AMBIGUOUS' END AS target FROM hl)"""


def horizons(spark, sf):
    h = C.horizon_outcomes(event_log(spark, sf), LOG, ["set_payment_block"], ["clear_invoice"], HOR)
    return h.withColumn("target", L.horizon_target(F.col("evidence_at_t0"), F.col("adverse"), F.col("cleared")))


@query("e22_horizon_outcomes", f"WITH {EV}, {HZ} SELECT case_id, horizon_days, evidence_at_t0, adverse, cleared, target FROM ht")
def _(spark, sf):
    return horizons(spark, sf).drop("decision_time")


@query("a58_label_transitions", f"""WITH {EV}, {HZ} SELECT a.target AS original_label, b.target AS horizon_label, b.horizon_days, count(*) AS cases
 FROM ht a JOIN ht b ON a.case_id = b.case_id WHERE a.horizon_days = 3 GROUP BY ALL""")
def _(spark, sf):
    h = horizons(spark, sf)
    wide = h.groupBy("case_id").pivot("horizon_days", HOR).agg(F.first("target"))
    rows = F.array(*[F.struct(F.lit(d).alias("horizon_days"), F.col(str(d)).alias("horizon_label")) for d in HOR])
    return wide.select(F.col("3").alias("original_label"), F.inline(rows)).groupBy("original_label", "horizon_label", "horizon_days").agg(F.count("*").alias("cases"))


@query("e23_order_inversions", """WITH z AS (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY (event_id * 7919) % 100003, event_id) AS p,
 year(ts)::INT AS year FROM events) SELECT year, count(*) AS events, count(*) FILTER (WHERE ts < p)::BIGINT AS order_inversions FROM z GROUP BY 1""")
def _(spark, sf):
    # the file order is shuffled on purpose so that inversions exist
    ev = table(spark, sf, "events").withColumn("case_id", F.col("user_id")).withColumn("flag_text", F.lit("yes"))
    ev = ev.withColumn("event_id", (F.col("event_id") * 7919 % 100003) * 1_000_000_000 + F.col("event_id"))
    return C.order_inversions(ev, LOG)


@query("e23_source_audit", f"""WITH {EV} SELECT case_id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-05' OR ts >= TIMESTAMP '2024-01-25') AS events_outside,
 coalesce(min(ts) FILTER (WHERE {is_sql('create_po')}) > any_value(t0), false) AS po_after_first_invoice, {rs(f"(epoch_us(max(ts)) - epoch_us(any_value(t0))) / {D}")} AS observed_span_days FROM ex GROUP BY 1""")
def _(spark, sf):
    return rounded(C.source_audit(event_log(spark, sf), LOG, "2024-01-05", "2024-01-25"))


@query("e24_maturity", """SELECT d AS min_followup_days, count(*) AS n FROM orders, (SELECT unnest([0, 365, 730, 1460]) AS d)
 WHERE (epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(o_orderdate)) / 86400000000.0 >= d GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    return C.mature(o, "o_orderdate", "o_orderdate", [0, 365, 730, 1460]).groupBy("min_followup_days").agg(F.count("*").alias("n"))


@query("e25_b01_hash_sample", "SELECT event_id, event_type FROM events ORDER BY sha256('seed42:' || event_id::VARCHAR), event_id LIMIT 200")
def _(spark, sf):
    return C.hash_sample(table(spark, sf, "events"), "event_id", "seed42:", 200).select("event_id", "event_type")


@query("e25_complete_cases", f"WITH {EV} SELECT case_id, event_id FROM ev WHERE case_id IN (SELECT case_id FROM ev GROUP BY 1 ORDER BY min(event_id) LIMIT 100)")
def _(spark, sf):
    return C.complete_cases(event_log(spark, sf), "case_id", "event_id", 100).select("case_id", "event_id")


@query("a07_evidence_report", f"""{STATE} SELECT metric, n, {rs("100.0 * n / total")} AS pct FROM (SELECT count(*) AS total, unnest(['total', 'possible', 'with_value', 'absent_then_future']) AS metric,
 unnest([count(*), count(*) FILTER (WHERE outcome_future_gr), count(*) FILTER (WHERE first_future_gr_value_eur IS NOT NULL), count(*) FILTER (WHERE NOT gr_available_at_t0 AND outcome_future_gr)]) AS n FROM cs)""")
def _(spark, sf):
    from ..operators.profile import share_rows

    s = C.case_state(event_log(spark, sf), LOG)
    return rounded(share_rows(s, {
        "total": F.lit(True), "possible": F.col("gather_gr_possible"), "with_value": F.col("gather_gr_has_value"),
        "absent_then_future": ~F.col("gr_available_at_t0") & F.col("gather_gr_possible")}))


@query("v06_case_invariants", f"""{STATE} SELECT 'unique' AS "check", sum(n)::BIGINT AS rows, count(*) FILTER (WHERE n > 1) AS violations, count(*)::DOUBLE AS measured FROM (SELECT case_id, count(*) AS n FROM cs GROUP BY 1)
 UNION ALL SELECT 'decision_time_present' AS "check", count(*) AS rows, count(*) FILTER (WHERE decision_time IS NULL) AS violations, {rs('coalesce(sum(year(decision_time)), 0)::DOUBLE', 4)} AS measured FROM cs
 UNION ALL SELECT 'has_decision_event' AS "check", count(*) AS rows, count(*) FILTER (WHERE n_invoice_receipts_at_t0_history < 1) AS violations, {rs('coalesce(sum(n_invoice_receipts_at_t0_history), 0)::DOUBLE', 4)} AS measured FROM cs""")
def _(spark, sf):
    from ..operators.checks import check_rows, unique_rows

    s = C.case_state(event_log(spark, sf), LOG)
    seen = F.col("n_invoice_receipts_at_t0_history")
    return rounded(unique_rows(s, ["case_id"]).unionByName(check_rows(s, {
        "decision_time_present": (F.col("decision_time").isNotNull(), F.year("decision_time")), "has_decision_event": (seen >= 1, seen)})), digits=4)


# ---- second-cut targets -------------------------------------------------------------------
def t1_sql(names) -> str:
    return f"CASE WHEN {' OR '.join(names)} THEN 'NOT_SAFE_TO_EXECUTE' WHEN after_t1_eventually_cleared THEN 'SAFE_TO_EXECUTE' ELSE 'AMBIGUOUS' END"


T1_TARGETS = f"{T1_STATE}, tg AS (SELECT *, {', '.join(f'{t1_sql(v)} AS {k}' for k, v in L.T1_DEFINITIONS.items())} FROM s1)"


def t1_targets(spark, sf):
    s = C.transition_state(event_log(spark, sf), LOG)
    return s.withColumns({k: L.t1_target(k) for k in L.T1_DEFINITIONS})


@query("l05_t1_targets", f"{T1_TARGETS} SELECT case_id, {', '.join(L.T1_DEFINITIONS)} FROM tg")
def _(spark, sf):
    return t1_targets(spark, sf).select("case_id", *L.T1_DEFINITIONS)


SIG = L.T1_CONSERVATIVE


@query("a04_signal_prevalence", f"{T1_STATE} SELECT signal, sum(x::INT)::BIGINT AS n_true, {rs('100.0 * avg(x::INT)')} AS pct_true FROM ({' UNION ALL '.join(f'''SELECT '{s}' AS signal, {s} AS x FROM s1''' for s in SIG)}) GROUP BY 1")
def _(spark, sf):
    from ..operators.profile import flag_prevalence

    return rounded(flag_prevalence(C.transition_state(event_log(spark, sf), LOG), SIG))


@query("a17_signal_overlap", f"""{T1_STATE}, sg AS ({' UNION ALL '.join(f"SELECT case_id, '{s}' AS sig, {s}::INT AS x FROM s1" for s in SIG)})
SELECT a.sig AS sig_a, b.sig AS sig_b, sum(a.x * b.x)::BIGINT AS n FROM sg a JOIN sg b USING (case_id) GROUP BY 1, 2""")
def _(spark, sf):
    from ..operators.profile import overlap

    return overlap(C.transition_state(event_log(spark, sf), LOG), SIG)


@query("a18_clearance_conflicts", f"""{T1_STATE} SELECT signal, sum(x::INT)::BIGINT AS signal_count, sum((x AND cl)::INT)::BIGINT AS both_count,
 {rs('100.0 * sum((x AND cl)::INT) / greatest(sum(x::INT), 1)')} AS pct_signal, {rs('100.0 * avg((x AND cl)::INT)')} AS pct_all
 FROM ({' UNION ALL '.join(f"SELECT '{s}' AS signal, {s} AS x, after_t1_eventually_cleared AS cl FROM s1" for s in SIG)}) GROUP BY 1""")
def _(spark, sf):
    from ..operators.profile import conflict_table

    return rounded(conflict_table(C.transition_state(event_log(spark, sf), LOG), SIG, "after_t1_eventually_cleared"))


@query("a19_target_balance", f"""{T1_TARGETS} SELECT definition, count(*) FILTER (WHERE t <> 'AMBIGUOUS') AS resolved, {rs("100.0 * avg((t <> 'AMBIGUOUS')::INT)")} AS resolved_pct,
 count(*) FILTER (WHERE t = 'SAFE_TO_EXECUTE') AS safe, count(*) FILTER (WHERE t = 'NOT_SAFE_TO_EXECUTE') AS unsafe, count(*) FILTER (WHERE t = 'AMBIGUOUS') AS ambiguous,
 {rs("100.0 * count(*) FILTER (WHERE t = 'NOT_SAFE_TO_EXECUTE') / nullif(count(*) FILTER (WHERE t <> 'AMBIGUOUS'), 0)")} AS unsafe_pct_resolved
 FROM ({' UNION ALL '.join(f"SELECT '{k}' AS definition, {k} AS t FROM tg" for k in L.T1_DEFINITIONS)}) GROUP BY 1""")
def _(spark, sf):
    from ..operators.profile import label_balance

    return rounded(label_balance(t1_targets(spark, sf), list(L.T1_DEFINITIONS)))


@query("a20_target_stability", f"{T1_TARGETS} SELECT {', '.join(L.T1_DEFINITIONS)}, count(*) AS n, {rs('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM tg GROUP BY ALL")
def _(spark, sf):
    from ..operators.profile import counts_with_share

    return rounded(counts_with_share(t1_targets(spark, sf), list(L.T1_DEFINITIONS)))


NUM = ["n", "non_null", "mean", "p50", "p90", "p95", "p99", "max"]


@query("a22_profile_per_class", f"""{T1_TARGETS} SELECT "D1_CORE" AS label, count(*) AS n, count(x) AS non_null, {rs('avg(x)')} AS mean, {rs('quantile_cont(x, 0.5)')} AS p50, {rs('quantile_cont(x, 0.9)')} AS p90,
 {rs('quantile_cont(x, 0.95)')} AS p95, {rs('quantile_cont(x, 0.99)')} AS p99, {rs('max(x)')} AS max FROM (SELECT *, (epoch_us(t1_time) - epoch_us(t0_time)) / {D} AS x FROM tg) GROUP BY 1""")
def _(spark, sf):
    from ..operators.profile import numeric_summary

    t = t1_targets(spark, sf).select(F.col("D1_CORE").alias("label"), "elapsed_t0_to_t1_days")
    return rounded(numeric_summary(t, "elapsed_t0_to_t1_days", ["label"], {"p50": .5, "p90": .9, "p95": .95, "p99": .99}, ["n", "non_null", "mean", "max"]))


@query("a23_ambiguous_profile", f"{T1_TARGETS} SELECT signal, sum(x::INT)::BIGINT AS n_true, {rs('100.0 * avg(x::INT)')} AS pct_true FROM ({' UNION ALL '.join(f'''SELECT '{s}' AS signal, {s} AS x FROM tg WHERE D1_CORE = 'AMBIGUOUS' ''' for s in ['after_t1_future_gr', 'after_t1_service_entry', 'after_t1_additional_invoice'])}) GROUP BY 1")
def _(spark, sf):
    from ..operators.profile import flag_prevalence

    amb = t1_targets(spark, sf).where(F.col("D1_CORE") == S.AMBIGUOUS)
    return rounded(flag_prevalence(amb, ["after_t1_future_gr", "after_t1_service_entry", "after_t1_additional_invoice"]))


@query("a62_resolved_summary", f"""{T1_TARGETS}, z AS (SELECT count(*) AS n, count(*) FILTER (WHERE D1_CORE <> 'AMBIGUOUS') AS res, count(*) FILTER (WHERE D1_CORE = 'NOT_SAFE_TO_EXECUTE') AS uns FROM tg)
SELECT n AS all_cases, res AS resolved, uns AS unsafe, {rs('100.0 * (n - res) / n')} AS ambiguous_pct, {rs('100.0 * uns / nullif(res, 0)')} AS unsafe_pct,
 CASE WHEN 100.0 * (n - res) / n > 10 THEN 'TOO_AMBIGUOUS' WHEN 100.0 * uns / nullif(res, 0) BETWEEN 1 AND 40 THEN 'VIABLE' ELSE 'IMBALANCED' END AS verdict FROM z""")
def _(spark, sf):
    from ..operators.profile import resolved_summary

    return rounded(resolved_summary(t1_targets(spark, sf), "D1_CORE"))


@query("a16_population_stages", f"""{CAND} SELECT stage, n, {rs('100.0 * n / total')} AS pct FROM (SELECT (SELECT count(*) FROM cs) AS total, unnest(['all', 'no_gr', 'future_gr', 'no_gr_and_future', 'eligible', 'strictly_after', 'same_timestamp', 'intervening']) AS stage,
 unnest([(SELECT count(*) FROM cs), (SELECT count(*) FROM cs WHERE NOT gr_available_at_t0), (SELECT count(*) FROM cs WHERE outcome_future_gr), (SELECT count(*) FROM cs WHERE NOT gr_available_at_t0 AND outcome_future_gr),
 (SELECT count(*) FROM cand), (SELECT count(*) FROM cand WHERE t1 > decision_time), (SELECT count(*) FROM cand WHERE t1 = decision_time), (SELECT count(*) FROM cand WHERE {BEF})]) AS n)""")
def _(spark, sf):
    from ..operators.profile import share_rows

    s = C.case_state(event_log(spark, sf), LOG)
    ok = ~F.col("gr_available_at_t0") & F.col("gather_gr_possible") & F.col("gather_gr_has_value")
    t1, t0 = F.col("first_future_gr_time"), F.col("decision_time")
    return rounded(share_rows(s, {
        "all": F.lit(True), "no_gr": ~F.col("gr_available_at_t0"), "future_gr": F.col("gather_gr_possible"),
        "no_gr_and_future": ~F.col("gr_available_at_t0") & F.col("gather_gr_possible"), "eligible": ok, "strictly_after": ok & (t1 > t0),
        "same_timestamp": ok & (t1 == t0), "intervening": ok & S.any_of([F.col(c) < t1 for c in C.TIMED_EVENTS.values()])}, name="stage"))


@query("a15_candidate_summary", f"""{CAND} SELECT vendor_id, count(*) AS cases, {rs('quantile_cont(w, 0.5)')} AS p50, {rs('quantile_cont(w, 0.9)')} AS p90,
 {rs('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM (SELECT *, (epoch_us(t1) - epoch_us(decision_time)) / {D} AS w FROM cand) GROUP BY 1""")
def _(spark, sf):
    from ..operators.profile import counts_with_share

    c = C.transition_candidates(C.case_state(event_log(spark, sf), LOG)).select("vendor_id", "elapsed_t0_to_t1_days")
    p = O.percentiles(c, "elapsed_t0_to_t1_days", {"p50": 0.5, "p90": 0.9}, ["vendor_id"])
    return rounded(counts_with_share(c, ["vendor_id"], name="cases").join(p, "vendor_id"))
