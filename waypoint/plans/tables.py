"""The given tables shaped as the three inputs the operators work on.

``event_log``: user activity in three-day cases. ``value_cases``: one row per
order with ordered, invoiced and received value. ``episodes``: the same cases
with scores, interventions and a second decision point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.cases import Log
from ..sources.tables import table

# Which event type plays which role in the activity table.
ROLES = {
    "create_po": "signup",
    "vendor_invoice": "click",
    "invoice_receipt": "purchase",
    "goods_receipt": "view",
    "cancel_gr": "error",
    "cancel_invoice": "error",
    "clear_invoice": "signup",
    "price_change": "click",
    "quantity_change": "error",
    "set_payment_block": "error",
    "remove_payment_block": "click",
    "subsequent_invoice": "view",
    "service_entry": "signup",
    "delete_po": "error",
    "block_po": "click",
    "reactivate_po": "view",
    "change_approval": "signup",
    "release_po": "purchase",
}
LOG = Log(
    case="case_id", activity="event_type", ts="ts", order="event_id", value="value",
    attributes={"user_id": "vendor_id", "props": "sub_spend_area"},
    flags={"flag_text": "goods_receipt_required"}, activities=ROLES,
)
#: Case attributes of the models with all inputs: state column -> rule over the user.
WIDE = {
    "company": "user_id % 5", "source_system": "user_id % 3", "document_type": "user_id % 7", "document_category": "user_id % 2", "item_type": "user_id % 4",
    "item_category": "user_id % 6", "spend_classification": "user_id % 11", "spend_area": "user_id % 37",
}
WIDE_LOG = Log(
    case="case_id", activity="event_type", ts="ts", order="event_id", value="value",
    attributes={**{f"w_{n}": n for n in WIDE}, "user_id": "vendor_id", "props": "sub_spend_area"},
    flags={"flag_text": "goods_receipt_required", "verified": "gr_based_invoice_verification"}, activities=ROLES,
)
CASE_SQL = "(user_id::VARCHAR || ':' || (date_diff('day', DATE '2024-01-01', ts::DATE) // 3)::VARCHAR)"
EV = f"""ev0 AS (
  SELECT {CASE_SQL} AS case_id, event_type, time_bucket(INTERVAL '6 hours', ts) AS ts, event_id,
         CASE WHEN event_id % 4 <> 0 THEN value END AS value, user_id, props,
         CASE WHEN user_id % 3 = 0 THEN 'yes' WHEN user_id % 3 = 1 THEN 'N' ELSE 'maybe' END AS flag_text
  FROM events),
ev AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS k FROM ev0),
t0 AS (SELECT case_id, min(k) AS k0, min(ts) AS t0, arg_min(event_id, k) AS ord0 FROM ev WHERE event_type = 'purchase' GROUP BY 1),
ex AS (SELECT ev.*, k0, t0, ord0, k <= k0 AS past, k > k0 AS fut FROM ev JOIN t0 USING (case_id))"""


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour time stamps (so events tie and need their order) and some missing values."""
    ev = table(spark, sf, "events")
    window = F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")) / 3)
    word = F.when(F.col("user_id") % 3 == 0, "yes").when(F.col("user_id") % 3 == 1, "N").otherwise("maybe")
    coarse = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600) * 21600)
    return ev.select(
        F.concat_ws(":", F.col("user_id").cast("string"), window.cast("string")).alias("case_id"),
        "event_type", coarse.cast("timestamp_ntz").alias("ts"), "event_id",
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"), "user_id", "props", word.alias("flag_text"),
    )


def wide_event_log(spark: SparkSession, sf: str) -> DataFrame:
    """The event log with all case attributes that the published models read."""
    ev = event_log(spark, sf)
    return ev.select("*", *[F.expr(e).cast("string").alias(f"w_{n}") for n, e in WIDE.items()], F.when(F.col("user_id") % 2 == 0, "true").otherwise("false").alias("verified"))


# (name, kind, condition) with E = shipped by the order date, L = shipped later.
LINE_RULES = [
    ("gr_available_at_t0", "any", "E"),
    ("n_goods_receipts_before_t0", "n", "E AND l_linestatus = 'F'"),
    ("n_cancel_gr_before_t0", "n", "E AND l_returnflag = 'R' AND l_quantity > 25"),
    ("had_gr_cancellation_before_t0", "any", "E AND l_returnflag = 'R' AND l_quantity > 20"),
    ("n_cancel_invoice_before_t0", "n", "E AND l_tax > 0.06"),
    ("had_invoice_cancellation_before_t0", "any", "E AND l_tax > 0.05"),
    ("n_price_change_before_t0", "n", "E AND l_discount > 0.08"),
    ("had_price_change_before_t0", "any", "E AND l_discount > 0.07"),
    ("n_quantity_change_before_t0", "n", "E AND l_quantity > 45"),
    ("had_quantity_change_before_t0", "any", "E AND l_quantity > 44"),
    ("n_set_payment_block_before_t0", "n", "E AND l_linenumber = 6"),
    ("n_remove_payment_block_before_t0", "n", "E AND l_linenumber = 5"),
    ("had_payment_block_before_t0", "any", "E AND l_linenumber >= 5"),
    ("outcome_eventually_cleared", "any", "L AND l_returnflag = 'A'"),
    ("outcome_invoice_cancelled_after_t0", "any", "L AND l_returnflag = 'R' AND l_tax > 0.06"),
    ("outcome_payment_block_removed_after_t0", "any", "L AND l_returnflag = 'R' AND l_discount < 0.02"),
    ("outcome_payment_block_set_after_t0", "any", "L AND l_returnflag = 'R' AND l_discount > 0.08"),
    ("outcome_future_gr", "any", "L AND l_linestatus = 'F'"),
    ("outcome_future_gr_cancel", "any", "L AND l_returnflag = 'R' AND l_quantity > 45"),
    ("outcome_future_price_change", "any", "L AND l_returnflag = 'R' AND l_linenumber = 5"),
    ("outcome_future_quantity_change", "any", "L AND l_returnflag = 'R' AND l_linenumber = 6"),
    ("outcome_subsequent_invoice", "any", "L AND l_returnflag = 'R' AND l_linenumber = 7"),
    ("outcome_additional_invoice_receipt", "any", "L AND l_returnflag = 'N' AND l_quantity > 40"),
    ("outcome_future_service_entry", "any", "L AND l_returnflag = 'N' AND l_linenumber = 1"),
]


def _plain(rule: str) -> str:
    return rule.replace("E", "(l_shipdate <= o_orderdate)", 1) if rule[0] == "E" else rule.replace("L", "(l_shipdate > o_orderdate)", 1)


def _rule_sql(name: str, kind: str, rule: str) -> str:
    c = _plain(rule)
    if kind == "n":
        return f"count(*) FILTER (WHERE {c})::BIGINT AS {name}"
    return f"coalesce(bool_or({c}), false) AS {name}"


VC = f"""vc0 AS (
  SELECT o_orderkey, any_value(o_custkey) AS group_id, any_value(o_orderdate) AS decision_time,
    any_value(o_orderpriority) AS item_category, any_value(o_orderstatus) AS status,
    any_value(o_totalprice) AS po_value_initial_eur,
    count(l_orderkey)::BIGINT AS n_lines, max(l_linenumber) AS max_line, date_diff('day', any_value(o_orderdate), min(l_shipdate))::DOUBLE AS po_to_invoice_days,
    round(sum(l_extendedprice), 2) AS invoice_value_t0_eur,
    round(sum(l_extendedprice) FILTER (WHERE l_shipdate <= o_orderdate AND l_linestatus = 'F'), 2) AS latest_gr_value_before_t0_eur,
    {", ".join(_rule_sql(*x) for x in LINE_RULES)}
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
vc AS (SELECT *, o_orderkey::VARCHAR AS case_id, item_category <> '5-LOW' AS goods_receipt_required,
    n_lines > 0 AS vendor_invoice_seen_at_t0, coalesce(max_line <> 7, true) AS po_created_at_t0,
    abs(invoice_value_t0_eur - po_value_initial_eur) / CASE WHEN abs(po_value_initial_eur) > 1e-12 THEN abs(po_value_initial_eur) END AS inv_po_abs_rel_diff,
    abs(invoice_value_t0_eur - latest_gr_value_before_t0_eur) / CASE WHEN abs(latest_gr_value_before_t0_eur) > 1e-12 THEN abs(latest_gr_value_before_t0_eur) END AS inv_gr_abs_rel_diff,
    abs(po_value_initial_eur) AS transaction_exposure_eur
  FROM vc0)"""


def value_cases(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem", [
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"])
    rows = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")

    def rule(name, kind, text):
        c = S.is_true(F.expr(_plain(text)))
        return (F.sum(c.cast("bigint")) if kind == "n" else F.max(c)).alias(name)

    received = F.expr("l_shipdate <= o_orderdate AND l_linestatus = 'F'")
    # the order's own columns are grouping keys: the buffers stay numeric and the aggregate hashed
    keys = {"o_custkey": "group_id", "o_orderdate": "decision_time", "o_orderpriority": "item_category",
            "o_orderstatus": "status", "o_totalprice": "po_value_initial_eur"}
    g = rows.groupBy("o_orderkey", *keys).agg(
        F.count("l_orderkey").alias("n_lines"), F.max("l_linenumber").alias("max_line"),
        F.min("l_shipdate").alias("_first"),
        F.round(F.sum("l_extendedprice"), 2).alias("invoice_value_t0_eur"),
        F.round(F.sum(F.when(received, F.col("l_extendedprice"))), 2).alias("latest_gr_value_before_t0_eur"),
        *[rule(*x) for x in LINE_RULES],
    ).withColumnsRenamed(keys)
    g = g.withColumn("po_to_invoice_days", F.datediff("_first", "decision_time").cast("double")).drop("_first")
    return g.withColumns({
        "case_id": F.col("o_orderkey").cast("string"),
        "goods_receipt_required": F.col("item_category") != "5-LOW",
        "vendor_invoice_seen_at_t0": F.col("n_lines") > 0,
        "po_created_at_t0": F.coalesce(F.col("max_line") != 7, F.lit(True)),
        "inv_po_abs_rel_diff": S.relative_gap("invoice_value_t0_eur", "po_value_initial_eur"),
        "inv_gr_abs_rel_diff": S.relative_gap("invoice_value_t0_eur", "latest_gr_value_before_t0_eur"),
        "transaction_exposure_eur": F.abs("po_value_initial_eur"),
    })


def _frac_sql(mult: int) -> str:
    return f"((o_orderkey * {mult} % 1000) / 1000.0)"


def _frac(mult: int):
    return (F.col("o_orderkey") * mult % 1000) / F.lit(1000.0)


CORE = [
    "outcome_invoice_cancelled_after_t0", "outcome_payment_block_set_after_t0", "outcome_future_gr_cancel",
    "outcome_future_price_change", "outcome_future_quantity_change", "outcome_subsequent_invoice",
]
SPLIT_SEED = "split-1:"
EPI = f"""epi0 AS (SELECT vc.*,
    CASE WHEN status = 'P' THEN CASE item_category WHEN '1-URGENT' THEN 'MISSING_GR' WHEN '2-HIGH' THEN 'PO_VALUE_CONTRADICTION'
      WHEN '3-MEDIUM' THEN 'INVOICE_VALUE_CONTRADICTION' WHEN '4-NOT SPECIFIED' THEN 'MULTI_FIELD_MISSING' ELSE 'NONE' END ELSE 'NONE' END AS intervention_type,
    CASE WHEN decision_time < TIMESTAMP '1997-03-01' THEN 'early' WHEN decision_time < TIMESTAMP '1999-06-01' THEN 'middle' ELSE 'late' END AS regime,
    CASE WHEN ((goods_receipt_required AND NOT gr_available_at_t0) OR {" OR ".join(CORE)}) THEN 'NOT_SAFE_TO_EXECUTE'
         WHEN outcome_eventually_cleared THEN 'SAFE_TO_EXECUTE' ELSE 'AMBIGUOUS' END AS target,
    CASE WHEN outcome_future_price_change OR outcome_future_quantity_change OR outcome_subsequent_invoice THEN 'NOT_SAFE_TO_EXECUTE'
         WHEN outcome_eventually_cleared THEN 'SAFE_TO_EXECUTE' ELSE 'AMBIGUOUS' END AS y_t1,
    {_frac_sql(7919)} AS w_e, {_frac_sql(104729)} AS w_g, {_frac_sql(1299709)} AS w_h, {_frac_sql(15485863)} AS p1_all,
    ('0x' || substr(sha256('{SPLIT_SEED}' || case_id), 1, 12))::BIGINT / 281474976710656.0 AS u
  FROM vc),
epi1 AS (SELECT *, (intervention_type <> 'NONE') AS synthetic,
    CASE WHEN intervention_type LIKE '%CONTRAD%' THEN CASE group_id % 4 WHEN 0 THEN 0.05 WHEN 1 THEN 0.1 WHEN 2 THEN 0.25 ELSE 0.5 END
         WHEN intervention_type <> 'NONE' THEN 1.0 END::DOUBLE AS strength,
    CASE WHEN intervention_type LIKE '%MULTI%' THEN 'SEVERE_EVIDENCE_LOSS' WHEN intervention_type LIKE '%CONTRAD%' THEN 'CONTRADICTION'
         WHEN intervention_type LIKE '%MISSING%' THEN 'MISSINGNESS' ELSE 'NATURAL' END AS family,
    CASE intervention_type WHEN 'MISSING_GR' THEN 'GATHER' WHEN 'MULTI_FIELD_MISSING' THEN 'ABSTAIN' WHEN 'NONE' THEN
         CASE WHEN gr_available_at_t0 THEN 'EXECUTE' ELSE 'GATHER' END ELSE 'ESCALATE' END AS expected_action_reference,
    (0.6 * w_e + 0.4 * (target = 'SAFE_TO_EXECUTE')::INT)::DOUBLE AS p_safe_t0_raw,
    (NOT gr_available_at_t0 AND outcome_future_gr) AS transition_available,
    CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'calibration' ELSE 'test' END AS part
  FROM epi0),
epi2 AS (SELECT *, floor(p_safe_t0_raw * 20) / 20 AS p_safe_t0_cal,
    w_e / (w_e + w_g + w_h + 0.1) AS p_cal_execute, w_g / (w_e + w_g + w_h + 0.1) AS p_cal_gather,
    w_h / (w_e + w_g + w_h + 0.1) AS p_cal_escalate, 0.1 / (w_e + w_g + w_h + 0.1) AS p_cal_abstain,
    CASE WHEN synthetic THEN 'NOT_SAFE_TO_EXECUTE' ELSE target END AS robust_target,
    (transition_available AND expected_action_reference = 'GATHER' AND NOT synthetic) AS gather_policy_eligible,
    CASE WHEN transition_available THEN p1_all END AS p_safe_t1
  FROM epi1),
epi AS (SELECT *, CASE WHEN gather_policy_eligible THEN p_safe_t1 END AS p_safe_t1_primary,
    CASE WHEN p_cal_execute >= greatest(p_cal_gather, p_cal_escalate, p_cal_abstain) THEN 'EXECUTE'
         WHEN p_cal_gather >= greatest(p_cal_escalate, p_cal_abstain) THEN 'GATHER'
         WHEN p_cal_escalate >= p_cal_abstain THEN 'ESCALATE' ELSE 'ABSTAIN' END AS predicted_action,
    (robust_target = 'NOT_SAFE_TO_EXECUTE' OR (robust_target = 'AMBIGUOUS' AND expected_action_reference <> 'EXECUTE')) AS unsafe,
    (robust_target <> 'AMBIGUOUS') AS known, (NOT goods_receipt_required OR gr_available_at_t0) AS complete
  FROM epi2)"""
BASE = f"WITH {VC},\n{EPI}"


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.labels import action_fallback_unsafe, d1_target

    d = value_cases(spark, sf)
    kind = F.expr(
        "CASE WHEN status = 'P' THEN CASE item_category WHEN '1-URGENT' THEN 'MISSING_GR' "
        "WHEN '2-HIGH' THEN 'PO_VALUE_CONTRADICTION' WHEN '3-MEDIUM' THEN 'INVOICE_VALUE_CONTRADICTION' "
        "WHEN '4-NOT SPECIFIED' THEN 'MULTI_FIELD_MISSING' ELSE 'NONE' END ELSE 'NONE' END")
    late_signals = [F.col(c) for c in ("outcome_future_price_change", "outcome_future_quantity_change", "outcome_subsequent_invoice")]
    d = d.withColumns({
        "intervention_type": kind,
        "regime": F.expr("CASE WHEN decision_time < timestamp_ntz'1997-03-01' THEN 'early' "
                         "WHEN decision_time < timestamp_ntz'1999-06-01' THEN 'middle' ELSE 'late' END"),
        "target": d1_target(),
        "y_t1": F.when(S.any_of(late_signals), S.UNSAFE).when(F.col("outcome_eventually_cleared"), S.SAFE).otherwise(S.AMBIGUOUS),
        "w_e": _frac(7919), "w_g": _frac(104729), "w_h": _frac(1299709), "p1_all": _frac(15485863),
        "u": S.hash_unit(F.col("case_id"), SPLIT_SEED),
    })
    total = F.col("w_e") + F.col("w_g") + F.col("w_h") + F.lit(0.1)
    d = d.withColumns({
        "synthetic": F.col("intervention_type") != "NONE",
        "strength": F.expr(
            "CASE WHEN intervention_type LIKE '%CONTRAD%' THEN CASE group_id % 4 WHEN 0 THEN 0.05D WHEN 1 THEN 0.1D "
            "WHEN 2 THEN 0.25D ELSE 0.5D END WHEN intervention_type <> 'NONE' THEN 1.0D END"),
        "family": S.intervention_family("intervention_type"),
        "expected_action_reference": F.expr(
            "CASE intervention_type WHEN 'MISSING_GR' THEN 'GATHER' WHEN 'MULTI_FIELD_MISSING' THEN 'ABSTAIN' WHEN 'NONE' THEN "
            "CASE WHEN gr_available_at_t0 THEN 'EXECUTE' ELSE 'GATHER' END ELSE 'ESCALATE' END"),
        "p_safe_t0_raw": F.lit(0.6) * F.col("w_e") + F.lit(0.4) * (F.col("target") == S.SAFE).cast("int"),
        "transition_available": ~F.col("gr_available_at_t0") & F.col("outcome_future_gr"),
        "part": F.when(F.col("u") < 0.7, "train").when(F.col("u") < 0.85, "calibration").otherwise("test"),
    })
    d = d.withColumns({
        "p_safe_t0_cal": F.floor(F.col("p_safe_t0_raw") * 20) / F.lit(20.0),
        "p_cal_execute": F.col("w_e") / total, "p_cal_gather": F.col("w_g") / total,
        "p_cal_escalate": F.col("w_h") / total, "p_cal_abstain": F.lit(0.1) / total,
        "robust_target": F.when(F.col("synthetic"), S.UNSAFE).otherwise(F.col("target")),
        "gather_policy_eligible": F.col("transition_available") & (F.col("expected_action_reference") == "GATHER") & ~F.col("synthetic"),
        "p_safe_t1": F.when(F.col("transition_available"), F.col("p1_all")),
    })
    names = ["execute", "gather", "escalate", "abstain"]
    return d.withColumns({
        "p_safe_t1_primary": F.when(F.col("gather_policy_eligible"), F.col("p_safe_t1")),
        "predicted_action": S.first_largest([n.upper() for n in names], [F.col(f"p_cal_{n}") for n in names]),
        "unsafe": action_fallback_unsafe("robust_target", "expected_action_reference"),
        "known": F.col("robust_target") != S.AMBIGUOUS,
        "complete": S.evidence_complete("goods_receipt_required", "gr_available_at_t0"),
    })
