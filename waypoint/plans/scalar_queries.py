"""Sources, scalar expressions and labels over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gate as G
from ..functions import labels as L
from ..functions import scalars as S
from ..operators import ordered as O
from ..operators.cases import with_risk_stratum
from ..sources.tables import load_table, table
from .registry import query, r, rounded, rs
from .tables import BASE, CORE, episodes, value_cases

WORD = """CASE user_id % 7 WHEN 0 THEN ' TRUE' WHEN 1 THEN 'no ' WHEN 2 THEN 'Y' WHEN 3 THEN '0'
 WHEN 4 THEN 'maybe' WHEN 5 THEN 't' END"""


@query("s02_column_scan", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def _(spark, sf):
    return table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"]).where(
        "l_shipdate < timestamp_ntz'1996-01-01'").drop("l_shipdate")


@query("s04_load_by_suffix", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(spark, sf):
    return load_table(spark, f"{sf}/nation.parquet").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("p01_parse_time", """
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE TRY_CAST(txt AS TIMESTAMP) IS NULL) AS n_invalid
FROM (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN 'not a time' ELSE ts::VARCHAR END AS txt FROM events) GROUP BY 1""")
def _(spark, sf):
    text = F.when(F.col("event_id") % 10 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), O.count_if(S.parse_time(text).isNull()).alias("n_invalid"))


@query("p02_parse_bool", f"""
SELECT word, lower(trim(word)) IN ('true','1','yes','y') AS tr, count(*) AS n FROM (SELECT {WORD} AS word FROM events)
WHERE lower(trim(word)) IN ('true','1','yes','y','false','0','no','n') GROUP BY 1, 2
UNION ALL SELECT word, NULL, count(*) FROM (SELECT {WORD} AS word FROM events)
WHERE word IS NULL OR lower(trim(word)) NOT IN ('true','1','yes','y','false','0','no','n') GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "events").select(F.expr(WORD).alias("word"))
    return d.groupBy("word", S.parse_bool("word").alias("tr")).agg(F.count("*").alias("n"))


@query("p03_truthy", f"""
SELECT word, coalesce(lower(trim(word)) IN ('true','1','yes','y','t'), false) AS tr, count(*) AS n
FROM (SELECT {WORD} AS word FROM events) GROUP BY 1, 2""")
def _(spark, sf):
    d = table(spark, sf, "events").select(F.expr(WORD).alias("word"))
    return d.groupBy("word", S.truthy("word").alias("tr")).agg(F.count("*").alias("n"))


@query("p04_upper_text", f"""
SELECT upper(trim(coalesce(word, ''))) AS filled, upper(trim(word)) AS kept, count(*) AS n
FROM (SELECT {WORD} AS word FROM events) GROUP BY 1, 2""")
def _(spark, sf):
    d = table(spark, sf, "events").select(F.expr(WORD).alias("word"))
    return d.groupBy(S.upper_text("word").alias("filled"), S.upper_text("word", keep_null=True).alias("kept")).agg(F.count("*").alias("n"))


@query("p05_number", f"""
SELECT event_type, count(TRY_CAST(txt AS DOUBLE)) AS n_good, {rs("sum(TRY_CAST(txt AS DOUBLE))", 2)} AS total
FROM (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE value::VARCHAR END AS txt FROM events) GROUP BY 1""")
def _(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_type", S.number(text).alias("x")).groupBy("event_type").agg(
        F.count("x").alias("n_good"), r(F.sum("x"), 2).alias("total"))


LABEL_WORD = """CASE o_orderkey % 8 WHEN 0 THEN 'safe' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '1' WHEN 3 THEN 'Not_Safe'
 WHEN 4 THEN '0' WHEN 5 THEN 'AMBIGUOUS' WHEN 6 THEN 'natural' END"""


@query("p06_safety_label", f"""
SELECT w, CASE WHEN upper(trim(w)) IN ('SAFE_TO_EXECUTE','SAFE','TRUE','1') THEN 'SAFE_TO_EXECUTE'
 WHEN upper(trim(w)) IN ('NOT_SAFE_TO_EXECUTE','UNSAFE','NOT_SAFE','FALSE','0') THEN 'NOT_SAFE_TO_EXECUTE' ELSE 'AMBIGUOUS' END AS label, count(*) AS n
FROM (SELECT {LABEL_WORD} AS w FROM orders) GROUP BY 1, 2""")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.expr(LABEL_WORD).alias("w"))
    return d.groupBy("w", S.safety_label("w").alias("label")).agg(F.count("*").alias("n"))


@query("p07_synthetic_word", f"""
SELECT w, CASE WHEN lower(trim(w)) IN ('true','1','yes','y','synthetic') THEN 'SYNTHETIC'
 WHEN lower(trim(w)) IN ('false','0','no','n','natural') THEN 'NATURAL' ELSE w END AS label, count(*) AS n
FROM (SELECT {LABEL_WORD} AS w FROM orders) GROUP BY 1, 2""")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.expr(LABEL_WORD).alias("w"))
    return d.groupBy("w", S.synthetic_word("w").alias("label")).agg(F.count("*").alias("n"))


@query("p08_exposure", "SELECT c_custkey, coalesce(abs(CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END), 0.0)::DOUBLE AS exposure FROM customer")
def _(spark, sf):
    held = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", S.exposure(held).alias("exposure"))


@query("p09_category", "SELECT coalesce(trim(CASE WHEN c_nationkey <> 3 THEN c_mktsegment || ' ' END), '__NA__') AS cat, count(*) AS n FROM customer GROUP BY 1")
def _(spark, sf):
    text = F.when(F.col("c_nationkey") != 3, F.concat("c_mktsegment", F.lit(" ")))
    return table(spark, sf, "customer").groupBy(S.category(text).alias("cat")).agg(F.count("*").alias("n"))


@query("p10_days_between", f"""
SELECT l_orderkey, l_linenumber, {rs("(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0")} AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate"])
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", r(S.days_between("o_orderdate", "l_shipdate")).alias("days"))


@query("p11_relative_gap", f"""{BASE}
SELECT case_id, {rs("inv_po_abs_rel_diff")} AS guarded, {rs("inv_gr_abs_rel_diff")} AS gr_guarded,
 {rs("abs(invoice_value_t0_eur - po_value_initial_eur) / nullif(abs(po_value_initial_eur), 0)")} AS exact_zero_only FROM vc""")
def _(spark, sf):
    return value_cases(spark, sf).select(
        "case_id", r("inv_po_abs_rel_diff").alias("guarded"), r("inv_gr_abs_rel_diff").alias("gr_guarded"),
        r(S.relative_gap("invoice_value_t0_eur", "po_value_initial_eur", 0.0)).alias("exact_zero_only"))


@query("p12_exposure_year_month", f"""
SELECT abs(o_totalprice) AS exposure, year(o_orderdate)::INT AS decision_year, strftime(o_orderdate, '%Y-%m') AS decision_month, o_orderkey FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        F.abs("o_totalprice").alias("exposure"), F.year("o_orderdate").alias("decision_year"),
        S.month_text("o_orderdate").alias("decision_month"), "o_orderkey")


@query("p13_category_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(spark, sf):
    return table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"]).where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))


REASON_SQL = {
    "MISSING_PO_VALUE": "po_value_initial_eur IS NULL",
    "MISSING_INVOICE_VALUE": "invoice_value_t0_eur IS NULL",
    "MISSING_GR": "NOT gr_available_at_t0",
    "MISSING_GR_VALUE": "gr_available_at_t0 AND latest_gr_value_before_t0_eur IS NULL",
    "PO_INV_MISMATCH": "coalesce(inv_po_abs_rel_diff > 0.3, false)",
    "INV_GR_MISMATCH": "gr_available_at_t0 AND coalesce(inv_gr_abs_rel_diff > 0.3, false)",
    "GR_MATCH_UNKNOWN": "gr_available_at_t0 AND latest_gr_value_before_t0_eur IS NOT NULL AND invoice_value_t0_eur IS NOT NULL AND inv_gr_abs_rel_diff IS NULL",
    "PO_INV_MATCH_UNKNOWN": "po_value_initial_eur IS NOT NULL AND invoice_value_t0_eur IS NOT NULL AND inv_po_abs_rel_diff IS NULL",
    "PRIOR_GR_CANCELLATION": "had_gr_cancellation_before_t0",
    "PRIOR_INVOICE_CANCELLATION": "had_invoice_cancellation_before_t0",
    "PRIOR_PRICE_CHANGE": "had_price_change_before_t0",
    "PRIOR_QUANTITY_CHANGE": "had_quantity_change_before_t0",
    "PRIOR_PAYMENT_BLOCK": "had_payment_block_before_t0",
}
FLAGS_CTE = f"{BASE}, rf AS (SELECT *, {', '.join(f'({e}) AS f_{n}' for n, e in REASON_SQL.items())} FROM epi)"
REVIEW_SQL = " OR ".join(f"f_{n}" for n in [*L.REVIEW_REASONS, "PRIOR_PRICE_CHANGE"])
READY_SQL = f"CASE WHEN {REVIEW_SQL} THEN 'REVIEW' WHEN f_MISSING_GR THEN 'WAIT_FOR_EVIDENCE' ELSE 'READY' END"


def flags(tolerance: float = 0.3):
    return L.reason_flags(tolerance, tolerance)


@query("p14_reason_flags", f"{FLAGS_CTE} SELECT case_id, {', '.join('f_' + n for n in REASON_SQL)} FROM rf")
def _(spark, sf):
    return episodes(spark, sf).select("case_id", *[c.alias(f"f_{n}") for n, c in flags().items()])


@query("p15_p16_readiness_label", f"{FLAGS_CTE} SELECT case_id, ({REVIEW_SQL}) AS review, {READY_SQL} AS label FROM rf")
def _(spark, sf):
    f = flags()
    opt = ["PRIOR_PRICE_CHANGE"]
    return episodes(spark, sf).select("case_id", L.review_required(f, opt).alias("review"), L.readiness_label(f, opt).alias("label"))


CODES_SQL = "concat_ws('|', " + ", ".join(f"CASE WHEN f_{n} THEN '{n}' END" for n in REASON_SQL) + ")"


@query("p17_f01_reason_codes", f"{FLAGS_CTE} SELECT case_id, coalesce(nullif({CODES_SQL}, ''), 'NONE') AS codes FROM rf")
def _(spark, sf):
    return episodes(spark, sf).select("case_id", L.code_text(flags()).alias("codes"))


@query("p18_one_hot_targets", f"""{FLAGS_CTE}
SELECT case_id, ({READY_SQL} = 'READY')::INT AS target_ready, ({READY_SQL} = 'WAIT_FOR_EVIDENCE')::INT AS target_wait,
 ({READY_SQL} = 'REVIEW')::INT AS target_review FROM rf""")
def _(spark, sf):
    label = L.readiness_label(flags(), ["PRIOR_PRICE_CHANGE"])
    return episodes(spark, sf).select("case_id", *[
        (label == v).cast("int").alias(n) for n, v in
        [("target_ready", "READY"), ("target_wait", "WAIT_FOR_EVIDENCE"), ("target_review", "REVIEW")]])


BIN_EDGES = [0.0, 0.05, 0.25, 0.5, 1.0]
BIN_LABELS = ["0", "0-5%", "5-25%", "25-50%", "50-100%", ">100%"]
BIN_SQL = "CASE " + " ".join(f"WHEN x <= {e} THEN '{n}'" for e, n in zip(BIN_EDGES, BIN_LABELS)) + f" WHEN x > 1.0 THEN '{BIN_LABELS[-1]}' END"


@query("p19_right_closed_bins", f"{BASE} SELECT case_id, {BIN_SQL} AS bin FROM (SELECT case_id, inv_po_abs_rel_diff AS x FROM vc)")
def _(spark, sf):
    return value_cases(spark, sf).select("case_id", S.right_closed_bin(F.col("inv_po_abs_rel_diff"), BIN_EDGES, BIN_LABELS).alias("bin"))


BAND_SQL = "CASE WHEN x IS NULL THEN 'MISSING' " + " ".join(
    f"WHEN x < {e} THEN '{n}'" for e, n in zip(S.SCORE_BANDS, S.SCORE_BAND_LABELS)) + f" ELSE '{S.SCORE_BAND_LABELS[-1]}' END"


@query("p20_score_bands", f"{BASE} SELECT case_id, {BAND_SQL} AS band FROM (SELECT case_id, p_safe_t1_primary AS x FROM epi)")
def _(spark, sf):
    return episodes(spark, sf).select("case_id", S.score_band("p_safe_t1_primary").alias("band"))


STRATUM = """q AS (SELECT quantile_cont(transaction_exposure_eur, 0.5) p50, quantile_cont(transaction_exposure_eur, 0.9) p90,
 quantile_cont(transaction_exposure_eur, 0.99) p99 FROM epi),
st AS (SELECT epi.*, CASE WHEN transaction_exposure_eur <= p50 THEN 'R1_0_50' WHEN transaction_exposure_eur <= p90 THEN 'R2_50_90'
 WHEN transaction_exposure_eur <= p99 THEN 'R3_90_99' WHEN transaction_exposure_eur > p99 THEN 'R4_99_100' END AS stratum FROM epi, q)"""


@query("p21_risk_stratum", f"{BASE}, {STRATUM} SELECT case_id, stratum FROM st")
def _(spark, sf):
    d = with_risk_stratum(value_cases(spark, sf).select("case_id", "transaction_exposure_eur"))
    return d.select("case_id", F.col("transaction_risk_stratum").alias("stratum"))


@query("p22_exposure_quartile", f"""
WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE greatest(1, ceil(4.0 * (rn - 1) / (n - 1)))::INT WHEN 1 THEN 'Q1_LOWEST' WHEN 2 THEN 'Q2' WHEN 3 THEN 'Q3' ELSE 'Q4_HIGHEST' END AS quartile FROM x""")
def _(spark, sf):
    from ..operators.ranking import rank_quartile

    d = table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    return rank_quartile(d, "o_totalprice", "o_orderkey").select("o_orderkey", "quartile")


TRAIN_REF = """tr AS (SELECT quantile_cont(transaction_exposure_eur, 0.5) AS p50, quantile_cont(transaction_exposure_eur, 0.9) AS p90,
 quantile_cont(transaction_exposure_eur, 0.99) AS p99 FROM epi WHERE part = 'train')"""


def train_refs(d):
    return O.percentiles(d.where(F.col("part") == "train"), "transaction_exposure_eur", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("p23_p24_consequence", f"""{BASE}, {TRAIN_REF}
SELECT case_id, 1.0::DOUBLE AS uniform, {rs("ln(1 + transaction_exposure_eur) / ln(1 + p50)")} AS log_p50, {rs("ln(1 + transaction_exposure_eur) / ln(1 + p90)")} AS log_p90,
 {rs("ln(1 + transaction_exposure_eur) / ln(1 + p99)")} AS log_p99, {rs("transaction_exposure_eur / p90")} AS linear, {rs("least(transaction_exposure_eur / p90, 10)")} AS capped
FROM epi, tr""")
def _(spark, sf):
    d = episodes(spark, sf)
    v = F.col("transaction_exposure_eur")
    t = d.select("case_id", v, O.scalars(train_refs(d)).alias("t"))
    return t.select(
        "case_id", S.consequence(v, None, "UNIFORM").alias("uniform"),
        *[r(S.consequence(v, F.col(f"t.{p}"))).alias(f"log_{p}") for p in ("p50", "p90", "p99")],
        r(S.consequence(v, F.col("t.p90"), "LINEAR")).alias("linear"), r(S.consequence(v, F.col("t.p90"), "CAPPED")).alias("capped"))


PC = ["p_cal_execute", "p_cal_gather", "p_cal_escalate", "p_cal_abstain"]


@query("p25_entropy", f"""{BASE}
SELECT case_id, {rs("-(" + " + ".join(f"greatest({p}, 1e-15) * ln(greatest({p}, 1e-15))" for p in PC) + ") / ln(4)")} AS entropy4,
 {rs("-(greatest(p_safe_t0_raw, 1e-15) * ln(greatest(p_safe_t0_raw, 1e-15)) + greatest(1 - p_safe_t0_raw, 1e-15) * ln(greatest(1 - p_safe_t0_raw, 1e-15))) / ln(2)")} AS entropy2 FROM epi""")
def _(spark, sf):
    p = F.col("p_safe_t0_raw")
    return episodes(spark, sf).select("case_id", r(S.entropy([F.col(c) for c in PC])).alias("entropy4"), r(S.entropy([p, 1 - p])).alias("entropy2"))


@query("p26_largest_class", f"""{BASE}
SELECT case_id, predicted_action, {rs("greatest(" + ", ".join(PC) + ")")} AS p_max, {rs("1 - p_cal_execute")} AS p_nonexecute,
 {rs("p_cal_gather + p_cal_escalate + p_cal_abstain")} AS p_nonexecute_sum FROM epi""")
def _(spark, sf):
    return episodes(spark, sf).select(
        "case_id", "predicted_action", r(F.greatest(*PC)).alias("p_max"), r(1 - F.col("p_cal_execute")).alias("p_nonexecute"),
        r(F.col("p_cal_gather") + F.col("p_cal_escalate") + F.col("p_cal_abstain")).alias("p_nonexecute_sum"))


@query("p27_probability_checks", f"""{BASE}
SELECT count(*) AS n, count(*) FILTER (WHERE {" OR ".join(f"{p} IS NULL" for p in PC)}) AS n_null,
 count(*) FILTER (WHERE {" OR ".join(f"{p} < 0 OR {p} > 1" for p in PC)}) AS n_out_of_range,
 count(*) FILTER (WHERE abs({" + ".join(PC)} - 1) > 1e-6) AS n_bad_sum FROM epi""")
def _(spark, sf):
    from ..operators.checks import probability_checks

    return probability_checks(episodes(spark, sf), PC)


TYPE_WORD = """CASE o_orderkey % 9 WHEN 0 THEN 'Multi_field_missing' WHEN 1 THEN 'po_contradiction' WHEN 2 THEN 'HIDE receipt' WHEN 3 THEN 'none'
 WHEN 4 THEN 'severe perturb' WHEN 5 THEN ' perturbed' WHEN 6 THEN 'other' WHEN 7 THEN '' END"""


@query("p30_p31_intervention_family", f"""
SELECT w, CASE WHEN z LIKE '%SEVERE%' OR z LIKE '%MULTI%' THEN 'SEVERE_EVIDENCE_LOSS' WHEN z LIKE '%CONTRAD%' OR z LIKE '%PERTURB%' THEN 'CONTRADICTION'
 WHEN z LIKE '%MISSING%' OR z LIKE '%HIDE%' THEN 'MISSINGNESS' WHEN z IN ('', 'NONE', 'NATURAL', 'NO_INTERVENTION') THEN 'NATURAL' ELSE 'OTHER' END AS family,
 z NOT IN ('', 'NONE', 'NATURAL', 'NO_INTERVENTION') AS synthetic, count(*) AS n
FROM (SELECT w, upper(trim(coalesce(w, ''))) AS z FROM (SELECT {TYPE_WORD} AS w FROM orders)) GROUP BY 1, 2, 3""")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.expr(TYPE_WORD).alias("intervention_type"))
    return d.groupBy(F.col("intervention_type").alias("w"), S.intervention_family("intervention_type").alias("family"),
                     S.synthetic_flag(d).alias("synthetic")).agg(F.count("*").alias("n"))


@query("p32_p33_f04_hash_split", """
SELECT c_custkey, (('0x' || substr(sha256('20261004' || c_custkey::VARCHAR), 1, 8))::BIGINT % 2)::INT AS half,
 (round(('0x' || substr(sha256('all:' || c_custkey::VARCHAR), 1, 12))::BIGINT / 281474976710656.0, 9) + 0.0) AS u FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", S.hash_half(k, 20261004).alias("half"), r(S.hash_unit(k, "all:"), 9).alias("u"))


@query("p35_severity_rank", f"""{BASE}
SELECT intervention_type, CASE intervention_type WHEN 'NONE' THEN 0 WHEN 'MISSING_GR' THEN 1 WHEN 'MULTI_FIELD_MISSING' THEN 3 ELSE 2 END AS severity, count(*) AS n
FROM epi GROUP BY 1, 2""")
def _(spark, sf):
    return episodes(spark, sf).groupBy("intervention_type", S.severity_rank("intervention_type").alias("severity")).agg(F.count("*").alias("n"))


@query("p37_number_changed", """
SELECT l_orderkey, l_linenumber, ((a IS NULL) <> (b IS NULL)) OR coalesce(abs(a - b) > 1e-9 + 1e-6 * abs(b), false) AS changed FROM (
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 4 THEN l_extendedprice END AS a,
 CASE WHEN l_linenumber < 6 THEN l_extendedprice * (CASE WHEN l_returnflag = 'R' THEN 1.00001 ELSE 1.0000000001 END) END AS b FROM lineitem)""")
def _(spark, sf):
    d = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"])
    a = F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice"))
    factor = F.when(F.col("l_returnflag") == "R", 1.00001).otherwise(1.0000000001)
    b = F.when(F.col("l_linenumber") < 6, F.col("l_extendedprice") * factor)
    return d.select("l_orderkey", "l_linenumber", S.number_changed(a, b, 1e-9, 1e-6).alias("changed"))


@query("p38_evidence_complete", f"{BASE} SELECT case_id, complete FROM epi")
def _(spark, sf):
    return value_cases(spark, sf).select("case_id", S.evidence_complete("goods_receipt_required", "gr_available_at_t0").alias("complete"))


@query("p39_calendar_regime", """
SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' AND o_orderdate >= TIMESTAMP '1995-01-01' THEN 'train'
 WHEN o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'calibration'
 WHEN o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1999-01-01' THEN 'test' ELSE 'unused' END AS regime, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    spans = [("train", "1995-01-01", "1997-01-01"), ("calibration", "1997-01-01", "1998-01-01"), ("test", "1998-06-01", "1999-01-01")]
    return table(spark, sf, "orders").groupBy(S.calendar_regime(F.col("o_orderdate"), spans).alias("regime")).agg(F.count("*").alias("n"))


# ---- labels -------------------------------------------------------------------------------
ADV = " OR ".join(CORE)
NEED = "(goods_receipt_required AND NOT gr_available_at_t0)"


@query("l01_l04_t0_targets", f"""{BASE}
SELECT case_id, target AS d1,
 CASE WHEN {NEED} OR {ADV} OR outcome_additional_invoice_receipt THEN 'NOT_SAFE_TO_EXECUTE' WHEN outcome_eventually_cleared THEN 'SAFE_TO_EXECUTE' ELSE 'AMBIGUOUS' END AS d2,
 CASE WHEN synthetic THEN 'NOT_SAFE_TO_EXECUTE' ELSE target END AS d3,
 CASE WHEN expected_action_reference = 'EXECUTE' THEN 'SAFE_TO_EXECUTE' ELSE 'NOT_SAFE_TO_EXECUTE' END AS d4 FROM epi""")
def _(spark, sf):
    return episodes(spark, sf).select(
        "case_id", L.d1_target().alias("d1"), L.d2_target().alias("d2"), L.d3_target(F.col("synthetic")).alias("d3"),
        L.d4_target("expected_action_reference").alias("d4"))


@query("l06_robustness_target", f"""{BASE},
src AS (SELECT o_orderkey, target FROM epi WHERE regime <> 'middle')
SELECT epi.case_id, CASE WHEN synthetic THEN 'NOT_SAFE_TO_EXECUTE' ELSE coalesce(src.target, 'AMBIGUOUS') END AS target
FROM epi LEFT JOIN src ON epi.group_id = src.o_orderkey""")
def _(spark, sf):
    d = episodes(spark, sf)
    src = d.where(F.col("regime") != "middle").select(F.col("o_orderkey").alias("_k"), F.col("target").alias("_t"))
    return d.join(src, d["group_id"] == src["_k"], "left").select("case_id", L.robustness_target(F.col("synthetic"), F.col("_t")).alias("target"))


@query("l07_action_fallback", f"{BASE} SELECT case_id, unsafe FROM epi")
def _(spark, sf):
    return episodes(spark, sf).select("case_id", L.action_fallback_unsafe("robust_target", "expected_action_reference").alias("unsafe"))


CONV_SQL = """conv AS (SELECT epi.*, convention, CASE WHEN robust_target <> 'AMBIGUOUS' THEN robust_target = 'NOT_SAFE_TO_EXECUTE'
 WHEN convention = 'FALLBACK' THEN expected_action_reference <> 'EXECUTE' WHEN convention = 'AMBIGUOUS_SAFE' THEN false
 WHEN convention = 'AMBIGUOUS_UNSAFE' THEN true END AS cu FROM epi, (SELECT unnest(['FALLBACK','RESOLVED_ONLY','AMBIGUOUS_SAFE','AMBIGUOUS_UNSAFE']) AS convention))"""


@query("l08_ambiguity_conventions", f"{BASE}, {CONV_SQL} SELECT convention, regime, count(cu) AS n, count(*) FILTER (WHERE cu) AS n_unsafe FROM conv GROUP BY 1, 2")
def _(spark, sf):
    # counts per (regime, label, reference) first; the four conventions only meet that small table
    d = episodes(spark, sf).groupBy("regime", "robust_target", "expected_action_reference").agg(F.count("*").alias("k"))
    g = d.withColumn("convention", F.explode(F.array(*[F.lit(c) for c in L.CONVENTIONS])))
    u = L.convention_unsafe(F.col("convention"), F.col("robust_target"), F.col("expected_action_reference"))
    return g.groupBy("convention", "regime").agg(
        F.sum(F.when(u.isNotNull(), F.col("k")).otherwise(0)).alias("n"), F.sum(F.when(u, F.col("k")).otherwise(0)).alias("n_unsafe"))


# ---- evidence gate ------------------------------------------------------------------------
N = {k: f"n_{k}_before_t0" for k in ("goods_receipts", "cancel_gr", "cancel_invoice", "price_change", "quantity_change", "set_payment_block", "remove_payment_block")}
MISS_SQL = {
    "missing_po_value": "po_value_initial_eur IS NULL",
    "missing_invoice_value": "invoice_value_t0_eur IS NULL",
    "missing_required_gr": NEED,
    "missing_vendor_invoice_evidence": "NOT vendor_invoice_seen_at_t0",
    "missing_po_creation_evidence": "NOT po_created_at_t0",
}
HIST_SQL = {
    "gr_flag_false_but_gr_count_positive": f"NOT gr_available_at_t0 AND {N['goods_receipts']} > 0",
    "gr_flag_true_but_gr_count_zero": f"gr_available_at_t0 AND {N['goods_receipts']} = 0",
    "gr_cancel_flag_without_cancel_count": f"had_gr_cancellation_before_t0 AND {N['cancel_gr']} = 0",
    "invoice_cancel_flag_without_cancel_count": f"had_invoice_cancellation_before_t0 AND {N['cancel_invoice']} = 0",
    "price_change_flag_without_count": f"had_price_change_before_t0 AND {N['price_change']} = 0",
    "quantity_change_flag_without_count": f"had_quantity_change_before_t0 AND {N['quantity_change']} = 0",
    "payment_block_flag_without_history": f"had_payment_block_before_t0 AND {N['set_payment_block']} + {N['remove_payment_block']} = 0",
}


def value_sql(delta: str) -> str:
    return (f"(coalesce(inv_po_abs_rel_diff >= {delta}, false) OR (gr_available_at_t0 AND coalesce(inv_gr_abs_rel_diff >= {delta}, false)))")


def gate_sql(delta: str) -> str:
    return (f"CASE WHEN {' OR '.join(f'({e})' for e in HIST_SQL.values())} OR {value_sql(delta)} THEN 'CONTRADICTORY' "
            f"WHEN {' OR '.join(f'({e})' for e in MISS_SQL.values())} THEN 'INCOMPLETE' ELSE 'VALID' END")


RULES_SQL = {**MISS_SQL, **HIST_SQL}
GATE_DELTA = 1.0
GATED = f"{BASE}, gt AS (SELECT *, {gate_sql('1.0')} AS gate, {value_sql('1.0')} AS value_bad FROM epi)"


def gated(spark, sf, delta: float = GATE_DELTA):
    return episodes(spark, sf).withColumn("gate", G.gate_state(delta))


@query("l09_gate_rules", f"{BASE} SELECT case_id, {', '.join(f'({e}) AS {n}' for n, e in RULES_SQL.items())} FROM epi")
def _(spark, sf):
    return value_cases(spark, sf).select("case_id", *[c.alias(n) for n, c in G.fixed_rules().items()])


@query("l10_l11_gate_state", f"{GATED} SELECT case_id, value_bad, gate FROM gt")
def _(spark, sf):
    return value_cases(spark, sf).select("case_id", G.value_rule(GATE_DELTA).alias("value_bad"), G.gate_state(GATE_DELTA).alias("gate"))


HITS = [*RULES_SQL.items(), ("value_inconsistency", value_sql("1.0"))]


@query("l12_rule_hits", f"""{BASE} SELECT case_id, {' + '.join(f'({e})::INT' for _, e in HITS)} AS hits,
 coalesce(nullif(concat_ws('|', {', '.join(f"CASE WHEN {e} THEN '{n}' END" for n, e in HITS)}), ''), 'NONE') AS rules FROM epi""")
def _(spark, sf):
    rules = {**G.fixed_rules(), "value_inconsistency": G.value_rule(GATE_DELTA)}
    return value_cases(spark, sf).select("case_id", L.code_count(rules).alias("hits"), L.code_text(rules).alias("rules"))


DELTAS = [0.25, 0.5, 1.0, 2.0]


@query("l13_a38_gate_by_delta", f"""{BASE} SELECT delta, family, count(*) AS episodes, count(*) FILTER (WHERE gate <> 'VALID') AS blocked,
 {rs("avg((gate <> 'VALID')::INT)")} AS block_rate, {rs("avg((gate = 'INCOMPLETE')::INT)")} AS incomplete_rate FROM
 (SELECT delta, family, {gate_sql('delta')} AS gate FROM epi, (SELECT unnest({DELTAS})::DOUBLE AS delta)) GROUP BY 1, 2""")
def _(spark, sf):
    from ..operators.gate_audit import gate_by_delta

    return rounded(gate_by_delta(episodes(spark, sf), DELTAS, ["family"]), ["block_rate", "incomplete_rate"])


@query("l14_comparison_group", f"""{GATED} SELECT case_id, CASE WHEN family = 'CONTRADICTION' AND gate <> 'VALID' THEN 'CONTRADICTION_BLOCKED'
 WHEN family = 'CONTRADICTION' AND predicted_action = 'EXECUTE' THEN 'CONTRADICTION_VALID_EXECUTED' WHEN family = 'CONTRADICTION' THEN 'CONTRADICTION_VALID_NOT_EXECUTED'
 WHEN family = 'NATURAL' AND expected_action_reference = 'EXECUTE' THEN 'NATURAL_REFERENCE_EXECUTE' ELSE 'OTHER' END AS grp FROM gt""")
def _(spark, sf):
    return gated(spark, sf).select("case_id", G.comparison_group("gate", "predicted_action", "family", "expected_action_reference").alias("grp"))


@query("p40_gate_flags", f"""{GATED} SELECT case_id, gate = 'VALID' AS gate_valid, gate = 'INCOMPLETE' AS gate_incomplete,
 gate = 'CONTRADICTORY' AS gate_contradictory, {rs("1 - p_safe_t0_cal")} AS execute_risk FROM gt""")
def _(spark, sf):
    return gated(spark, sf).select("case_id", *[(F.col("gate") == g).alias(f"gate_{g.lower()}") for g in ("VALID", "INCOMPLETE", "CONTRADICTORY")],
                                   r(1 - F.col("p_safe_t0_cal")).alias("execute_risk"))


@query("p43_error_flags", f"""{GATED} SELECT case_id, (gate = 'VALID' AND p_safe_t0_cal >= 0.8) AS executed, (gate = 'VALID' AND p_safe_t0_cal >= 0.8 AND unsafe) AS unsafe_executed,
 coalesce(p_safe_t0_cal >= 0.95 AND unsafe, false) AS confident_but_unsafe FROM gt""")
def _(spark, sf):
    from ..operators.errors import error_flags

    d = gated(spark, sf).withColumn("action", F.when((F.col("gate") == "VALID") & (F.col("p_safe_t0_cal") >= 0.8), "EXECUTE").otherwise("ESCALATE"))
    return error_flags(d, "p_safe_t0_cal").select("case_id", "executed", "unsafe_executed", "confident_but_unsafe")
