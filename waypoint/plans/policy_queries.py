"""Decisions, losses, policy metrics and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as D
from ..functions import scalars as S
from ..operators import metrics as M
from ..operators import ordered as O
from ..operators import policy as PO
from ..operators import profile as P
from ..session import materialize
from .registry import query, r, rounded, rs
from .scalar_queries import GATED, TRAIN_REF, gated, train_refs

PAR = D.Params(c_g=0.02, c_h=0.1, c_a=0.118, rho_h=0.02, tau0=0.8, beta0=0.2, tau1=0.7, beta1=0.3)
INF = "'Infinity'::DOUBLE"


def c_sql(mode: str = "mode") -> str:
    v = "ln(1 + transaction_exposure_eur)"
    return (f"CASE {mode} WHEN 'UNIFORM' THEN 1.0 WHEN 'LOG_TRAIN_P50' THEN {v} / ln(1 + p50) WHEN 'LOG_TRAIN_P90' THEN {v} / ln(1 + p90) ELSE {v} / ln(1 + p99) END::DOUBLE")


MODED = f"""{GATED}, {TRAIN_REF}, md AS (SELECT gt.*, mode, {c_sql()} AS c FROM gt, tr, (SELECT unnest({D.MODES}) AS mode)),
ls AS (SELECT *, 0.1 + 0.02 * c AS lh, 0.118::DOUBLE AS la, (1 - p_safe_t0_cal) * c AS les, (1 - p_cal_execute) * c AS lem, (1 - p_safe_t1_primary) * c AS lp1 FROM md),
l2 AS (SELECT *, least(CASE WHEN coalesce(p_safe_t1_primary >= 0.7 AND lp1 <= 0.3, false) THEN lp1 ELSE {INF} END, lh, la) AS lpost,
 CASE WHEN coalesce(p_safe_t0_cal >= 0.8 AND les <= 0.2, false) THEN les ELSE {INF} END AS es, CASE WHEN coalesce(p_cal_execute >= 0.8 AND lem <= 0.2, false) THEN lem ELSE {INF} END AS em FROM ls),
l3 AS (SELECT *, CASE WHEN gather_policy_eligible THEN 0.02 + lpost ELSE {INF} END AS lg, CASE WHEN gate = 'VALID' THEN es ELSE {INF} END AS esg, CASE WHEN gate = 'VALID' THEN em ELSE {INF} END AS emg,
 CASE WHEN gather_policy_eligible THEN 0.02 + least(1 - p_safe_t1_primary, 0.1, 0.118) ELSE {INF} END AS lgb,
 CASE WHEN lpost = (CASE WHEN coalesce(p_safe_t1_primary >= 0.7 AND lp1 <= 0.3, false) THEN lp1 ELSE {INF} END) THEN 'EXECUTE' WHEN lpost = lh THEN 'ESCALATE' ELSE 'ABSTAIN' END AS after FROM l2),
l4 AS (SELECT *, CASE WHEN gate = 'CONTRADICTORY' THEN {INF} ELSE lg END AS lgg FROM l3)"""


def pick_sql(*opts: tuple[str, str]) -> str:
    m = "least(" + ", ".join(e for _, e in opts) + ")"
    return "CASE " + " ".join(f"WHEN {e} = {m} THEN '{n}'" for n, e in opts[:-1]) + f" ELSE '{opts[-1][0]}' END"


def four(e: str, g: str, h: str = "lh", a: str = "la") -> str:
    return pick_sql(("EXECUTE", e), ("GATHER", g), ("ESCALATE", h), ("ABSTAIN", a))


ACT = {
    "ARGMAX_V1": "predicted_action", "CONFIDENCE_THRESHOLD_V1": "CASE WHEN p_cal_execute >= 0.5 THEN 'EXECUTE' ELSE 'ESCALATE' END",
    "VOI_BLIND_V1": four("(1 - p_cal_execute)", "lgb", "0.1", "0.118"), "V1_FULL": four("em", "lg"), "V2_SAFETY_NO_GATE": four("es", "lg"),
    "V2_GATE_MULTICLASS_EXECUTE": four("emg", "lgg"), "V2_NO_GATHER": four("esg", INF), "V2_FULL": four("esg", "lgg"),
}
WIDE = f"{MODED}, dw AS (SELECT *, {', '.join(f'{e} AS action__{n}' for n, e in ACT.items())} FROM l4)"
LONG = f"{WIDE}, dl AS ({' UNION ALL '.join(f'''SELECT *, '{n}' AS policy, action__{n} AS action FROM dw''' for n in ACT)})"
LOSS_A = "CASE action WHEN 'EXECUTE' THEN unsafe::INT * c WHEN 'GATHER' THEN 0.02 WHEN 'ESCALATE' THEN 0.1 ELSE 0.118 END"
LOSS_B = "CASE action WHEN 'EXECUTE' THEN unsafe::INT * c WHEN 'GATHER' THEN 0.02 WHEN 'ESCALATE' THEN lh ELSE 0.118 END"
CONT = "CASE WHEN after = 'EXECUTE' AND y_t1 = 'NOT_SAFE_TO_EXECUTE' THEN c WHEN after = 'EXECUTE' AND y_t1 = 'SAFE_TO_EXECUTE' THEN 0.0 WHEN after = 'ESCALATE' THEN lh WHEN after = 'ABSTAIN' THEN 0.118 END"
LOSS_C = f"CASE WHEN action = 'GATHER' THEN 0.02 + {CONT} ELSE {LOSS_B} END"


def metric_sql(loss: str = LOSS_A, v: str = "transaction_exposure_eur") -> str:
    ex, bad = "action = 'EXECUTE'", "action = 'EXECUTE' AND unsafe"
    return f"""count(*) AS episodes, count(*) FILTER (WHERE {ex}) AS execute_count, {rs(f"avg(({ex})::INT)")} AS autonomous_execution_coverage,
 count(*) FILTER (WHERE {bad}) AS unsafe_execute_count, {rs(f"count(*) FILTER (WHERE {bad}) / nullif(count(*) FILTER (WHERE {ex}), 0)")} AS unsafe_execution_rate,
 {rs(f"sum(CASE WHEN {bad} THEN {v} ELSE 0 END) / nullif(sum(CASE WHEN {ex} THEN {v} ELSE 0 END), 0)")} AS raw_exposure_weighted_unsafe_rate,
 {rs(f"sum(CASE WHEN {bad} THEN c ELSE 0 END) / nullif(sum(CASE WHEN {ex} THEN c ELSE 0 END), 0)")} AS consequence_weighted_unsafe_rate,
 {rs(f"avg({loss})")} AS mean_realized_normalized_loss, {rs("avg((action = 'ESCALATE')::INT)")} AS human_escalation_rate, {rs("avg((action = 'GATHER')::INT)")} AS gather_rate, {rs("avg((action = 'ABSTAIN')::INT)")} AS abstention_rate"""


def moded(spark, sf, modes=D.MODES):
    d = gated(spark, sf)
    return PO.with_consequence(d, O.scalars(train_refs(d)), modes)


def longs(spark, sf, keep=(), modes=D.MODES):
    base = ["case_id", "group_id", "regime", "mode", "c", "unsafe", "transaction_exposure_eur", "gate", "expected_action_reference", "family", "y_t1", "p_safe_t1_primary", "p_safe_t0_cal", *keep]
    return PO.decisions_long(moded(spark, sf, modes), PAR, base)


DECIDES = ["part", "transaction_exposure_eur", "gate", "unsafe", "y_t1", "predicted_action", "p_cal_execute", "p_safe_t0_cal", "p_safe_t1_primary", "gather_policy_eligible"]


def terms(loss=None):
    a, u, c = F.col("action"), F.col("unsafe"), F.col("c")
    return M.row_terms(a, u, F.col("transaction_exposure_eur"), c, D.loss_a(a, u, c, PAR) if loss is None else loss)


def metrics_of(df, by, loss=None):
    a, u, c = F.col("action"), F.col("unsafe"), F.col("c")
    return M.policy_metrics(df, by, a, u, F.col("transaction_exposure_eur"), c, D.loss_a(a, u, c, PAR) if loss is None else loss)


@query("d01_first_policy_dataset", f"""{GATED} SELECT case_id, transition_available, gather_policy_eligible, CASE WHEN NOT transition_available THEN 'NO_REAL_T1_TRANSITION' WHEN expected_action_reference <> 'GATHER' THEN 'REFERENCE_NOT_GATHER'
 WHEN synthetic THEN 'SYNTHETIC_EPISODE_EXCLUDED_PRIMARY' ELSE 'ELIGIBLE' END AS reason, {rs('p_safe_t1')} AS p_safe_t1_observed, {rs('p_safe_t1_primary')} AS p_safe_t1_primary, {rs('1 - p_cal_execute')} AS p_nonexecute FROM gt""")
def _(spark, sf):
    from ..operators.datasets import first_policy_dataset

    e = gated(spark, sf).drop("p_safe_t1_primary", "gather_policy_eligible", "transition_available")
    t1 = e.where(F.col("p_safe_t1").isNotNull()).select("case_id", "p_safe_t1")
    d = first_policy_dataset(e.drop("p_safe_t1"), t1, "case_id")
    return rounded(d.select("case_id", "transition_available", "gather_policy_eligible", "reason", F.col("p_safe_t1").alias("p_safe_t1_observed"), "p_safe_t1_primary", "p_nonexecute"))


@query("d02_d03_policy_dataset", f"""{GATED}, {TRAIN_REF} SELECT case_id, gate, {rs('p_safe_t0_cal')} AS p_safe_t0_cal, gate = 'VALID' AS gate_valid, {rs('1 - p_safe_t0_cal')} AS execute_risk, {rs('p50', 2)} AS train_p50, {rs('p90', 2)} AS train_p90, {rs('p99', 2)} AS train_p99 FROM gt, tr""")
def _(spark, sf):
    from ..operators.datasets import policy_dataset

    e = gated(spark, sf)
    d = policy_dataset(e.drop("gate", "p_safe_t0_cal"), e.select("case_id", "p_safe_t0_cal"), e.select("case_id", "gate"), "case_id", train_refs(e))
    return d.select("case_id", "gate", r("p_safe_t0_cal").alias("p_safe_t0_cal"), "gate_valid", r("execute_risk").alias("execute_risk"), *[r(f"train_{p}", 2).alias(f"train_{p}") for p in ("p50", "p90", "p99")])


@query("a61_policy_input_summary", f"""{GATED} SELECT gather_policy_eligible, CASE WHEN NOT transition_available THEN 'NO_REAL_T1_TRANSITION' WHEN expected_action_reference <> 'GATHER' THEN 'REFERENCE_NOT_GATHER'
 WHEN synthetic THEN 'SYNTHETIC_EPISODE_EXCLUDED_PRIMARY' ELSE 'ELIGIBLE' END AS reason, family, count(*) AS episodes, count(DISTINCT group_id) AS source_cases FROM gt GROUP BY 1, 2, 3""")
def _(spark, sf):
    from ..operators.datasets import eligibility_reason

    e = gated(spark, sf).withColumn("reason", eligibility_reason(F.col("transition_available"), F.col("expected_action_reference"), F.col("synthetic")))
    per = e.groupBy("gather_policy_eligible", "reason", "family", "group_id").agg(F.count("*").alias("k"))
    return per.groupBy("gather_policy_eligible", "reason", "family").agg(F.sum("k").alias("episodes"), F.count("*").alias("source_cases"))


@query("d04_d07_losses", f"""{MODED} SELECT case_id, mode, {rs('les')} AS l_execute, {rs('lh')} AS l_escalate, {rs('la')} AS l_abstain, {rs('lpost')} AS l_after, after, (es <> {INF}) AS execute_feasible FROM l4""")
def _(spark, sf):
    d = moded(spark, sf)
    ps, p1, c = F.col("p_safe_t0_cal"), F.col("p_safe_t1_primary"), F.col("c")
    after, loss = D.continuation(p1, c, PAR)
    return d.select("case_id", "mode", r((1 - ps) * c).alias("l_execute"), r(D.escalate_loss(c, PAR)).alias("l_escalate"), r(F.lit(PAR.c_a)).alias("l_abstain"), r(loss).alias("l_after"), after.alias("after"),
                    D.may_execute(ps, c, PAR.tau0, PAR.beta0).alias("execute_feasible"))


@query("d08_d13_eight_policies_wide", f"{WIDE} SELECT case_id, mode, {', '.join('action__' + n for n in ACT)} FROM dw")
def _(spark, sf):
    return PO.with_actions(moded(spark, sf), PAR).select("case_id", "mode", *[f"action__{n}" for n in D.POLICIES])


@query("d17_d19_loss_conventions", f"""{LONG} SELECT policy, mode, {rs(f"avg({LOSS_A})")} AS loss_a, {rs(f"avg({LOSS_B})")} AS loss_b, {rs(f"avg({LOSS_C})")} AS loss_c, count(*) FILTER (WHERE {LOSS_C} IS NULL) AS unknown FROM dl GROUP BY 1, 2""")
def _(spark, sf):
    # the columns that decide are written first, so their making and the policies are compiled apart
    d = materialize(gated(spark, sf).select(*DECIDES))
    d = PO.with_consequence(d, O.scalars(train_refs(d)), D.MODES)
    out = PO.convention_means(PO.with_actions(d, PAR), PAR, ["mode"])
    return out.select("policy", "mode", r("loss_a").alias("loss_a"), r("loss_b").alias("loss_b"), r("loss_c").alias("loss_c"), "unknown")


@query("a26_policy_metrics", f"{LONG} SELECT regime, mode, policy, {metric_sql()} FROM dl GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(metrics_of(longs(spark, sf), ["regime", "mode", "policy"]))


GS = ["gate", "expected_action_reference", "family"]


@query("a28_metrics_by_each_grouping", f"{LONG} " + " UNION ALL ".join(f"SELECT mode, policy, '{g}' AS grouping, {g} AS value, {metric_sql()} FROM dl WHERE mode = 'LOG_TRAIN_P90' GROUP BY 1, 2, 4" for g in GS))
def _(spark, sf):
    return rounded(M.metrics_by_each(longs(spark, sf, modes=["LOG_TRAIN_P90"]), ["mode", "policy"], GS, terms()))


@query("a29_action_counts", f"{LONG} SELECT mode, policy, action, count(*) AS n, {rs('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY mode, policy)')} AS pct FROM dl GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(P.counts_with_share(longs(spark, sf), ["mode", "policy", "action"], ["mode", "policy"]))


MET = f"{LONG}, mt AS (SELECT regime, mode, policy, {metric_sql()} FROM dl GROUP BY 1, 2, 3)"


@query("d14_j09_ablation_deltas", f"{MET} " + " UNION ALL ".join(
    f"SELECT a.regime, a.mode, '{label}' AS comparison, '{m}' AS metric, a.{m} AS \"left\", b.{m} AS \"right\", {rs(f'a.{m} - b.{m}', 5)} AS delta FROM mt a JOIN mt b USING (regime, mode) WHERE a.policy = '{x}' AND b.policy = '{y}'"
    for x, y, label in D.ABLATIONS for m in M.RATES))
def _(spark, sf):
    m = rounded(metrics_of(longs(spark, sf), ["regime", "mode", "policy"]))
    d = PO.ablation_deltas(m, ["regime", "mode"], D.ABLATIONS)
    return d.withColumn("delta", r("delta", 5))


@query("v01_metric_identities", f"""{MET} SELECT 'actions_sum_to_one' AS "check", count(*) AS rows, count(*) FILTER (WHERE abs(autonomous_execution_coverage + human_escalation_rate + gather_rate + abstention_rate - 1) > 1e-5) AS violations, {rs('coalesce(sum(autonomous_execution_coverage + human_escalation_rate + gather_rate + abstention_rate), 0)::DOUBLE', 4)} AS measured FROM mt
 UNION ALL SELECT 'coverage_is_ratio' AS "check", count(*) AS rows, count(*) FILTER (WHERE abs(autonomous_execution_coverage - execute_count / episodes) > 1e-5) AS violations, {rs('coalesce(sum(autonomous_execution_coverage), 0)::DOUBLE', 4)} AS measured FROM mt
 UNION ALL SELECT 'unsafe_within_executed' AS "check", count(*) AS rows, count(*) FILTER (WHERE unsafe_execute_count > execute_count) AS violations, {rs('coalesce(sum(unsafe_execute_count), 0)::DOUBLE', 4)} AS measured FROM mt""")
def _(spark, sf):
    from ..operators.checks import check_rows

    m = rounded(metrics_of(longs(spark, sf), ["regime", "mode", "policy"]), M.RATES)
    cover, unsafe, done = F.col("autonomous_execution_coverage"), F.col("unsafe_execute_count"), F.col("execute_count")
    total = cover + F.col("human_escalation_rate") + F.col("gather_rate") + F.col("abstention_rate")
    return rounded(check_rows(m, {
        "actions_sum_to_one": (F.abs(total - 1) <= 1e-5, total), "coverage_is_ratio": (F.abs(cover - done / F.col("episodes")) <= 1e-5, cover),
        "unsafe_within_executed": (unsafe <= done, unsafe)}), digits=4)


# ---- frontier -----------------------------------------------------------------------------
T0S, B0S, T1S, B1S = [0.5, 0.7, 0.8, 0.9], [0.05, 0.1, 0.2, 0.4, 0.8], [0.5, 0.7, 0.8, 0.9], [0.05, 0.1, 0.2, 0.4]
FG = f"""g AS (SELECT a.x AS tau0, b.x AS beta0, c1.x AS tau1, d.x AS beta1 FROM (SELECT unnest({T0S})::DOUBLE AS x) a, (SELECT unnest({B0S})::DOUBLE AS x) b, (SELECT unnest({T1S})::DOUBLE AS x) c1, (SELECT unnest({B1S})::DOUBLE AS x) d)"""
FR = f"""{MODED}, {FG}, f1 AS (SELECT regime, mode, tau0, beta0, tau1, beta1, unsafe, transaction_exposure_eur, c, lh, la, gate, gather_policy_eligible,
 CASE WHEN gate = 'VALID' AND p_safe_t0_cal >= tau0 AND les <= beta0 THEN les ELSE {INF} END AS e, CASE WHEN coalesce(p_safe_t1_primary >= tau1 AND lp1 <= beta1, false) THEN lp1 ELSE {INF} END AS pe FROM ls, g WHERE mode IN ('UNIFORM', 'LOG_TRAIN_P90')),
f2 AS (SELECT *, CASE WHEN gather_policy_eligible AND gate <> 'CONTRADICTORY' THEN 0.02 + least(pe, lh, la) ELSE {INF} END AS gg FROM f1),
f3 AS (SELECT *, {four('e', 'gg')} AS action FROM f2),
fr AS (SELECT regime, mode, tau0, beta0, tau1, beta1, {metric_sql()} FROM f3 GROUP BY 1, 2, 3, 4, 5, 6)"""
FKEY = ["regime", "mode", "tau0", "beta0", "tau1", "beta1"]


def frontier(spark, sf):
    d = moded(spark, sf, ["UNIFORM", "LOG_TRAIN_P90"])
    return rounded(PO.frontier(d, ["regime", "mode"], PAR, T0S, B0S, T1S, B1S), M.RATES)


@query("d15_j14_s12_frontier", f"{FR} SELECT * FROM fr")
def _(spark, sf):
    return frontier(spark, sf)


@query("j08_w11_pareto", f"""{FR} SELECT {', '.join(FKEY)} FROM fr a WHERE NOT EXISTS (SELECT 1 FROM fr b WHERE a.regime = b.regime AND a.mode = b.mode AND b.autonomous_execution_coverage >= a.autonomous_execution_coverage
 AND coalesce(b.unsafe_execution_rate, 0) <= coalesce(a.unsafe_execution_rate, 0) AND b.mean_realized_normalized_loss <= a.mean_realized_normalized_loss AND (b.autonomous_execution_coverage > a.autonomous_execution_coverage
 OR coalesce(b.unsafe_execution_rate, 0) < coalesce(a.unsafe_execution_rate, 0) OR b.mean_realized_normalized_loss < a.mean_realized_normalized_loss))""")
def _(spark, sf):
    from ..session import materialize

    return PO.pareto(materialize(frontier(spark, sf)), ["regime", "mode"]).select(*FKEY)


CAPS = [0.05, 0.2, 0.5]
BEST = f"""{FR}, bc AS (SELECT * FROM (SELECT fr.*, risk_cap, row_number() OVER (PARTITION BY regime, mode, risk_cap ORDER BY autonomous_execution_coverage DESC, mean_realized_normalized_loss, consequence_weighted_unsafe_rate NULLS LAST,
 raw_exposure_weighted_unsafe_rate NULLS LAST, human_escalation_rate, gather_rate, tau0 DESC, beta0, tau1 DESC, beta1) AS rn FROM fr, (SELECT unnest({CAPS})::DOUBLE AS risk_cap) WHERE execute_count = 0 OR unsafe_execution_rate <= risk_cap) WHERE rn = 1)"""


@query("w12_best_at_caps", f"{BEST} SELECT {', '.join(FKEY)}, risk_cap, autonomous_execution_coverage, unsafe_execution_rate FROM bc")
def _(spark, sf):
    return PO.best_at_caps(frontier(spark, sf), ["regime", "mode"], CAPS).select(*FKEY, "risk_cap", "autonomous_execution_coverage", "unsafe_execution_rate")


@query("w13_best_mode", f"{BEST} SELECT regime, risk_cap, mode FROM (SELECT *, row_number() OVER (PARTITION BY regime, risk_cap ORDER BY autonomous_execution_coverage DESC, mean_realized_normalized_loss, unsafe_execution_rate NULLS LAST, mode) AS r2 FROM bc) WHERE r2 = 1")
def _(spark, sf):
    return PO.best_mode(PO.best_at_caps(frontier(spark, sf), ["regime", "mode"], CAPS)).select("regime", "risk_cap", "mode")


@query("w14_reference_comparison", f"""{BEST}, rf AS (SELECT regime, mode, autonomous_execution_coverage AS rc, mean_realized_normalized_loss AS rl FROM fr WHERE tau0 = 0.8 AND beta0 = 0.2 AND tau1 = 0.7 AND beta1 = 0.2)
SELECT regime, mode, risk_cap, {rs('autonomous_execution_coverage - rc')} AS coverage_delta, {rs('mean_realized_normalized_loss - rl')} AS loss_delta FROM bc LEFT JOIN rf USING (regime, mode)""")
def _(spark, sf):
    from ..operators.checks import checked_join
    from ..session import materialize

    f = materialize(frontier(spark, sf))
    ref = f.where("tau0 = 0.8 AND beta0 = 0.2 AND tau1 = 0.7 AND beta1 = 0.2").select("regime", "mode", F.col("autonomous_execution_coverage").alias("rc"), F.col("mean_realized_normalized_loss").alias("rl"))
    j = checked_join(PO.best_at_caps(f, ["regime", "mode"], CAPS), ref, ["regime", "mode"], "many_to_one")
    return j.select("regime", "mode", "risk_cap", r(F.col("autonomous_execution_coverage") - F.col("rc")).alias("coverage_delta"), r(F.col("mean_realized_normalized_loss") - F.col("rl")).alias("loss_delta"))


# ---- error tables -------------------------------------------------------------------------
FULLQ = f"{LONG}, fu AS (SELECT * FROM dl WHERE policy = 'V2_FULL' AND mode = 'LOG_TRAIN_P90')"


def full(spark, sf, keep=("intervention_type", "strength", "item_category")):
    d = moded(spark, sf, ["LOG_TRAIN_P90"])
    c = F.col("c")
    a, _ = D.decide(F.col("p_safe_t0_cal"), F.col("p_safe_t1_primary"), c, PAR, F.col("gather_policy_eligible"), F.col("gate"))
    return d.withColumns({"action": a, "after": D.continuation(F.col("p_safe_t1_primary"), c, PAR)[0]})


EG = ["family", "intervention_type", "gate", "band", "expected_action_reference"]
BANDS = "CASE " + " ".join(f"WHEN p_safe_t0_cal < {e} THEN '{n}'" for e, n in zip(S.SCORE_BANDS, S.SCORE_BAND_LABELS)) + f" ELSE '{S.SCORE_BAND_LABELS[-1]}' END"


@query("a30_errors_by_grouping", f"{FULLQ}, fb AS (SELECT *, {BANDS} AS band FROM fu) " + " UNION ALL ".join(f"SELECT '{g}' AS grouping, {g} AS value, {metric_sql()} FROM fb GROUP BY 2" for g in EG))
def _(spark, sf):
    d = full(spark, sf).withColumn("band", S.score_band("p_safe_t0_cal"))
    return rounded(M.metrics_by_each(d, [], EG, terms()))


@query("a31_confident_false_safe", f"""{FULLQ} SELECT regime, t AS threshold, count(*) AS episodes, count(*) FILTER (WHERE p_safe_t0_cal >= t) AS high, count(*) FILTER (WHERE p_safe_t0_cal >= t AND unsafe) AS high_unsafe,
 count(*) FILTER (WHERE p_safe_t0_cal >= t AND unsafe AND action = 'EXECUTE') AS high_unsafe_executed, {rs('count(*) FILTER (WHERE p_safe_t0_cal >= t AND unsafe) / nullif(count(*) FILTER (WHERE p_safe_t0_cal >= t), 0)')} AS unsafe_rate
 FROM fu, (SELECT unnest([0.8, 0.9, 0.95])::DOUBLE AS t) GROUP BY 1, 2""")
def _(spark, sf):
    from ..operators.errors import confident_false_safe

    return rounded(confident_false_safe(full(spark, sf), "p_safe_t0_cal", [0.8, 0.9, 0.95], ["regime"]))


@query("a32_evidence_outcomes", f"""{FULLQ} SELECT regime, family, count(*) AS gathered, count(*) FILTER (WHERE after = 'EXECUTE') AS post_execute, count(*) FILTER (WHERE after = 'ESCALATE') AS post_escalate, count(*) FILTER (WHERE after = 'ABSTAIN') AS post_abstain,
 count(*) FILTER (WHERE after = 'EXECUTE' AND y_t1 <> 'AMBIGUOUS') AS known, count(*) FILTER (WHERE after = 'EXECUTE' AND y_t1 = 'NOT_SAFE_TO_EXECUTE') AS post_unsafe,
 {rs("count(*) FILTER (WHERE after = 'EXECUTE' AND y_t1 = 'NOT_SAFE_TO_EXECUTE') / nullif(count(*) FILTER (WHERE after = 'EXECUTE' AND y_t1 <> 'AMBIGUOUS'), 0)")} AS post_unsafe_rate FROM fu WHERE action = 'GATHER' GROUP BY 1, 2""")
def _(spark, sf):
    from ..operators.errors import evidence_outcomes

    return rounded(evidence_outcomes(full(spark, sf), ["regime", "family"]))


@query("a33_label_conversion", f"{FULLQ} SELECT regime, robust_target, y_t1, count(*) AS n, {rs('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY regime)')} AS pct FROM fu WHERE action = 'GATHER' GROUP BY 1, 2, 3")
def _(spark, sf):
    d = full(spark, sf).where(F.col("action") == "GATHER")
    return rounded(P.counts_with_share(d, ["regime", "robust_target", "y_t1"], ["regime"]))


@query("a34_loss_accounting", f"""{FULLQ} SELECT regime, count(*) AS episodes, count(*) FILTER (WHERE action = 'GATHER') AS gathered, {rs(f'avg({LOSS_B})')} AS top_level, {rs(f'avg({LOSS_C})')} AS end_to_end,
 {rs(f'avg({LOSS_C}) - avg({LOSS_B})')} AS delta, count(*) FILTER (WHERE {LOSS_C} IS NULL) AS unknown FROM fu GROUP BY 1""")
def _(spark, sf):
    a, u, c = F.col("action"), F.col("unsafe"), F.col("c")
    d = full(spark, sf).select("regime", "action", D.loss_b(a, u, c, PAR).alias("b"), D.loss_c(a, u, F.col("after"), F.col("y_t1"), c, PAR).alias("e"))
    return rounded(d.groupBy("regime").agg(F.count("*").alias("episodes"), O.count_if(a == "GATHER").alias("gathered"), F.avg("b").alias("top_level"), F.avg("e").alias("end_to_end"),
                                           (F.avg("e") - F.avg("b")).alias("delta"), O.count_if(F.col("e").isNull()).alias("unknown")))


# ---- first-generation policies ------------------------------------------------------------
V1H = "0.1 + 0.02 * c"
V1 = f"""{MODED}, v0 AS (SELECT *, (1 - p_cal_execute) * c AS le FROM l4 WHERE mode = 'LOG_TRAIN_P90'), v1 AS (SELECT *, CASE WHEN le <= 0.2 THEN le ELSE {INF} END AS leb, avg(lh) OVER () AS mh FROM v0),
vp AS (SELECT *, predicted_action AS p_ARGMAX, CASE WHEN predicted_action = 'GATHER' THEN CASE WHEN mh <= 0.118 THEN 'ESCALATE' ELSE 'ABSTAIN' END ELSE predicted_action END AS f_ARGMAX,
 CASE WHEN p_cal_execute >= 0.8 THEN 'EXECUTE' ELSE 'ESCALATE' END AS p_CONFIDENCE_THRESHOLD, {pick_sql(('EXECUTE', 'le'), ('ESCALATE', 'lh'), ('ABSTAIN', 'la'))} AS p_COST_AWARE_BLIND,
 {pick_sql(('EXECUTE', 'leb'), ('ESCALATE', 'lh'), ('ABSTAIN', 'la'))} AS p_NO_GATHER, {pick_sql(('EXECUTE', 'leb'), ('ESCALATE', 'lh'), ('ABSTAIN', 'la'), ('GATHER', 'lg'))} AS p_FULL FROM v1),
vl AS (SELECT *, 'ARGMAX' AS policy, p_ARGMAX AS pa, f_ARGMAX AS fa FROM vp UNION ALL SELECT *, 'CONFIDENCE_THRESHOLD', p_CONFIDENCE_THRESHOLD, p_CONFIDENCE_THRESHOLD FROM vp UNION ALL SELECT *, 'COST_AWARE_BLIND', p_COST_AWARE_BLIND, p_COST_AWARE_BLIND FROM vp
 UNION ALL SELECT *, 'NO_GATHER', p_NO_GATHER, p_NO_GATHER FROM vp UNION ALL SELECT *, 'FULL', p_FULL, CASE WHEN p_FULL = 'GATHER' THEN after ELSE p_FULL END FROM vp),
vr AS (SELECT *, (fa = 'EXECUTE' AND ((pa = 'EXECUTE' AND expected_action_reference <> 'EXECUTE') OR (pa = 'GATHER' AND y_t1 <> 'SAFE_TO_EXECUTE'))) AS bad,
 CASE pa WHEN 'EXECUTE' THEN (expected_action_reference <> 'EXECUTE')::INT * c WHEN 'ESCALATE' THEN lh WHEN 'ABSTAIN' THEN 0.118 ELSE 0.02 + CASE fa WHEN 'EXECUTE' THEN (y_t1 <> 'SAFE_TO_EXECUTE')::INT * c WHEN 'ESCALATE' THEN lh WHEN 'ABSTAIN' THEN 0.118 ELSE 0 END END AS loss FROM vl)"""


@query("d16_a27_d22_first_generation", f"""{V1} SELECT policy, count(*) AS episodes, count(*) FILTER (WHERE fa = 'EXECUTE') AS executed, count(*) FILTER (WHERE bad) AS unsafe, {rs("avg((fa = 'EXECUTE')::INT)")} AS coverage,
 {rs("count(*) FILTER (WHERE bad) / nullif(count(*) FILTER (WHERE fa = 'EXECUTE'), 0)")} AS unsafe_rate, {rs('avg(loss)')} AS mean_loss, {rs("avg((pa = 'GATHER')::INT)")} AS gather_rate, {rs("avg((fa = 'ESCALATE')::INT)")} AS escalation_rate,
 {rs("avg((pa = 'GATHER' AND fa = 'EXECUTE')::INT)")} AS post_gather_execute_rate FROM vr GROUP BY 1""")
def _(spark, sf):
    from ..operators.first_generation import evaluate

    d = moded(spark, sf, ["LOG_TRAIN_P90"])
    e = evaluate(d, ["ARGMAX", "CONFIDENCE_THRESHOLD", "COST_AWARE_BLIND", "NO_GATHER", "FULL"], PAR, ["policy"])
    return rounded(e)


@query("d16_first_generation_budget_sweep", f"""{MODED}, sw AS (SELECT *, (1 - p_cal_execute) * c AS le FROM l4, (SELECT unnest([0.05, 0.1, 0.2, 0.4, 0.8])::DOUBLE AS beta0) WHERE mode = 'LOG_TRAIN_P90'),
s2 AS (SELECT *, {pick_sql(('EXECUTE', f'(CASE WHEN le <= beta0 THEN le ELSE {INF} END)'), ('ESCALATE', 'lh'), ('ABSTAIN', 'la'))} AS a FROM sw)
SELECT beta0, count(*) FILTER (WHERE a = 'EXECUTE') AS executed, count(*) FILTER (WHERE a = 'EXECUTE' AND expected_action_reference <> 'EXECUTE') AS unsafe, {rs("avg(CASE a WHEN 'EXECUTE' THEN (expected_action_reference <> 'EXECUTE')::INT * c WHEN 'ESCALATE' THEN lh ELSE 0.118 END)")} AS mean_loss FROM s2 GROUP BY 1""")
def _(spark, sf):
    from ..operators.first_generation import budget_sweep

    return rounded(budget_sweep(moded(spark, sf, ["LOG_TRAIN_P90"]), [0.05, 0.1, 0.2, 0.4, 0.8], PAR))


FT = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@query("d16_first_generation_confidence_sweep", f"""{MODED}, sw AS (SELECT *, p_cal_execute >= t AS ex, expected_action_reference <> 'EXECUTE' AS bad FROM l4, (SELECT unnest({FT})::DOUBLE AS t) WHERE mode = 'LOG_TRAIN_P90')
SELECT t AS threshold, count(*) FILTER (WHERE ex) AS executed, count(*) FILTER (WHERE ex AND bad) AS unsafe, {rs('avg(ex::INT)')} AS coverage, {rs('count(*) FILTER (WHERE ex AND bad) / nullif(count(*) FILTER (WHERE ex), 0)')} AS unsafe_rate,
 {rs('avg(CASE WHEN ex THEN bad::INT * c ELSE lh END)')} AS mean_loss FROM sw GROUP BY 1""")
def _(spark, sf):
    from ..operators.first_generation import confidence_sweep

    return rounded(confidence_sweep(moded(spark, sf, ["LOG_TRAIN_P90"]), FT, PAR))


CG = [(g, h, a) for g in (0.01, 0.02, 0.05, 0.1) for h in (0.05, 0.1, 0.2) for a in (0.2, 0.5, 1.0) if g < h < a]


@query("d16_s13_cost_grid", f"""{MODED}, cg AS (SELECT * FROM (SELECT unnest([0.01, 0.02, 0.05, 0.1])::DOUBLE AS g) , (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS h), (SELECT unnest([0.2, 0.5, 1.0])::DOUBLE AS a) WHERE g < h AND h < a),
z0 AS (SELECT *, (1 - p_cal_execute) * c AS le, h + 0.02 * c AS hh FROM md, cg WHERE mode = 'LOG_TRAIN_P90'),
z1 AS (SELECT *, CASE WHEN le <= 0.2 THEN le ELSE {INF} END AS e, CASE WHEN gather_policy_eligible THEN g + least(CASE WHEN coalesce(p_safe_t1_primary >= 0.7 AND (1 - p_safe_t1_primary) * c <= 0.3, false) THEN (1 - p_safe_t1_primary) * c ELSE {INF} END, hh, a) ELSE {INF} END AS gg FROM z0),
z2 AS (SELECT *, {pick_sql(('EXECUTE', 'e'), ('ESCALATE', 'hh'), ('ABSTAIN', 'a'), ('GATHER', 'gg'))} AS act FROM z1)
SELECT g AS c_g, h AS c_h, a AS c_a, count(*) FILTER (WHERE act = 'EXECUTE') AS executed, count(*) FILTER (WHERE act = 'GATHER') AS gathered, count(*) FILTER (WHERE act = 'ESCALATE') AS escalated, count(*) FILTER (WHERE act = 'ABSTAIN') AS abstained FROM z2 GROUP BY 1, 2, 3""")
def _(spark, sf):
    from ..operators.first_generation import cost_grid

    return cost_grid(moded(spark, sf, ["LOG_TRAIN_P90"]), [0.01, 0.02, 0.05, 0.1], [0.05, 0.1, 0.2], [0.2, 0.5, 1.0], PAR)


PT, PB = [0.1, 0.3, 0.5, 0.7, 0.9], [0.1, 0.3, 0.6]


@query("d16_post_evidence_gate_sweep", f"""{MODED}, z0 AS (SELECT *, (1 - p_cal_execute) * c AS le, (1 - p_safe_t1_primary) * c AS l1 FROM l4, (SELECT unnest({PT})::DOUBLE AS tau1), (SELECT unnest({PB})::DOUBLE AS beta1) WHERE mode = 'LOG_TRAIN_P90'),
z1 AS (SELECT *, CASE WHEN le <= 0.2 THEN le ELSE {INF} END AS e, CASE WHEN coalesce(p_safe_t1_primary >= tau1 AND l1 <= beta1, false) THEN l1 ELSE {INF} END AS e1 FROM z0),
z2 AS (SELECT *, {pick_sql(('EXECUTE', 'e1'), ('ESCALATE', 'lh'), ('ABSTAIN', '0.118'))} AS later, CASE WHEN gather_policy_eligible THEN 0.02 + least(e1, lh, 0.118) ELSE {INF} END AS gg FROM z1),
z3 AS (SELECT *, {pick_sql(('EXECUTE', 'e'), ('ESCALATE', 'lh'), ('ABSTAIN', '0.118'), ('GATHER', 'gg'))} AS act FROM z2)
SELECT tau1, beta1, count(*) FILTER (WHERE act = 'EXECUTE' OR (act = 'GATHER' AND later = 'EXECUTE')) AS executed, count(*) FILTER (WHERE act = 'GATHER') AS gathered, count(*) FILTER (WHERE act = 'GATHER' AND later = 'EXECUTE') AS post_gather_executed,
 {rs("avg((act = 'GATHER' AND later = 'EXECUTE')::INT)")} AS post_gather_execute_rate, count(*) FILTER (WHERE act = 'GATHER' AND later = 'ESCALATE') AS post_gather_escalated, count(*) FILTER (WHERE act = 'GATHER' AND later = 'ABSTAIN') AS post_gather_abstained FROM z3 GROUP BY 1, 2""")
def _(spark, sf):
    from ..operators.first_generation import post_gate_sweep

    return rounded(post_gate_sweep(moded(spark, sf, ["LOG_TRAIN_P90"]), PT, PB, PAR))
