"""Curves, discrimination, class metrics and rule comparisons over scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as D
from ..functions import scalars as S
from ..operators import curves as C
from ..operators import metrics as M
from ..operators import ordered as O
from ..operators import rules as R
from .policy_queries import PAR, WIDE, c_sql, moded
from .population_queries import GRP
from .registry import query, r, rounded, rs
from .scalar_queries import GATED, PC, TRAIN_REF, gated, train_refs
from .tables import BASE, episodes

SC = f"""{GATED}, sc AS (SELECT * EXCLUDE (u), (target = 'NOT_SAFE_TO_EXECUTE') AS u FROM gt WHERE target <> 'AMBIGUOUS'),
bt AS (SELECT *, 'RAW' AS score_type, p_safe_t0_raw AS s FROM sc UNION ALL SELECT *, 'CALIBRATED', p_safe_t0_cal FROM sc)"""


def scored(spark, sf, base=None):
    d = (gated(spark, sf) if base is None else base).where(F.col("target") != S.AMBIGUOUS)
    return d.withColumn("u", F.col("target") == S.UNSAFE)


def both(spark, sf, keep=("case_id", "regime", "u", "transaction_exposure_eur")):
    rows = F.array(F.struct(F.lit("RAW").alias("score_type"), F.col("p_safe_t0_raw").alias("s")), F.struct(F.lit("CALIBRATED").alias("score_type"), F.col("p_safe_t0_cal").alias("s")))
    return scored(spark, sf).select(*keep, F.inline(rows))


BY = ["regime", "score_type"]
CURVE = f"""{SC}, cu AS (SELECT regime, score_type, case_id, s AS threshold, row_number() OVER w AS rank, count(*) OVER (PARTITION BY regime, score_type) AS n, sum(u::INT) OVER w AS cu,
 sum(transaction_exposure_eur) OVER w AS cv, sum(CASE WHEN u THEN transaction_exposure_eur ELSE 0 END) OVER w AS cuv FROM bt WINDOW w AS (PARTITION BY regime, score_type ORDER BY s DESC, case_id ROWS UNBOUNDED PRECEDING)),
cv AS (SELECT *, rank / n AS coverage, cu / rank AS unsafe_rate, cuv / nullif(cv, 0) AS wrate FROM cu)"""


def curve(spark, sf):
    return C.risk_curve(both(spark, sf), "s", "case_id", "u", "transaction_exposure_eur", BY)


@query("w01_risk_curve", f"{CURVE} SELECT regime, score_type, case_id, rank, {rs('coverage')} AS coverage, {rs('unsafe_rate')} AS unsafe_rate, {rs('wrate', 5)} AS weighted_unsafe_rate FROM cv")
def _(spark, sf):
    return curve(spark, sf).select(*BY, "case_id", "rank", r("coverage").alias("coverage"), r("unsafe_rate").alias("unsafe_rate"), r("weighted_unsafe_rate", 5).alias("weighted_unsafe_rate"))


AREA = "ar AS (SELECT regime, score_type, sum((coverage - c0) * (unsafe_rate + r0) / 2) AS aurc, sum((coverage - c0) * (wrate + w0) / 2) AS waurc FROM (SELECT *, lag(coverage) OVER x AS c0, lag(unsafe_rate) OVER x AS r0, lag(wrate) OVER x AS w0 FROM cv WINDOW x AS (PARTITION BY regime, score_type ORDER BY rank)) GROUP BY 1, 2)"


@query("w02_area_under_curve", f"{CURVE}, {AREA} SELECT regime, score_type, {rs('aurc', 5)} AS aurc, {rs('waurc', 5)} AS weighted_aurc FROM ar")
def _(spark, sf):
    return rounded(C.area_under(curve(spark, sf), BY), digits=5)


TG = [0.05, 0.1, 0.25, 0.5, 0.9, 1.0]


@query("w03_at_coverages", f"""{CURVE} SELECT regime, score_type, t AS coverage_target, rank, {rs('coverage')} AS coverage, {rs('threshold')} AS threshold, {rs('unsafe_rate')} AS unsafe_rate FROM (
 SELECT *, row_number() OVER (PARTITION BY regime, score_type, t ORDER BY abs(coverage - t), rank) AS pos FROM cv, (SELECT unnest({TG})::DOUBLE AS t)) WHERE pos = 1""")
def _(spark, sf):
    return rounded(C.at_coverages(curve(spark, sf), BY, TG).drop("weighted_unsafe_rate"), ["coverage", "threshold", "unsafe_rate"])


CP = [0.0, 0.05, 0.2, 0.5]


@query("w04_at_risk_caps", f"""{CURVE}, k AS (SELECT regime, score_type, cap FROM (SELECT DISTINCT regime, score_type FROM cv), (SELECT unnest({CP})::DOUBLE AS cap)),
b AS (SELECT * FROM (SELECT cv.*, cap, row_number() OVER (PARTITION BY regime, score_type, cap ORDER BY rank DESC) AS pos FROM cv, (SELECT unnest({CP})::DOUBLE AS cap) WHERE unsafe_rate <= cap) WHERE pos = 1)
SELECT k.regime, k.score_type, k.cap AS risk_cap, coalesce(rank, 0) AS selected, {rs('coalesce(coverage, 0)')} AS coverage, {rs('threshold')} AS threshold, {rs('unsafe_rate')} AS unsafe_rate FROM k LEFT JOIN b USING (regime, score_type, cap)""")
def _(spark, sf):
    return rounded(C.at_risk_caps(curve(spark, sf), BY, CP), ["coverage", "threshold", "unsafe_rate"])


SUMQ = f"""{CURVE}, {AREA}, sm AS (SELECT regime, score_type, count(*) AS n_cases, count(*) FILTER (WHERE u) AS unsafe_cases, avg(u::INT) AS unsafe_prevalence, sum(CASE WHEN u THEN transaction_exposure_eur ELSE 0 END) / sum(transaction_exposure_eur) AS full_weighted_rate,
 avg(s) AS mean_score, quantile_cont(s, 0.5) AS median_score, min(s) AS min_score, max(s) AS max_score FROM bt GROUP BY 1, 2)"""


@query("w05_curve_summary", f"{SUMQ} SELECT regime, score_type, n_cases, unsafe_cases, " + ", ".join(f"{rs(x, 5)} AS {x}" for x in ("unsafe_prevalence", "full_weighted_rate", "mean_score", "median_score", "min_score", "max_score", "aurc")) + f", {rs('waurc', 5)} AS weighted_aurc, 0 AS missing_value FROM sm JOIN ar USING (regime, score_type)")
def _(spark, sf):
    return rounded(C.curve_summary(both(spark, sf), curve(spark, sf), "s", "u", "transaction_exposure_eur", BY), digits=5)


@query("w06_raw_vs_calibrated", f"{CURVE}, {AREA} SELECT a.regime, {rs('a.aurc', 5)} AS aurc_raw, {rs('b.aurc', 5)} AS aurc_calibrated, {rs('b.aurc - a.aurc', 4)} AS aurc_delta FROM ar a JOIN ar b USING (regime) WHERE a.score_type = 'RAW' AND b.score_type = 'CALIBRATED'")
def _(spark, sf):
    a = C.area_under(curve(spark, sf), BY).groupBy("regime").pivot("score_type", ["RAW", "CALIBRATED"]).agg(F.first("aurc"))
    return a.select("regime", r("RAW", 5).alias("aurc_raw"), r("CALIBRATED", 5).alias("aurc_calibrated"), r(F.col("CALIBRATED") - F.col("RAW"), 4).alias("aurc_delta"))


@query("w07_rank_agreement", f"""{SC}, rk AS (SELECT regime, p_safe_t0_raw AS a, p_safe_t0_cal AS b, (rank() OVER (PARTITION BY regime ORDER BY p_safe_t0_raw) + (count(*) OVER (PARTITION BY regime, p_safe_t0_raw) - 1) / 2.0) / count(*) OVER (PARTITION BY regime) AS ra,
 (rank() OVER (PARTITION BY regime ORDER BY p_safe_t0_cal) + (count(*) OVER (PARTITION BY regime, p_safe_t0_cal) - 1) / 2.0) / count(*) OVER (PARTITION BY regime) AS rb FROM sc)
SELECT regime, count(*) AS n, {rs('corr(a, b)', 5)} AS pearson, {rs('corr(ra, rb)', 5)} AS spearman, {rs('avg(abs(ra - rb))', 5)} AS mean_shift, {rs('quantile_cont(abs(ra - rb), 0.9)', 5)} AS p90_shift, {rs('quantile_cont(abs(ra - rb), 0.99)', 5)} AS p99_shift FROM rk GROUP BY 1""")
def _(spark, sf):
    return rounded(C.rank_agreement(scored(spark, sf).select("regime", "p_safe_t0_raw", "p_safe_t0_cal"), "p_safe_t0_raw", "p_safe_t0_cal", ["regime"]), digits=5)


PTS = f"""{SC}, gp AS (SELECT regime, score_type, s, count(*) FILTER (WHERE NOT u) AS pos, count(*) FILTER (WHERE u) AS neg FROM bt GROUP BY 1, 2, 3),
pt AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER t AS p, sum(neg) OVER t AS n FROM gp WINDOW w AS (PARTITION BY regime, score_type ORDER BY s DESC ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY regime, score_type))"""


def points(spark, sf):
    return C.score_points(both(spark, sf), "s", ~F.col("u"), BY)


@query("w08_roc_pr_points", f"{PTS} SELECT regime, score_type, {rs('s')} AS threshold, {rs('cp / p')} AS tpr, {rs('cn / n')} AS fpr, {rs('cp / (cp + cn)')} AS \"precision\" FROM pt")
def _(spark, sf):
    return rounded(C.roc_pr_points(points(spark, sf), BY))


@query("m15_m16_auroc_ap", f"{PTS} SELECT regime, score_type, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives, {rs('sum(neg * (cp - pos / 2.0)) / (any_value(p) * any_value(n))')} AS auroc, {rs('sum(pos * (cp / (cp + cn))) / any_value(p)')} AS average_precision FROM pt GROUP BY 1, 2")
def _(spark, sf):
    return rounded(C.discrimination(points(spark, sf), BY))


@query("m21_score_type_metrics", f"{PTS} SELECT regime, score_type, {rs('sum(pos * (cp / (cp + cn))) / any_value(p) / (any_value(p) / (any_value(p) + any_value(n)))', 5)} AS lift, count(*) AS distinct_scores, {rs('max(s)')} AS max_score FROM pt GROUP BY 1, 2")
def _(spark, sf):
    from ..session import materialize

    p = materialize(points(spark, sf))
    d = C.discrimination(p, BY)
    prev = F.col("positives") / (F.col("positives") + F.col("negatives"))
    k = p.groupBy(*BY).agg(F.count("*").alias("distinct_scores"), r(F.max("score")).alias("max_score"))
    return d.select(*BY, r(F.col("average_precision") / prev, 5).alias("lift")).join(k, BY)


@query("a44_plateaus", f"""{SC}, pl AS (SELECT regime, p_safe_t0_cal AS cal, count(*) AS n_rows, count(DISTINCT p_safe_t0_raw) AS ru FROM sc GROUP BY 1, 2)
SELECT regime, max(n_rows) AS largest_plateau, {rs('max(n_rows) / sum(n_rows)')} AS largest_share, max(ru) AS max_raw_per_value, count(*) AS calibrated_values, {rs('quantile_cont(n_rows, 0.5)')} AS median_rows FROM pl GROUP BY 1""")
def _(spark, sf):
    return rounded(C.compression(C.plateau_map(scored(spark, sf), "p_safe_t0_raw", "p_safe_t0_cal", ~F.col("u"), ["regime"]), ["regime"]))


VARS = ["inv_po_abs_rel_diff", "p_safe_t0_raw", "transaction_exposure_eur"]
SEP = f"""{GATED}, g AS (SELECT *, {GRP} AS grp FROM gt), sv AS ({' UNION ALL '.join(f"SELECT '{v}' AS variable, {v}::DOUBLE AS x, grp = 'CONTRADICTION_BLOCKED' AS a, grp = 'NATURAL_REFERENCE_EXECUTE' AS b FROM g WHERE {v} IS NOT NULL" for v in VARS)})"""


def separated(spark, sf):
    d = gated(spark, sf)
    blocked = (F.col("family") == "CONTRADICTION") & (F.col("gate") != "VALID")
    natural = (F.col("family") == "NATURAL") & (F.col("expected_action_reference") == "EXECUTE")
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in VARS])
    return d.select(blocked.alias("a"), natural.alias("b"), F.inline(rows)).where(F.col("x").isNotNull())


@query("w09_q12_separability", f"""{SEP}, va AS (SELECT variable, x, count(*) FILTER (WHERE a) AS ca, count(*) FILTER (WHERE b) AS cb FROM sv WHERE a OR b GROUP BY 1, 2),
ks AS (SELECT variable, max(abs(fa - fb)) AS ks FROM (SELECT variable, sum(ca) OVER w / sum(ca) OVER (PARTITION BY variable) AS fa, sum(cb) OVER w / sum(cb) OVER (PARTITION BY variable) AS fb FROM va WINDOW w AS (PARTITION BY variable ORDER BY x ROWS UNBOUNDED PRECEDING)) GROUP BY 1)
SELECT variable, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, {rs('(avg(x) FILTER (WHERE a) - avg(x) FILTER (WHERE b)) / sqrt((var_samp(x) FILTER (WHERE a) + var_samp(x) FILTER (WHERE b)) / 2)', 5)} AS smd, {rs('any_value(ks)', 5)} AS ks FROM sv JOIN ks USING (variable) GROUP BY 1""")
def _(spark, sf):
    d = separated(spark, sf)
    m = C.mean_difference(d, "x", F.col("a"), F.col("b"), ["variable"]).select("variable", "n_a", "n_b", r("smd", 5).alias("smd"))
    return m.join(rounded(C.ks_distance(d, "x", F.col("a"), F.col("b"), ["variable"]), digits=5), "variable")


@query("q11_mean_difference", f"{SEP} SELECT variable, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, {rs('avg(x) FILTER (WHERE a)', 4)} AS mean_a, {rs('avg(x) FILTER (WHERE b)', 4)} AS mean_b, {rs('(avg(x) FILTER (WHERE a) - avg(x) FILTER (WHERE b)) / sqrt((var_samp(x) FILTER (WHERE a) + var_samp(x) FILTER (WHERE b)) / 2)', 4)} AS smd FROM sv GROUP BY 1")
def _(spark, sf):
    return rounded(C.mean_difference(separated(spark, sf), "x", F.col("a"), F.col("b"), ["variable"]), digits=4)


@query("q13_quantile_overlap", f"""{SEP}, qq AS (SELECT variable, quantile_cont(x, 0.01) AS p01, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99 FROM sv WHERE b GROUP BY 1)
SELECT variable, count(*) AS n, {rs('avg((x BETWEEN p05 AND p95)::INT)')} AS inside_p05_p95, {rs('avg((x BETWEEN p01 AND p99)::INT)')} AS inside_p01_p99 FROM sv JOIN qq USING (variable) WHERE a GROUP BY 1""")
def _(spark, sf):
    return rounded(C.quantile_overlap(separated(spark, sf), "x", F.col("a"), F.col("b"), ["variable"]))


# ---- class metrics ------------------------------------------------------------------------
CLS = ["EXECUTE", "GATHER", "ESCALATE", "ABSTAIN"]
CF = f"{BASE}, cf AS (SELECT regime, expected_action_reference AS actual, predicted_action AS predicted, count(*) AS n FROM epi GROUP BY 1, 2, 3)"
CR = f"""{CF}, cr AS ({' UNION ALL '.join(f"SELECT regime, '{c}' AS class, coalesce(sum(n) FILTER (WHERE actual = '{c}' AND predicted = '{c}'), 0) AS tp, coalesce(sum(n) FILTER (WHERE actual = '{c}'), 0) AS sup, coalesce(sum(n) FILTER (WHERE predicted = '{c}'), 0) AS ch FROM cf GROUP BY 1" for c in CLS)}),
cx AS (SELECT *, coalesce(tp / nullif(ch, 0), 0) AS pr, coalesce(tp / nullif(sup, 0), 0) AS rc, coalesce(2 * tp / nullif(sup + ch, 0), 0) AS f1 FROM cr)"""


def report(spark, sf):
    return C.class_report(C.confusion(episodes(spark, sf), "expected_action_reference", "predicted_action", ["regime"]), CLS, ["regime"])


@query("m09_overall_report", f"{CR} SELECT regime, sum(sup)::BIGINT AS n, {rs('sum(tp) / sum(sup)')} AS accuracy, {rs('avg(rc) FILTER (WHERE sup > 0)')} AS balanced_accuracy, {rs('avg(f1)')} AS macro_f1, {rs('sum(f1 * sup) / sum(sup)')} AS weighted_f1 FROM cx GROUP BY 1")
def _(spark, sf):
    return rounded(C.overall_report(report(spark, sf), ["regime"]))


@query("m10_class_report", f"{CR} SELECT regime, class, {rs('pr')} AS \"precision\", {rs('rc')} AS recall, {rs('f1')} AS f1, sup::BIGINT AS support FROM cx")
def _(spark, sf):
    return rounded(report(spark, sf).drop("tp"))


@query("m11_confusion_matrix", f"{CF} SELECT regime, actual, {', '.join(f'''coalesce(sum(n) FILTER (WHERE predicted = '{c}'), 0)::BIGINT AS \"pred_{c}\"''' for c in CLS)} FROM cf GROUP BY 1, 2")
def _(spark, sf):
    return C.confusion_matrix(C.confusion(episodes(spark, sf), "expected_action_reference", "predicted_action", ["regime"]), CLS, ["regime"])


PT = "CASE expected_action_reference " + " ".join(f"WHEN '{c}' THEN p_cal_{c.lower()}" for c in CLS) + " END"


@query("m12_m13_log_loss_brier", f"{BASE} SELECT regime, {rs(f'-avg(ln(least(greatest({PT}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))')} AS log_loss, " + rs("avg(" + " + ".join(f"(p_cal_{c.lower()} - (expected_action_reference = '{c}')::INT) ** 2" for c in CLS) + ")") + " AS brier FROM epi GROUP BY 1")
def _(spark, sf):
    ref = F.col("expected_action_reference")
    truth = F.when(ref == CLS[0], F.col(PC[0]))
    for c, p in zip(CLS[1:], PC[1:]):
        truth = truth.when(ref == c, F.col(p))
    return rounded(episodes(spark, sf).groupBy("regime").agg(C.log_loss(truth).alias("log_loss"), C.brier(ref, CLS, [F.col(p) for p in PC]).alias("brier")))


@query("m14_calibration_error", f"""{SC} SELECT regime, score_type, {rs('sum(k * abs(my - mp)) / sum(k)')} AS ece FROM (SELECT regime, score_type, least(floor(s * 10), 9) AS b, count(*) AS k, avg(s) AS mp, avg((NOT u)::INT) AS my FROM bt GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(C.calibration_error(both(spark, sf), F.col("s"), ~F.col("u"), 10, BY))


@query("m18_dangerous_errors", f"{CF} SELECT regime, coalesce(sum(n) FILTER (WHERE actual = 'ESCALATE'), 0)::BIGINT AS escalate_cases, coalesce(sum(n) FILTER (WHERE actual = 'ESCALATE' AND predicted = 'EXECUTE'), 0)::BIGINT AS escalate_executed, {rs('''sum(n) FILTER (WHERE actual = 'ESCALATE' AND predicted = 'EXECUTE') / nullif(sum(n) FILTER (WHERE actual = 'ESCALATE'), 0)''')} AS rate FROM cf GROUP BY 1")
def _(spark, sf):
    return rounded(R.dangerous_errors(C.confusion(episodes(spark, sf), "expected_action_reference", "predicted_action", ["regime"]), ["regime"]))


@query("m20_class_balance", f"{BASE} SELECT regime, part, robust_target AS label, count(*) AS n, {rs('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY regime, part)')} AS pct FROM epi GROUP BY 1, 2, 3")
def _(spark, sf):
    from ..operators.profile import counts_with_share

    d = episodes(spark, sf).select("regime", "part", F.col("robust_target").alias("label"))
    return rounded(counts_with_share(d, ["regime", "part", "label"], ["regime", "part"]))


# ---- score tables -------------------------------------------------------------------------
@query("a42_score_by_family", f"""{BASE} SELECT family, count(*) AS n, {rs('avg(p_safe_t0_cal)')} AS mean, {', '.join(f"{rs(f'avg((p_safe_t0_cal >= {t})::INT)')} AS ge_{int(t * 100)}" for t in (0.5, 0.8, 0.9))}, {rs('quantile_cont(p_safe_t0_cal, 0.9)')} AS p90 FROM epi GROUP BY 1""")
def _(spark, sf):
    d = episodes(spark, sf).select("family", "p_safe_t0_cal")
    x = F.col("p_safe_t0_cal")
    b = d.groupBy("family").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), *[F.avg((x >= t).cast("int")).alias(f"ge_{int(t * 100)}") for t in (0.5, 0.8, 0.9)])
    return rounded(b.join(O.percentiles(d, "p_safe_t0_cal", {"p90": 0.9}, ["family"]), "family"))


TT = [0.0, 0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


@query("a43_threshold_table", f"""{SC} SELECT regime, score_type, t AS threshold, count(*) AS cases, count(*) FILTER (WHERE s >= t) AS selected, {rs('avg((s >= t)::INT)')} AS coverage, count(*) FILTER (WHERE s >= t AND u) AS unsafe,
 {rs('count(*) FILTER (WHERE s >= t AND u) / nullif(count(*) FILTER (WHERE s >= t), 0)')} AS unsafe_rate, {rs('count(*) FILTER (WHERE s >= t AND NOT u) / nullif(count(*) FILTER (WHERE s >= t), 0)')} AS "precision",
 {rs('count(*) FILTER (WHERE s >= t AND NOT u) / nullif(count(*) FILTER (WHERE NOT u), 0)')} AS recall FROM bt, (SELECT unnest({TT})::DOUBLE AS t) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rounded(R.threshold_table(both(spark, sf), "s", "u", TT, BY))


@query("a45_conditional_calibration", f"""{SC}, {TRAIN_REF} SELECT CASE WHEN p_safe_t0_cal < 0.5 THEN '<0.5' WHEN p_safe_t0_cal < 0.8 THEN '0.5-0.8' ELSE '>=0.8' END AS band, transaction_exposure_eur > p90 AS high_value, count(*) AS n, {rs('avg(u::INT)')} AS unsafe_rate, {rs('1 - avg(p_safe_t0_cal)')} AS expected_rate FROM sc, tr GROUP BY 1, 2""")
def _(spark, sf):
    base = gated(spark, sf)
    d = scored(spark, sf, base)
    ref = O.scalars(train_refs(base))["p90"]
    return rounded(R.conditional_calibration(d.withColumn("_ref", ref), "p_safe_t0_cal", "u", [0.5, 0.8], ["<0.5", "0.5-0.8", ">=0.8"], F.col("transaction_exposure_eur") > F.col("_ref")))


# ---- fixed rules --------------------------------------------------------------------------
RL = f"""{SC}, {TRAIN_REF}, rb AS (SELECT sc.*, p90, p_safe_t0_cal AS s, {c_sql("'LOG_TRAIN_P90'")} AS c, transaction_exposure_eur / p90 AS cl FROM sc, tr),
ru AS (SELECT *, [('Evidence complete', complete), ('Gate only', gate = 'VALID'), ('Safety', s >= 0.8), ('Gate safety', gate = 'VALID' AND s >= 0.8), ('Reference', gate = 'VALID' AND s >= 0.8 AND (1 - s) * c <= 0.09), ('Plug-in cost', gate = 'VALID' AND (1 - s) * c <= 0.1), ('Escalate all', false)] AS rr FROM rb),
rl AS (SELECT * EXCLUDE (rr, pr), pr[1] AS policy, pr[2] AS ex, c AS cc FROM (SELECT *, unnest(rr) AS pr FROM ru))"""
RULE_TAU, RULE_BETA = 0.8, 0.09


def ruled(spark, sf):
    base = gated(spark, sf)
    d = scored(spark, sf, base).withColumn("s", F.col("p_safe_t0_cal"))
    ref = O.scalars(train_refs(base))
    d = d.withColumn("_ref", ref)
    v = F.col("transaction_exposure_eur")
    return d.withColumns({"c": S.consequence(v, F.col("_ref.p90")), "p90": F.col("_ref.p90")}).drop("_ref")


def rules(c="c"):
    return D.fixed_rules(F.col("s"), F.col(c), RULE_TAU, RULE_BETA)


@query("d20_d21_a46_fixed_rules", f"""{RL} SELECT regime, policy, count(*) AS cases, count(*) FILTER (WHERE ex) AS executed, count(*) FILTER (WHERE ex AND u) AS unsafe, {rs('avg(ex::INT)')} AS coverage, {rs('count(*) FILTER (WHERE ex AND u) / nullif(count(*) FILTER (WHERE ex), 0)')} AS unsafe_rate,
 {rs('coalesce(sum(transaction_exposure_eur) FILTER (WHERE ex AND u), 0) / sum(transaction_exposure_eur) FILTER (WHERE ex)', 5)} AS value_weighted_unsafe_rate, {rs('avg(CASE WHEN ex THEN u::INT * c ELSE 0.1 END)')} AS mean_loss,
 {rs('coalesce(sum(transaction_exposure_eur) FILTER (WHERE ex AND u), 0) * 1000 / count(*)', 1)} AS unsafe_value_per_1000, {rs('coalesce(sum(transaction_exposure_eur) FILTER (WHERE NOT ex), 0) * 1000 / count(*)', 1)} AS escalated_value_per_1000,
 {rs('coalesce(sum(transaction_exposure_eur) FILTER (WHERE ex), 0) * 1000 / count(*)', 1)} AS executed_value_per_1000 FROM rl GROUP BY 1, 2""")
def _(spark, sf):
    m = M.rule_metrics(ruled(spark, sf), ["regime"], rules(), F.col("u"), F.col("transaction_exposure_eur"), F.col("c"))
    m = rounded(m, ["coverage", "unsafe_rate", "mean_loss"])
    return rounded(rounded(m, ["value_weighted_unsafe_rate"], 5), ["unsafe_value_per_1000", "escalated_value_per_1000", "executed_value_per_1000"], 1)


@query("a54_consequence_modes", f"""{RL}, cm AS (SELECT regime, m, u, gate, s, complete, CASE m WHEN 'LOG' THEN c WHEN 'LINEAR' THEN cl ELSE least(cl, 10) END AS c FROM rb, (SELECT unnest(['LOG', 'LINEAR', 'CAPPED']) AS m)),
cn AS (SELECT *, gate = 'VALID' AND s >= 0.8 AND (1 - s) * c <= 0.09 AS ex FROM cm) SELECT regime, m AS mode, count(*) FILTER (WHERE ex) AS executed, {rs('avg(CASE WHEN ex THEN u::INT * c ELSE 0.1 END)')} AS mean_loss FROM cn GROUP BY 1, 2""")
def _(spark, sf):
    d = ruled(spark, sf)
    return rounded(R.consequence_modes(d, ["regime"], RULE_TAU, RULE_BETA))


PAIRS = [("Gate only", "Evidence complete"), ("Reference", "Safety"), ("Reference", "Gate safety")]
DL = f"{RL}, dx AS ({' UNION ALL '.join(f'''SELECT a.regime, a.case_id, a.group_id, '{x} minus {y}' AS comparison, a.u, a.c, a.ex::INT - b.ex::INT AS d, (CASE WHEN a.ex THEN a.u::INT * a.c ELSE 0.1 END) - (CASE WHEN b.ex THEN b.u::INT * b.c ELSE 0.1 END) AS delta FROM rl a JOIN rl b ON a.case_id = b.case_id WHERE a.policy = '{x}' AND b.policy = '{y}' ''' for x, y in PAIRS)})"


@query("a49_break_even", f"{DL} SELECT regime, comparison, (-sum(d))::BIGINT AS removed, (-sum(d * u::INT))::BIGINT AS unsafe_removed, {rs('-sum(d * u::INT * c) / nullif(-sum(d), 0)', 5)} AS break_even FROM dx GROUP BY 1, 2")
def _(spark, sf):
    return rounded(R.break_even(ruled(spark, sf), rules(), PAIRS, ["regime"]), digits=5)


@query("a47_loss_concentration", f"""{DL}, o AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY abs(delta) DESC, case_id) AS rk, row_number() OVER (PARTITION BY comparison ORDER BY greatest(-delta, 0) DESC, case_id) AS bk FROM dx)
SELECT comparison, count(*) FILTER (WHERE abs(delta) > 1e-14) AS changed_cases, {rs('sum(delta)', 4)} AS total_difference, {rs('max(abs(delta))', 5)} AS largest_abs_case, {rs('sum(greatest(-delta, 0)) FILTER (WHERE bk <= 1) / nullif(sum(greatest(-delta, 0)), 0)', 5)} AS benefit_top1_share,
 {rs('sum(greatest(-delta, 0)) FILTER (WHERE bk <= 5) / nullif(sum(greatest(-delta, 0)), 0)', 5)} AS benefit_top5_share, {rs('avg(delta) FILTER (WHERE rk > 1)')} AS without_largest, {rs('avg(delta) FILTER (WHERE rk > 5)')} AS without_largest5 FROM o GROUP BY 1""")
def _(spark, sf):
    c = R.loss_concentration(ruled(spark, sf), rules(), PAIRS, "case_id")
    c = rounded(rounded(c, ["total_difference"], 4), ["without_largest", "without_largest5"])
    return rounded(c, ["largest_abs_case", "benefit_top1_share", "benefit_top5_share"], 5)


@query("a48_group_concentration", f"""{BASE}, gs AS (SELECT part, group_id, count(*) AS k FROM epi GROUP BY 1, 2), gr AS (SELECT *, k / sum(k) OVER (PARTITION BY part) AS share, row_number() OVER (PARTITION BY part ORDER BY k DESC, group_id) AS rk FROM gs)
SELECT part, count(*) AS groups, {rs('max(share)')} AS top_share, {rs('sum(share) FILTER (WHERE rk <= 5)')} AS top5_share, {rs('1 / sum(share * share)', 4)} AS effective_groups FROM gr GROUP BY 1""")
def _(spark, sf):
    c = R.group_concentration(episodes(spark, sf), "group_id", ["part"])
    return rounded(rounded(c, ["top_share", "top5_share"]), ["effective_groups"], 4)


COSTS = [round(i * 0.002, 3) for i in range(126)]


@query("a50_cost_curves", f"""{RL}, kc AS (SELECT unnest({COSTS})::DOUBLE AS c_h), kd AS (SELECT regime, c_h, u, c, gate = 'VALID' AND s >= 0.8 AND (1 - s) * c <= 0.09 AS fx, s >= 0.8 AS ot, gate = 'VALID' AND s >= 0.8 AND (1 - s) * c <= least(0.09, c_h) AS rt FROM rb, kc)
SELECT regime, c_h, {rs('avg((fx::INT - ot::INT) * (u::INT * c - c_h))')} AS fixed_difference, {rs('avg((CASE WHEN rt THEN u::INT * c ELSE c_h END) - (CASE WHEN ot THEN u::INT * c ELSE c_h END))')} AS retuned_difference FROM kd GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(R.cost_curves(ruled(spark, sf), RULE_TAU, RULE_BETA, COSTS, ["regime"]))


@query("a53_ambiguity_bounds", f"""{GATED}, {TRAIN_REF}, ab AS (SELECT gt.*, {c_sql("'LOG_TRAIN_P90'")} AS c, gate = 'VALID' AND p_safe_t0_cal >= 0.5 AS ex FROM gt, tr),
ac AS (SELECT *, cv, (target = 'NOT_SAFE_TO_EXECUTE' OR (cv = 'ambiguous_unsafe' AND target = 'AMBIGUOUS')) AS lab FROM ab, (SELECT unnest(['ambiguous_safe', 'ambiguous_unsafe']) AS cv))
SELECT regime, cv AS convention, count(*) AS cases, count(*) FILTER (WHERE target = 'AMBIGUOUS' AND ex) AS ambiguous_executed, {rs('avg(ex::INT)')} AS coverage, {rs('avg(lab::INT) FILTER (WHERE ex)')} AS unsafe_rate, {rs('avg(CASE WHEN ex THEN lab::INT * c ELSE 0.1 END)')} AS mean_loss FROM ac GROUP BY 1, 2""")
def _(spark, sf):
    d = gated(spark, sf)
    d = d.withColumn("_ref", O.scalars(train_refs(d))).withColumn("c", S.consequence(F.col("transaction_exposure_eur"), F.col("_ref.p90")))
    return rounded(R.ambiguity_bounds(d, (F.col("gate") == "VALID") & (F.col("p_safe_t0_cal") >= 0.5), ["regime"]))


@query("a56_retention", f"""{WIDE} SELECT regime, count(*) FILTER (WHERE family = 'NATURAL') AS natural_cases, count(*) FILTER (WHERE family = 'NATURAL' AND expected_action_reference = 'EXECUTE') AS reference_execute,
 count(*) FILTER (WHERE family = 'NATURAL' AND expected_action_reference = 'EXECUTE' AND gate = 'VALID') AS gate_passed, count(*) FILTER (WHERE family = 'NATURAL' AND expected_action_reference = 'EXECUTE' AND action__V2_NO_GATHER = 'EXECUTE') AS executed FROM dw WHERE mode = 'LOG_TRAIN_P90' GROUP BY 1""")
def _(spark, sf):
    d = moded(spark, sf, ["LOG_TRAIN_P90"])
    a, _ = D.decide(F.col("p_safe_t0_cal"), F.col("p_safe_t1_primary"), F.col("c"), PAR, F.col("gather_policy_eligible"), F.col("gate"), allow_gather=False)
    return R.retention(d.withColumn("action", a), ["regime"])


@query("a57_predicted_vs_outcome_loss", f"""{WIDE}, pl AS (SELECT *, action__V2_NO_GATHER = 'EXECUTE' AS ex FROM dw WHERE mode = 'LOG_TRAIN_P90') SELECT regime, count(*) AS episodes, count(*) FILTER (WHERE ex) AS executed, {rs('avg(CASE WHEN ex THEN les ELSE 0.1 END)')} AS mean_predicted,
 {rs('avg(CASE WHEN ex THEN unsafe::INT * c ELSE 0.1 END)')} AS mean_outcome, {rs('avg(ex::INT) * 0.2 + (1 - avg(ex::INT)) * 0.1')} AS upper_bound, {rs('max(les) FILTER (WHERE ex)')} AS max_predicted FROM pl GROUP BY 1""")
def _(spark, sf):
    d = moded(spark, sf, ["LOG_TRAIN_P90"])
    a, _ = D.decide(F.col("p_safe_t0_cal"), F.col("p_safe_t1_primary"), F.col("c"), PAR, F.col("gather_policy_eligible"), F.col("gate"), allow_gather=False)
    return rounded(R.predicted_vs_outcome(d.withColumn("ex", a == "EXECUTE"), "p_safe_t0_cal", 0.2, 0.1, ["regime"]))


@query("a60_step_counts", f"""{RL} SELECT regime, count(DISTINCT s) AS distinct_values, count(DISTINCT s) FILTER (WHERE s >= 0.8) AS above_threshold, count(*) FILTER (WHERE gate = 'VALID' AND s >= 0.8 AND (1 - s) * c > 0.09) AS budget_removals, count(*) FILTER (WHERE gate = 'VALID' AND s >= 0.8 AND transaction_exposure_eur > p90) AS gated_above_p90 FROM rb GROUP BY 1""")
def _(spark, sf):
    return R.step_counts(ruled(spark, sf), "s", RULE_TAU, RULE_BETA, ["regime"])


HG = [(h, rho) for h in (0.05, 0.1, 0.2) for rho in (0.0, 0.02, 0.05)]


@query("a51_human_cost_grid", f"""{GATED}, {TRAIN_REF}, hm AS (SELECT gt.*, {c_sql("'LOG_TRAIN_P90'")} AS c FROM gt, tr), hx AS (SELECT *, h + rho * c AS lh, CASE WHEN gate = 'VALID' AND p_safe_t0_cal >= 0.8 AND (1 - p_safe_t0_cal) * c <= 0.2 THEN (1 - p_safe_t0_cal) * c ELSE 'Infinity'::DOUBLE END AS e
 FROM hm, (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS h), (SELECT unnest([0.0, 0.02, 0.05])::DOUBLE AS rho)), hy AS (SELECT *, CASE WHEN e <= least(lh, 0.118) THEN 'EXECUTE' WHEN lh <= 0.118 THEN 'ESCALATE' ELSE 'ABSTAIN' END AS action FROM hx)
SELECT h AS c_h, rho AS rho_h, count(*) FILTER (WHERE action = 'EXECUTE') AS executed, {rs("avg(CASE action WHEN 'EXECUTE' THEN unsafe::INT * c WHEN 'ESCALATE' THEN lh ELSE 0.118 END)")} AS loss, {rs('avg(lh)')} AS always_escalate FROM hy GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(R.human_cost_grid(moded(spark, sf, ["LOG_TRAIN_P90"]), [0.05, 0.1, 0.2], [0.0, 0.02, 0.05], PAR))


@query("a52_consequence_only_ablation", f"""{WIDE}, ca AS (SELECT a.regime, a.mode AS decision_mode, a.action__V2_NO_GATHER AS action, b.c, b.lh, b.unsafe FROM dw a JOIN dw b USING (case_id) WHERE a.mode IN ('UNIFORM', 'LOG_TRAIN_P90') AND b.mode = 'LOG_TRAIN_P90')
SELECT regime, decision_mode, count(*) FILTER (WHERE action = 'EXECUTE') AS executed, {rs("avg(CASE action WHEN 'EXECUTE' THEN unsafe::INT * c WHEN 'ESCALATE' THEN lh ELSE 0.118 END)")} AS loss FROM ca GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(R.consequence_only(moded(spark, sf, ["LOG_TRAIN_P90"]), PAR, ["regime"]))


V3 = f"""{RL}, vm AS (SELECT regime, policy, count(*) FILTER (WHERE ex) AS n, coalesce(sum(transaction_exposure_eur) FILTER (WHERE ex), 0) * 1000 / count(*) AS v, avg(CASE WHEN ex THEN u::INT * c ELSE 0.1 END) AS l FROM rl GROUP BY 1, 2),
vx AS (SELECT s.regime, s.n AS sn, g.n AS gn, f.n AS fn, s.v AS sv, g.v AS gv, f.v AS fv, g.l - s.l AS d FROM vm s JOIN vm g USING (regime) JOIN vm f USING (regime) WHERE s.policy = 'Safety' AND g.policy = 'Gate safety' AND f.policy = 'Reference')"""


@query("v03_restriction_monotonicity", f"""{V3} SELECT 'gate_safety_within_safety' AS "check", count(*) AS rows, count(*) FILTER (WHERE gn > sn OR gv > sv + 1e-6) AS violations, {rs('sum(sn - gn)::DOUBLE', 4)} AS measured FROM vx
 UNION ALL SELECT 'reference_within_gate_safety', count(*), count(*) FILTER (WHERE fn > gn OR fv > gv + 1e-6), {rs('sum(gn - fn)::DOUBLE', 4)} FROM vx UNION ALL SELECT 'v04_contrast_is_difference', count(*), 0, {rs('sum(d)', 4)} FROM vx""")
def _(spark, sf):
    return rounded(R.monotonicity(ruled(spark, sf), rules(), ["regime"]), digits=4)
