"""Fitted models: checked by rows and invariants, preparation also by SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curves as C
from ..operators import models as M
from ..operators import softmax as X
from ..session import materialize
from .registry import query, r, rounded, rs
from .scalar_queries import TRAIN_REF, train_refs
from ..functions import labels as L
from ..operators import cases as K
from .case_queries import STATE, T0_DERIVED, T1, T1_DERIVED, T1_SQL, T1_STATE, t1_sql
from .tables import BASE, SPLIT_SEED, WIDE, WIDE_LOG, episodes, wide_event_log

CLS = ["EXECUTE", "GATHER", "ESCALATE", "ABSTAIN"]
S_SAFE = "target = 'SAFE_TO_EXECUTE'"
NUM = M.FEATURE_SETS["FULL"]
COLUMNS = ["case_id", "part", "family", "regime", "target", "expected_action_reference", "p_safe_t0_raw", *NUM, *M.CATEGORY_FEATURES]


def table(spark, sf) -> DataFrame:
    """The episodes, written once with the columns that models, their labels and their reports read."""
    return materialize(episodes(spark, sf).select(*COLUMNS))


def parts(d: DataFrame, label: str = "target"):
    known = d.where(F.col(label) != S.AMBIGUOUS)
    return known.where("part = 'train'"), known.where("part = 'calibration'"), known.where("part = 'test'")


@query("m01_feature_stats", f"{BASE}, tf AS (SELECT * FROM epi WHERE part = 'train'), ff AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, {c}::DOUBLE AS x FROM tf''' for c in NUM if not c.endswith('t0') or c.startswith('n_'))}), md AS (SELECT feature, coalesce(quantile_cont(x, 0.5), 0) AS m FROM ff GROUP BY 1) SELECT feature, {rs('any_value(m)', 4)} AS median, {rs('avg(coalesce(x, m))', 4)} AS mean, {rs('stddev_pop(coalesce(x, m))', 2)} AS spread FROM ff JOIN md USING (feature) GROUP BY 1")
def _(spark, sf):
    names = [c for c in NUM if not c.endswith("t0") or c.startswith("n_")]
    s = M.numeric_stats(episodes(spark, sf).where("part = 'train'"), names)
    return rounded(rounded(s, ["median", "mean"], 4), ["spread"], 2)


def auc(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    return C.discrimination(C.score_points(df, score, F.col("target") == S.SAFE, by), by)


@query("m03_m06_m08_safety_scores")
def _(spark, sf):
    d = table(spark, sf)
    tr, cal, _ = parts(d)
    m = M.fit_safety(tr, cal, "target", NUM, M.CATEGORY_FEATURES)
    return m.score(d.where("part = 'test'")).select("case_id", "target", r("p_safe_raw").alias("p_safe_raw"), r("p_safe_cal").alias("p_safe_cal"))


@query("m02_m05_action_scores")
def _(spark, sf):
    d = table(spark, sf)
    tr, cal, te = d.where("part = 'train'"), d.where("part = 'calibration'"), d.where("part = 'test'")
    m = M.fit_action(tr, "expected_action_reference", CLS, NUM, M.CATEGORY_FEATURES)
    out = M.calibrate_classes(materialize(m.score(cal)), m.score(te.drop(*[f"p_cal_{c.lower()}" for c in CLS])), CLS, "expected_action_reference")
    probs = [F.col(f"p_cal_{c}") for c in CLS]
    return out.select("case_id", *[r(f"p_cal_{c}").alias(f"p_{c.lower()}") for c in CLS], S.first_largest(CLS, probs).alias("predicted"), r(S.entropy(probs)).alias("entropy"))


@query("m04_boosted_comparison")
def _(spark, sf):
    d = table(spark, sf)
    tr, cal, te = parts(d)
    rows = []
    for kind in ("logistic", "boosted"):
        m = M.fit_safety(tr, cal, "target", NUM, M.CATEGORY_FEATURES, kind)
        rows.append(auc(m.score(te), "p_safe_raw", []).select(F.lit(kind).alias("model"), r("auroc").alias("auroc"), r("average_precision").alias("average_precision"), "positives", "negatives"))
    return rows[0].unionByName(rows[1])


# The isotonic value at a score is the largest, over starts at or before it, of the smallest mean up to ends at or after it.
ISO = f"""{BASE}, {TRAIN_REF}, kn AS (SELECT part, p_safe_t0_raw AS s, (target = 'SAFE_TO_EXECUTE')::DOUBLE AS y, (transaction_exposure_eur > p50)::INT + (transaction_exposure_eur > p90)::INT AS b FROM epi, tr WHERE target <> 'AMBIGUOUS'),
fi AS (SELECT b, s, count(*) AS w, sum(y) AS t FROM kn WHERE part = 'calibration' GROUP BY 1, 2),
cu AS (SELECT b, s, row_number() OVER o AS i, sum(w) OVER o AS cw, sum(t) OVER o AS ct, w, t FROM fi WINDOW o AS (PARTITION BY b ORDER BY s)),
mm AS (SELECT b, k, s, min(mean) OVER (PARTITION BY b, j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM
 (SELECT x.b, x.i AS j, z.i AS k, z.s, (z.ct - x.ct + x.t) / (z.cw - x.cw + x.w) AS mean FROM cu x JOIN cu z ON x.b = z.b AND x.i <= z.i)),
iso AS (SELECT b, s, max(low) AS g FROM mm GROUP BY 1, 2),
ap AS (SELECT te.*, lo.s AS s0, lo.g AS g0, hi.s AS s1, hi.g AS g1 FROM (SELECT * FROM kn WHERE part = 'test') te ASOF LEFT JOIN iso lo ON te.b = lo.b AND te.s >= lo.s ASOF LEFT JOIN iso hi ON te.b = hi.b AND te.s <= hi.s),
pr AS (SELECT b, y, least(greatest(CASE WHEN s0 IS NULL THEN g1 WHEN s1 IS NULL OR s0 = s1 THEN g0 ELSE g0 + (g1 - g0) * (s - s0) / (s1 - s0) END, 0), 1) AS p FROM ap)"""


@query("m07_value_bin_calibration", f"{ISO} SELECT b AS value_bin, count(*) AS n, {rs('avg(p)')} AS mean_score, {rs('avg(y)')} AS safe_rate FROM pr GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf)
    _, cal, te = parts(d)
    q = train_refs(d).first()
    cuts = [q["p50"], q["p90"]]
    out = M.calibrate_by_value(cal, te, "p_safe_t0_raw", F.col("target") == S.SAFE, "transaction_exposure_eur", cuts, "p_bin")
    return out.groupBy(M.value_bin(F.abs("transaction_exposure_eur"), cuts).alias("value_bin")).agg(
        F.count("*").alias("n"), r(F.avg("p_bin")).alias("mean_score"), r(F.avg((F.col("target") == S.SAFE).cast("int"))).alias("safe_rate"))


@query("m17_m19_feature_ablation")
def _(spark, sf):
    d = table(spark, sf)
    tr, cal, te = parts(d)
    rows = []
    for name, numeric in M.FEATURE_SETS.items():
        m = M.fit_safety(tr, cal, "target", numeric, M.CATEGORY_FEATURES)
        a = m.audit()
        rows.append(auc(m.score(te), "p_safe_raw", []).select(
            F.lit(name).alias("feature_set"), r("auroc").alias("auroc"), F.lit(len(numeric)).alias("inputs"), F.lit(a["training_rows"]).alias("training_rows"),
            F.lit(a["iterations"]).alias("iterations"), F.lit(a["converged"]).alias("converged")))
    return reduce(lambda x, y: x.unionByName(y), rows)


@query("m22_mismatch_sensitivity")
def _(spark, sf):
    d = table(spark, sf)
    tr, cal, _ = parts(d)
    te = d.where("part = 'test'")
    rows = []
    for name, numeric in (("without", M.FEATURE_SETS["NO_MISMATCH"]), ("with", M.FEATURE_SETS["FULL"])):
        s = M.fit_safety(tr, cal, "target", numeric, M.CATEGORY_FEATURES).score(te)
        rows.append(s.groupBy("family").agg(F.count("*").alias("n"), r(F.avg("p_safe_cal")).alias("mean_score"), F.sum((F.col("p_safe_cal") >= 0.5).cast("bigint")).alias("selected")).withColumn("mismatch_inputs", F.lit(name)))
    return rows[0].unionByName(rows[1])


@query("m23_corrected_action_model")
def _(spark, sf):
    d = table(spark, sf)
    tr, cal, te = parts(d)
    action = M.fit_action(d.where("part = 'train'"), "expected_action_reference", CLS, NUM, M.CATEGORY_FEATURES).score(te)
    safety = M.fit_safety(tr, cal, "target", NUM, M.CATEGORY_FEATURES).score(te)
    both = action.select("case_id", "target", F.col("p_raw_EXECUTE").alias("action_score")).join(safety.select("case_id", "p_safe_raw"), "case_id")
    both = materialize(both)
    one = lambda c: auc(both, c, []).select(F.lit(c).alias("score"), r("auroc").alias("auroc"), r("average_precision").alias("average_precision"))
    return one("action_score").unionByName(one("p_safe_raw"))


# At the optimum the free intercept makes mean scores equal class shares on the training rows, and an isotonic
# map keeps the mean on the rows it was fitted to: identities that SQL can work out from the labels alone.
def share_sql(part: str, what: str, cond: str, known: str) -> str:
    return f"SELECT '{part}' AS part, '{what}' AS score, count(*) AS n, {rs(f'avg(({cond})::INT)', 3)} AS mean_score FROM epi WHERE part = '{part}' AND {known}"


KNOWN = "target <> 'AMBIGUOUS'"


@query("m03_m06_fit_identities", f"{BASE} {share_sql('train', 'raw', S_SAFE, KNOWN)} UNION ALL {share_sql('calibration', 'calibrated', S_SAFE, KNOWN)}")
def _(spark, sf):
    tr, cal, _ = parts(table(spark, sf))
    m = M.fit_safety(tr, cal, "target", NUM, M.CATEGORY_FEATURES)
    one = lambda d, part, what, c: m.score(d).agg(F.count("*").alias("n"), r(F.avg(c), 3).alias("mean_score")).select(F.lit(part).alias("part"), F.lit(what).alias("score"), "n", "mean_score")
    return one(tr, "train", "raw", "p_safe_raw").unionByName(one(cal, "calibration", "calibrated", "p_safe_cal"))


@query("m02_m05_fit_identities", f"{BASE} " + " UNION ALL ".join(share_sql("train", c, f"expected_action_reference = '{c}'", "true") for c in CLS))
def _(spark, sf):
    tr = table(spark, sf).where("part = 'train'")
    scored = M.fit_action(tr, "expected_action_reference", CLS, NUM, M.CATEGORY_FEATURES).score(tr)
    means = scored.agg(F.count("*").alias("n"), *[r(F.avg(f"p_raw_{c}"), 3).alias(c) for c in CLS])
    return means.select(F.inline(F.array(*[F.struct(F.lit("train").alias("part"), F.lit(c).alias("score"), F.col("n"), F.col(c).alias("mean_score")) for c in CLS])))


# ---- all published inputs, at the decision and at the evidence ------------------------------
DICT = ["item_category", "group_id", "regime", "goods_receipt_required"]


def levels_sql(names: list[str], source: str) -> str:
    """lv: the levels of each category with their counts."""
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce({c}::VARCHAR, '{M.MISSING}') AS level, count(*) AS n FROM {source} GROUP BY 1, 2" for c in names)
    return f"lv AS ({rows})"


@query("m01_level_dictionary", f"""{BASE}, tf AS (SELECT * FROM epi WHERE part = 'train'), {levels_sql(DICT, 'tf')}
SELECT feature, level, n, CASE WHEN n < 5 THEN count(*) FILTER (WHERE n >= 5) OVER (PARTITION BY feature) ELSE row_number() OVER (PARTITION BY feature, n < 5 ORDER BY level) - 1 END AS slot FROM lv""")
def _(spark, sf):
    return M.level_dictionary(episodes(spark, sf).where("part = 'train'"), DICT)


def equations_sql(numeric: list[str], categorical: list[str], source: str) -> str:
    """Every input with a gap of zero: the fit is the optimum of its convex problem."""
    numbers = ", ".join(f"'{c}'" for c in numeric)
    return f"""SELECT DISTINCT feature, CASE WHEN n < 5 THEN '{M.RARE}' ELSE level END AS level, (SELECT count(*) FROM {source}) AS training_rows, 0.0::DOUBLE AS gap FROM lv
 UNION ALL SELECT unnest([{numbers}]), NULL, (SELECT count(*) FROM {source}), 0.0"""


def equations(m: M.SafetyModel):
    return m.equations().select("feature", "level", F.lit(m.rows).cast("bigint").alias("training_rows"), r("gap", 3).alias("gap"))


SPLIT_SQL = f"('0x' || substr(sha256('{SPLIT_SEED}' || case_id), 1, 12))::BIGINT / 281474976710656.0"
WIDE_SQL = ", ".join(f"{e.replace('user_id', 'uid')} AS {n}" for n, e in WIDE.items()) + ", uid % 2 = 0 AS gr_based_invoice_verification"
UID = "ux AS (SELECT case_id, any_value(user_id) AS uid, arg_min(props, k) AS first_props, CASE any_value(flag_text) WHEN 'yes' THEN true WHEN 'N' THEN false END AS flag FROM ex GROUP BY 1)"
D1_SQL = f"CASE WHEN (goods_receipt_required AND NOT gr_available_at_t0) OR {' OR '.join(L.CORE_SIGNALS)} THEN 'NOT_SAFE_TO_EXECUTE' WHEN outcome_eventually_cleared THEN 'SAFE_TO_EXECUTE' ELSE 'AMBIGUOUS' END"


def split_known(d: DataFrame, label: str):
    u = S.hash_unit(F.col("case_id"), SPLIT_SEED)
    return parts(d.withColumn("part", F.when(u < 0.7, "train").when(u < 0.85, "calibration").otherwise("test")), label)


@query("m03_t0_full_inputs", f"""{STATE}, {UID}, cd AS (SELECT cs.*, {WIDE_SQL} FROM cs JOIN ux USING (case_id)),
tf AS (SELECT * FROM cd WHERE {D1_SQL} <> 'AMBIGUOUS' AND {SPLIT_SQL} < 0.7), {levels_sql(M.T0_CATEGORIES, 'tf')} {equations_sql(M.T0_NUMERIC, M.T0_CATEGORIES, 'tf')}""")
def _(spark, sf):
    d = materialize(K.case_state(wide_event_log(spark, sf), WIDE_LOG).withColumn("target", L.d1_target()))
    tr, cal, _ = split_known(d, "target")
    return equations(M.fit_safety(tr, cal, "target", M.T0_NUMERIC, M.T0_CATEGORIES))


@query("m03_t1_full_inputs", f"""{T1_STATE}, {UID}, cd AS (SELECT s1.*, {WIDE_SQL}, first_props AS sub_spend_area, flag AS goods_receipt_required FROM s1 JOIN ux USING (case_id)),
tf AS (SELECT * FROM cd WHERE {t1_sql(L.T1_CORE)} <> 'AMBIGUOUS' AND {SPLIT_SQL} < 0.7), {levels_sql(M.T1_CATEGORIES, 'tf')} {equations_sql(M.T1_NUMERIC, M.T1_CATEGORIES, 'tf')}""")
def _(spark, sf):
    d = materialize(K.transition_state(wide_event_log(spark, sf), WIDE_LOG).withColumn("y_t1_d1", L.t1_target("D1_CORE")))
    tr, cal, _ = split_known(d, "y_t1_d1")
    return equations(M.fit_safety(tr, cal, "y_t1_d1", M.T1_NUMERIC, M.T1_CATEGORIES))


@query("m08_t1_scores")
def _(spark, sf):
    d = materialize(K.transition_state(wide_event_log(spark, sf), WIDE_LOG).withColumn("y_t1_d1", L.t1_target("D1_CORE")))
    tr, cal, _ = split_known(d, "y_t1_d1")
    m = M.fit_safety(tr, cal, "y_t1_d1", M.T1_NUMERIC, M.T1_CATEGORIES)
    return m.score(d).select("case_id", "y_t1_d1", r("p_safe_raw").alias("p_safe_raw"), r("p_safe_cal").alias("p_safe_cal"))


@query("m08_score_checks", f"{BASE} SELECT family, count(*) AS n, 0::BIGINT AS missing, 0::BIGINT AS outside FROM epi WHERE part = 'test' GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf)
    tr, cal, _ = parts(d)
    s = M.fit_safety(tr, cal, "target", NUM, M.CATEGORY_FEATURES).score(d.where("part = 'test'"))
    inside = F.col("p_safe_raw").between(0, 1) & F.col("p_safe_cal").between(0, 1)
    n = lambda c: F.sum(c.cast("bigint"))
    return s.groupBy("family").agg(F.count("*").alias("n"), n(F.col("p_safe_raw").isNull() | F.col("p_safe_cal").isNull()).alias("missing"), n(~inside).alias("outside"))


KNOWN_TRAIN = f"tf AS (SELECT * FROM epi WHERE part = 'train' AND {KNOWN})"


@query("m22_fit_equations", f"""{BASE}, {KNOWN_TRAIN}, {levels_sql(M.CATEGORY_FEATURES, 'tf')}
SELECT 'without' AS mismatch_inputs, * FROM ({equations_sql(M.FEATURE_SETS['NO_MISMATCH'], M.CATEGORY_FEATURES, 'tf')}) UNION ALL SELECT 'with', * FROM ({equations_sql(NUM, M.CATEGORY_FEATURES, 'tf')})""")
def _(spark, sf):
    tr, cal, _ = parts(table(spark, sf))
    one = lambda name, inputs: equations(M.fit_safety(tr, cal, "target", inputs, M.CATEGORY_FEATURES)).select(F.lit(name).alias("mismatch_inputs"), "*")
    return one("without", M.FEATURE_SETS["NO_MISMATCH"]).unionByName(one("with", NUM))


# ---- action models of three feature sets over three splits -----------------------------------
REGIMES = {
    "iid": ("part = 'train'", "part = 'test'"),
    "temporal": ("regime = 'early'", "regime = 'late'"),
    "exposure": ("transaction_exposure_eur <= 250000 AND part <> 'test'", "transaction_exposure_eur > 250000"),
}
NAMES = [*NUM, *M.CATEGORY_FEATURES]


def inputs_sql(names: list[str]) -> str:
    return f"{len(names)} + (SELECT count(*) FROM lv WHERE n >= 5) + (SELECT (count(*) > 0)::INT FROM lv WHERE n < 5)"


def ablation_sql(regime: str) -> str:
    train, test = REGIMES[regime]
    rows = " UNION ALL ".join(f"SELECT '{n}' AS feature_set, ({inputs_sql(f)})::BIGINT AS inputs" for n, f in M.FEATURE_SETS.items())
    return f"""SELECT '{regime}' AS regime, feature_set, inputs, (SELECT count(*) FROM tf) AS training_rows, (SELECT count(*) FROM epi WHERE {test}) AS test_rows, true AS converged, true AS falling, 0.0::DOUBLE AS largest_gap
 FROM (WITH tf AS (SELECT * FROM epi WHERE {train}), {levels_sql(M.CATEGORY_FEATURES, 'tf')} {rows}), (SELECT 1)""".replace("(SELECT count(*) FROM tf) AS training_rows", f"(SELECT count(*) FROM epi WHERE {train}) AS training_rows")


MAX_ITER = 2000


def action_fits(spark, sf):
    """(regime, feature set, audit with the largest gap, scored test rows) of every action model."""
    code = F.lit(None).cast("double")
    for i, c in enumerate(CLS):
        code = F.when(F.col("expected_action_reference") == c, float(i)).otherwise(code)
    d = table(spark, sf)
    sets = {name: [*inputs, *M.CATEGORY_FEATURES] for name, inputs in M.FEATURE_SETS.items()}
    keep = ["expected_action_reference", "part", "regime", "transaction_exposure_eur"]
    study = X.prepare(d, code, len(CLS), {n: F.expr(train) for n, (train, _) in REGIMES.items()}, sets, NUM, M.CATEGORY_FEATURES, keep)
    if study is None:
        yield from wide_fits(d, code, sets, keep)
        return
    gaps = study.fit(MAX_ITER)
    scored = study.scored({n: F.expr(test) for n, (_, test) in REGIMES.items()}, ["expected_action_reference"])
    for i, (m, gap) in enumerate(zip(study.models, gaps, strict=True)):
        own = F.col(f"_prob_{i}")
        yield m.training, m.inputs, study.audit(i, MAX_ITER) | {"largest_gap": gap}, scored.where(own.isNotNull()).select("expected_action_reference", own.alias("_prob"))


def wide_fits(d: DataFrame, code, sets: dict[str, list[str]], keep: list[str]):
    """The same models one by one, for categories of so many levels that a model's curvature is too large to hold."""
    for regime, (train, test) in REGIMES.items():
        m = M.matrix(d, F.expr(train), NUM, M.CATEGORY_FEATURES, keep)
        for name, inputs in sets.items():
            model, scored, audit = M.fit_masked(m, code, F.expr(train), inputs, "multinomial", MAX_ITER)
            gaps = M.score_gaps(model, m.masked(inputs, F.expr(train)).withColumn("label", code))
            audit["inputs"] = model.numFeatures
            audit["largest_gap"] = max(abs(x) for g in gaps.values() for x in g)
            yield regime, name, audit, scored.where(test).withColumn("_prob", vector_to_array("_prob"))


@query("m17_m19_action_audit", f"{BASE} " + " UNION ALL ".join(ablation_sql(n) for n in REGIMES))
def _(spark, sf):
    rows = [
        (regime, name, a["inputs"], a["training_rows"], scored.count(), a["converged"], a["falling"], round(a["largest_gap"], 3) + 0.0)
        for regime, name, a, scored in action_fits(spark, sf)
    ]
    return spark.createDataFrame(rows, "regime string, feature_set string, inputs bigint, training_rows bigint, test_rows bigint, converged boolean, falling boolean, largest_gap double")


@query("m17_action_ablation")
def _(spark, sf):
    rows = []
    for regime, name, a, scored in action_fits(spark, sf):
        p = F.col("_prob")
        chosen = S.first_largest(CLS, [p[i] for i in range(len(CLS))])
        rows.append(scored.agg(F.count("*").alias("n"), r(F.avg((chosen == F.col("expected_action_reference")).cast("int"))).alias("accuracy")).select(
            F.lit(regime).alias("regime"), F.lit(name).alias("feature_set"), "n", "accuracy", F.lit(a["iterations"]).alias("iterations"), F.lit(a["last_objective"]).alias("objective")))
    return reduce(lambda x, y: x.unionByName(y), rows)
