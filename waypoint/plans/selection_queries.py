"""Risk-controlled selection and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as D
from ..functions import scalars as S
from ..operators import ordered as O
from ..operators import policy as PO
from ..operators import resample as Q
from ..operators import rules as R
from ..operators import selection as Z
from ..operators.metrics import RATES
from ..session import materialize
from ..sources.tables import table
from .curve_queries import DL, PAIRS, RL, ruled, rules
from .policy_queries import LONG, LOSS_A, PAR, longs, terms
from .registry import query, r, rounded, rs
from .scalar_queries import GATED, TRAIN_REF, gated, train_refs
from .tables import BASE, episodes

# 20 seeds.
SEEDS = ["20261004", *[str(s) for s in range(20261024, 20261043)]]
CAPS = [0.02, 0.10, 0.30, 0.60]
BT = [0.05, 0.06, 0.07, 0.08, 0.09, 0.10]


def tail_sql(u: str, n: str, a: str) -> str:
    return (f"CASE WHEN {n} = 0 THEN 1.0 ELSE list_sum(list_transform(generate_series(0, {u}), lambda k: exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln({a}) + ({n} - k) * ln(1 - {a})))) END")


CAL = f"""{RL}, cal0 AS (SELECT case_id, group_id, part, s, complete AS g, u, c, regime FROM rb),
cal AS (SELECT *, (('0x' || substr(sha256('20261004' || case_id), 1, 8))::BIGINT % 2)::INT AS half FROM cal0 WHERE part = 'calibration'),
sd AS (SELECT cal0.*, seed, (('0x' || substr(sha256(seed || case_id), 1, 8))::BIGINT % 2)::INT AS half FROM cal0, (SELECT unnest({SEEDS}) AS seed) WHERE part = 'calibration'),
caps AS (SELECT unnest({CAPS})::DOUBLE AS cap)"""


def calibration(spark, sf):
    # complete evidence stands in for the gate here: few of these cases are VALID
    d = ruled(spark, sf).withColumn("g", F.col("complete"))
    return d.select("case_id", "group_id", "part", "s", "g", "u", "c", "regime")


def halves(spark, sf, seeds=SEEDS):
    return Z.by_seed(calibration(spark, sf).where("part = 'calibration'"), "case_id", seeds)


def seed_nodes(spark, sf):
    return Z.seed_node_counts(calibration(spark, sf).where("part = 'calibration'"), "case_id", SEEDS, betas=BT)


GRID = [i / 25 for i in range(25)]


@query("r01_binomial_tail", f"""{BASE}, z AS (SELECT regime, part, count(*) AS n, count(*) FILTER (WHERE unsafe) AS u FROM epi GROUP BY 1, 2), a AS (SELECT z.*, cap FROM z, (SELECT unnest([0.3, 0.5, 0.6, 0.7])::DOUBLE AS cap))
SELECT regime, part, cap, n, u, {rs(tail_sql('u', 'n', 'cap'))} AS p_value FROM a""")
def _(spark, sf):
    z = episodes(spark, sf).groupBy("regime", "part").agg(F.count("*").alias("n"), O.count_if(F.col("unsafe")).alias("u"))
    return Z.tested(z, [0.3, 0.5, 0.6, 0.7]).select("regime", "part", "cap", "n", "u", r("p_value").alias("p_value"))


@query("r02_learn_then_test", f"""{CAL}, lp AS (SELECT *, p = 'Safety' OR g AS ok FROM cal, (SELECT unnest(['Safety', 'Gate safety']) AS p) WHERE half = 1), lc AS (SELECT p AS policy, t AS threshold, count(*) FILTER (WHERE s >= t AND ok) AS n, count(*) FILTER (WHERE s >= t AND ok AND u) AS u FROM lp, (SELECT unnest({GRID})::DOUBLE AS t) GROUP BY 1, 2),
lt AS (SELECT lc.*, cap, {tail_sql('u', 'n', 'cap')} AS pv FROM lc, caps) SELECT policy, cap, threshold, n, u, {rs('pv')} AS p_value FROM (SELECT *, row_number() OVER (PARTITION BY policy, cap ORDER BY n DESC, threshold) AS k FROM lt WHERE n > 0 AND pv <= 0.05 / {len(GRID)}) WHERE k = 1""")
def _(spark, sf):
    d = Z.both_gates(halves(spark, sf, SEEDS[:1]).where("half = 1"), F.col("g"))
    return rounded(Z.learn_then_test(d, "s", GRID, CAPS, ["policy"]), ["p_value"])


@query("r03_conformal_control", f"""{CAL}, cc AS (SELECT t AS threshold, count(*) AS m, count(*) FILTER (WHERE s >= t) AS n, count(*) FILTER (WHERE s >= t AND u) AS u FROM cal, (SELECT unnest({GRID})::DOUBLE AS t) WHERE half = 1 GROUP BY 1)
SELECT cap, threshold, n, u, {rs('(u + 1) / (m + 1)')} AS corrected FROM (SELECT cc.*, cap, row_number() OVER (PARTITION BY cap ORDER BY n DESC, threshold) AS k FROM cc, caps WHERE (u + 1) / (m + 1) <= cap) WHERE k = 1""")
def _(spark, sf):
    return rounded(Z.conformal_control(halves(spark, sf, SEEDS[:1]).where("half = 1"), "s", GRID, CAPS, []), ["corrected"])


NODES = f"""nd AS (SELECT seed, tau, beta, count(*) FILTER (WHERE g AND s >= tau AND (1 - s) * c <= least(beta, 0.1)) AS n, count(*) FILTER (WHERE u AND g AND s >= tau AND (1 - s) * c <= least(beta, 0.1)) AS u
 FROM sd, (SELECT unnest({Z.TAUS})::DOUBLE AS tau), (SELECT unnest({BT})::DOUBLE AS beta) WHERE half = 1 GROUP BY 1, 2, 3), nt AS (SELECT nd.*, cap, {tail_sql('u', 'n', 'cap')} AS pv FROM nd, caps)"""
NBEST = "row_number() OVER (PARTITION BY seed, cap ORDER BY n DESC, tau, beta) AS k"


@query("r04_empirical_selection", f"{CAL}, {NODES} SELECT seed, cap, tau, beta, n, u FROM (SELECT *, {NBEST} FROM nt WHERE n > 0 AND u / n <= cap) WHERE k = 1")
def _(spark, sf):
    return Z.empirical_selection(seed_nodes(spark, sf), CAPS, ["seed"])


GRAPH = f"{NODES}, gp AS (SELECT *, min((n > 0 AND pv <= 0.05 / 8)::INT) OVER (PARTITION BY seed, cap, tau ORDER BY beta ROWS UNBOUNDED PRECEDING) AS pass FROM nt), gb AS (SELECT * FROM (SELECT *, {NBEST} FROM gp WHERE pass = 1) WHERE k = 1)"


@query("r07_w10_graph_selection", f"{CAL}, {GRAPH} SELECT seed, cap, tau, beta, n, u FROM gb")
def _(spark, sf):
    return Z.graph_selection(seed_nodes(spark, sf), CAPS, ["seed"])


@query("r09_bonferroni_families", f"{CAL}, {NODES} SELECT seed, cap, tau, beta, n, u FROM (SELECT *, {NBEST} FROM nt WHERE n > 0 AND pv <= 0.05 / 48) WHERE k = 1")
def _(spark, sf):
    return Z.bonferroni_selection(seed_nodes(spark, sf), CAPS, ["seed"], 48)


@query("r11_apply_to_test", f"""{CAL}, {GRAPH}, te AS (SELECT * FROM cal0 WHERE part = 'test'), tx AS (SELECT sx.seed, caps.cap, te.*, coalesce(te.g AND te.s >= gb.tau AND (1 - te.s) * te.c <= least(gb.beta, 0.1), false) AS ex FROM te, (SELECT unnest({SEEDS}) AS seed) sx, caps LEFT JOIN gb ON gb.seed = sx.seed AND gb.cap = caps.cap)
SELECT seed, cap, count(*) AS cases, count(*) FILTER (WHERE ex) AS executed, count(*) FILTER (WHERE ex AND u) AS unsafe, {rs('avg(ex::INT)')} AS coverage, {rs('avg(CASE WHEN ex THEN u::INT * c ELSE 0.1 END)')} AS mean_loss FROM tx GROUP BY 1, 2""")
def _(spark, sf):
    picked = Z.graph_selection(seed_nodes(spark, sf), CAPS, ["seed"])
    return rounded(Z.apply_choice(calibration(spark, sf).where("part = 'test'"), picked, SEEDS, CAPS, betas=BT))


KN = """kp AS (SELECT sd.*, p AS policy, p = 'Safety' OR g AS ok FROM sd, (SELECT unnest(['Safety', 'Gate safety']) AS p)),
kt AS (SELECT k.seed, k.policy, k.t, count(*) FILTER (WHERE x.s >= k.t AND ok AND half = 1) AS n, count(*) FILTER (WHERE x.s >= k.t AND ok AND half = 1 AND u) AS u, count(*) FILTER (WHERE x.s >= k.t AND ok AND half = 0) AS n0, count(*) FILTER (WHERE x.s >= k.t AND ok AND half = 0 AND u) AS u0
 FROM (SELECT DISTINCT seed, policy, s AS t FROM kp WHERE half = 0) k JOIN kp x USING (seed, policy) GROUP BY 1, 2, 3)"""
FST = f"{KN}, kv AS (SELECT kt.*, cap, {tail_sql('u', 'n', 'cap')} AS pv, {tail_sql('u0', 'n0', 'cap')} AS pv0 FROM kt, caps)"
KB = "row_number() OVER (PARTITION BY seed, policy, cap ORDER BY n DESC, t) AS k"


def knots(spark, sf):
    d = materialize(Z.gate_counts(calibration(spark, sf).where("part = 'calibration'"), "case_id", SEEDS, F.col("g")))
    return d.where("half = 0"), d.where("half = 1")


@query("r05_fixed_sequence", f"{CAL}, {FST}, kf AS (SELECT *, min((pv <= 0.05)::INT) OVER (PARTITION BY seed, policy, cap ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS pass FROM kv) SELECT seed, policy, cap, t AS threshold, n, u FROM (SELECT *, {KB} FROM kf WHERE pass = 1 AND n > 0) WHERE k = 1")
def _(spark, sf):
    fit, sel = knots(spark, sf)
    return Z.fixed_sequence(Z.knot_counts(fit, sel, ["seed", "policy"]), CAPS, ["seed", "policy"])


@query("r06_learned_start", f"""{CAL}, {FST}, ks AS (SELECT seed, policy, cap, t AS start FROM (SELECT *, row_number() OVER (PARTITION BY seed, policy, cap ORDER BY n0 DESC, t) AS k FROM kv WHERE n0 > 0 AND pv0 <= 0.05) WHERE k = 1),
kf AS (SELECT *, min((pv <= 0.05)::INT) OVER (PARTITION BY seed, policy, cap ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS pass FROM kv LEFT JOIN ks USING (seed, policy, cap) WHERE start IS NULL OR t <= start) SELECT seed, policy, cap, t AS threshold, n, u FROM (SELECT *, {KB} FROM kf WHERE pass = 1 AND n > 0) WHERE k = 1""")
def _(spark, sf):
    fit, sel = knots(spark, sf)
    by = ["seed", "policy"]
    start = Z.learned_start(Z.knot_counts(fit, fit, by), CAPS, by)
    return Z.fixed_sequence(Z.knot_counts(fit, sel, by), CAPS, by, start)


ST = [0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.97]


@query("r08_eight_starts", f"""{CAL}, {KN}, kk AS (SELECT seed, policy, start, t, true AS is_knot FROM (SELECT DISTINCT seed, policy, s AS t FROM kp WHERE half = 0), (SELECT unnest({ST})::DOUBLE AS start) WHERE t < start UNION ALL SELECT DISTINCT seed, policy, start, start, false FROM kp, (SELECT unnest({ST})::DOUBLE AS start) WHERE half = 0),
kc AS (SELECT kk.seed, kk.policy, start, t, count(*) FILTER (WHERE x.s >= t AND ok AND half = 1) AS n, count(*) FILTER (WHERE x.s >= t AND ok AND half = 1 AND u) AS u FROM kk JOIN kp x USING (seed, policy) GROUP BY 1, 2, 3, 4),
kv AS (SELECT kc.*, cap, {tail_sql('u', 'n', 'cap')} AS pv FROM kc, caps), kf AS (SELECT *, min((pv <= 0.05 / 8)::INT) OVER (PARTITION BY seed, policy, cap, start ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS pass FROM kv)
SELECT seed, policy, cap, t AS threshold, start, n, u FROM (SELECT *, row_number() OVER (PARTITION BY seed, policy, cap ORDER BY n DESC, t, start) AS k FROM kf WHERE pass = 1 AND n > 0) WHERE k = 1""")
def _(spark, sf):
    fit, sel = knots(spark, sf)
    by = ["seed", "policy"]
    return Z.eight_starts(Z.knot_counts(fit, sel, by, ST), CAPS, by, ST)


@query("a55_r10_repeat_summary", f"""{CAL}, {GRAPH}, te AS (SELECT * FROM cal0 WHERE part = 'test'), tx AS (SELECT sx.seed, caps.cap, coalesce(te.g AND te.s >= gb.tau AND (1 - te.s) * te.c <= least(gb.beta, 0.1), false) AS ex FROM te, (SELECT unnest({SEEDS}) AS seed) sx, caps LEFT JOIN gb ON gb.seed = sx.seed AND gb.cap = caps.cap),
rp AS (SELECT seed, cap, avg(ex::INT) AS coverage, seed || cap::VARCHAR IN (SELECT seed || cap::VARCHAR FROM gb) AS certified FROM tx GROUP BY 1, 2) SELECT cap, count(*) AS repetitions, {rs('avg(certified::INT)')} AS certification_fraction, {rs('quantile_cont(coverage, 0.5)')} AS coverage_median, {rs('min(coverage)')} AS coverage_min, {rs('max(coverage)')} AS coverage_max FROM rp GROUP BY 1""")
def _(spark, sf):
    picked = materialize(Z.graph_selection(seed_nodes(spark, sf), CAPS, ["seed"]))
    m = Z.apply_choice(calibration(spark, sf).where("part = 'test'"), picked, SEEDS, CAPS, betas=BT).join(picked.select("seed", "cap", F.lit(True).alias("certified")), ["seed", "cap"], "left")
    return rounded(Z.repeat_summary(m.withColumn("certified", F.coalesce("certified", F.lit(False))), ["cap"]))


# both published sweeps: 101 points for scores, 201 for the finer curve
SWEEP = [i / 200 for i in range(201)]


@query("r12_descriptive_sweep", f"{RL} SELECT regime, t AS threshold, count(*) FILTER (WHERE s >= t) AS selected, {rs('avg((s >= t)::INT)')} AS coverage, {rs('count(*) FILTER (WHERE s >= t AND u) / nullif(count(*) FILTER (WHERE s >= t), 0)')} AS unsafe_rate FROM rb, (SELECT unnest({SWEEP})::DOUBLE AS t) GROUP BY 1, 2")
def _(spark, sf):
    return rounded(R.threshold_table(ruled(spark, sf), "s", "u", SWEEP, ["regime"]).select("regime", "threshold", "selected", "coverage", "unsafe_rate"), ["coverage", "unsafe_rate"])


BISECT = f"""{BASE.replace('WITH', 'WITH RECURSIVE', 1)}, z AS (SELECT regime, count(*) AS n, count(*) FILTER (WHERE unsafe) AS u FROM epi WHERE part = 'test' GROUP BY 1),
bi AS (SELECT regime, n, u, 0 AS step, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS u0, 1.0::DOUBLE AS u1 FROM z UNION ALL
 SELECT regime, n, u, step + 1, CASE WHEN low < 0.025 THEN lm ELSE l0 END, CASE WHEN low < 0.025 THEN l1 ELSE lm END, CASE WHEN up > 0.025 THEN um ELSE u0 END, CASE WHEN up > 0.025 THEN u1 ELSE um END
 FROM (SELECT *, {tail_sql('u', 'n', 'um')} AS up, CASE WHEN u = 0 THEN 0 ELSE 1 - {tail_sql('(u - 1)', 'n', 'lm')} END AS low FROM (SELECT *, (l0 + l1) / 2 AS lm, (u0 + u1) / 2 AS um FROM bi WHERE step < 45)))"""


@query("r13_exact_interval", f"{BISECT} SELECT regime, n, u, {rs('CASE WHEN u = 0 THEN 0 ELSE (l0 + l1) / 2 END')} AS lower, {rs('CASE WHEN u = n THEN 1 ELSE (u0 + u1) / 2 END')} AS upper FROM bi WHERE step = 45")
def _(spark, sf):
    z = episodes(spark, sf).where("part = 'test'").groupBy("regime").agg(F.count("*").alias("n"), O.count_if(F.col("unsafe")).alias("u"))
    return rounded(Z.exact_intervals(z, "n", "u").select("regime", "n", "u", "lower", "upper"), ["lower", "upper"])


def dealt_sql(source: str, seed: str, by: str, name: str) -> str:
    """CTE ``name``: the rows of source (with _x = place, _n = size and c) at the places of a seed's permutation."""
    keys = Z.round_keys(seed)
    k, a, b = ([key[i] for key in keys] for i in range(3))
    mirror = f"((({k}[i] - x) % _n + _n) % _n)"
    swap = f"CASE WHEN ((greatest(x, {mirror}) % {Z.COIN} * {a}[i] + {b}[i]) % {Z.COIN}) % 2 = 1 THEN {mirror} ELSE x END"
    return f"{name} AS (SELECT {by}'{seed}' AS j, list_reduce(range(1, {Z.ROUNDS + 1}), lambda x, i: {swap}, _x::BIGINT) AS _x, c FROM {source})"


@query("b13_permutation_placebo", f"""{RL}, pa AS (SELECT case_id, c, row_number() OVER (ORDER BY sha256(case_id), case_id) - 1 AS _x, count(*) OVER () AS _n FROM rb), {dealt_sql('pa', 'perm1:', '', 'pb')}
SELECT pa.case_id, {rs('pb.c')} AS c_placebo FROM pa JOIN pb USING (_x)""")
def _(spark, sf):
    d = calibration(spark, sf).select("case_id", "c")
    return Z.permuted(d, "case_id", "c", "perm1:", "c_placebo").select("case_id", r("c_placebo").alias("c_placebo"))


PERMS = [f"perm{j}:" for j in range(20)]
# cells between grid values are counted before the grid is met: the twin stays small at 20 permutations x 20 seeds
CELL = "CASE WHEN g AND s >= 0 THEN list_count(list_filter({0}, lambda x: s >= x)) ELSE 0 END AS ti, list_count(list_filter({1}, lambda x: (1 - s) * cp <= least(x, 0.1))) AS bi"


@query("r14_placebo_certification", f"""{CAL}, ps AS (SELECT regime, case_id, c, row_number() OVER (PARTITION BY regime ORDER BY sha256(case_id), case_id) - 1 AS _x, count(*) OVER (PARTITION BY regime) AS _n FROM cal0 WHERE part = 'calibration'),
{', '.join(dealt_sql('ps', p, 'regime, ', f'd{i}') for i, p in enumerate(PERMS))}, pd AS ({' UNION ALL '.join(f'SELECT * FROM d{i}' for i in range(len(PERMS)))}),
pm AS (SELECT pd.j, ps.case_id, pd.c AS cp FROM ps JOIN pd USING (regime, _x) UNION ALL SELECT 'actual', case_id, c FROM ps),
pc AS (SELECT regime, pm.j AS permutation, seed, {CELL.format(Z.TAUS, BT)}, u, count(*) AS m FROM sd JOIN pm USING (case_id) WHERE half = 1 GROUP BY ALL),
pn AS (SELECT regime, permutation, seed, tau, beta, coalesce(sum(m) FILTER (WHERE ti >= tx AND bi >= {len(BT)} - bx + 1), 0)::BIGINT AS n, coalesce(sum(m) FILTER (WHERE u AND ti >= tx AND bi >= {len(BT)} - bx + 1), 0)::BIGINT AS u
 FROM pc, (SELECT tau, row_number() OVER (ORDER BY tau) AS tx FROM (SELECT unnest({Z.TAUS})::DOUBLE AS tau)), (SELECT beta, row_number() OVER (ORDER BY beta) AS bx FROM (SELECT unnest({BT})::DOUBLE AS beta)) GROUP BY 1, 2, 3, 4, 5),
pv AS (SELECT pn.*, cap, {tail_sql('u', 'n', 'cap')} AS pv FROM pn, caps), pg AS (SELECT *, min((n > 0 AND pv <= 0.05 / 8)::INT) OVER (PARTITION BY regime, permutation, seed, cap, tau ORDER BY beta ROWS UNBOUNDED PRECEDING) AS pass FROM pv)
SELECT regime, permutation, cap, count(DISTINCT seed) FILTER (WHERE pass = 1) AS certifications FROM pg GROUP BY 1, 2, 3""")
def _(spark, sf):
    # written once: the 21 arms share a row's hashes
    cal = materialize(calibration(spark, sf).where("part = 'calibration'").select("case_id", "regime", "s", "g", "u", "c", Z.seed_bits("case_id", SEEDS).alias("halves")))
    arms = Z.permuted_all(cal, "case_id", "c", PERMS, "cp", ["regime"]).unionByName(cal.withColumn("permutation", F.lit("actual")).withColumn("cp", F.col("c")))
    by = ["regime", "permutation", "seed"]
    nodes = materialize(Z.seed_node_counts(arms.drop("c").withColumnRenamed("cp", "c"), "case_id", SEEDS, by[:2], betas=BT, halves="halves"))
    t = Z.tested(nodes, CAPS)
    kept = Z.stop_at_first_failure(t, [*by, "cap", "tau"], "bj", (F.col("n") > 0) & (F.col("p_value") <= 0.05 / 8))
    hit = kept.select("regime", "permutation", "cap", "seed").distinct().groupBy("regime", "permutation", "cap").agg(F.count("*").alias("certifications"))
    return t.select("regime", "permutation", "cap").distinct().join(hit, ["regime", "permutation", "cap"], "left").fillna(0, ["certifications"])


# ---- bootstraps ---------------------------------------------------------------------------
# keeps sums that end in exactly half a digit off the rounding edge, on both sides alike
OFF = " + 3e-10"
REPS, BS = 2000, "boot1"
CASES = " ".join(f"WHEN x < {float(c)!r} THEN {k}" for k, c in enumerate(Q.poisson_steps()))


def key_sql(text: str, at: int) -> str:
    return f"(('0x' || substr(sha256({text}), {at}, 8))::BIGINT % 2147483646 + 1)"


def boot(key: str, src: str, reps: int = REPS) -> str:
    return f"""rp AS (SELECT i AS rep, {key_sql(f"'{BS}:' || i::VARCHAR", 1)} AS m1, {key_sql(f"'{BS}:' || i::VARCHAR", 9)} AS m2 FROM generate_series(0, {reps - 1}) t(i)),
cl AS (SELECT DISTINCT {key} AS ck, {key_sql(f'{key}::VARCHAR', 1)} AS k1, {key_sql(f'{key}::VARCHAR', 9)} AS k2 FROM {src}),
bw AS (SELECT ck, rep, CASE {CASES} ELSE {len(Q.poisson_steps())} END AS w FROM (SELECT ck, rep, ((k1 * m1 + k2 * m2) % 2147483647) / 2147483647.0 AS x FROM cl, rp))"""


@query("q01_bootstrap_weights", f"WITH {boot('c_custkey', 'customer')} SELECT rep, count(*) AS clusters, sum(w)::BIGINT AS weight, sum(w * w)::BIGINT AS square, sum(w * (ck % 97))::BIGINT AS keyed FROM bw GROUP BY 1")
def _(spark, sf):
    return Q.weight_moments(table(spark, sf, "customer", ["c_custkey"]), "c_custkey", F.col("c_custkey") % 97, REPS, BS)


V = "transaction_exposure_eur"
TERM_SQL = {
    "n": "1", "executed": "(action = 'EXECUTE')::INT", "unsafe_executed": "(action = 'EXECUTE' AND unsafe)::INT", "value_executed": f"CASE WHEN action = 'EXECUTE' THEN {V} ELSE 0 END",
    "value_unsafe": f"CASE WHEN action = 'EXECUTE' AND unsafe THEN {V} ELSE 0 END", "c_executed": "CASE WHEN action = 'EXECUTE' THEN c ELSE 0 END", "c_unsafe": "CASE WHEN action = 'EXECUTE' AND unsafe THEN c ELSE 0 END",
    "loss": LOSS_A, "escalated": "(action = 'ESCALATE')::INT", "gathered": "(action = 'GATHER')::INT", "abstained": "(action = 'ABSTAIN')::INT"}
BM = f"""{LONG}, fd AS (SELECT * FROM dl WHERE mode = 'LOG_TRAIN_P90'), cs AS (SELECT group_id, policy, {', '.join(f'sum({e})::DOUBLE AS {n}' for n, e in TERM_SQL.items())} FROM fd GROUP BY 1, 2), {boot('group_id', 'fd')},
bs AS (SELECT policy, rep, {', '.join(f'sum(w * {n}) AS {n}' for n in TERM_SQL)} FROM cs JOIN bw ON ck = group_id GROUP BY 1, 2),
bm AS (SELECT policy, rep, executed / n AS autonomous_execution_coverage, unsafe_executed / nullif(executed, 0) AS unsafe_execution_rate, value_unsafe / nullif(value_executed, 0) AS raw_exposure_weighted_unsafe_rate, c_unsafe / nullif(c_executed, 0) AS consequence_weighted_unsafe_rate,
 loss / n AS mean_realized_normalized_loss, escalated / n AS human_escalation_rate, gathered / n AS gather_rate, abstained / n AS abstention_rate FROM bs)"""


def replicates(spark, sf, reps=REPS):
    per = Q.policy_cluster_sums(longs(spark, sf, modes=["LOG_TRAIN_P90"]), "group_id", ["policy"], terms())
    return Q.replicate_metrics(per, "group_id", ["policy"], reps, BS)


@query("q02_weighted_metrics", f"{BM} SELECT policy, rep, {', '.join(f'{rs(m + OFF)} AS {m}' for m in RATES)} FROM bm")
def _(spark, sf):
    return rounded(replicates(spark, sf).select("policy", "rep", *[(F.col(m) + float(OFF[3:])).alias(m) for m in RATES]))


def interval_sql(src: str, by: str, value: str) -> str:
    return f"SELECT {by}, count({value}) AS replicates, {rs(f'avg({value})', 5)} AS mean, {rs(f'stddev_samp({value})', 5)} AS se, {rs(f'quantile_cont({value}, 0.025)', 5)} AS lower, {rs(f'quantile_cont({value}, 0.975)', 5)} AS upper FROM {src} GROUP BY ALL HAVING count({value}) > 0"


@query("q04_q05_intervals", f"{BM}, lg AS ({' UNION ALL '.join(f'''SELECT policy, '{m}' AS metric, {m} AS x FROM bm''' for m in RATES)}) {interval_sql('lg', 'policy, metric', 'x')}")
def _(spark, sf):
    return rounded(Q.intervals(replicates(spark, sf), RATES, ["policy"]), digits=5)


DELTA = f"{BM}, dt AS ({' UNION ALL '.join(f'''SELECT a.rep, '{lab}' AS comparison, '{m}' AS metric, a.{m} - b.{m} AS delta FROM bm a JOIN bm b USING (rep) WHERE a.policy = '{x}' AND b.policy = '{y}' ''' for x, y, lab in D.ABLATIONS for m in RATES)})"


def deltas(spark, sf):
    return PO.ablation_deltas(replicates(spark, sf), ["rep"], D.ABLATIONS)


@query("q06_paired_intervals", f"""{DELTA} SELECT comparison, metric, count(delta) AS replicates, {rs('avg(delta)', 5)} AS mean, {rs('quantile_cont(delta, 0.025)', 5)} AS lower, {rs('quantile_cont(delta, 0.975)', 5)} AS upper, {rs('avg((delta < -1e-12)::INT)')} AS p_below, {rs('avg((delta > 1e-12)::INT)')} AS p_above FROM dt GROUP BY 1, 2 HAVING count(delta) > 0""")
def _(spark, sf):
    d = deltas(spark, sf).withColumn("delta", F.when(F.abs("delta") <= 1e-12, 0.0).otherwise(F.col("delta")))
    p = Q.paired_intervals(d, ["comparison", "metric"])
    return rounded(rounded(p, ["mean", "lower", "upper"], 5), ["p_below", "p_above"])


@query("q17_replicate_deltas", f"{DELTA} SELECT rep, comparison, metric, {rs('delta' + OFF, 5)} AS delta FROM dt")
def _(spark, sf):
    return rounded(deltas(spark, sf).select("rep", "comparison", "metric", (F.col("delta") + float(OFF[3:])).alias("delta")), digits=5)


DIAG = {
    "natural_reference_execute_retention": ("family = 'NATURAL' AND expected_action_reference = 'EXECUTE' AND gate = 'VALID'", "family = 'NATURAL' AND expected_action_reference = 'EXECUTE'"),
    "natural_coverage": ("family = 'NATURAL' AND action = 'EXECUTE'", "family = 'NATURAL'"),
    "natural_unsafe_rate": ("family = 'NATURAL' AND action = 'EXECUTE' AND unsafe", "family = 'NATURAL' AND action = 'EXECUTE'"),
    "contradiction_block_rate": ("family = 'CONTRADICTION' AND gate <> 'VALID'", "family = 'CONTRADICTION'"),
    "residual_contradiction_execution": ("family = 'CONTRADICTION' AND gate = 'VALID' AND action = 'EXECUTE'", "family = 'CONTRADICTION' AND gate = 'VALID'"),
    "missingness_block_rate": ("family = 'MISSINGNESS' AND gate <> 'VALID'", "family = 'MISSINGNESS'"),
    "severe_block_rate": ("family = 'SEVERE_EVIDENCE_LOSS' AND gate <> 'VALID'", "family = 'SEVERE_EVIDENCE_LOSS'"),
}


@query("q03_diagnostic_rates", f"""{LONG}, fd AS (SELECT * FROM dl WHERE mode = 'LOG_TRAIN_P90' AND policy = 'V2_FULL'), cs AS (SELECT group_id, {', '.join(f'sum(({a})::INT) AS a_{n}, sum(({b})::INT) AS b_{n}' for n, (a, b) in DIAG.items())} FROM fd GROUP BY 1), {boot('group_id', 'fd')},
bs AS (SELECT rep, {', '.join(f'sum(w * a_{n}) / nullif(sum(w * b_{n}), 0) AS {n}' for n in DIAG)} FROM cs JOIN bw ON ck = group_id GROUP BY 1), lg AS ({' UNION ALL '.join(f"SELECT '{n}' AS metric, {n} AS x FROM bs" for n in DIAG)}) {interval_sql('lg', 'metric', 'x')}""")
def _(spark, sf):
    from .policy_queries import full

    d = full(spark, sf)
    sums = [x for n in DIAG for x in (f"a_{n}", f"b_{n}")]
    per = d.groupBy("group_id").agg(*[O.count_if(F.expr(e)).alias(f"{p}_{n}") for n, ab in DIAG.items() for p, e in zip("ab", ab)])
    q = Q.replicate_sums(per, "group_id", sums, REPS, BS)
    q = q.select("rep", *[F.try_divide(F.col(f"a_{n}"), F.col(f"b_{n}")).alias(n) for n in DIAG])
    return rounded(Q.intervals(q, list(DIAG), []), digits=5)


@query("q07_cluster_mean", f"""{RL}, cs AS (SELECT group_id, regime, sum(u::INT * c) AS x, count(*) AS n FROM rb GROUP BY 1, 2), {boot('group_id', 'rb')}, bs AS (SELECT regime, rep, sum(w * x) / nullif(sum(w * n), 0) AS v FROM cs JOIN bw ON ck = group_id GROUP BY 1, 2)
SELECT b.regime, count(v) AS replicates, {rs('quantile_cont(v, 0.025)', 5)} AS lower, {rs('quantile_cont(v, 0.975)', 5)} AS upper, any_value(clusters) AS clusters, {rs('any_value(e)', 5)} AS estimate FROM bs b JOIN (SELECT regime, count(*) AS clusters, sum(x) / sum(n) AS e FROM cs GROUP BY 1) p USING (regime) GROUP BY 1""")
def _(spark, sf):
    d = ruled(spark, sf)
    return rounded(Q.mean_interval(d, "group_id", F.col("u").cast("double") * F.col("c"), REPS, BS, ["regime"]), digits=5)


Q8 = f"""{DL}, cs AS (SELECT group_id, comparison, sum(delta) AS x, count(*) AS n FROM dx GROUP BY 1, 2), {boot('group_id', 'dx')}, bs AS (SELECT comparison, rep, sum(w * x) / nullif(sum(w * n), 0) AS v FROM cs JOIN bw ON ck = group_id GROUP BY 1, 2),
qi AS (SELECT b.comparison, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, any_value(e) AS e FROM bs b JOIN (SELECT comparison, sum(x) / sum(n) AS e FROM cs GROUP BY 1) p USING (comparison) GROUP BY 1)"""


def contrasts(spark, sf):
    p = R.paired(ruled(spark, sf), rules(), PAIRS, ["group_id"])
    return Q.mean_interval(p, "group_id", F.col("delta"), REPS, BS, ["comparison"])


@query("q08_paired_loss", f"{Q8} SELECT comparison, {rs('e', 5)} AS estimate, {rs('lo', 5)} AS lower, {rs('hi', 5)} AS upper FROM qi")
def _(spark, sf):
    return rounded(contrasts(spark, sf).select("comparison", "estimate", "lower", "upper"), digits=5)


@query("q15_component_effects", f"""{Q8} SELECT component, comparison, {rs('CASE WHEN flip THEN -e ELSE e END', 5)} AS estimate, {rs('CASE WHEN flip THEN -hi ELSE lo END', 5)} AS lower, {rs('CASE WHEN flip THEN -lo ELSE hi END', 5)} AS upper FROM qi JOIN (VALUES ('Gate', 'Gate only minus Evidence complete', false), ('Consequence', 'Reference minus Gate safety', true)) m(component, comparison, flip) USING (comparison)""")
def _(spark, sf):
    from ..operators.reports import component_effects

    return rounded(component_effects(contrasts(spark, sf), {"Gate": ("Gate only minus Evidence complete", False), "Consequence": ("Reference minus Gate safety", True)}), digits=5)


@query("q10_rate_difference", f"""{RL}, rd AS (SELECT group_id, u, gate = 'VALID' AND s >= 0.4 AS sel, transaction_exposure_eur > p90 / 2 AS hi FROM rb), cs AS (SELECT group_id, count(*) FILTER (WHERE sel AND NOT hi) AS nl, count(*) FILTER (WHERE sel AND hi) AS nh, count(*) FILTER (WHERE sel AND NOT hi AND u) AS ul, count(*) FILTER (WHERE sel AND hi AND u) AS uh FROM rd GROUP BY 1), {boot('group_id', 'rd')},
bs AS (SELECT rep, sum(w * uh) / nullif(sum(w * nh), 0) - sum(w * ul) / nullif(sum(w * nl), 0) AS v FROM cs JOIN bw ON ck = group_id GROUP BY 1) SELECT count(v) AS replicates, {rs('quantile_cont(v, 0.025)', 5)} AS lower, {rs('quantile_cont(v, 0.975)', 5)} AS upper, (SELECT {rs('sum(uh) / sum(nh) - sum(ul) / sum(nl)', 5)} FROM cs) AS estimate FROM bs""")
def _(spark, sf):
    d = ruled(spark, sf)
    sel, hi = (F.col("gate") == "VALID") & (F.col("s") >= 0.4), F.col("transaction_exposure_eur") > F.col("p90") / 2
    return rounded(Q.rate_difference(d, "group_id", sel, hi, F.col("u"), REPS, BS), digits=5)


AUC = f"""{RL}, {boot('group_id', 'rb')}, au AS (SELECT group_id, u, p_safe_t0_raw AS a, s AS b FROM rb), an AS (SELECT -1 AS rep, ck, 1 AS w FROM cl UNION ALL SELECT rep, ck, w FROM bw)"""


def auc_sql(score: str) -> str:
    return f"""SELECT rep, sum(neg * (cp - pos / 2.0)) / nullif(any_value(p) * any_value(n), 0) AS auroc, sum(CASE WHEN cp + cn > 0 THEN pos * (cp / (cp + cn)) ELSE 0 END) / nullif(any_value(p), 0) AS average_precision
 FROM (SELECT rep, pos, neg, sum(pos) OVER o AS cp, sum(neg) OVER o AS cn, sum(pos) OVER (PARTITION BY rep) AS p, sum(neg) OVER (PARTITION BY rep) AS n FROM
 (SELECT rep, {score} AS x, sum(CASE WHEN NOT u THEN w ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN u THEN w ELSE 0 END)::DOUBLE AS neg FROM au JOIN an ON ck = group_id GROUP BY 1, 2) WINDOW o AS (PARTITION BY rep ORDER BY x DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1"""


@query("q09_paired_auroc", f"""{AUC}, ua AS ({auc_sql('a')}), ub AS ({auc_sql('b')}), ud AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, rep, ua.{m} AS a, ub.{m} AS b, ub.{m} - ua.{m} AS d FROM ua JOIN ub USING (rep)" for m in ('auroc', 'average_precision'))})
SELECT metric, {', '.join(f"{rs(f'max({c}) FILTER (WHERE rep = -1)', 5)} AS {n}" for c, n in (('a', 'a'), ('b', 'b'), ('d', 'estimate')))}, count(*) FILTER (WHERE rep >= 0) AS replicates, {rs('avg(d) FILTER (WHERE rep >= 0)', 5)} AS mean, {rs('quantile_cont(d, 0.025) FILTER (WHERE rep >= 0)', 5)} AS lower, {rs('quantile_cont(d, 0.975) FILTER (WHERE rep >= 0)', 5)} AS upper FROM ud GROUP BY 1""")
def _(spark, sf):
    d = ruled(spark, sf).withColumn("safe", ~F.col("u"))
    return rounded(Q.paired_curves(d, "group_id", "p_safe_t0_raw", "s", "safe", REPS, BS).drop("p_below", "p_above"), digits=5)


@query("q14_report_table", f"""{BM}, lg AS ({' UNION ALL '.join(f'''SELECT policy, '{m}' AS metric, {m} AS x FROM bm''' for m in RATES[:2])}), it AS (SELECT policy, metric, avg(x) AS mean, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM lg GROUP BY 1, 2)
SELECT policy, {', '.join(f"{rs(f'''max({c}) FILTER (WHERE metric = '{m}')''', 5)} AS {m}_{n}" for m in RATES[:2] for c, n in (('mean', 'mean'), ('lo', 'lower'), ('hi', 'upper')))} FROM it GROUP BY 1""")
def _(spark, sf):
    from ..operators.reports import wide_intervals

    return rounded(wide_intervals(Q.intervals(replicates(spark, sf), RATES[:2], ["policy"]), ["policy"], RATES[:2]), digits=5)


@query("q16_repeated_split_summary", f"""{RL}, sp AS (SELECT seed, avg(CASE WHEN part2 = 'test' THEN u::INT * c END) - avg(CASE WHEN part2 = 'train' THEN u::INT * c END) AS gap FROM (SELECT rb.*, seed, CASE WHEN ('0x' || substr(sha256(seed || group_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0 < 0.7 THEN 'train' ELSE 'test' END AS part2 FROM rb, (SELECT unnest({SEEDS}) AS seed)) GROUP BY 1)
SELECT count(*) AS splits, {rs('quantile_cont(gap, 0.5)')} AS gap_median, {rs('min(gap)')} AS gap_min, {rs('max(gap)')} AS gap_max, count(*) FILTER (WHERE gap > 0) AS positive_splits FROM sp""")
def _(spark, sf):
    from ..operators.reports import split_gap_summary

    return rounded(split_gap_summary(ruled(spark, sf), "group_id", F.col("u").cast("double") * F.col("c"), SEEDS))


@query("v05_same_as_archived", """WITH a AS (SELECT o_custkey, sum(o_totalprice) AS x, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey, sum(o_totalprice) AS x, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE a.x IS NULL OR b.x IS NULL) AS only_in_one, count(*) FILTER (WHERE a.x IS NOT NULL AND b.x IS NOT NULL AND (abs(a.x - b.x) > 1e-9 * abs(b.x) OR a.n <> b.n)) AS different FROM a FULL JOIN b USING (o_custkey)""")
def _(spark, sf):
    from ..operators.reports import same_table

    # the archived run lacks the pending orders, so both kinds of difference turn up
    o = table(spark, sf, "orders", ["o_custkey", "o_orderstatus", "o_totalprice"])
    run = lambda d: d.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("x"), F.count("*").alias("n"))
    return same_table(run(o), run(o.where("o_orderstatus <> 'P'")), ["o_custkey"], ["x", "n"], rtol=1e-9)
