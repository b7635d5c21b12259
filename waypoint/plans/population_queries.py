"""Profiles, joins, splits, corrupted copies and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gate as G
from ..functions import labels as L
from ..functions import scalars as S
from ..operators import benchmark as B
from ..operators import checks as K
from ..operators import gate_audit as GA
from ..operators import ordered as O
from ..operators import profile as P
from ..operators import splits as X
from ..operators.cases import with_risk_stratum
from ..session import materialize
from ..sources.tables import table
from .registry import query, r, rounded, rs
from .scalar_queries import (
    BIN_EDGES, BIN_LABELS, BIN_SQL, FLAGS_CTE, GATED, HITS, REASON_SQL, READY_SQL, REVIEW_SQL, STRATUM, flags, gate_sql, gated,
)
from .tables import BASE, VC, episodes, value_cases

# ---- profiles -----------------------------------------------------------------------------
PROFILED = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("a01_column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, {rs(f'100.0 * (count(*) - count({c})) / count(*)')} AS missing_pct, count(DISTINCT {c}) AS distinct_values FROM orders" for c in PROFILED))
def _(spark, sf):
    return rounded(P.column_profile(table(spark, sf, "orders", PROFILED)))


@query("a02_value_counts", "SELECT x, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS x FROM orders) GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("x"))
    return d.groupBy("x").agg(F.count("*").alias("n"))


STATS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


@query("a03_describe", f"""SELECT count(*) AS n, {rs('avg(l_extendedprice)', 4)} AS mean, {rs('stddev_samp(l_extendedprice)', 4)} AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
 {rs('quantile_cont(l_extendedprice, 0.5)', 4)} AS p50, {rs('quantile_cont(l_extendedprice, 0.9)', 4)} AS p90, {rs('quantile_cont(l_extendedprice, 0.99)', 4)} AS p99 FROM lineitem""")
def _(spark, sf):
    d = P.numeric_summary(table(spark, sf, "lineitem", ["l_extendedprice"]), "l_extendedprice", [], STATS, ["n", "mean", "std", "min", "max"])
    return rounded(d, digits=4)


@query("a05_filter_funnel", f"""SELECT stage, cases, events, {rs('100.0 * cases / max(cases) OVER ()', 4)} AS retention_pct FROM (
 SELECT 'all' AS stage, count(DISTINCT l_orderkey) AS cases, count(*) AS events FROM lineitem UNION ALL
 SELECT 'category', count(DISTINCT l_orderkey), count(*) FROM lineitem WHERE l_returnflag IN ('A', 'R') UNION ALL
 SELECT 'with_activity', count(DISTINCT l_orderkey), count(*) FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A','R') AND l_linestatus = 'F'))""")
def _(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_returnflag", "l_linestatus"])
    return rounded(P.funnel(li, "l_orderkey", F.col("l_returnflag").isin("A", "R"), F.col("l_linestatus") == "F"), digits=4)


@query("a06_cases_per_category", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS cases FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_returnflag"])
    return li.distinct().groupBy("l_returnflag").agg(F.count("*").alias("cases"))


@query("a08_share_within_group", f"{FLAGS_CTE} SELECT item_category, {READY_SQL} AS label, count(*) AS n, {rs('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY item_category)', 4)} AS pct FROM rf GROUP BY 1, 2")
def _(spark, sf):
    d = episodes(spark, sf).select("item_category", L.readiness_label(flags(), ["PRIOR_PRICE_CHANGE"]).alias("label"))
    return rounded(P.counts_with_share(d, ["item_category", "label"], ["item_category"]), digits=4)


@query("a09_reason_summary", f"""{FLAGS_CTE} {' UNION ALL '.join(f"SELECT '{n}' AS signal, count(*) FILTER (WHERE f_{n}) AS n_true, {rs(f'100.0 * avg(f_{n}::INT)', 4)} AS pct_true, {str(n in L.REVIEW_REASONS).lower()} AS forces_review FROM rf" for n in REASON_SQL)}""")
def _(spark, sf):
    d = episodes(spark, sf).select(*[c.alias(n) for n, c in flags().items()])
    return rounded(P.flag_prevalence(d, list(REASON_SQL)).withColumn("forces_review", F.col("signal").isin(L.REVIEW_REASONS)), digits=4)


@query("a10_reason_combinations", f"""{FLAGS_CTE} SELECT coalesce(nullif(concat_ws('|', {', '.join(f"CASE WHEN f_{n} THEN '{n}' END" for n in REASON_SQL)}), ''), 'NONE') AS codes, count(*) AS n FROM rf WHERE {READY_SQL} = 'REVIEW' GROUP BY 1""")
def _(spark, sf):
    f = flags()
    d = episodes(spark, sf).where(L.readiness_label(f, ["PRIOR_PRICE_CHANGE"]) == "REVIEW")
    return d.groupBy(L.code_text(f).alias("codes")).agg(F.count("*").alias("n"))


MULT = (["1", "2", "3-5", "6+"], [1, 2, 5])


@query("a11_multiplicity", f"""{BASE}, b AS (SELECT unnest(['0', '1', '2', '3-5', '6+']) AS bucket) SELECT bucket, count(case_id) AS n FROM b LEFT JOIN
 (SELECT case_id, CASE WHEN n_lines = 0 THEN '0' WHEN n_lines = 1 THEN '1' WHEN n_lines = 2 THEN '2' WHEN n_lines <= 5 THEN '3-5' ELSE '6+' END AS bucket FROM vc) USING (bucket) GROUP BY 1""")
def _(spark, sf):
    d = value_cases(spark, sf).select("n_lines")
    return P.bucket_counts(d, F.col("n_lines"), [0, 1, 2, 5], ["0", "1", "2", "3-5", "6+"], "bucket")


@query("a12_f02_structural_profile", f"""{BASE} SELECT item_category, count(*) AS n, {rs('quantile_cont(inv_po_abs_rel_diff, 0.5)')} AS p50, {rs('avg(inv_po_abs_rel_diff)')} AS mean,
 {rs('avg((inv_po_abs_rel_diff > 1)::INT)')} AS share_above_1 FROM vc GROUP BY 1""")
def _(spark, sf):
    d = value_cases(spark, sf).select("item_category", "inv_po_abs_rel_diff")
    s = P.numeric_summary(d, "inv_po_abs_rel_diff", ["item_category"], {"p50": 0.5}, ["n", "mean"])
    above = d.groupBy(F.col("item_category").alias("_c")).agg(F.avg((F.col("inv_po_abs_rel_diff") > 1).cast("int")).alias("share_above_1"))
    return rounded(s.join(above, F.col("item_category") == F.col("_c")).drop("_c"))


@query("a13_mismatch_bands", f"""{BASE} SELECT 'po' AS field, {BIN_SQL} AS band, count(*) AS n FROM (SELECT inv_po_abs_rel_diff AS x FROM vc) GROUP BY 1, 2
 UNION ALL SELECT 'gr', {BIN_SQL}, count(*) FROM (SELECT inv_gr_abs_rel_diff AS x FROM vc) GROUP BY 1, 2""")
def _(spark, sf):
    d = value_cases(spark, sf).select(F.inline(F.array(
        F.struct(F.lit("po").alias("field"), F.col("inv_po_abs_rel_diff").alias("x")), F.struct(F.lit("gr").alias("field"), F.col("inv_gr_abs_rel_diff").alias("x")))))
    return d.groupBy("field", S.right_closed_bin(F.col("x"), BIN_EDGES, BIN_LABELS).alias("band")).agg(F.count("*").alias("n"))


P14 = {"p01": .01, "p05": .05, "p25": .25, "p50": .5, "p75": .75, "p90": .9, "p95": .95, "p99": .99}


@query("a14_numeric_summary", f"""{BASE} SELECT family, count(*) AS n, count(x) AS non_null, {rs('avg(x)')} AS mean, {rs('stddev_samp(x)')} AS std, {rs('min(x)')} AS min, {rs('max(x)')} AS max,
 {', '.join(f"{rs(f'quantile_cont(x, {p})')} AS {n}" for n, p in P14.items())} FROM (SELECT family, p_safe_t0_raw AS x FROM epi) GROUP BY 1""")
def _(spark, sf):
    d = episodes(spark, sf).select("family", "p_safe_t0_raw")
    return rounded(P.numeric_summary(d, "p_safe_t0_raw", ["family"], P14, ["n", "non_null", "mean", "std", "min", "max"]))


@query("a21_reference_agreement", f"{BASE} SELECT target, expected_action_reference, count(*) AS n FROM epi GROUP BY 1, 2")
def _(spark, sf):
    return episodes(spark, sf).groupBy("target", "expected_action_reference").agg(F.count("*").alias("n"))


@query("a25_conflicts", "SELECT l_orderkey::VARCHAR AS k, 'l_linestatus' AS column_name, count(DISTINCT l_linestatus) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def _(spark, sf):
    c = K.conflicts(table(spark, sf, "lineitem", ["l_orderkey", "l_linestatus"]), "l_orderkey", ["l_linestatus"])
    return c.select(F.col("l_orderkey").cast("string").alias("k"), F.col("column").alias("column_name"), "n_values")


# ---- gate audits --------------------------------------------------------------------------
FAMS = ["NATURAL", "MISSINGNESS", "CONTRADICTION", "SEVERE_EVIDENCE_LOSS"]


@query("a37_gate_summary", f"""{GATED} SELECT family, count(*) AS episodes, count(*) FILTER (WHERE gate <> 'VALID') AS blocked_count, {rs("avg((gate <> 'VALID')::INT)")} AS block_rate,
 {rs("avg((gate = 'VALID')::INT)")} AS valid_rate, {rs("avg((gate = 'INCOMPLETE')::INT)")} AS incomplete_rate, {rs("avg((gate = 'CONTRADICTORY')::INT)")} AS contradictory_rate FROM gt GROUP BY 1""")
def _(spark, sf):
    return rounded(GA.gate_summary(gated(spark, sf), ["family"]))


@query("a37_natural_false_blocks", f"""{GATED} SELECT population, count(*) AS episodes, count(*) FILTER (WHERE gate <> 'VALID') AS blocked_count, {rs("avg((gate <> 'VALID')::INT)")} AS false_block_rate FROM (
 SELECT 'ALL_NATURAL' AS population, gate FROM gt WHERE family = 'NATURAL' UNION ALL SELECT 'NATURAL_REFERENCE_EXECUTE', gate FROM gt WHERE family = 'NATURAL' AND expected_action_reference = 'EXECUTE') GROUP BY 1""")
def _(spark, sf):
    return rounded(GA.natural_false_blocks(gated(spark, sf)))


@query("a36_rule_activation", f"""{BASE} {' UNION ALL '.join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {e}) AS overall_trigger_count, {rs(f'avg(({e})::INT)')} AS overall_trigger_rate, " + ', '.join(f"count(*) FILTER (WHERE ({e}) AND family = '{f}') AS {f.lower()}_trigger_count, {rs(f'''count(*) FILTER (WHERE ({e}) AND family = '{f}') / nullif(count(*) FILTER (WHERE family = '{f}'), 0)''')} AS {f.lower()}_trigger_rate" for f in FAMS) + " FROM epi" for n, e in HITS)}""")
def _(spark, sf):
    rules = {**G.fixed_rules(), "value_inconsistency": G.value_rule(1.0)}
    return rounded(GA.rule_activation(episodes(spark, sf), rules, "family", FAMS))


@query("a35_contradiction_flow", f"""{GATED} SELECT intervention_type, strength, gate, predicted_action, count(*) AS n, {rs("count(*) / sum(count(*)) OVER (PARTITION BY intervention_type, strength)")} AS share
 FROM gt WHERE family = 'CONTRADICTION' GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    d = gated(spark, sf).where(F.col("family") == "CONTRADICTION")
    c = P.counts_with_share(d, ["intervention_type", "strength", "gate", "predicted_action"], ["intervention_type", "strength"])
    return rounded(c.withColumn("share", F.col("pct") / 100).drop("pct"))


GRP = """CASE WHEN family = 'CONTRADICTION' AND gate <> 'VALID' THEN 'CONTRADICTION_BLOCKED'
 WHEN family = 'CONTRADICTION' AND predicted_action = 'EXECUTE' THEN 'CONTRADICTION_VALID_EXECUTED' WHEN family = 'CONTRADICTION' THEN 'CONTRADICTION_VALID_NOT_EXECUTED'
 WHEN family = 'NATURAL' AND expected_action_reference = 'EXECUTE' THEN 'NATURAL_REFERENCE_EXECUTE' ELSE 'OTHER' END"""
BOOLS = ["goods_receipt_required", "gr_available_at_t0", "had_price_change_before_t0", "had_payment_block_before_t0"]


@query("a39_rates_by_comparison_group", f"""{GATED}, g AS (SELECT *, {GRP} AS grp FROM gt) {' UNION ALL '.join(f"SELECT grp, '{b}' AS signal, count(*) FILTER (WHERE {b}) AS n_true, {rs(f'100.0 * avg({b}::INT)')} AS pct_true FROM g GROUP BY 1" for b in BOOLS)}""")
def _(spark, sf):
    d = gated(spark, sf).withColumn("grp", G.comparison_group("gate", "predicted_action", "family", "expected_action_reference"))
    return rounded(P.flag_prevalence(d, BOOLS, ["grp"]))


# ---- joins --------------------------------------------------------------------------------
@query("j01_checked_many_to_one", "SELECT o_orderkey, c_mktsegment, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON c_custkey = o_custkey")
def _(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_custkey"]).withColumnRenamed("o_custkey", "k")
    c = table(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"]).where("c_nationkey < 20").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return K.checked_join(o, c, ["k"], "many_to_one", marker="found").select("o_orderkey", "c_mktsegment", "found")


@query("j02_checked_one_to_one", f"WITH {VC} SELECT case_id, o_orderstatus FROM vc JOIN orders USING (o_orderkey)")
def _(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderstatus"])
    return K.checked_join(value_cases(spark, sf).select("o_orderkey", "case_id"), o, ["o_orderkey"], "one_to_one", "inner").select("case_id", "o_orderstatus")


@query("j03_one_to_many", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey"])
    o = table(spark, sf, "orders", ["o_custkey", "o_orderkey"]).withColumnRenamed("o_custkey", "c_custkey")
    return K.checked_join(c, o, ["c_custkey"], "one_to_many")


@query("j04_inner_join", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"])
    return li.join(table(spark, sf, "part", ["p_partkey", "p_brand"]), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand")


@query("j06_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY 1 LIMIT 10")
def _(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey"])
    li = table(spark, sf, "lineitem", ["l_orderkey"]).withColumnRenamed("l_orderkey", "o_orderkey")
    return K.missing_keys(o, li, ["o_orderkey"], 10)


@query("j07_key_lookup", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def _(spark, sf):
    s = table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"])
    return s.join(table(spark, sf, "nation", ["n_nationkey", "n_name"]), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("j11_j13_attach_missing_columns", f"WITH {VC} SELECT case_id, status, o_orderdate IS NOT NULL AS has_date, o_totalprice FROM vc LEFT JOIN orders USING (o_orderkey)")
def _(spark, sf):
    from ..operators.joins import attach_missing

    left = value_cases(spark, sf).select("o_orderkey", "case_id", "status")
    o = table(spark, sf, "orders")
    return attach_missing(left, o, ["o_orderkey"]).select("case_id", "status", F.col("o_orderdate").isNotNull().alias("has_date"), "o_totalprice")


@query("j12_pairing_check", """SELECT o_custkey, count(*) AS n_rows, count(DISTINCT o_orderstatus) AS d_status, count(DISTINCT o_orderpriority) AS d_priority FROM orders GROUP BY 1""")
def _(spark, sf):
    from ..operators.joins import duplicate_equivalence

    d = duplicate_equivalence(table(spark, sf, "orders", ["o_custkey", "o_orderstatus", "o_orderpriority"]), "o_custkey", ["o_orderstatus", "o_orderpriority"])
    return d.select("o_custkey", "n_rows", F.col("d_o_orderstatus").alias("d_status"), F.col("d_o_orderpriority").alias("d_priority"))


# ---- splits -------------------------------------------------------------------------------
RANDOM = """xs AS (SELECT o_orderkey, o_orderdate, o_custkey, o_totalprice, row_number() OVER (ORDER BY sha256('x1:' || o_orderkey::VARCHAR), o_orderkey) AS rn, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS tn, count(*) OVER () AS n FROM orders),
sp AS (SELECT *, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'calibration' ELSE 'test' END AS iid,
 CASE WHEN tn <= floor(n * 0.7) THEN 'train' WHEN tn <= floor(n * 0.85) THEN 'calibration' ELSE 'test' END AS temporal FROM xs)"""


def order_cases(spark, sf):
    return table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority"])


@query("x01_random_split", f"WITH {RANDOM} SELECT o_orderkey, iid AS split FROM sp")
def _(spark, sf):
    return X.random_split(order_cases(spark, sf), "o_orderkey", "x1:").select("o_orderkey", "split")


@query("x02_case_table", f"SELECT l_orderkey, epoch_us(min(l_shipdate)) AS first_us, min(l_linestatus) AS l_linestatus, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 2 ELSE 1 END AS n_strata FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_shipdate", "l_linestatus"])
    return X.case_table(li, "l_orderkey", "l_shipdate", "l_linestatus").select("l_orderkey", S.micros("decision_time").alias("first_us"), "l_linestatus", "n_strata")


@query("x03_temporal_split", f"WITH {RANDOM} SELECT o_orderkey, temporal AS split FROM sp")
def _(spark, sf):
    return X.temporal_split(order_cases(spark, sf), "o_orderkey", "o_orderdate").select("o_orderkey", "split")


HS = "CASE WHEN ('0x' || substr(sha256('{s}' || {k}::VARCHAR), 1, 12))::BIGINT / 281474976710656.0 < 0.7 THEN 'train' WHEN ('0x' || substr(sha256('{s}' || {k}::VARCHAR), 1, 12))::BIGINT / 281474976710656.0 < 0.85 THEN 'calibration' ELSE 'test' END"


@query("x04_exposure_split", f"""WITH b AS (SELECT o_orderkey, o_totalprice, {HS.format(s='o:', k='o_orderkey')} AS base, (SELECT quantile_cont(abs(o_totalprice), 0.99) FROM orders) AS q FROM orders)
SELECT o_orderkey, CASE WHEN abs(o_totalprice) > q THEN 'ood_test' WHEN base = 'test' THEN 'id_test' ELSE base END AS split FROM b""")
def _(spark, sf):
    o = order_cases(spark, sf)
    return o.select("o_orderkey", X.exposure_split(o, "o_totalprice", X.hash_split(F.col("o_orderkey"), "o:")).alias("split"))


def variants(spark, sf):
    """Lines as variants of their order, with the order's split attached."""
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"])
    return li.withColumns({"iid": X.hash_split(F.col("l_orderkey"), "o:"), "by_line": X.hash_split(F.col("l_linenumber"), "n:")})


VAR = f"va AS (SELECT l_orderkey, l_linenumber, l_returnflag, {HS.format(s='o:', k='l_orderkey')} AS iid, {HS.format(s='n:', k='l_linenumber')} AS by_line FROM lineitem)"


@query("x05_leakage_check", f"WITH {VAR} SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM va GROUP BY 1 HAVING count(DISTINCT iid) > 1)) AS leaking_iid, (SELECT count(*) FROM (SELECT l_orderkey FROM va GROUP BY 1 HAVING count(DISTINCT by_line) > 1)) AS leaking_by_line")
def _(spark, sf):
    v = variants(spark, sf)
    one = X.leaking_cases(v, "l_orderkey", "iid").agg(F.count("*").alias("leaking_iid"))
    return one.select("leaking_iid", X.leaking_cases(v, "l_orderkey", "by_line").agg(F.count("*")).scalar().alias("leaking_by_line"))


@query("x06_split_map", f"WITH {VAR} SELECT l_orderkey, min(iid) AS iid, min(by_line) AS by_line, ((count(DISTINCT iid) > 1)::INT + (count(DISTINCT by_line) > 1)::INT) AS conflicts FROM va GROUP BY 1")
def _(spark, sf):
    return X.split_map(variants(spark, sf), "l_orderkey", ["iid", "by_line"])


@query("x08_split_summary", f"WITH {VAR} SELECT iid, count(*) AS episodes, count(DISTINCT l_orderkey) AS cases, {rs('count(*) / sum(count(*)) OVER ()')} AS episode_share, {rs('count(DISTINCT l_orderkey) / sum(count(DISTINCT l_orderkey)) OVER ()')} AS case_share FROM va GROUP BY 1")
def _(spark, sf):
    return rounded(X.split_summary(variants(spark, sf), "l_orderkey", "iid"))


@query("x09_part_distribution", f"WITH {VAR} SELECT 'iid' AS regime, iid AS part, l_returnflag, count(*) AS n FROM va GROUP BY 2, 3 UNION ALL SELECT 'by_line', by_line, l_returnflag, count(*) FROM va GROUP BY 2, 3")
def _(spark, sf):
    return X.part_distribution(variants(spark, sf), ["iid", "by_line"], "l_returnflag")


@query("x10_cut_times", f"WITH {RANDOM} SELECT temporal AS split, epoch_us(min(o_orderdate)) AS first_us, epoch_us(max(o_orderdate)) AS last_us FROM sp GROUP BY 1")
def _(spark, sf):
    t = X.cut_times(X.temporal_split(order_cases(spark, sf), "o_orderkey", "o_orderdate"), "split", "o_orderdate")
    return t.select("split", S.micros("first_time").alias("first_us"), S.micros("last_time").alias("last_us"))


# 20 seeds.
SEEDS = ["20261004", *[str(s) for s in range(20261024, 20261043)]]


@query("x11_group_split_many_seeds", " UNION ALL ".join(f"SELECT '{s}' AS seed, {HS.format(s=s + ':', k='o_custkey')} AS part, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM orders GROUP BY 2" for s in SEEDS))
def _(spark, sf):
    g = order_cases(spark, sf).groupBy("o_custkey").agg(F.count("*").alias("k"))
    rows = F.array(*[F.struct(F.lit(s).alias("seed"), X.hash_split(F.col("o_custkey"), s + ":").alias("part")) for s in SEEDS])
    return g.select("k", F.inline(rows)).groupBy("seed", "part").agg(F.sum("k").alias("n"), F.count("*").alias("groups"))


@query("x12_calibration_half", f"{BASE} SELECT (('0x' || substr(sha256('20261004' || case_id), 1, 8))::BIGINT % 2)::INT AS half, count(*) AS n FROM epi WHERE part = 'calibration' GROUP BY 1")
def _(spark, sf):
    c = episodes(spark, sf).where(F.col("part") == "calibration")
    return c.groupBy(S.hash_half(F.col("case_id"), 20261004).alias("half")).agg(F.count("*").alias("n"))


@query("x13_group_overlap", f"""WITH {RANDOM}, g AS (SELECT o_custkey, count(*) FILTER (WHERE iid = 'test') AS t, count(*) FILTER (WHERE iid = 'train') AS r FROM sp GROUP BY 1)
SELECT sum(t)::BIGINT AS test_cases, sum(CASE WHEN r > 0 THEN t ELSE 0 END)::BIGINT AS test_cases_with_group_in_train, count(*) FILTER (WHERE t > 0) AS test_groups, count(*) FILTER (WHERE t > 0 AND r > 0) AS shared_groups FROM g""")
def _(spark, sf):
    return X.group_overlap(X.random_split(order_cases(spark, sf), "o_orderkey", "x1:"), "o_custkey", "split")


@query("x14_cohorts", f"""{BASE} SELECT regime, part, count(*) AS total, count(*) FILTER (WHERE known) AS resolved, count(*) FILTER (WHERE NOT known) AS ambiguous, count(*) FILTER (WHERE complete) AS complete,
 epoch_us(min(decision_time)) AS min_us, epoch_us(max(decision_time)) AS max_us FROM epi GROUP BY 1, 2""")
def _(spark, sf):
    c = X.cohort_table(episodes(spark, sf), ["regime", "part"])
    return c.select("regime", "part", "total", "resolved", "ambiguous", "complete", S.micros("decision_min").alias("min_us"), S.micros("decision_max").alias("max_us"))


@query("x15_v02_disjoint_parts", f"""WITH {RANDOM} SELECT 'cases' AS level, count(*) AS shared FROM (SELECT o_orderkey FROM sp WHERE iid = 'train' INTERSECT SELECT o_orderkey FROM sp WHERE iid = 'test') UNION ALL SELECT 'groups', count(*) FROM (SELECT o_custkey FROM sp WHERE iid = 'train' INTERSECT SELECT o_custkey FROM sp WHERE iid = 'test')""")
def _(spark, sf):
    s = X.random_split(order_cases(spark, sf), "o_orderkey", "x1:")
    tr, te = s.where("split = 'train'"), s.where("split = 'test'")
    shared = lambda k: tr.select(k).intersect(te.select(k)).agg(F.count("*").alias("shared"))
    return shared("o_orderkey").select(F.lit("cases").alias("level"), "shared").unionByName(shared("o_custkey").select(F.lit("groups").alias("level"), "shared"))


# ---- corrupted copies ---------------------------------------------------------------------
STRENGTHS = [0.05, 0.5]
N_ARM = 500
BSEED = "bench7:"
ARM_SQL = " UNION ALL ".join(
    f"SELECT *, '{a.key}' AS arm_key, '{a.name}' AS benchmark_arm, '{a.kind}' AS kind, {a.strength if a.strength is not None else 'NULL'}::DOUBLE AS s, '{a.expected}' AS expected, {str(a.synthetic).lower()} AS syn FROM vc WHERE coalesce({a.needs}, false)"
    for a in B.all_arms(STRENGTHS))
BM = f"""WITH {VC}, off AS ({ARM_SQL}),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm_key ORDER BY sha256('{BSEED}' || arm_key || ':' || case_id), case_id) AS rn FROM off) WHERE rn <= {N_ARM}),
fac AS (SELECT *, greatest(1.0 + (CASE WHEN ('0x' || substr(sha256('{BSEED}' || arm_key || ':' || case_id), 1, 8))::BIGINT % 2 = 0 THEN -1.0 ELSE 1.0 END) * s, 0.01) AS f FROM pick),
bm0 AS (SELECT case_id, arm_key, benchmark_arm, kind, s, expected, syn, po_value_initial_eur AS o_po, invoice_value_t0_eur AS o_inv, gr_available_at_t0 AS o_seen, latest_gr_value_before_t0_eur AS o_gr, inv_po_abs_rel_diff AS o_pg, inv_gr_abs_rel_diff AS o_gg,
 CASE WHEN kind IN ('MISSING_PO_VALUE', 'MULTI_FIELD_MISSING') THEN NULL WHEN kind = 'PO_VALUE_CONTRADICTION' THEN po_value_initial_eur * f ELSE po_value_initial_eur END AS po,
 CASE WHEN kind IN ('MISSING_INVOICE_VALUE', 'MULTI_FIELD_MISSING') THEN NULL WHEN kind = 'INVOICE_VALUE_CONTRADICTION' THEN invoice_value_t0_eur * f ELSE invoice_value_t0_eur END AS inv,
 CASE WHEN kind IN ('MISSING_GR', 'MULTI_FIELD_MISSING') THEN false ELSE gr_available_at_t0 END AS seen,
 CASE WHEN kind IN ('MISSING_GR', 'MULTI_FIELD_MISSING') THEN NULL ELSE latest_gr_value_before_t0_eur END AS gr FROM fac),
bm AS (SELECT *, CASE WHEN kind IN ('MISSING_PO_VALUE', 'MISSING_INVOICE_VALUE', 'MULTI_FIELD_MISSING') THEN NULL WHEN kind LIKE '%CONTRADICTION' THEN abs(inv - po) / nullif(abs(po), 0) ELSE o_pg END AS pg,
 CASE WHEN kind IN ('MISSING_GR', 'MISSING_INVOICE_VALUE', 'MULTI_FIELD_MISSING') THEN NULL WHEN kind = 'INVOICE_VALUE_CONTRADICTION' THEN abs(inv - gr) / nullif(abs(gr), 0) ELSE o_gg END AS gg FROM bm0)"""


def bench(spark, sf):
    return B.build(value_cases(spark, sf), "case_id", STRENGTHS, BSEED, N_ARM)


@query("b02_b08_benchmark_copies", f"""{BM} SELECT case_id, arm_key, benchmark_arm, kind AS intervention_type, s AS strength, expected AS expected_action_reference, syn AS synthetic_intervention, {rs('po')} AS po, {rs('inv')} AS inv, seen, {rs('gr')} AS gr,
 {rs('pg')} AS po_gap, {rs('gg')} AS gr_gap, o_po, o_inv, o_seen, o_gr FROM bm""")
def _(spark, sf):
    b = bench(spark, sf)
    return b.select("case_id", "arm_key", "benchmark_arm", "intervention_type", F.col("intervention_strength").alias("strength"), "expected_action_reference", "synthetic_intervention",
                    r(B.PO).alias("po"), r(B.INV).alias("inv"), F.col(B.SEEN).alias("seen"), r(B.GR).alias("gr"), r(B.PO_GAP).alias("po_gap"), r(B.GR_GAP).alias("gr_gap"),
                    F.col(f"original_{B.PO}").alias("o_po"), F.col(f"original_{B.INV}").alias("o_inv"), F.col(f"original_{B.SEEN}").alias("o_seen"), F.col(f"original_{B.GR}").alias("o_gr"))


@query("p34_modified_flags", f"""{BM} SELECT case_id, arm_key, (po IS DISTINCT FROM o_po) AS po_mod, (inv IS DISTINCT FROM o_inv) AS inv_mod,
 (seen IS DISTINCT FROM o_seen OR gr IS DISTINCT FROM o_gr OR (gr IS NULL AND o_gr IS NULL)) AS gr_mod FROM bm""")
def _(spark, sf):
    return bench(spark, sf).select("case_id", "arm_key", F.col("po_value_was_modified").alias("po_mod"), F.col("invoice_value_was_modified").alias("inv_mod"), F.col("gr_observation_was_modified").alias("gr_mod"))


@query("p36_w17_episode_ids", f"""{BM} SELECT case_id, arm_key, printf('EP_%09d', row_number() OVER (ORDER BY benchmark_arm, kind, s NULLS FIRST, case_id) - 1) AS benchmark_episode_id FROM bm""")
def _(spark, sf):
    return B.with_episode_ids(bench(spark, sf).select("case_id", "arm_key", "benchmark_arm", "intervention_type", "intervention_strength"), "case_id").select("case_id", "arm_key", "benchmark_episode_id")


@query("b09_benchmark_invariants", f"""{BM} SELECT 'unique' AS "check", sum(n)::BIGINT AS rows, count(*) FILTER (WHERE n > 1) AS violations, count(*)::DOUBLE AS measured FROM (SELECT case_id, arm_key, count(*) AS n FROM bm GROUP BY 1, 2)
 UNION ALL SELECT 'action_present' AS "check", count(*) AS rows, count(*) FILTER (WHERE expected IS NULL) AS violations, {rs('coalesce(sum(length(expected)), 0)::DOUBLE', 4)} AS measured FROM bm
 UNION ALL SELECT 'natural_not_synthetic' AS "check", count(*) AS rows, count(*) FILTER (WHERE benchmark_arm LIKE 'NATURAL%' AND syn) AS violations, {rs('coalesce(sum((benchmark_arm[1] = chr(78))::INT), 0)::DOUBLE', 4)} AS measured FROM bm
 UNION ALL SELECT 'controlled_synthetic' AS "check", count(*) AS rows, count(*) FILTER (WHERE benchmark_arm LIKE 'CONTROLLED%' AND NOT syn) AS violations, {rs('coalesce(sum(syn::INT), 0)::DOUBLE', 4)} AS measured FROM bm""")
def _(spark, sf):
    b = materialize(bench(spark, sf).select("case_id", "arm_key", "benchmark_arm", "synthetic_intervention", "expected_action_reference"))
    natural, syn, action = F.col("benchmark_arm").startswith("NATURAL"), F.col("synthetic_intervention"), F.col("expected_action_reference")
    return rounded(K.unique_rows(b, ["case_id", "arm_key"]).unionByName(K.check_rows(b, {
        "action_present": (action.isNotNull(), F.length(action)), "natural_not_synthetic": (~(natural & syn), natural.cast("int")), "controlled_synthetic": (natural | syn, syn.cast("int"))})), digits=4)


@query("a59_benchmark_composition", f"{BM} SELECT benchmark_arm, kind AS intervention_type, s AS intervention_strength, count(*) AS n, {rs('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM bm GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(P.counts_with_share(bench(spark, sf), ["benchmark_arm", "intervention_type", "intervention_strength"]), ["pct"])


KINDS = ["ORIGINAL", "NEGATIVE_PO_AGE", "COHERENT_VALUE_SUBSTITUTION"]
# A frozen scoring rule stands in for the fitted model here, so that SQL can score the corrupted rows too.
FROZEN = (1.5, -0.08, 0.012, -1.5)
ST = f"""{BASE}, sx AS (SELECT epi.* REPLACE (CASE WHEN corruption = 'NEGATIVE_PO_AGE' THEN -7.0 ELSE po_to_invoice_days END AS po_to_invoice_days, po_value_initial_eur * k AS po_value_initial_eur, invoice_value_t0_eur * k AS invoice_value_t0_eur), corruption
 FROM (SELECT *, CASE WHEN corruption LIKE 'COH%' THEN 10.0 ELSE 1.0 END AS k FROM (SELECT unnest({KINDS}) AS corruption)), epi WHERE NOT synthetic),
sy AS (SELECT *, {gate_sql('1.0')} AS g0, 1 / (1 + exp(-({FROZEN[0]} + {FROZEN[1]} * ln(1 + abs(po_value_initial_eur)) + {FROZEN[2]} * coalesce(po_to_invoice_days, 0) + {FROZEN[3]} * coalesce(inv_po_abs_rel_diff, 0)))) AS score FROM sx),
sz AS (SELECT 'all_natural' AS subset, * FROM sy UNION ALL SELECT 'gate_valid', * FROM sy WHERE g0 = 'VALID')"""


def frozen_score():
    a, b, c, d = FROZEN
    z = F.lit(a) + F.lit(b) * F.log1p(F.abs(B.PO)) + F.lit(c) * F.coalesce(F.col(B.AGE), F.lit(0.0)) + F.lit(d) * F.coalesce(F.col(B.PO_GAP), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


@query("b10_b12_stress_arms", f"""{ST} SELECT subset, corruption, count(*) AS cases, count(*) FILTER (WHERE g0 <> 'VALID') AS gate_blocked, count(*) FILTER (WHERE score >= 0.45) AS high_score, count(*) FILTER (WHERE score >= 0.45 AND g0 = 'VALID') AS selected,
 {rs('avg(score)', 5)} AS mean_score, {rs('sum(po_value_initial_eur) + 0.001', 0)} AS total_po FROM sz GROUP BY 1, 2""")
def _(spark, sf):
    s = B.stress_outcomes(episodes(spark, sf).where("not synthetic"), KINDS, frozen_score(), G.gate_state(1.0), 0.45)
    # the thousandth keeps sums of whole cents off the rounding edge, on both sides alike
    return rounded(rounded(s.withColumn("total_po", F.col("total_po") + 0.001), ["mean_score"], 5), ["total_po"], 0)


FIELDS = [B.PO, B.INV, B.SEEN, B.GR, B.PO_GAP, B.GR_GAP]
_pairs = list(zip(FIELDS, ["po", "inv", "seen", "gr", "pg", "gg"], ["o_po", "o_inv", "o_seen", "o_gr", "o_pg", "o_gg"]))
FP = "fp AS (" + " UNION ALL ".join(
    f"SELECT case_id, arm_key, kind, s, '{f}' AS field, {i} AS pos, " + (f"({a} IS DISTINCT FROM {b})" if f == B.SEEN else f"((({a} IS NULL) <> ({b} IS NULL)) OR coalesce(abs({a} - {b}) > 1e-9 + 1e-9 * abs({b}), false))")
    + f" AS changed, {'NULL' if f == B.SEEN else f'({a} - {b})'}::DOUBLE AS delta FROM bm WHERE syn" for i, (f, a, b) in enumerate(_pairs)) + ")"


def prints(spark, sf):
    base = value_cases(spark, sf)
    return B.footprint(B.build(base, "case_id", STRENGTHS, BSEED, N_ARM), base, "case_id", FIELDS)


@query("b14_a40_footprint_rates", f"{BM}, {FP} SELECT kind AS intervention_type, field, count(*) AS n, count(*) FILTER (WHERE changed) AS n_changed, {rs('avg(changed::INT)')} AS change_rate, {rs('avg(delta)', 3)} AS mean_delta FROM fp GROUP BY 1, 2")
def _(spark, sf):
    c = B.change_rates(prints(spark, sf))
    return rounded(rounded(c, ["change_rate"]), ["mean_delta"], 3)


@query("a41_changed_fields", f"""{BM}, {FP}, l AS (SELECT case_id, arm_key, kind, s, count(*) FILTER (WHERE changed) AS nc, coalesce(string_agg(field, '|' ORDER BY pos) FILTER (WHERE changed), 'NONE') AS cf FROM fp GROUP BY 1, 2, 3, 4)
SELECT kind AS intervention_type, s AS intervention_strength, nc::INT AS n_changed, cf AS changed_fields, count(*) AS n FROM l GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    c = B.changed_fields(prints(spark, sf), "case_id", FIELDS)
    return c.groupBy("intervention_type", "intervention_strength", "n_changed", "changed_fields").agg(F.count("*").alias("n"))


@query("w18_union_distinct_intersect", """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer)
 UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)""")
def _(spark, sf):
    o = table(spark, sf, "orders", ["o_custkey"]).select(F.col("o_custkey").alias("k"))
    c = table(spark, sf, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("k"))
    n = lambda d, op: d.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(o.unionByName(c), "union").unionByName(n(o.dropDuplicates(["k"]), "distinct")).unionByName(n(o.intersect(c), "intersect"))


@query("w15_ordered_sample", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(spark, sf):
    return order_cases(spark, sf).orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("p42_exposure_bins", f"""{BASE}, q AS (SELECT regime, quantile_cont(transaction_exposure_eur, 0.5) AS a, quantile_cont(transaction_exposure_eur, 0.9) AS b, quantile_cont(transaction_exposure_eur, 0.99) AS c FROM epi GROUP BY 1)
SELECT regime, CASE WHEN transaction_exposure_eur <= a THEN 'Q1' WHEN transaction_exposure_eur <= b THEN 'Q2' WHEN transaction_exposure_eur <= c THEN 'Q3' ELSE 'Q4' END AS bin, count(*) AS n FROM epi JOIN q USING (regime) GROUP BY 1, 2""")
def _(spark, sf):
    d = episodes(spark, sf).select("regime", "transaction_exposure_eur")
    return P.quantile_bins(d, "transaction_exposure_eur", ["regime"], [0.5, 0.9, 0.99]).groupBy("regime", "bin").agg(F.count("*").alias("n"))


@query("a24_train_references", f"""WITH {VC}, u AS (SELECT DISTINCT group_id, first_value(transaction_exposure_eur) OVER (PARTITION BY group_id ORDER BY o_orderkey) AS v, {HS.format(s='t:', k='group_id')} AS part FROM vc)
SELECT count(*) AS train_cases, {rs('quantile_cont(v, 0.5)')} AS p50, {rs('quantile_cont(v, 0.9)')} AS p90, {rs('quantile_cont(v, 0.99)')} AS p99 FROM u WHERE part = 'train'""")
def _(spark, sf):
    d = value_cases(spark, sf).select("group_id", "o_orderkey", "transaction_exposure_eur", X.hash_split(F.col("group_id"), "t:").alias("part"))
    return rounded(P.train_references(d, "group_id", "o_orderkey", "transaction_exposure_eur"))
