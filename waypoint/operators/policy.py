"""Decision tables, ablations and parameter sweeps."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy as D
from ..functions.scalars import is_true, steps_reached, upper_text
from ..session import ship_package
from .metrics import RATES, TERMS, ratios, row_terms


ACTIONS = [D.EXECUTE, D.GATHER, D.ESCALATE, D.ABSTAIN]


def with_consequence(df: DataFrame, refs: Column, modes: list[str], value: str = "transaction_exposure_eur") -> DataFrame:
    """One copy of each row per consequence mode with its C(v)."""
    rows = df.withColumn("_refs", refs).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return rows.withColumn("c", D.mode_consequence(F.col("mode"), F.col(value), F.col("_refs"))).drop("_refs")


def with_actions(df: DataFrame, p: D.Params) -> DataFrame:
    """The eight compared policies as ``action__<POLICY>`` columns.

    Shared losses are columns of their own, so each is computed once per row.
    """
    pe, ps, p1, c = F.col("p_cal_execute"), F.col("p_safe_t0_cal"), F.col("p_safe_t1_primary"), F.col("c")
    inf = F.lit(D.INF)
    only = lambda cost, ok: F.when(ok, F.col(cost)).otherwise(inf)
    state = upper_text("gate")
    d = df.withColumns({
        "_valid": state == "VALID", "_clear": state != "CONTRADICTORY", "_ok": is_true(F.col("gather_policy_eligible")),
        "_h": D.escalate_loss(c, p), "_a": D.lit(p.c_a), "_es": (1 - ps) * c, "_em": (1 - pe) * c, "_p": (1 - p1) * c,
    })
    d = d.withColumns({
        "_es": only("_es", is_true((ps >= D.lit(p.tau0)) & (F.col("_es") <= D.lit(p.beta0)))),
        "_em": only("_em", is_true((pe >= D.lit(p.tau0)) & (F.col("_em") <= D.lit(p.beta0)))),
        "_g": D.lit(p.c_g) + F.least(only("_p", is_true((p1 >= D.lit(p.tau1)) & (F.col("_p") <= D.lit(p.beta1)))), F.col("_h"), F.col("_a")),
    })
    d = d.withColumn("_g", only("_g", F.col("_ok")))
    d = d.withColumns({"_esg": only("_es", F.col("_valid")), "_emg": only("_em", F.col("_valid")), "_gg": only("_g", F.col("_clear")), "_none": inf})

    def least(e: str, g: str) -> Column:
        return D.least_loss([(D.EXECUTE, F.col(e)), (D.GATHER, F.col(g)), (D.ESCALATE, F.col("_h")), (D.ABSTAIN, F.col("_a"))])[0]

    actions = {
        "ARGMAX_V1": upper_text("predicted_action"),
        "CONFIDENCE_THRESHOLD_V1": D.confidence_rule(pe),
        "VOI_BLIND_V1": D.blind_gather(pe, p1, p, F.col("_ok")),
        "V1_FULL": least("_em", "_g"),
        "V2_SAFETY_NO_GATE": least("_es", "_g"),
        "V2_GATE_MULTICLASS_EXECUTE": least("_emg", "_gg"),
        "V2_NO_GATHER": least("_esg", "_none"),
        "V2_FULL": least("_esg", "_gg"),
    }
    return d.select(*df.columns, *[a.alias(f"action__{n}") for n, a in actions.items()])


def decisions_long(df: DataFrame, p: D.Params, keep: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), F.col(f"action__{n}").alias("action")) for n in D.POLICIES])
    return with_actions(df, p).select(*keep, F.inline(rows))


def convention_means(df: DataFrame, p: D.Params, by: list[str]) -> DataFrame:
    """Mean loss of every policy under the three conventions, and its cases of unknown end-to-end loss.

    ``df`` has the ``action__<POLICY>`` columns. What a row costs depends on its action only,
    so losses are summed once per action and kind of row (the list of its actions); only
    kinds meet the policies. Known losses are counted beside their sums.
    """
    u, c, label = F.col("unsafe"), F.col("c"), F.col("y_t1")
    acts = [f"action__{n}" for n in D.POLICIES]
    # the continuation is a column of its own: worked out once per row
    rows = df.withColumn("_after", D.continuation(F.col("p_safe_t1_primary"), c, p)[0])
    costs = {}
    for i, name in enumerate(ACTIONS):
        a = F.lit(name)
        costs |= {f"a{i}": D.loss_a(a, u, c, p), f"b{i}": D.loss_b(a, u, c, p), f"c{i}": D.loss_c(a, u, F.col("_after"), label, c, p)}
    rows = rows.select(*by, *acts, *[x.alias(n) for n, x in costs.items()])
    kinds = rows.groupBy(*by, *acts).agg(F.count("*").alias("n"), *[F.sum(n).alias(f"s_{n}") for n in costs], *[F.count(n).alias(f"k_{n}") for n in costs])

    def of(action: Column, what: str) -> Column:
        out = F.lit(None)
        for i, name in enumerate(ACTIONS):
            out = F.when(action == name, F.col(f"{what}{i}")).otherwise(out)
        return out

    names = [f"{w}_{x}" for x in "abc" for w in "sk"]
    long = F.array(*[F.struct(F.lit(n).alias("policy"), *[of(F.col(f"action__{n}"), x).alias(x) for x in names]) for n in D.POLICIES])
    sums = kinds.select(*by, "n", F.inline(long)).groupBy("policy", *by).agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])
    return sums.select("policy", *by, *[F.try_divide(F.col(f"s_{x}"), F.col(f"k_{x}").cast("double")).alias(f"loss_{x}") for x in "abc"], (F.col("n") - F.coalesce("k_c", F.lit(0))).alias("unknown"))


def ablation_deltas(metrics: DataFrame, keys: list[str], pairs: list[tuple[str, str, str]], rates: list[str] = RATES) -> DataFrame:
    """Left minus right for each policy pair and metric; the input has one row per (keys, policy)."""
    wide = metrics.groupBy(*keys).agg(*[
        F.max(F.when(F.col("policy") == p, F.struct(*rates))).alias(p) for p in sorted({x for a, b, _ in pairs for x in (a, b)})])
    rows = F.array(*[F.struct(F.lit(label).alias("comparison"), F.lit(m).alias("metric"), F.col(a)[m].alias("left"),
                              F.col(b)[m].alias("right"), (F.col(a)[m] - F.col(b)[m]).alias("delta")) for a, b, label in pairs for m in rates])
    return wide.select(*keys, F.inline(rows))


def frontier(df: DataFrame, by: list[str], p: D.Params, tau0: list[float], beta0: list[float], tau1: list[float], beta1: list[float]) -> DataFrame:
    """Metrics of the gated policy at every grid point.

    Whether a row may execute now and whether it may execute after evidence are
    the only facts a grid point changes. Each row therefore yields at most four
    decisions, and its place between the grid values is a small key. The grid
    only meets the table of keys, whose size does not depend on the data.
    """
    t0, b0, t1, b1 = sorted(tau0), sorted(beta0), sorted(tau1), sorted(beta1)
    ps, p1, c = F.col("p_safe_t0_cal"), F.col("p_safe_t1_primary"), F.col("c")
    above = lambda x, edges: reduce(lambda a, b: a + b, [is_true(x > F.lit(e)).cast("int") for e in edges])
    valid = F.upper(F.trim("gate")) == "VALID"
    rows = df.withColumns({
        "i0": F.when(is_true(valid), steps_reached(ps, t0)).otherwise(0), "j0": above((1 - ps) * c, b0),
        "i1": steps_reached(p1, t1), "j1": F.when(p1.isNull(), len(b1)).otherwise(above((1 - p1) * c, b1)),
    })
    can0 = (F.col("i0") > 0) & (F.col("j0") < len(b0))
    can1 = (F.col("i1") > 0) & (F.col("j1") < len(b1))
    flag = lambda a, b: F.struct(F.lit(a).alias("f0"), F.lit(b).alias("f1"))
    combos = F.filter(F.array(flag(False, False), F.when(can0, flag(True, False)), F.when(can1, flag(False, True)), F.when(can0 & can1, flag(True, True))), lambda x: x.isNotNull())
    rows = rows.select("*", F.inline(combos))
    action, _ = D.decide(ps, p1, c, p, is_true(F.col("gather_policy_eligible")), F.col("gate"), can_execute=F.col("f0"), can_continue=F.col("f1"))
    rows = rows.withColumn("_a", action)
    a = F.col("_a")
    terms = row_terms(a, F.col("unsafe"), F.col("transaction_exposure_eur"), c, D.loss_a(a, F.col("unsafe"), c, p))
    key = [*by, "i0", "j0", "i1", "j1", "f0", "f1"]
    cells = rows.select(*key, *[x.alias(n) for n, x in terms.items()]).groupBy(*key).agg(*[F.sum(n).alias(n) for n in TERMS])
    points = cells.withColumn("a0", F.explode(F.lit(list(range(1, len(t0) + 1))))).withColumn("a1", F.explode(F.lit(list(range(1, len(b0) + 1)))))
    points = points.where(((F.col("a0") <= F.col("i0")) & (F.col("a1") > F.col("j0"))) == F.col("f0"))
    points = points.withColumn("a2", F.explode(F.lit(list(range(1, len(t1) + 1))))).withColumn("a3", F.explode(F.lit(list(range(1, len(b1) + 1)))))
    points = points.where(((F.col("a2") <= F.col("i1")) & (F.col("a3") > F.col("j1"))) == F.col("f1"))
    pick = lambda values, i: F.element_at(F.lit(values), F.col(i))
    sums = points.groupBy(*by, "a0", "a1", "a2", "a3").agg(*[F.sum(n).alias(n) for n in TERMS])
    return sums.select(*by, pick(t0, "a0").alias("tau0"), pick(b0, "a1").alias("beta0"), pick(t1, "a2").alias("tau1"), pick(b1, "a3").alias("beta1"), *ratios())


def _front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops dominated rows of a stream sorted by group, falling coverage, rising risk and loss.

    An earlier row has no less coverage, so a row is dominated if the earlier ones
    have a (risk, loss) at or below its own. Only those that no other is at or
    below are held, with rising risk and falling loss, and found by bisection.
    """
    group, risks, losses, last, verdict = None, [], [], None, True
    for batch in batches:
        keep = []
        for g, cov, risk, loss in zip(*(batch.column(n).to_pylist() for n in ("_g", "_cov", "_risk", "_loss")), strict=True):
            if g != group:
                group, risks, losses, last = g, [], [], None
            if cov is None or loss is None:
                keep.append(True)
                continue
            if (cov, risk, loss) == last:  # equal rows do not dominate each other
                keep.append(verdict)
                continue
            at = bisect_right(risks, risk)
            verdict, last = not (at and losses[at - 1] <= loss), (cov, risk, loss)
            if verdict:
                at = bisect_left(risks, risk)
                end = at
                while end < len(losses) and losses[end] >= loss:
                    end += 1
                risks[at:end], losses[at:end] = [risk], [loss]
            keep.append(verdict)
        yield batch.filter(pa.array(keep, pa.bool_()))


def pareto(points: DataFrame, by: list[str]) -> DataFrame:
    """Points no other point of the same group beats on coverage, risk and loss.

    Every task first drops what its own points dominate; what is left is sorted
    per group and swept once, so no pair of points is formed.
    """
    ship_package(points.sparkSession)
    group = F.concat_ws("\u0001", *[F.coalesce(F.col(b).cast("string"), F.lit("\u0002")) for b in by]) if by else F.lit("")
    marked = points.withColumns({
        "_g": group, "_cov": F.col("autonomous_execution_coverage").cast("double"),
        "_risk": F.coalesce(F.col("unsafe_execution_rate").cast("double"), F.lit(0.0)), "_loss": F.col("mean_realized_normalized_loss").cast("double"),
    })
    order = [F.col("_g"), F.col("_cov").desc_nulls_last(), F.col("_risk"), F.col("_loss")]
    own = marked.sortWithinPartitions(*order).mapInArrow(_front, marked.schema)
    return own.repartition("_g").sortWithinPartitions(*order).mapInArrow(_front, marked.schema).drop("_g", "_cov", "_risk", "_loss")


def best_at_caps(points: DataFrame, by: list[str], caps: list[float]) -> DataFrame:
    """Best feasible point per risk cap in a fixed ten-key order; no execution counts as feasible."""
    from .ranking import best_row

    rows = points.withColumn("risk_cap", F.explode(F.array(*[F.lit(x) for x in caps])))
    rows = rows.where((F.col("execute_count") == 0) | is_true(F.col("unsafe_execution_rate") <= F.col("risk_cap")))
    order = [
        F.col("autonomous_execution_coverage").desc_nulls_last(), F.col("mean_realized_normalized_loss").asc_nulls_last(),
        F.col("consequence_weighted_unsafe_rate").asc_nulls_last(), F.col("raw_exposure_weighted_unsafe_rate").asc_nulls_last(),
        F.col("human_escalation_rate").asc_nulls_last(), F.col("gather_rate").asc_nulls_last(),
        F.col("tau0").desc(), F.col("beta0").asc(), F.col("tau1").desc(), F.col("beta1").asc(),
    ]
    return best_row(rows, [*by, "risk_cap"], order)


def best_mode(best: DataFrame) -> DataFrame:
    from .ranking import best_row

    order = [F.col("autonomous_execution_coverage").desc(), F.col("mean_realized_normalized_loss").asc_nulls_last(), F.col("unsafe_execution_rate").asc_nulls_last(), F.col("mode")]
    return best_row(best, ["regime", "risk_cap"], order)
