"""The first-generation policies, scored end to end, and their sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy as D
from ..functions.scalars import SAFE, is_true, upper_text
from ..sources.spec import cost_points
from . import envelope
from .ordered import count_if


def _unsafe(primary: Column, final: Column) -> Column:
    direct = (primary == "EXECUTE") & (upper_text("expected_action_reference") != "EXECUTE")
    later = (primary == "GATHER") & ~is_true(F.col("y_t1") == SAFE)
    return (final == "EXECUTE") & (direct | later)


def evaluate(df: DataFrame, names: list[str], p: D.Params, by: list[str]) -> DataFrame:
    pe, p1, c, ok = F.col("p_cal_execute"), F.col("p_safe_t1_primary"), F.col("c"), is_true(F.col("gather_policy_eligible"))
    rows = []
    for n in names:
        if n == "ARGMAX":
            mean_h = df.agg(F.avg(D.escalate_loss(c, p))).scalar()
            primary, final, loss = D.argmax_policy(F.col("predicted_action"), mean_h, c, pe, p)
        else:
            primary, final, loss = D.first_policy(n, pe, p1, c, p, ok)
        rows.append(F.struct(F.lit(n).alias("policy"), primary.alias("pa"), final.alias("fa"), loss.alias("expected_loss")))
    long = df.select("c", "expected_action_reference", "y_t1", *[b for b in by if b != "policy"], F.inline(F.array(*rows)))
    pa, fa = F.col("pa"), F.col("fa")
    bad, ex = _unsafe(pa, fa), fa == "EXECUTE"
    rate = lambda x: F.avg(is_true(x).cast("int"))
    return long.groupBy(*by).agg(
        F.count("*").alias("episodes"), count_if(ex).alias("executed"), count_if(bad).alias("unsafe"), rate(ex).alias("coverage"),
        F.try_divide(count_if(bad).cast("double"), count_if(ex).cast("double")).alias("unsafe_rate"),
        F.avg(D.loss_v1(pa, fa, F.col("expected_action_reference"), F.col("y_t1"), c, p)).alias("mean_loss"),
        rate(pa == "GATHER").alias("gather_rate"), rate(fa == "ESCALATE").alias("escalation_rate"), rate((pa == "GATHER") & ex).alias("post_gather_execute_rate"))


def budget_sweep(df: DataFrame, budgets: list[float], p: D.Params) -> DataFrame:
    """No-gather policy over risk budgets: a row flips once, at its own expected loss."""
    from .ordered import at_thresholds

    pe, c = F.col("p_cal_execute"), F.col("c")
    l_e = (1 - pe) * c
    other, other_loss = D.least_loss([("ESCALATE", D.escalate_loss(c, p)), ("ABSTAIN", D.lit(p.c_a))])
    wins = l_e <= other_loss
    bad = (upper_text("expected_action_reference") != "EXECUTE").cast("double")
    # l_e <= beta is "-l_e >= -beta", so the shared threshold table applies
    d = df.select((-l_e).alias("s"), wins.cast("bigint").alias("ex"), (wins.cast("double") * bad).cast("bigint").alias("uns"),
                  F.when(wins, bad * c - other_loss).otherwise(0.0).alias("gain"), other_loss.alias("base"))
    t = at_thresholds(d, F.col("s"), [-b for b in budgets], {"ex": F.col("ex"), "uns": F.col("uns"), "gain": F.col("gain"), "base": F.col("base"), "one": F.lit(1)})
    return t.select((-F.col("threshold")).alias("beta0"), F.col("ex").alias("executed"), F.col("uns").alias("unsafe"),
                    ((F.col("all_base") + F.col("gain")) / F.col("all_one")).alias("mean_loss"))


def confidence_sweep(df: DataFrame, taus: list[float], p: D.Params) -> DataFrame:
    """Confidence policy over thresholds: execute at or above, else escalate."""
    from .ordered import at_thresholds

    c, other = F.col("c"), D.escalate_loss(F.col("c"), p)
    bad = (upper_text("expected_action_reference") != "EXECUTE").cast("bigint")
    d = df.select(F.col("p_cal_execute").alias("s"), bad.alias("uns"), (bad * c - other).alias("gain"), other.alias("base"))
    t = at_thresholds(d, F.col("s"), taus, {"ex": F.lit(1), "uns": F.col("uns"), "gain": F.col("gain"), "base": F.col("base")})
    return t.select("threshold", F.col("ex").alias("executed"), F.col("uns").alias("unsafe"), (F.col("ex") / F.col("all_ex")).alias("coverage"),
                    F.try_divide(F.col("uns").cast("double"), F.col("ex").cast("double")).alias("unsafe_rate"), ((F.col("all_base") + F.col("gain")) / F.col("all_ex")).alias("mean_loss"))


def cost_grid(df: DataFrame, c_g: list[float], c_h: list[float], c_a: list[float], p: D.Params) -> DataFrame:
    """Action counts of the full policy at every cost point with c_G < c_H < c_A."""
    points = [{"c_g": float(g), "c_h": float(h), "c_a": float(a)} for g, h, a in cost_points(c_g, c_h, c_a)]
    cells = envelope.kinds(df, [envelope.letter(_full(p.but(**x))[0]) for x in points], {})
    n = envelope.count_of
    return envelope.on_grid(cells, points).groupBy("c_g", "c_h", "c_a").agg(
        n("E").alias("executed"), n("G").alias("gathered"), n("H").alias("escalated"), n("A").alias("abstained"))


def _full(p: D.Params) -> tuple[Column, Column, Column]:
    return D.first_policy("FULL", F.col("p_cal_execute"), F.col("p_safe_t1_primary"), F.col("c"), p, is_true(F.col("gather_policy_eligible")))


def post_gate_sweep(df: DataFrame, taus: list[float], betas: list[float], p: D.Params) -> DataFrame:
    """The full policy at every threshold and budget of the gate after evidence: what is executed, gathered and executed after gathering."""
    points = [{"tau1": float(t), "beta1": float(b)} for t in taus for b in betas]
    fits = [_full(p.but(**x)) for x in points]
    cells = envelope.kinds(df, [envelope.letter(first, final) for first, final, _ in fits], {})
    n = envelope.count_of
    return envelope.on_grid(cells, points).groupBy("tau1", "beta1").agg(
        n("E", "e").alias("executed"), n("e", "h", "a").alias("gathered"), n("e").alias("post_gather_executed"),
        (n("e") / F.sum("n")).alias("post_gather_execute_rate"), n("h").alias("post_gather_escalated"), n("a").alias("post_gather_abstained"))
