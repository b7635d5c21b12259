"""Least-loss decisions and realised losses as column expressions.

Parameters may be numbers or columns, so the same builder serves one reference
point and a grid.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import AMBIGUOUS, SAFE, UNSAFE, consequence, is_true, upper_text

INF = float("inf")
EXECUTE, GATHER, ESCALATE, ABSTAIN = "EXECUTE", "GATHER", "ESCALATE", "ABSTAIN"
# Fixed values.
MODES = ["UNIFORM", "LOG_TRAIN_P50", "LOG_TRAIN_P90", "LOG_TRAIN_P99"]
POLICIES = [
    "ARGMAX_V1", "CONFIDENCE_THRESHOLD_V1", "VOI_BLIND_V1", "V1_FULL",
    "V2_SAFETY_NO_GATE", "V2_GATE_MULTICLASS_EXECUTE", "V2_NO_GATHER", "V2_FULL",
]
ABLATIONS = [
    ("V2_FULL", "V2_NO_GATHER", "GATHER_CONTRIBUTION"),
    ("V2_FULL", "V2_SAFETY_NO_GATE", "EVIDENCE_GATE_CONTRIBUTION"),
    ("V2_FULL", "V2_GATE_MULTICLASS_EXECUTE", "DEDICATED_SAFETY_BELIEF_CONTRIBUTION"),
    ("V2_FULL", "VOI_BLIND_V1", "CONSEQUENCE_AWARE_VS_VOI_BLIND"),
    ("V2_FULL", "V1_FULL", "V2_VS_V1"),
]


@dataclass(frozen=True)
class Params:
    """Costs, score thresholds and risk budgets; the defaults are the reference point."""

    c_g: Column | float = 0.02
    c_h: Column | float = 0.10
    c_a: Column | float = 0.50
    rho_h: Column | float = 0.0
    tau0: Column | float = 0.95
    beta0: Column | float = 0.05
    tau1: Column | float = 0.95
    beta1: Column | float = 0.05

    def but(self, **changes) -> Params:
        return replace(self, **changes)


def lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def mode_consequence(mode: Column, value: Column, refs: Column) -> Column:
    """C(v) for a mode column; refs holds train-only p50, p90 and p99."""
    return (
        F.when(mode == "UNIFORM", F.lit(1.0))
        .when(mode == "LOG_TRAIN_P50", consequence(value, refs["p50"]))
        .when(mode == "LOG_TRAIN_P90", consequence(value, refs["p90"]))
        .when(mode == "LOG_TRAIN_P99", consequence(value, refs["p99"]))
    )


def feasible(loss: Column, ok: Column) -> Column:
    return F.when(is_true(ok), loss).otherwise(F.lit(INF))


def least_loss(options: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(action, loss) of the smallest loss; earlier options win ties, missing losses lose."""
    costs = [F.coalesce(c, F.lit(INF)) for _, c in options]
    best = F.least(*costs)
    action = F.when(costs[0] == best, options[0][0])
    for (name, _), cost in zip(options[1:], costs[1:]):
        action = action.when(cost == best, name)
    return action, best


def escalate_loss(c: Column, p: Params) -> Column:
    return lit(p.c_h) + lit(p.rho_h) * c


def may_execute(score: Column, c: Column, tau: Column | float, beta: Column | float) -> Column:
    return is_true((score >= lit(tau)) & ((1 - score) * c <= lit(beta)))


def continuation(p1: Column, c: Column, p: Params, allowed: Column | None = None) -> tuple[Column, Column]:
    """Action and expected loss after the evidence arrived."""
    ok = may_execute(p1, c, p.tau1, p.beta1) if allowed is None else allowed
    return least_loss([
        (EXECUTE, feasible((1 - p1) * c, ok)), (ESCALATE, escalate_loss(c, p)), (ABSTAIN, lit(p.c_a)),
    ])


def decide(
    p0: Column, p1: Column, c: Column, p: Params, eligible: Column, gate: Column | None = None, allow_gather: bool = True,
    can_execute: Column | None = None, can_continue: Column | None = None,
) -> tuple[Column, Column]:
    """EXECUTE, GATHER, ESCALATE or ABSTAIN by least expected loss, in that tie order.

    With a gate, only VALID cases may execute and CONTRADICTORY ones may not gather.
    """
    ok = may_execute(p0, c, p.tau0, p.beta0) if can_execute is None else can_execute
    gather_ok = eligible if allow_gather else F.lit(False)
    if gate is not None:
        state = upper_text(gate)
        ok, gather_ok = ok & (state == "VALID"), gather_ok & (state != "CONTRADICTORY")
    _, after = continuation(p1, c, p, can_continue)
    return least_loss([
        (EXECUTE, feasible((1 - p0) * c, ok)), (GATHER, feasible(lit(p.c_g) + after, gather_ok)),
        (ESCALATE, escalate_loss(c, p)), (ABSTAIN, lit(p.c_a)),
    ])


def confidence_rule(score: Column, threshold: float = 0.5) -> Column:
    return F.when(is_true(score >= threshold), EXECUTE).otherwise(ESCALATE)


def blind_gather(p0: Column, p1: Column, p: Params, eligible: Column) -> Column:
    """One-step value of information with every consequence set to one and no feasibility test."""
    after = F.least(1 - p1, lit(p.c_h), lit(p.c_a))
    return least_loss([
        (EXECUTE, 1 - p0), (GATHER, feasible(lit(p.c_g) + after, eligible)), (ESCALATE, lit(p.c_h)), (ABSTAIN, lit(p.c_a)),
    ])[0]


def first_policy(name: str, pe: Column, p1: Column, c: Column, p: Params, eligible: Column) -> tuple[Column, Column, Column]:
    """First-generation policies: (primary action, final action, expected loss).

    Tie order here is EXECUTE, ESCALATE, ABSTAIN, GATHER; execution needs only
    the risk budget.
    """
    l_e, l_h, l_a = (1 - pe) * c, escalate_loss(c, p), lit(p.c_a)
    if name == "CONFIDENCE_THRESHOLD":
        a = confidence_rule(pe, p.tau0)
        return a, a, F.when(a == EXECUTE, l_e).otherwise(l_h)
    if name == "COST_AWARE_BLIND":
        a, loss = least_loss([(EXECUTE, l_e), (ESCALATE, l_h), (ABSTAIN, l_a)])
        return a, a, loss
    direct = [(EXECUTE, feasible(l_e, l_e <= lit(p.beta0))), (ESCALATE, l_h), (ABSTAIN, l_a)]
    if name == "NO_GATHER":
        a, loss = least_loss(direct)
        return a, a, loss
    if name in ("VOI_BLIND", "FULL"):
        after, after_loss = continuation(p1, c, p)
        a, loss = least_loss([*direct, (GATHER, feasible(lit(p.c_g) + after_loss, eligible))])
        return a, F.when(a == GATHER, after).otherwise(a), loss
    raise ValueError(f"unknown policy {name}")


def argmax_policy(predicted: Column, mean_escalate: Column, c: Column, pe: Column, p: Params) -> tuple[Column, Column, Column]:
    """Predicted class as is; gathered rows fall back to the cheaper of mean escalation and abstention."""
    primary = upper_text(predicted)
    fallback = F.when(mean_escalate <= lit(p.c_a), ESCALATE).otherwise(ABSTAIN)
    final = F.when(primary == GATHER, fallback).otherwise(primary)
    tail = F.when(final == ESCALATE, escalate_loss(c, p)).otherwise(lit(p.c_a))
    loss = F.when(primary == EXECUTE, (1 - pe) * c).when(primary == GATHER, lit(p.c_g) + tail).otherwise(tail)
    return primary, final, loss


# ---- realised losses ----------------------------------------------------------------------
def loss_a(action: Column, unsafe: Column, c: Column, p: Params) -> Column:
    """Convention A: GATHER costs c_G and ESCALATE costs c_H."""
    return (
        F.when(action == EXECUTE, unsafe.cast("double") * c).when(action == GATHER, lit(p.c_g))
        .when(action == ESCALATE, lit(p.c_h)).when(action == ABSTAIN, lit(p.c_a))
    )


def loss_b(action: Column, unsafe: Column, c: Column, p: Params) -> Column:
    """Convention B: as A, with the residual risk of escalation added."""
    return F.when(action == ESCALATE, escalate_loss(c, p)).otherwise(loss_a(action, unsafe, c, p))


def continuation_loss(after: Column, t1_label: Column, c: Column, p: Params) -> Column:
    """Realised loss after evidence; execution with an unresolved label stays NULL."""
    return (
        F.when((after == EXECUTE) & (t1_label == UNSAFE), c).when((after == EXECUTE) & (t1_label == SAFE), F.lit(0.0))
        .when(after == ESCALATE, escalate_loss(c, p)).when(after == ABSTAIN, lit(p.c_a))
    )


def loss_c(action: Column, unsafe: Column, after: Column, t1_label: Column, c: Column, p: Params) -> Column:
    """Convention C: end to end, gather cost plus the realised continuation."""
    return F.when(action == GATHER, lit(p.c_g) + continuation_loss(after, t1_label, c, p)).otherwise(loss_b(action, unsafe, c, p))


def loss_v1(primary: Column, final: Column, reference: Column, t1_label: Column, c: Column, p: Params) -> Column:
    """First-generation convention: after evidence anything not SAFE is unsafe; never NULL."""
    direct_bad = (upper_text(reference) != EXECUTE).cast("double")
    later_bad = (~is_true(t1_label == SAFE)).cast("double")
    tail = (
        F.when(final == EXECUTE, later_bad * c).when(final == ESCALATE, escalate_loss(c, p))
        .when(final == ABSTAIN, lit(p.c_a)).otherwise(F.lit(0.0))
    )
    return (
        F.when(primary == EXECUTE, direct_bad * c).when(primary == ESCALATE, escalate_loss(c, p))
        .when(primary == ABSTAIN, lit(p.c_a)).otherwise(lit(p.c_g) + tail)
    )


def short_rule(gate_ok: Column, score: Column, c: Column, tau: Column | float, beta: Column | float, c_h: Column | float = 0.1) -> Column:
    return is_true(gate_ok & (score >= lit(tau)) & ((1 - score) * c <= F.least(lit(beta), lit(c_h))))


def fixed_rules(score: Column, c: Column, tau: float = 0.95, beta: float = 0.05, c_h: float = 0.1) -> dict[str, Column]:
    """Seven fixed selection rules over complete, gate and score."""
    g, high = F.col("gate") == "VALID", is_true(score >= tau)
    return {
        "Evidence complete": is_true(F.col("complete")),
        "Gate only": is_true(g),
        "Safety": high,
        "Gate safety": is_true(g) & high,
        "Reference": short_rule(g, score, c, tau, beta, c_h),
        "Plug-in cost": short_rule(g, score, c, 0.0, c_h, c_h),
        "Escalate all": F.lit(False),
    }
