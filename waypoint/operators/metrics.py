"""Policy metrics as sums first and ratios last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import ABSTAIN, ESCALATE, EXECUTE, GATHER
from ..functions.scalars import is_true
from .ordered import count_if

RATES = [
    "autonomous_execution_coverage", "unsafe_execution_rate", "raw_exposure_weighted_unsafe_rate",
    "consequence_weighted_unsafe_rate", "mean_realized_normalized_loss", "human_escalation_rate", "gather_rate", "abstention_rate",
]


def row_terms(action: Column, unsafe: Column, value: Column, c: Column, loss: Column) -> dict[str, Column]:
    """The additive terms of one decision; every metric is a ratio of their sums."""
    ex = is_true(action == EXECUTE)
    bad = ex & is_true(unsafe)
    v = F.coalesce(F.abs(value), F.lit(0.0))
    one = lambda cond: cond.cast("bigint")
    zero = F.lit(0.0)
    return {
        "n": F.lit(1).cast("bigint"), "executed": one(ex), "unsafe_executed": one(bad),
        "value_executed": F.when(ex, v).otherwise(zero), "value_unsafe": F.when(bad, v).otherwise(zero),
        "c_executed": F.when(ex, c).otherwise(zero), "c_unsafe": F.when(bad, c).otherwise(zero),
        "loss": loss, "loss_known": one(loss.isNotNull()),
        "escalated": one(is_true(action == ESCALATE)), "gathered": one(is_true(action == GATHER)), "abstained": one(is_true(action == ABSTAIN)),
    }


def ratios(prefix: str = "") -> list[Column]:
    s = lambda n: F.col(f"{prefix}{n}")
    div = lambda a, b: F.try_divide(s(a).cast("double"), s(b).cast("double"))
    return [
        s("n").alias("episodes"), s("executed").alias("execute_count"), div("executed", "n").alias("autonomous_execution_coverage"),
        s("unsafe_executed").alias("unsafe_execute_count"), div("unsafe_executed", "executed").alias("unsafe_execution_rate"),
        div("value_unsafe", "value_executed").alias("raw_exposure_weighted_unsafe_rate"),
        div("c_unsafe", "c_executed").alias("consequence_weighted_unsafe_rate"), div("loss", "loss_known").alias("mean_realized_normalized_loss"),
        div("escalated", "n").alias("human_escalation_rate"), div("gathered", "n").alias("gather_rate"), div("abstained", "n").alias("abstention_rate"),
    ]


TERMS = ["n", "executed", "unsafe_executed", "value_executed", "value_unsafe", "c_executed", "c_unsafe", "loss", "loss_known", "escalated", "gathered", "abstained"]


def policy_metrics(df: DataFrame, by: list[str], action: Column, unsafe: Column, value: Column, c: Column, loss: Column) -> DataFrame:
    terms = row_terms(action, unsafe, value, c, loss)
    sums = df.select(*by, *[x.alias(n) for n, x in terms.items()]).groupBy(*by).agg(*[F.sum(n).alias(n) for n in TERMS])
    return sums.select(*by, *ratios())


def metrics_by_each(df: DataFrame, keys: list[str], groupings: list[str], terms: dict[str, Column]) -> DataFrame:
    """The same metrics under one grouping at a time, from a single grouping-sets aggregate."""
    rows = df.select(*keys, *groupings, *[x.alias(n) for n, x in terms.items()])
    sets = [[F.col(k) for k in keys] + [F.col(g)] for g in groupings]
    cols = [F.col(c) for c in [*keys, *groupings]]
    sums = rows.groupingSets(sets, *cols).agg(*[F.sum(n).alias(n) for n in TERMS], *[F.grouping(g).alias(f"_g_{g}") for g in groupings])
    name = F.coalesce(*[F.when(F.col(f"_g_{g}") == 0, g) for g in groupings])
    value = F.coalesce(*[F.when(F.col(f"_g_{g}") == 0, F.col(g).cast("string")) for g in groupings])
    return sums.select(*keys, name.alias("grouping"), value.alias("value"), *ratios())


def rule_metrics(df: DataFrame, by: list[str], rules: dict[str, Column], unsafe: Column, value: Column, c: Column, other_cost: float = 0.1) -> DataFrame:
    """Execute-or-escalate rules side by side: coverage, unsafe rate, weighted rate, mean loss and totals per 1,000."""
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), x.alias("ex")) for n, x in rules.items()])
    long = df.select(*by, is_true(unsafe).alias("u"), F.coalesce(F.abs(value), F.lit(0.0)).alias("v"), c.alias("c"), F.inline(rows))
    ex, u = F.col("ex"), F.col("u")
    money = lambda cond: F.sum(F.when(cond, F.col("v")).otherwise(0.0))
    return long.groupBy(*by, "policy").agg(
        F.count("*").alias("cases"), count_if(ex).alias("executed"), count_if(ex & u).alias("unsafe"),
        F.avg(ex.cast("int")).alias("coverage"), F.try_divide(count_if(ex & u).cast("double"), count_if(ex).cast("double")).alias("unsafe_rate"),
        F.try_divide(money(ex & u), money(ex)).alias("value_weighted_unsafe_rate"),
        F.avg(F.when(ex, u.cast("double") * F.col("c")).otherwise(other_cost)).alias("mean_loss"),
        (money(ex & u) * 1000 / F.count("*")).alias("unsafe_value_per_1000"), (money(~ex) * 1000 / F.count("*")).alias("escalated_value_per_1000"),
        (money(ex) * 1000 / F.count("*")).alias("executed_value_per_1000"))
