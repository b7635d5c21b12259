"""How the evidence gate behaves per population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gate as G
from ..functions.scalars import any_of, is_true, steps_reached
from .ordered import count_if, grid_column


def gate_by_delta(df: DataFrame, deltas: list[float], by: list[str]) -> DataFrame:
    """Gate outcomes for several value tolerances from one pass over the cases.

    A case is described by three facts: does a history rule fire, is evidence
    missing, and how many tolerances does its largest relevant gap reach. Only
    the counts of those facts meet the tolerance list.
    """
    ds = sorted(deltas)
    gr_gap = F.when(F.col("gr_available_at_t0"), F.col("inv_gr_abs_rel_diff"))
    gap = F.greatest(F.col("inv_po_abs_rel_diff"), gr_gap)
    facts = df.select(
        *by, any_of(list(G.history_rules().values())).alias("hist"),
        any_of(list(G.missing_rules().values())).alias("miss"), steps_reached(gap, ds).alias("steps"),
    ).groupBy(*by, "hist", "miss", "steps").agg(F.count("*").alias("k"))
    g = facts.withColumn("_g", grid_column({"i": list(range(1, len(ds) + 1)), "d": ds}))
    contra = F.col("hist") | (F.col("steps") >= F.col("_g.i"))
    incomplete = ~contra & F.col("miss")

    def n(c: Column) -> Column:
        return F.sum(F.when(c, F.col("k")).otherwise(0))

    return g.groupBy(F.col("_g.d").alias("delta"), *by).agg(
        F.sum("k").alias("episodes"), n(contra | incomplete).alias("blocked"),
        (n(contra | incomplete) / F.sum("k")).alias("block_rate"), (n(incomplete) / F.sum("k")).alias("incomplete_rate"))


def gate_summary(df: DataFrame, by: list[str], gate: str = "gate") -> DataFrame:
    g = F.col(gate)
    rate = lambda c: F.avg(is_true(c).cast("int"))
    return df.groupBy(*by).agg(
        F.count("*").alias("episodes"), count_if(g != "VALID").alias("blocked_count"), rate(g != "VALID").alias("block_rate"),
        rate(g == "VALID").alias("valid_rate"), rate(g == "INCOMPLETE").alias("incomplete_rate"),
        rate(g == "CONTRADICTORY").alias("contradictory_rate"))


def natural_false_blocks(df: DataFrame, gate: str = "gate") -> DataFrame:
    """Blocked share among natural cases, all and those whose reference is EXECUTE."""
    executes = F.upper(F.trim("expected_action_reference")) == "EXECUTE"
    rows = F.array(F.struct(F.lit("ALL_NATURAL").alias("population"), F.lit(True).alias("inside")),
                   F.struct(F.lit("NATURAL_REFERENCE_EXECUTE").alias("population"), is_true(executes).alias("inside")))
    long = df.where(F.col("family") == "NATURAL").select(gate, F.inline(rows)).where("inside")
    blocked = F.col(gate) != "VALID"
    return long.groupBy("population").agg(
        F.count("*").alias("episodes"), count_if(blocked).alias("blocked_count"), F.avg(blocked.cast("int")).alias("false_block_rate"))


def rule_activation(df: DataFrame, rules: dict[str, Column], population: str, populations: list[str]) -> DataFrame:
    """Trigger count and rate of every rule, overall and per population, in one pass."""
    flagged = df.select(population, *[c.alias(n) for n, c in rules.items()])
    sums = flagged.groupBy(population).agg(F.count("*").alias("_n"), *[F.sum(F.col(n).cast("bigint")).alias(n) for n in rules])
    long = sums.select(population, "_n", F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("hits")) for n in rules])))
    out = [F.sum("hits").alias("overall_trigger_count"), (F.sum("hits") / F.sum("_n")).alias("overall_trigger_rate")]
    for p in populations:
        here = F.col(population) == p
        k, n = F.sum(F.when(here, F.col("hits")).otherwise(0)), F.sum(F.when(here, F.col("_n")))
        out += [k.alias(f"{p.lower()}_trigger_count"), F.try_divide(k, n).alias(f"{p.lower()}_trigger_rate")]
    return long.groupBy("rule").agg(*out)
