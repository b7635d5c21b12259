"""Controlled corruption of case copies.

Arms are chosen in one pass: every case offers itself to each arm it qualifies
for under a seeded hash, the first n per arm stay, and one set of expressions
keyed by the arm's fields edits the copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import differs, is_true, number_changed, relative_gap, severity_rank
from .ordered import count_if, hash_ranks

PO, INV, SEEN, GR = "po_value_initial_eur", "invoice_value_t0_eur", "gr_available_at_t0", "latest_gr_value_before_t0_eur"
PO_GAP, GR_GAP = "inv_po_abs_rel_diff", "inv_gr_abs_rel_diff"


@dataclass(frozen=True)
class Arm:
    name: str
    kind: str
    expected: str
    strength: float | None
    synthetic: bool
    needs: str  # SQL condition on the base case

    @property
    def key(self) -> str:
        return f"{self.name}/{self.kind}/{self.strength}"


NATURAL_ARMS = [
    Arm("NATURAL_COMPLETE_EVIDENCE", "NONE", "EXECUTE", None, False, SEEN),
    Arm("NATURAL_DELAYED_EVIDENCE", "NONE", "GATHER", None, False, f"NOT {SEEN}"),
]
MISSING_ARMS = [
    Arm("CONTROLLED_MISSINGNESS", "MISSING_GR", "GATHER", 1.0, True, SEEN),
    Arm("CONTROLLED_MISSINGNESS", "MISSING_PO_VALUE", "ESCALATE", 1.0, True, SEEN),
    Arm("CONTROLLED_MISSINGNESS", "MISSING_INVOICE_VALUE", "ESCALATE", 1.0, True, SEEN),
    Arm("CONTROLLED_SEVERE_MISSINGNESS", "MULTI_FIELD_MISSING", "ABSTAIN", 1.0, True, SEEN),
]


def contradiction_arms(strengths: list[float]) -> list[Arm]:
    out = []
    for s in strengths:
        out.append(Arm("CONTROLLED_CONTRADICTION", "PO_VALUE_CONTRADICTION", "ESCALATE", s, True, f"{SEEN} AND {PO} IS NOT NULL AND {INV} IS NOT NULL"))
        out.append(Arm("CONTROLLED_CONTRADICTION", "INVOICE_VALUE_CONTRADICTION", "ESCALATE", s, True, f"{SEEN} AND {INV} IS NOT NULL"))
    return out


def all_arms(strengths: list[float]) -> list[Arm]:
    return [*NATURAL_ARMS, *MISSING_ARMS, *contradiction_arms(strengths)]


def assign(base: DataFrame, case: str, arms: list[Arm], seed: str, n: int) -> DataFrame:
    """(case copy, arm columns) for the first n qualifying cases of every arm in hash order."""
    offers = F.filter(F.array(*[
        F.when(is_true(F.expr(a.needs)), F.struct(
            F.lit(a.key).alias("arm_key"), F.lit(a.name).alias("benchmark_arm"), F.lit(a.kind).alias("intervention_type"),
            F.lit(a.strength).cast("double").alias("intervention_strength"), F.lit(a.expected).alias("expected_action_reference"),
            F.lit(a.synthetic).alias("synthetic_intervention")))
        for a in arms]), lambda x: x.isNotNull())
    offered = base.select("*", F.inline(offers))
    key = F.sha2(F.concat(F.lit(seed), F.col("arm_key"), F.lit(":"), F.col(case).cast("string")), 256)
    return hash_ranks(offered, key, case, by=["arm_key"], limit=n).drop("rank")


def shift_factor(case: Column, seed: str, strength: Column) -> Column:
    """1 + s or 1 - s by hash parity, never below 0.01."""
    parity = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), case.cast("string")), 256), 1, 8), 16, 10).cast("bigint") % 2
    sign = F.when(parity == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.greatest(F.lit(1.0) + sign * strength, F.lit(0.01))


def corrupt(copies: DataFrame, case: str, seed: str) -> DataFrame:
    """Apply the intervention of each copy and keep the untouched values beside it."""
    kind = F.col("intervention_type")
    multi = kind == "MULTI_FIELD_MISSING"
    drop_po = kind.isin("MISSING_PO_VALUE") | multi
    drop_inv = kind.isin("MISSING_INVOICE_VALUE") | multi
    drop_gr = kind.isin("MISSING_GR") | multi
    shift_po, shift_inv = kind == "PO_VALUE_CONTRADICTION", kind == "INVOICE_VALUE_CONTRADICTION"
    f = shift_factor(F.concat(F.col("arm_key"), F.lit(":"), F.col(case).cast("string")), seed, F.col("intervention_strength"))
    edited = copies.withColumns({f"original_{c}": F.col(c) for c in (PO, INV, SEEN, GR)}).withColumns({
        PO: F.when(drop_po, F.lit(None)).when(shift_po, F.col(PO) * f).otherwise(F.col(PO)),
        INV: F.when(drop_inv, F.lit(None)).when(shift_inv, F.col(INV) * f).otherwise(F.col(INV)),
        SEEN: F.when(drop_gr, F.lit(False)).otherwise(F.col(SEEN)),
        GR: F.when(drop_gr, F.lit(None)).otherwise(F.col(GR)),
    })
    # untouched ratios stay as they were; shifted ones guard an exact zero only
    return edited.withColumns({
        PO_GAP: F.when(drop_po | drop_inv, F.lit(None)).when(shift_po | shift_inv, relative_gap(INV, PO, 0.0)).otherwise(F.col(PO_GAP)),
        GR_GAP: F.when(drop_gr | drop_inv, F.lit(None)).when(shift_inv, relative_gap(INV, GR, 0.0)).otherwise(F.col(GR_GAP)),
    })


def modified_flags(df: DataFrame) -> DataFrame:
    """Which observation differs from the kept original; a missing receipt on both sides counts as modified."""
    return df.withColumns({
        "po_value_was_modified": differs(F.col(PO), F.col(f"original_{PO}")),
        "invoice_value_was_modified": differs(F.col(INV), F.col(f"original_{INV}")),
        "gr_observation_was_modified": differs(F.col(SEEN), F.col(f"original_{SEEN}")) | differs(F.col(GR), F.col(f"original_{GR}"), null_counts=True),
        "intervention_severity_rank": severity_rank("intervention_type"),
    })


def build(base: DataFrame, case: str, strengths: list[float], seed: str, n: int) -> DataFrame:
    copies = assign(base, case, all_arms(strengths), seed, n)
    return modified_flags(corrupt(copies, case, seed))


def with_episode_ids(df: DataFrame, case: str) -> DataFrame:
    """Numbered ids over (arm, type, strength, case), a total order that is not time."""
    from .ordered import prefix

    order = [F.col("benchmark_arm"), F.col("intervention_type"), F.col("intervention_strength").asc_nulls_first(), F.col(case)]
    return prefix(df, order).withColumn("benchmark_episode_id", F.format_string("EP_%09d", F.col("rank") - 1)).drop("rank")


AGE = "po_to_invoice_days"


def stress(df: DataFrame, kinds: list[str], recompute: bool = True) -> DataFrame:
    """Copies under unseen corruptions: ORIGINAL, NEGATIVE_PO_AGE, COHERENT_VALUE_SUBSTITUTION."""
    if "NEGATIVE_PO_AGE" in kinds and AGE not in df.columns:
        raise ValueError(f"{AGE} is missing: the NEGATIVE_PO_AGE copies would equal the originals")
    rows = df.withColumn("corruption", F.explode(F.array(*[F.lit(k) for k in kinds])))
    coherent = F.col("corruption") == "COHERENT_VALUE_SUBSTITUTION"
    scaled = rows.withColumns({c: F.when(coherent, F.col(c) * 10.0).otherwise(F.col(c)) for c in (PO, INV, GR)})
    if "NEGATIVE_PO_AGE" in kinds:
        scaled = scaled.withColumn(AGE, F.when(F.col("corruption") == "NEGATIVE_PO_AGE", F.lit(-7.0)).otherwise(F.col(AGE)))
    if not recompute:
        return scaled
    return scaled.withColumns({PO_GAP: relative_gap(INV, PO), GR_GAP: relative_gap(INV, GR)})


def stress_outcomes(df: DataFrame, kinds: list[str], score: Column, gate: Column, high: float) -> DataFrame:
    """Gate and score of the corrupted rows, over all rows and over those the gate lets pass.

    ``score`` and ``gate`` are worked out on the corrupted values, never carried over.
    """
    s = stress(df, kinds).withColumn("_score", score).withColumn("_gate", gate)
    blocked, top = F.col("_gate") != "VALID", F.col("_score") >= high
    subsets = F.when(blocked, F.array(F.lit("all_natural"))).otherwise(F.array(F.lit("all_natural"), F.lit("gate_valid")))
    return s.select("*", F.explode(subsets).alias("subset")).groupBy("subset", "corruption").agg(
        F.count("*").alias("cases"), count_if(blocked).alias("gate_blocked"), count_if(top).alias("high_score"), count_if(top & ~blocked).alias("selected"),
        F.avg("_score").alias("mean_score"), F.sum(PO).alias("total_po"))


def footprint(episodes: DataFrame, base: DataFrame, case: str, fields: list[str], atol: float = 1e-9, rtol: float = 1e-9) -> DataFrame:
    """Per synthetic copy and field: did it change against its source case?"""
    b = base.select(F.col(case).alias("_b"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    j = episodes.where("synthetic_intervention").join(b, F.col(case) == F.col("_b"))
    kinds = dict(episodes.dtypes)

    def changed(f: str) -> Column:
        if kinds[f] in ("double", "bigint", "int"):
            return number_changed(F.col(f).cast("double"), F.col(f"_b_{f}").cast("double"), atol, rtol)
        return differs(F.col(f), F.col(f"_b_{f}"))

    def delta(f: str) -> Column:
        return (F.col(f) - F.col(f"_b_{f}")).cast("double") if kinds[f] in ("double", "bigint", "int") else F.lit(None).cast("double")

    rows = F.array(*[F.struct(F.lit(f).alias("field"), changed(f).alias("changed"), delta(f).alias("delta"),
                              F.col(f"_b_{f}").cast("string").alias("from_value"), F.col(f).cast("string").alias("to_value")) for f in fields])
    return j.select(case, "arm_key", "intervention_type", "intervention_strength", F.inline(rows))


def change_rates(prints: DataFrame) -> DataFrame:
    return prints.groupBy("intervention_type", "field").agg(
        F.count("*").alias("n"), F.sum(F.col("changed").cast("bigint")).alias("n_changed"),
        F.avg(F.col("changed").cast("int")).alias("change_rate"), F.avg("delta").alias("mean_delta"))


def changed_fields(prints: DataFrame, case: str, fields: list[str]) -> DataFrame:
    """Changed-field list and count per copy (at most one entry per field)."""
    hit = F.col("changed")
    order = {f: i for i, f in enumerate(fields)}
    pos = F.create_map(*[x for f, i in order.items() for x in (F.lit(f), F.lit(i))])[F.col("field")]
    g = prints.groupBy(case, "arm_key", "intervention_type", "intervention_strength").agg(
        F.array_sort(F.collect_list(F.when(hit, F.struct(pos.alias("i"), F.col("field").alias("f"))))).alias("_l"))
    names = F.transform("_l", lambda x: x["f"])
    return g.select(case, "intervention_type", "intervention_strength", F.size("_l").alias("n_changed"),
                    F.when(F.size("_l") == 0, "NONE").otherwise(F.array_join(names, "|")).alias("changed_fields"))
