"""Safety labels and readiness reasons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import (
    AMBIGUOUS, SAFE, UNSAFE, any_of, evidence_complete, is_true, safety_label, truthy, upper_text,
)

# Fixed values.
CORE_SIGNALS = [
    "outcome_invoice_cancelled_after_t0",
    "outcome_payment_block_set_after_t0",
    "outcome_future_gr_cancel",
    "outcome_future_price_change",
    "outcome_future_quantity_change",
    "outcome_subsequent_invoice",
]
EXPANDED_SIGNALS = [*CORE_SIGNALS, "outcome_additional_invoice_receipt"]
T1_CORE = [
    "after_t1_invoice_cancelled",
    "after_t1_payment_block_set",
    "after_t1_gr_cancel",
    "after_t1_price_change",
    "after_t1_quantity_change",
    "after_t1_subsequent_invoice",
]
T1_EXPANDED = [*T1_CORE, "after_t1_additional_invoice"]
T1_CONSERVATIVE = [*T1_EXPANDED, "after_t1_future_gr", "after_t1_service_entry"]
T1_DEFINITIONS = {"D1_CORE": T1_CORE, "D2_EXPANDED": T1_EXPANDED, "D3_CONSERVATIVE": T1_CONSERVATIVE}
REASONS = [
    "MISSING_PO_VALUE", "MISSING_INVOICE_VALUE", "MISSING_GR", "MISSING_GR_VALUE",
    "PO_INV_MISMATCH", "INV_GR_MISMATCH", "GR_MATCH_UNKNOWN", "PO_INV_MATCH_UNKNOWN",
    "PRIOR_GR_CANCELLATION", "PRIOR_INVOICE_CANCELLATION", "PRIOR_PRICE_CHANGE",
    "PRIOR_QUANTITY_CHANGE", "PRIOR_PAYMENT_BLOCK",
]
REVIEW_REASONS = [
    "MISSING_PO_VALUE", "MISSING_INVOICE_VALUE", "MISSING_GR_VALUE", "PO_INV_MISMATCH",
    "INV_GR_MISMATCH", "GR_MATCH_UNKNOWN", "PO_INV_MATCH_UNKNOWN",
]


def three_way(unsafe: Column, cleared: Column) -> Column:
    """Unsafe wins over cleared; neither is ambiguous."""
    return F.when(is_true(unsafe), UNSAFE).when(is_true(cleared), SAFE).otherwise(AMBIGUOUS)


def d1_target(signals: list[str] | None = None) -> Column:
    """Missing required evidence or any adverse signal is unsafe."""
    complete = evidence_complete("goods_receipt_required", "gr_available_at_t0")
    adverse = any_of([truthy(s) for s in signals or CORE_SIGNALS])
    return three_way(~complete | adverse, truthy("outcome_eventually_cleared"))


def d2_target() -> Column:
    return d1_target(EXPANDED_SIGNALS)


def d3_target(synthetic: Column) -> Column:
    return F.when(is_true(synthetic), UNSAFE).otherwise(d1_target())


def d4_target(reference: Column | str) -> Column:
    return F.when(upper_text(reference) == "EXECUTE", SAFE).otherwise(UNSAFE)


def t1_target(definition: str) -> Column:
    return three_way(any_of([truthy(s) for s in T1_DEFINITIONS[definition]]), truthy("after_t1_eventually_cleared"))


def horizon_target(complete: Column, adverse: Column, cleared: Column) -> Column:
    return three_way(~is_true(complete) | is_true(adverse), cleared)


def robustness_target(synthetic: Column, source_label: Column) -> Column:
    return F.when(is_true(synthetic), UNSAFE).otherwise(F.coalesce(source_label, F.lit(AMBIGUOUS)))


def action_fallback_unsafe(label: Column | str, reference: Column | str) -> Column:
    """Resolved labels decide; unresolved ones fall back to the reference action."""
    word = safety_label(label)
    return F.when(word == UNSAFE, True).when(word == SAFE, False).otherwise(upper_text(reference) != "EXECUTE")


CONVENTIONS = ["FALLBACK", "RESOLVED_ONLY", "AMBIGUOUS_SAFE", "AMBIGUOUS_UNSAFE"]


def convention_unsafe(convention: Column, label: Column, reference: Column) -> Column:
    """Unsafe flag under an ambiguity convention; NULL leaves the row out."""
    return (
        F.when(label != AMBIGUOUS, label == UNSAFE)
        .when(convention == "FALLBACK", upper_text(reference) != "EXECUTE")
        .when(convention == "AMBIGUOUS_SAFE", False)
        .when(convention == "AMBIGUOUS_UNSAFE", True)
    )


def reason_flags(po_tolerance: float = 0.01, gr_tolerance: float = 0.01) -> dict[str, Column]:
    """The thirteen readiness reasons; mismatches are strict ``>``."""
    po, inv, gr = F.col("po_value_initial_eur"), F.col("invoice_value_t0_eur"), F.col("latest_gr_value_before_t0_eur")
    seen = truthy("gr_available_at_t0")
    po_gap, gr_gap = F.col("inv_po_abs_rel_diff"), F.col("inv_gr_abs_rel_diff")
    return {
        "MISSING_PO_VALUE": po.isNull(),
        "MISSING_INVOICE_VALUE": inv.isNull(),
        "MISSING_GR": ~seen,
        "MISSING_GR_VALUE": seen & gr.isNull(),
        "PO_INV_MISMATCH": is_true(po_gap > po_tolerance),
        "INV_GR_MISMATCH": seen & is_true(gr_gap > gr_tolerance),
        "GR_MATCH_UNKNOWN": seen & gr.isNotNull() & inv.isNotNull() & gr_gap.isNull(),
        "PO_INV_MATCH_UNKNOWN": po.isNotNull() & inv.isNotNull() & po_gap.isNull(),
        "PRIOR_GR_CANCELLATION": truthy("had_gr_cancellation_before_t0"),
        "PRIOR_INVOICE_CANCELLATION": truthy("had_invoice_cancellation_before_t0"),
        "PRIOR_PRICE_CHANGE": truthy("had_price_change_before_t0"),
        "PRIOR_QUANTITY_CHANGE": truthy("had_quantity_change_before_t0"),
        "PRIOR_PAYMENT_BLOCK": truthy("had_payment_block_before_t0"),
    }


def review_required(flags: dict[str, Column], optional: list[str] | None = None) -> Column:
    return any_of([flags[n] for n in [*REVIEW_REASONS, *(optional or [])]])


def readiness_label(flags: dict[str, Column], optional: list[str] | None = None) -> Column:
    return (
        F.when(review_required(flags, optional), "REVIEW")
        .when(flags["MISSING_GR"], "WAIT_FOR_EVIDENCE")
        .otherwise("READY")
    )


def code_text(flags: dict[str, Column], empty: str = "NONE", sep: str = "|") -> Column:
    codes = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())
    return F.when(F.size(codes) == 0, F.lit(empty)).otherwise(F.array_join(codes, sep))


def code_count(flags: dict[str, Column]) -> Column:
    total = F.lit(0)
    for c in flags.values():
        total = total + c.cast("int")
    return total
