"""Evidence-consistency rules and the three-state gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import any_of, is_true, number, truthy, upper_text

VALID, INCOMPLETE, CONTRADICTORY = "VALID", "INCOMPLETE", "CONTRADICTORY"


def missing_rules() -> dict[str, Column]:
    return {
        "missing_po_value": number("po_value_initial_eur").isNull(),
        "missing_invoice_value": number("invoice_value_t0_eur").isNull(),
        "missing_required_gr": truthy("goods_receipt_required") & ~truthy("gr_available_at_t0"),
        "missing_vendor_invoice_evidence": ~truthy("vendor_invoice_seen_at_t0"),
        "missing_po_creation_evidence": ~truthy("po_created_at_t0"),
    }


def history_rules() -> dict[str, Column]:
    seen = truthy("gr_available_at_t0")

    def n(name: str) -> Column:
        return F.coalesce(number(f"n_{name}_before_t0"), F.lit(0.0))

    def had(name: str) -> Column:
        return truthy(f"had_{name}_before_t0")

    return {
        "gr_flag_false_but_gr_count_positive": ~seen & (n("goods_receipts") > 0),
        "gr_flag_true_but_gr_count_zero": seen & (n("goods_receipts") == 0),
        "gr_cancel_flag_without_cancel_count": had("gr_cancellation") & (n("cancel_gr") == 0),
        "invoice_cancel_flag_without_cancel_count": had("invoice_cancellation") & (n("cancel_invoice") == 0),
        "price_change_flag_without_count": had("price_change") & (n("price_change") == 0),
        "quantity_change_flag_without_count": had("quantity_change") & (n("quantity_change") == 0),
        "payment_block_flag_without_history": had("payment_block")
        & (n("set_payment_block") + n("remove_payment_block") == 0),
    }


def fixed_rules() -> dict[str, Column]:
    return {**missing_rules(), **history_rules()}


def value_rule(delta: Column | float) -> Column:
    """Gap of at least delta against the order, or against a receipt that was seen."""
    d = F.lit(delta) if isinstance(delta, float) else delta
    return is_true(number("inv_po_abs_rel_diff") >= d) | (
        truthy("gr_available_at_t0") & is_true(number("inv_gr_abs_rel_diff") >= d)
    )


def gate_state(delta: Column | float) -> Column:
    contradictory = any_of([*history_rules().values(), value_rule(delta)])
    return (
        F.when(contradictory, CONTRADICTORY)
        .when(any_of(list(missing_rules().values())), INCOMPLETE)
        .otherwise(VALID)
    )


def comparison_group(gate: Column | str, action: Column | str, family: Column | str, reference: Column | str) -> Column:
    """Where an intervention or a natural reference case ended up."""
    f, g, a = upper_text(family), upper_text(gate), upper_text(action)
    contradiction = f == "CONTRADICTION"
    return (
        F.when(contradiction & (g != VALID), "CONTRADICTION_BLOCKED")
        .when(contradiction & (a == "EXECUTE"), "CONTRADICTION_VALID_EXECUTED")
        .when(contradiction, "CONTRADICTION_VALID_NOT_EXECUTED")
        .when((f == "NATURAL") & (upper_text(reference) == "EXECUTE"), "NATURAL_REFERENCE_EXECUTE")
        .otherwise("OTHER")
    )
