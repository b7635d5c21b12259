"""Case state before and after a decision event, from an event log.

One pass finds each case's cut point; the cut is joined back to the events and
every state column is a sum, minimum or maximum. Time and order of an event are
packed into one decimal that sorts like the pair, so all buffers are numbers of
fixed size and the aggregate is hashed; values are picked by that key. If there
are cases with more than ``HOT_ROWS`` events, these are aggregated per (case,
salt) first. Text attributes of a case are not aggregated with the events: they
are read from the case's first row, and only cases that lack one there and have
it later are searched further.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import any_of, is_true, parse_bool, relative_gap, require_columns
from ..session import materialize
from .ordered import hash_ranks, percentiles, prefix, scalars

HOT_ROWS = 1_000_000
#: Parts of a case whose first rows are found apart.
SPREAD = 64
#: Hot cases that are broadcast, at most.
HOT_CASES = 10_000
ARROW = " -> "

# Static case attributes (log column -> state column).
CASE_ATTRIBUTES = {
    "case:Purchasing Document": "purchasing_document",
    "case:Item": "item_id",
    "case:Vendor": "vendor_id",
    "case:Name": "vendor_name_anon",
    "case:Company": "company",
    "case:Source": "source_system",
    "case:Document Type": "document_type",
    "case:Purch. Doc. Category name": "document_category",
    "case:Item Type": "item_type",
    "case:Item Category": "item_category",
    "case:Spend classification text": "spend_classification",
    "case:Spend area text": "spend_area",
    "case:Sub spend area text": "sub_spend_area",
}
CASE_FLAGS = {
    "case:GR-Based Inv. Verif.": "gr_based_invoice_verification",
    "case:Goods Receipt": "goods_receipt_required",
}
# Role -> activity name in the public purchase-to-pay log.
ACTIVITIES = {
    "create_po": "Create Purchase Order Item",
    "vendor_invoice": "Vendor creates invoice",
    "invoice_receipt": "Record Invoice Receipt",
    "goods_receipt": "Record Goods Receipt",
    "cancel_gr": "Cancel Goods Receipt",
    "cancel_invoice": "Cancel Invoice Receipt",
    "clear_invoice": "Clear Invoice",
    "price_change": "Change Price",
    "quantity_change": "Change Quantity",
    "set_payment_block": "Set Payment Block",
    "remove_payment_block": "Remove Payment Block",
    "subsequent_invoice": "Record Subsequent Invoice",
    "service_entry": "Record Service Entry Sheet",
    "delete_po": "Delete Purchase Order Item",
    "block_po": "Block Purchase Order Item",
    "reactivate_po": "Reactivate Purchase Order Item",
    "change_approval": "Change Approval for Purchase Order",
    "release_po": "Release Purchase Order",
}
# Roles counted in the history of a cut, under the plural used in column names.
HISTORY = {
    "goods_receipts": "goods_receipt",
    "cancel_gr": "cancel_gr",
    "invoice_receipts": "invoice_receipt",
    "cancel_invoice": "cancel_invoice",
    "price_change": "price_change",
    "quantity_change": "quantity_change",
    "set_payment_block": "set_payment_block",
    "remove_payment_block": "remove_payment_block",
    "service_entry": "service_entry",
    "delete_po": "delete_po",
    "block_po": "block_po",
    "reactivate_po": "reactivate_po",
    "change_approval": "change_approval",
    "release_po": "release_po",
}
HISTORY_FLAGS = {
    "gr_cancellation": ["cancel_gr"],
    "invoice_cancellation": ["cancel_invoice"],
    "price_change": ["price_change"],
    "quantity_change": ["quantity_change"],
    "payment_block": ["set_payment_block", "remove_payment_block"],
}


_WIDE = "decimal(20,0)"


def packed(ts: Column, order: Column) -> Column:
    """(time, order) as one decimal(38) that sorts like the pair; undated events come last."""
    late = F.lit(1 << 61)
    micros = F.coalesce(F.unix_micros(ts.cast("timestamp")), late).cast(_WIDE)
    place = F.coalesce(order.cast("bigint"), F.lit(0)).cast(_WIDE)
    return micros * F.lit(str(1 << 64)).cast(_WIDE) + (place + F.lit(str(1 << 63)).cast(_WIDE))


@dataclass(frozen=True)
class Log:
    """Column roles of an event table and the activity behind each role."""

    case: str = "case:concept:name"
    activity: str = "concept:name"
    ts: str = "time:timestamp"
    order: str = "ord"
    value: str = "Cumulative net worth (EUR)"
    attributes: dict[str, str] = field(default_factory=lambda: dict(CASE_ATTRIBUTES))
    flags: dict[str, str] = field(default_factory=lambda: dict(CASE_FLAGS))
    activities: dict[str, str] = field(default_factory=lambda: dict(ACTIVITIES))

    def normal(self, events: DataFrame) -> DataFrame:
        """Rename the roles to fixed names and keep nothing else."""
        needed = [self.case, self.activity, self.ts, self.order, self.value, *self.attributes, *self.flags]
        require_columns(events, needed, "event log")
        return events.select(
            F.col(f"`{self.case}`").alias("case_id"),
            F.col(f"`{self.activity}`").alias("activity"),
            F.col(f"`{self.ts}`").alias("ts"),
            F.col(f"`{self.order}`").alias("ord"),
            packed(F.col(f"`{self.ts}`"), F.col(f"`{self.order}`")).alias("at"),
            F.col(f"`{self.value}`").cast("double").alias("value"),
            *[F.col(f"`{c}`").cast("string").alias(f"attr_{n}") for c, n in {**self.attributes, **self.flags}.items()],
        )

    def attribute_names(self) -> list[str]:
        return [*self.attributes.values(), *self.flags.values()]

    def is_role(self, *roles: str) -> Column:
        return F.col("activity").isin([self.activities[r] for r in roles])


@dataclass(frozen=True)
class Part:
    """An aggregate that can be merged: partial column, merge step, final shape."""

    partial: Column
    merge: Callable[[Column], Column]
    finish: Callable[[Column], Column] = lambda c: c


def count_where(cond: Column) -> Part:
    return Part(F.sum(is_true(cond).cast("bigint")), F.sum)


def any_where(cond: Column) -> Part:
    return Part(F.max(is_true(cond)), F.max)


def first_time(cond: Column) -> Part:
    return Part(F.min(F.when(cond, F.col("ts"))), F.min)


def last_time(cond: Column) -> Part:
    return Part(F.max(F.when(cond, F.col("ts"))), F.max)


def _picked(cond: Column, value: str, pick: Callable, end: Callable) -> Part:
    at = F.when(cond, F.col("at"))
    return Part(
        F.struct(pick(value, at).alias("v"), end(at).alias("k")),
        lambda c: F.struct(pick(c["v"], c["k"]).alias("v"), end(c["k"]).alias("k")), lambda c: c["v"],
    )


def first_row_value(cond: Column, value: str = "value") -> Part:
    """Value on the first matching row, NULL if that row has none."""
    return _picked(cond, value, F.min_by, F.min)


def last_row_value(cond: Column, value: str = "value") -> Part:
    return _picked(cond, value, F.max_by, F.max)


def first_value(cond: Column, value: str = "value") -> Part:
    """First value that is not NULL among the matching rows."""
    return first_row_value(is_true(cond) & F.col(value).isNotNull(), value)


def last_value(cond: Column, value: str = "value") -> Part:
    return last_row_value(is_true(cond) & F.col(value).isNotNull(), value)


def first_order(cond: Column) -> Part:
    return first_row_value(cond, "ord")


CUT, CUT1 = ["cut_at", "cut_ts", "cut_ord"], ["cut1_at", "cut1_ts", "cut1_ord"]


def combine(salted: DataFrame, parts: dict[str, Part], keep: list[str] | None = None) -> DataFrame:
    """Aggregate per case, by way of (case, salt) where ``attach`` has salted. ``keep`` columns are constant per case."""
    keep = keep or []
    salts = ["_salt"] if "_salt" in salted.columns else []
    out = salted.groupBy("case_id", *salts, *keep).agg(*[p.partial.alias(n) for n, p in parts.items()])
    if salts:
        out = out.groupBy("case_id", *keep).agg(*[p.merge(F.col(n)).alias(n) for n, p in parts.items()])
    return out.select("case_id", *keep, *[p.finish(F.col(n)).alias(n) for n, p in parts.items()])


def cut_points(events: DataFrame, decision: Column, attributes: list[str] | None = None) -> DataFrame:
    """First decision event of each case by (time, order); undated events never decide.

    With ``attributes`` also the case's first row and which of them it holds,
    and which the case holds at all (see ``static_attributes``).
    """
    at = F.when(decision & F.col("ts").isNotNull(), F.col("at"))
    held = _held(attributes) if attributes else None
    more = [F.min("at").alias("first_at"), F.min_by(held, "at").alias("first_held"), F.bit_or(held).alias("held")] if attributes else []
    return (
        events.groupBy("case_id")
        .agg(F.min(at).alias("cut_at"), F.min_by("ts", at).alias("cut_ts"), F.min_by("ord", at).alias("cut_ord"), F.count("*").alias("n_events"), *more)
        .where(F.col("cut_at").isNotNull())
    )


def second_cut(salted: DataFrame, evidence: Column) -> DataFrame:
    """First evidence event strictly after the first cut."""
    later = evidence & future()
    parts = {"cut1_at": Part(F.min(F.when(later, F.col("at"))), F.min), "cut1_ts": first_row_value(later, "ts"), "cut1_ord": first_row_value(later, "ord")}
    return combine(salted, parts, [*CUT, "n_events"]).where(F.col("cut1_at").isNotNull())


def _held(names: list[str]) -> Column:
    """One bit per attribute that is not NULL."""
    bits = [F.when(F.col(f"attr_{n}").isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, n in enumerate(names)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def static_attributes(events: DataFrame, cuts: DataFrame, names: list[str]) -> DataFrame:
    """(case_id, names): the first value of each attribute that is not NULL.

    ``cuts`` comes from ``cut_points`` with these attributes. The first row has
    them all in most cases; it is found by an equi-join on (case, key), which
    also spreads a hot case. The events of the other cases are searched.
    """
    whole = F.col("first_held") == F.col("held")
    columns = [f"attr_{n}" for n in names]
    first = cuts.where(whole).select(F.col("case_id").alias("_case"), F.col("first_at").alias("_at"))
    # rows that repeat time and order are one
    plain = events.join(first, (events["case_id"] == first["_case"]) & (events["at"] == first["_at"])).select("case_id", *columns)
    plain = plain.dropDuplicates(["case_id"]).select("case_id", *[F.col(f"attr_{n}").alias(n) for n in names])
    late = events.join(cuts.where(~whole).select("case_id"), "case_id")
    keyed = late.groupBy("case_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(n) for c, n in zip(columns, names, strict=True)])
    return plain.unionByName(keyed)


def attach(events: DataFrame, cuts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join the cut of its case to every event, salting only hot cases.

    A case is hot above ``hot_rows`` events and above a HOT_CASES-th of all, so
    at most HOT_CASES rows are broadcast; without one there are no salts.
    """
    size = cuts.agg(F.sum("n_events").alias("all"), F.max("n_events").alias("most")).first()
    bound = max(hot_rows, (size["all"] or 0) // HOT_CASES)
    if (size["most"] or 0) <= bound:
        return events.join(cuts, "case_id")
    salts = F.ceil(F.col("n_events") / F.lit(bound)).cast("int")
    hot = cuts.where(F.col("n_events") > bound).select(F.col("case_id").alias("_hot"), salts.alias("_salts"))
    spread = F.pmod(F.xxhash64("at"), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")
    left = (
        events.join(F.broadcast(hot), events["case_id"] == hot["_hot"], "left")
        .withColumn("_salt", spread)
        .drop("_hot", "_salts")
    )
    right = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, ["case_id", "_salt"])


def prepared(events: DataFrame, log: Log) -> tuple[DataFrame, DataFrame]:
    """(events with their cut attached, cut table) for the decision role of the log."""
    rows = log.normal(events)
    cuts = materialize(cut_points(rows, log.is_role("invoice_receipt")))
    return attach(rows, cuts), cuts


def past() -> Column:
    return F.col("ts").isNotNull() & (F.col("at") <= F.col("cut_at"))


def future() -> Column:
    return F.col("ts").isNotNull() & (F.col("at") > F.col("cut_at"))


def _days(start: str, end: str) -> Column:
    return (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / F.lit(86_400_000_000.0)


def case_state(events: DataFrame, log: Log) -> DataFrame:
    """Everything known at the decision event, and what was seen after it."""
    rows, names = log.normal(events), log.attribute_names()
    role = log.is_role
    cuts = materialize(cut_points(rows, role("invoice_receipt"), names))
    # the side of the cut is worked out once per event
    salted = attach(rows.drop(*[f"attr_{n}" for n in names]), cuts.select("case_id", *CUT, "n_events"))
    salted = salted.withColumns({"_past": past(), "_future": future()})
    before, after = F.col("_past"), F.col("_future")
    parts: dict[str, Part] = {
        "case_start_time": first_time(F.lit(True)),
        "case_end_time": last_time(F.lit(True)),
        "events_total_case": Part(F.count("*"), F.sum),
        "events_available_at_t0": count_where(before),
        "events_future_after_t0": count_where(after),
        "po_value_initial_eur": first_value(before & role("create_po")),
        "invoice_value_t0_eur": first_row_value(role("invoice_receipt") & F.col("ts").isNotNull()),
        "latest_gr_value_before_t0_eur": last_value(before & role("goods_receipt")),
        "gr_available_at_t0": any_where(before & role("goods_receipt")),
        "vendor_invoice_seen_at_t0": any_where(before & role("vendor_invoice")),
        "po_created_at_t0": any_where(before & role("create_po")),
    }
    for name, r in HISTORY.items():
        suffix = "at_t0_history" if r == "invoice_receipt" else "before_t0"
        parts[f"n_{name}_{suffix}"] = count_where(before & role(r))
    for name, roles in HISTORY_FLAGS.items():
        parts[f"had_{name}_before_t0"] = any_where(before & role(*roles))
    parts |= {
        "_po_time": first_time(before & role("create_po")),
        "_vendor_time": first_time(before & role("vendor_invoice")),
        "_gr_time": last_time(before & role("goods_receipt")),
        "outcome_eventually_cleared": any_where(after & role("clear_invoice")),
        "outcome_invoice_cancelled_after_t0": any_where(after & role("cancel_invoice")),
        "outcome_payment_block_removed_after_t0": any_where(after & role("remove_payment_block")),
        "outcome_payment_block_set_after_t0": any_where(after & role("set_payment_block")),
        "outcome_future_gr": any_where(after & role("goods_receipt")),
        "outcome_future_gr_cancel": any_where(after & role("cancel_gr")),
        "outcome_future_price_change": any_where(after & role("price_change")),
        "outcome_future_quantity_change": any_where(after & role("quantity_change")),
        "outcome_subsequent_invoice": any_where(after & role("subsequent_invoice")),
        "outcome_additional_invoice_receipt": any_where(after & role("invoice_receipt")),
        "outcome_future_service_entry": any_where(after & role("service_entry")),
        "first_future_gr_time": first_time(after & role("goods_receipt")),
        "last_future_gr_time": last_time(after & role("goods_receipt")),
        "first_future_gr_value_eur": first_row_value(after & role("goods_receipt")),
        "latest_future_gr_value_eur": last_row_value(after & role("goods_receipt")),
        "n_future_goods_receipts": count_where(after & role("goods_receipt")),
        "first_clear_time": first_time(after & role("clear_invoice")),
        "first_payment_block_removal_time": first_time(after & role("remove_payment_block")),
        "first_payment_block_set_time": first_time(after & role("set_payment_block")),
        "first_invoice_cancel_time": first_time(after & role("cancel_invoice")),
        "first_cancel_invoice_value_eur": first_row_value(after & role("cancel_invoice")),
        "first_additional_invoice_time": first_time(after & role("invoice_receipt")),
        "first_additional_invoice_value_eur": first_row_value(after & role("invoice_receipt")),
        "first_subsequent_invoice_time": first_time(after & role("subsequent_invoice")),
        "first_subsequent_invoice_value_eur": first_row_value(after & role("subsequent_invoice")),
        "first_future_price_change_time": first_time(after & role("price_change")),
        "first_future_quantity_change_time": first_time(after & role("quantity_change")),
    }
    state = combine(salted, parts, CUT).join(static_attributes(rows, cuts, names), "case_id")
    exceptions = [
        "outcome_invoice_cancelled_after_t0", "outcome_payment_block_removed_after_t0",
        "outcome_payment_block_set_after_t0", "outcome_future_gr_cancel",
        "outcome_future_price_change", "outcome_future_quantity_change", "outcome_subsequent_invoice",
    ]
    state = state.withColumns({
        "decision_time": F.col("cut_ts"),
        "decision_activity": F.lit(log.activities["invoice_receipt"]),
        **{n: parse_bool(n) for n in log.flags.values()},
    })
    return state.withColumns({
        "inv_po_abs_rel_diff": relative_gap("invoice_value_t0_eur", "po_value_initial_eur"),
        "inv_gr_abs_rel_diff": relative_gap("invoice_value_t0_eur", "latest_gr_value_before_t0_eur"),
        "po_to_invoice_days": _days("_po_time", "decision_time"),
        "vendor_invoice_to_recorded_invoice_days": _days("_vendor_time", "decision_time"),
        "last_gr_to_invoice_days": _days("_gr_time", "decision_time"),
        "time_to_clear_days": _days("decision_time", "first_clear_time"),
        "time_to_first_future_gr_days": _days("decision_time", "first_future_gr_time"),
        "gather_gr_possible": F.col("outcome_future_gr"),
        "gather_gr_has_value": F.col("first_future_gr_value_eur").isNotNull(),
        "outcome_any_post_t0_exception": any_of([F.col(c) for c in exceptions]),
        "post_gather_inv_first_gr_abs_rel_diff": relative_gap("invoice_value_t0_eur", "first_future_gr_value_eur"),
        "post_gather_inv_latest_gr_abs_rel_diff": relative_gap("invoice_value_t0_eur", "latest_future_gr_value_eur"),
        "transaction_exposure_eur": F.abs("po_value_initial_eur"),
        "decision_year": F.year("decision_time"),
        "decision_month": F.date_format("decision_time", "yyyy-MM"),
    }).drop(*CUT, "_po_time", "_vendor_time", "_gr_time")


def risk_stratum(value: Column, refs: Column) -> Column:
    return (
        F.when(value <= refs["p50"], "R1_0_50")
        .when(value <= refs["p90"], "R2_50_90")
        .when(value <= refs["p99"], "R3_90_99")
        .when(value > refs["p99"], "R4_99_100")
    )


def with_risk_stratum(df: DataFrame, value: str = "transaction_exposure_eur") -> DataFrame:
    refs = percentiles(df, value, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return df.withColumn("_refs", scalars(refs)).withColumn(
        "transaction_risk_stratum", risk_stratum(F.col(value), F.col("_refs"))
    ).drop("_refs")


def future_preview(events: DataFrame, log: Log, size: int = 12) -> DataFrame:
    """The first activities after the cut as text.

    A case is cut into SPREAD parts by a hash; each keeps its first ``size``
    rows, and the case the first of those, so a long case is not one task.
    """
    salted, cuts = prepared(events, log)
    later = salted.where(future()).select("case_id", F.pmod(F.xxhash64("at"), F.lit(SPREAD)).alias("_part"), "at", "activity")
    # the first rows of each part of a case, then of the case
    place = lambda *by: F.row_number().over(Window.partitionBy("case_id", *by).orderBy("at"))
    head = later.withColumn("pos", place("_part")).where(F.col("pos") <= size)
    head = head.withColumn("pos", place()).where(F.col("pos") <= size)
    text = head.groupBy("case_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "activity"))), lambda x: x["activity"]), ARROW).alias("preview")
    )
    return cuts.select("case_id").join(text, "case_id", "left").select(
        "case_id", F.coalesce("preview", F.lit("")).alias("future_sequence_preview")
    )


def transition_state(events: DataFrame, log: Log) -> DataFrame:
    """State at the first evidence event after the decision (the second cut)."""
    rows, names = log.normal(events), log.attribute_names()
    role = log.is_role
    cuts = materialize(cut_points(rows, role("invoice_receipt"), names))
    bare = rows.drop(*[f"attr_{n}" for n in names])
    both = materialize(second_cut(attach(bare, cuts.select("case_id", *CUT, "n_events")), role("goods_receipt")))
    key, dated = F.col("at"), F.col("ts").isNotNull()
    salted = attach(bare, both).withColumns({
        "_at_t0": dated & (key <= F.col("cut_at")), "_by_t1": dated & (key <= F.col("cut1_at")),
        "_between": dated & (key > F.col("cut_at")) & (key <= F.col("cut1_at")), "_later": dated & (key > F.col("cut1_at")),
    })
    at_t0, by_t1, between, later = (F.col(c) for c in ("_at_t0", "_by_t1", "_between", "_later"))
    parts: dict[str, Part] = {
        "events_total_case": Part(F.count("*"), F.sum),
        "events_available_at_t0_exact": count_where(at_t0),
        "events_between_t0_t1_inclusive_t1": count_where(between),
        "events_available_at_t1_exact": count_where(by_t1),
        "events_after_t1": count_where(later),
        "po_value_initial_eur": first_value(by_t1 & role("create_po")),
        "invoice_value_t0_eur": first_row_value(dated & role("invoice_receipt")),
        "latest_gr_value_at_t1_eur": last_value(by_t1 & role("goods_receipt")),
        "first_gr_value_at_t1_eur": first_row_value(between & role("goods_receipt")),
        "gr_available_at_t1": any_where(by_t1 & role("goods_receipt")),
        "vendor_invoice_seen_at_t1": any_where(by_t1 & role("vendor_invoice")),
        "po_created_at_t1": any_where(by_t1 & role("create_po")),
        **{f"n_{n}_by_t1": count_where(by_t1 & role(r)) for n, r in HISTORY.items()},
        **{f"had_{n}_by_t1": any_where(by_t1 & role(*rs)) for n, rs in HISTORY_FLAGS.items()},
        "_po_time": first_time(by_t1 & role("create_po")),
        "_vendor_time": first_time(by_t1 & role("vendor_invoice")),
        "_gr_time": last_time(by_t1 & role("goods_receipt")),
        **{f"between_n_{n}": count_where(between & role(r)) for n, r in HISTORY.items()},
        "between_any_non_gr_event": any_where(between & ~role("goods_receipt")),
        "after_t1_eventually_cleared": any_where(later & role("clear_invoice")),
        "after_t1_invoice_cancelled": any_where(later & role("cancel_invoice")),
        "after_t1_payment_block_removed": any_where(later & role("remove_payment_block")),
        "after_t1_payment_block_set": any_where(later & role("set_payment_block")),
        "after_t1_future_gr": any_where(later & role("goods_receipt")),
        "after_t1_gr_cancel": any_where(later & role("cancel_gr")),
        "after_t1_price_change": any_where(later & role("price_change")),
        "after_t1_quantity_change": any_where(later & role("quantity_change")),
        "after_t1_subsequent_invoice": any_where(later & role("subsequent_invoice")),
        "after_t1_additional_invoice": any_where(later & role("invoice_receipt")),
        "after_t1_service_entry": any_where(later & role("service_entry")),
        "_clear_time": first_time(later & role("clear_invoice")),
    }
    known = static_attributes(rows, cuts.join(both.select("case_id"), "case_id", "left_semi"), names)
    state = combine(salted, parts, [*CUT, *CUT1]).join(known, "case_id").withColumns({
        "t0_time": F.col("cut_ts"), "t0_event_order": F.col("cut_ord"),
        "t1_time": F.col("cut1_ts"), "t1_event_order": F.col("cut1_ord"),
        **{n: parse_bool(n) for n in log.flags.values()},
    })
    selected = ["invoice_cancelled", "payment_block_set", "gr_cancel", "price_change", "quantity_change", "subsequent_invoice"]
    return state.withColumns({
        "t1_same_timestamp_as_t0": F.col("t1_time") == F.col("t0_time"),
        "elapsed_t0_to_t1_days": _days("t0_time", "t1_time"),
        "po_to_t1_days": _days("_po_time", "t1_time"),
        "vendor_invoice_to_t1_days": _days("_vendor_time", "t1_time"),
        "last_gr_to_t1_days": _days("_gr_time", "t1_time"),
        "time_t1_to_clear_days": _days("t1_time", "_clear_time"),
        "after_t1_any_selected_exception": any_of([F.col(f"after_t1_{s}") for s in selected]),
        "diag_inv_po_abs_rel_diff_t1": relative_gap("invoice_value_t0_eur", "po_value_initial_eur"),
        "diag_inv_gr_abs_rel_diff_t1": relative_gap("invoice_value_t0_eur", "latest_gr_value_at_t1_eur"),
    }).drop(*CUT, *CUT1, "_po_time", "_vendor_time", "_gr_time", "_clear_time")


def horizon_outcomes(
    events: DataFrame, log: Log, adverse: list[str], clearing: list[str], horizons_days: list[int]
) -> DataFrame:
    """Outcomes strictly later by time and within h days, one row per case and horizon."""
    salted, _ = prepared(events, log)
    start = F.col("cut_ts")
    # the largest horizon filters the rows once; smaller ones are flags
    parts: dict[str, Part] = {"evidence_at_t0": any_where(past() & log.is_role("goods_receipt"))}
    for h in horizons_days:
        within = (F.col("ts") > start) & (F.col("ts") <= start + F.expr(f"INTERVAL '{h}' DAY"))
        parts[f"adverse_{h}"] = any_where(within & log.is_role(*adverse))
        parts[f"cleared_{h}"] = any_where(within & log.is_role(*clearing))
    wide = combine(salted, parts, CUT)
    rows = F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.col(f"adverse_{h}").alias("adverse"), F.col(f"cleared_{h}").alias("cleared"))
        for h in horizons_days
    ])
    return wide.select("case_id", F.col("cut_ts").alias("decision_time"), "evidence_at_t0", F.inline(rows))


def cases_with_activity(events: DataFrame, log: Log, role: str) -> DataFrame:
    keep = events.where(F.col(log.activity) == log.activities[role]).select(log.case).distinct()
    return events.join(keep, log.case, "left_semi")


# First-time columns of the state that are compared with the second cut.
TIMED_EVENTS = {
    "clear": "first_clear_time",
    "payment_block_removal": "first_payment_block_removal_time",
    "payment_block_set": "first_payment_block_set_time",
    "invoice_cancel": "first_invoice_cancel_time",
    "additional_invoice": "first_additional_invoice_time",
    "subsequent_invoice": "first_subsequent_invoice_time",
    "future_price_change": "first_future_price_change_time",
    "future_quantity_change": "first_future_quantity_change_time",
}


def transition_candidates(state: DataFrame) -> DataFrame:
    """Cases without evidence at t0 that got it (with a value) later, with timing flags."""
    t1 = F.col("first_future_gr_time")
    keep = ~F.col("gr_available_at_t0") & F.col("gather_gr_possible") & F.col("gather_gr_has_value") & t1.isNotNull()
    c = state.where(keep).withColumn("t1_time", t1)
    t1, t0 = F.col("t1_time"), F.col("decision_time")
    before = {f"{n}_before_t1": is_true(F.col(c_) < t1) for n, c_ in TIMED_EVENTS.items()}
    same = {f"{n}_same_timestamp_t1": is_true(F.col(c_) == t1) for n, c_ in TIMED_EVENTS.items()}
    return c.withColumns({
        "t1_after_t0": t1 > t0,
        "t1_same_timestamp_as_t0": t1 == t0,
        "n_goods_receipts_by_t1": F.col("n_goods_receipts_before_t0") + 1,
        "elapsed_t0_to_t1_days": _days("decision_time", "t1_time"),
        **before, **same,
        "selected_intervening_event_before_t1": any_of(list(before.values())),
        "selected_same_timestamp_order_ambiguity": any_of(list(same.values())),
    })


def timing_table(candidates: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("event"), F.col(c).alias("at")) for n, c in TIMED_EVENTS.items()])
    long = candidates.select("t1_time", F.inline(rows))
    n = lambda c: F.sum(is_true(c).cast("bigint"))
    at, t1 = F.col("at"), F.col("t1_time")
    return long.groupBy("event").agg(
        F.count("at").alias("observed"), n(at < t1).alias("before_t1"), n(at == t1).alias("same_timestamp_as_t1"),
        n(at > t1).alias("after_t1"), (n(at < t1) / F.count("*") * 100).alias("pct_before_t1"))


def transition_audit(exact: DataFrame, stored: DataFrame) -> DataFrame:
    """Exact second cut against the stored candidate time, as check rows."""
    j = stored.select("case_id", F.col("t1_time").alias("stored_t1")).join(
        exact.select("case_id", "t1_time", "t1_same_timestamp_as_t0", "gr_available_at_t1"), "case_id", "left")
    n = lambda c: F.sum(is_true(c).cast("bigint"))
    found = F.col("t1_time").isNotNull()
    match = is_true(F.col("t1_time") == F.col("stored_t1"))
    one = j.agg(
        F.count("*").alias("candidate_cases"), n(found).alias("exact_transition_rows"), n(match).alias("candidate_t1_time_match"),
        n(found & ~match).alias("candidate_t1_time_mismatch"), n(F.col("t1_same_timestamp_as_t0")).alias("same_timestamp_t0_t1"),
        n(~F.col("gr_available_at_t1")).alias("gr_available_at_t1_false"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("value")) for c in one.columns])))


def order_inversions(events: DataFrame, log: Log) -> DataFrame:
    """Per year: events and events whose time is earlier than the event filed just before.

    The previous event is found per block of 4,096 order numbers inside a case
    plus the last event of the case's block before it, so a long case is split.
    """
    rows = log.normal(events).withColumn("_block", F.floor(F.col("ord") / 4096))
    w = Window.partitionBy("case_id", "_block").orderBy("ord")
    inside = rows.withColumn("_prev", F.lag("ts").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    tails = rows.groupBy("case_id", "_block").agg(F.max_by("ts", "ord").alias("_tail"))
    blocks = Window.partitionBy("case_id").orderBy("_block")
    tails = tails.select("case_id", "_block", F.lag("_tail").over(blocks).alias("_carry"))
    j = inside.join(tails, ["case_id", "_block"])
    prev = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return j.groupBy(F.year("ts").alias("year")).agg(
        F.count("*").alias("events"), F.sum(is_true(F.col("ts") < prev).cast("bigint")).alias("order_inversions"))


def source_audit(events: DataFrame, log: Log, first_day: str, last_day: str) -> DataFrame:
    """Per case: events outside the expected dates, late documents, observed span after t0."""
    salted, _ = prepared(events, log)
    outside = (F.col("ts") < F.lit(first_day).cast("timestamp_ntz")) | (F.col("ts") >= F.lit(last_day).cast("timestamp_ntz"))
    parts = {
        "events_outside": count_where(outside),
        "_po": first_time(log.is_role("create_po")),
        "_last": last_time(F.lit(True)),
    }
    d = combine(salted, parts, CUT).withColumn("decision_time", F.col("cut_ts"))
    return d.select("case_id", "events_outside", is_true(F.col("_po") > F.col("decision_time")).alias("po_after_first_invoice"),
                    _days("decision_time", "_last").alias("observed_span_days"))


def mature(df: DataFrame, end_column: str, start_column: str, days: list[int]) -> DataFrame:
    """Rows with at least d days of calendar follow-up, one copy per d they satisfy."""
    end = df.agg(F.max(end_column)).scalar()
    span = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(start_column).cast("timestamp"))) / F.lit(86_400_000_000.0)
    return df.withColumn("_span", span).withColumn("min_followup_days", F.explode(F.array(*[F.lit(d) for d in days]))).where(
        F.col("_span") >= F.col("min_followup_days")).drop("_span")


def hash_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """First n rows in hash order: a seeded sample without replacement; ranked in even hash buckets, not in one task."""
    ranked = hash_ranks(df, F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key, rank="_rank", limit=n)
    return ranked.select(*df.columns)


def complete_cases(events: DataFrame, case: str, order: str, n: int) -> DataFrame:
    """All events of the first n cases by first appearance."""
    first = prefix(events.groupBy(case).agg(F.min(order).alias("_o")), [F.col("_o"), F.col(case)], rank="_rank")
    return events.join(first.where(F.col("_rank") <= n).select(case), case, "left_semi")
