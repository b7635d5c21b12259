"""Personal data: patterns propose spans, checksums confirm them, context scores them.

DataFrame operations only. Four base kinds are always reported when their
check holds: email, ip (parts at most 255), card (Luhn) and phone (10 to 15
digits). Further kinds start from a lower score and are reported only when the
score reaches THRESHOLD: iban (mod-97 confirms it on its own), ssn and
national phone numbers (only with a context word near by).

Defined cases: a null text counts as empty and gives no spans; offsets are code
points; repeated rows give equal results; an empty table gives an empty
result; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import find_if, written

# The patterns of the base kinds. Each equals the plain pattern
# named beside it; possessive runs and the run's beginning keep it linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
CARD = r"[0-9](?:[ -]?[0-9])++"  # [0-9]([\x20-]?[0-9])+
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"  # \+[0-9][\x20().0-9-]+[0-9]
# The patterns of the further kinds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
# Words that raise the score of a kind when they stand just before it.
CONTEXT = {
    "email": "e-?mail|mail|contact|address",
    "ip": "ip|host|server|address",
    "card": "card|credit|visa|mastercard|amex|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|tax id",
    "local": "phone|tel|call|mobile|fax",
}
NEAR = 40
THRESHOLD = 0.6
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn", "local"]
# Score before context; a confirmed checksum is part of it.
START = {"email": 0.8, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "local": 0.3}
LIFT = 0.35


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where the last digit checks the others; ``number`` holds digits only."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda c: c.cast("int"))
    weighed = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(account: Column) -> Column:
    """True where the account number, country and check digits moved to the end, leaves 1 modulo 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def byte_parts(value: Column) -> Column:
    """True where all four numbers of the address are at most 255."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def _between(value: Column, low: int, high: int) -> Column:
    return F.length(digits(value)).between(low, high)


def proposals(text: Column) -> dict[str, Column]:
    """Confirmed spans of each kind."""
    digit = text.rlike("[0-9]")
    return {
        "email": find_if(text, F.contains(text, F.lit("@")), EMAIL),
        "ip": F.filter(find_if(text, text.rlike(r"[0-9]\.[0-9]"), IP), lambda s: byte_parts(s["value"])),
        "card": F.filter(find_if(text, text.rlike(r"[0-9][0-9 -]{12}"), CARD), lambda s: F.when(_between(s["value"], 14, 19), luhn(digits(s["value"]))).otherwise(False)),
        "phone": F.filter(find_if(text, F.contains(text, F.lit("+")), PHONE), lambda s: _between(s["value"], 10, 15)),
        "iban": F.filter(find_if(text, digit & text.rlike("[A-Z]{2}[0-9]{2}"), IBAN), lambda s: mod97(s["value"])),
        "ssn": find_if(text, text.rlike("[0-9]-[0-9]{2}-[0-9]"), SSN),
        "local": find_if(text, text.rlike(r"[0-9]{3}[.-][0-9]{4}"), LOCAL),
    }


def scored(text: Column, spans: Column, kind: str) -> Column:
    """Spans of one kind as (start, rank, end, kind, score)."""
    near = lambda s: F.substr(text, F.greatest(s["start"] - (NEAR - 1), F.lit(1)), F.least(s["start"], F.lit(NEAR)))
    lift = lambda s: F.when(near(s).rlike(rf"(?i)\b(?:{CONTEXT[kind]})\b"), LIFT).otherwise(0.0)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.least(F.lit(START[kind]) + lift(s), F.lit(1.0)).alias("score")))


def _clear_of(extra: Column, base: Column) -> Column:
    return F.filter(extra, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii``: (start, rank, end, kind, score) of every reported span, sorted.

    A further kind is left out where it overlaps a base span.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = proposals(F.col("_body"))
    rows = docs.withColumn("_body", body).withColumns({f"_{k}": v for k, v in kinds.items()})
    rows = rows.withColumns({f"_{k}": scored(F.col("_body"), F.col(f"_{k}"), k) for k in KINDS})
    base = F.concat(*[F.col(f"_{k}") for k in BASE])
    extra = F.filter(F.concat(*[F.col(f"_{k}") for k in KINDS[len(BASE):]]), lambda s: s["score"] >= THRESHOLD)
    rows = rows.withColumn("_base", base).withColumn("pii", F.array_sort(F.concat("_base", _clear_of(extra, F.col("_base")))))
    return rows.drop("_body", "_base", *[f"_{k}" for k in KINDS])


def base_spans(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``find_pii``'s output."""
    spans = F.col("pii")
    return docs.select(
        "doc_id",
        *[count_kind(spans, k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(base_spans(spans, BASE)), 256).alias("base_sha256"),
        written(spans).alias("spans"),
    )
