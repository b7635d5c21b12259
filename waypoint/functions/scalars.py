"""Scalar clean-up and arithmetic on columns.

Missing means NULL everywhere: NaN becomes NULL when a number is read, and a
rule over a missing value is false, never unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
NATURAL_TYPES = ["", "NONE", "NATURAL", "NO_INTERVENTION"]
SAFE = "SAFE_TO_EXECUTE"
UNSAFE = "NOT_SAFE_TO_EXECUTE"
AMBIGUOUS = "AMBIGUOUS"
SAFE_WORDS = [SAFE, "SAFE", "TRUE", "1"]
UNSAFE_WORDS = [UNSAFE, "UNSAFE", "NOT_SAFE", "FALSE", "0"]
TRUE_WORDS = ["true", "1", "yes", "y"]
FALSE_WORDS = ["false", "0", "no", "n"]
SEVERITY = {
    "NONE": 0,
    "MISSING_GR": 1,
    "MISSING_PO_VALUE": 2,
    "MISSING_INVOICE_VALUE": 2,
    "PO_VALUE_CONTRADICTION": 2,
    "INVOICE_VALUE_CONTRADICTION": 2,
    "MULTI_FIELD_MISSING": 3,
}
SCORE_BANDS = [0.50, 0.80, 0.90, 0.95, 0.97, 0.99]
SCORE_BAND_LABELS = [
    "<0.50", "0.50-0.80", "0.80-0.90", "0.90-0.95", "0.95-0.97", "0.97-0.99", ">=0.99",
]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def require_columns(df: DataFrame, names: list[str], label: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"{label}: missing required columns: {', '.join(missing)}")
    return df


def is_true(c: Column) -> Column:
    """A condition as a strict boolean: NULL counts as false."""
    return F.coalesce(c, F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [is_true(c) for c in conditions], F.lit(False))


def number(c: Column | str) -> Column:
    """Text or number to double; bad text and NaN become NULL."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def parse_time(c: Column | str) -> Column:
    return F.try_to_timestamp(col(c))


def parse_bool(c: Column | str) -> Column:
    """true/1/yes/y and false/0/no/n; anything else is NULL."""
    word = F.lower(F.trim(col(c).cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def truthy(c: Column | str) -> Column:
    """Text or boolean as a strict flag: true/1/yes/y/t in any case, everything else false.

    These are the words Spark's own boolean cast reads, so a boolean column costs nothing.
    """
    return F.coalesce(col(c).try_cast("boolean"), F.lit(False))


def upper_text(c: Column | str, keep_null: bool = False) -> Column:
    text = F.upper(F.trim(col(c).cast("string")))
    return text if keep_null else F.coalesce(text, F.lit(""))


def safety_label(c: Column | str) -> Column:
    word = upper_text(c)
    return (
        F.when(word.isin(SAFE_WORDS), SAFE)
        .when(word.isin(UNSAFE_WORDS), UNSAFE)
        .otherwise(AMBIGUOUS)
    )


def synthetic_word(c: Column | str) -> Column:
    word = F.lower(F.trim(col(c).cast("string")))
    return (
        F.when(word.isin([*TRUE_WORDS, "synthetic"]), "SYNTHETIC")
        .when(word.isin([*FALSE_WORDS, "natural"]), "NATURAL")
        .otherwise(col(c).cast("string"))
    )


def exposure(c: Column | str) -> Column:
    return F.coalesce(F.abs(number(c)), F.lit(0.0))


def category(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c).cast("string")), F.lit("__NA__"))


def micros(c: Column | str) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def days_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(86_400_000_000.0)


def relative_gap(value: Column | str, base: Column | str, zero: float = 1e-12) -> Column:
    """|value - base| / |base|, NULL when the base is (nearly) zero.

    ``zero=0.0`` guards an exact zero only.
    """
    size = F.abs(col(base))
    return F.abs(col(value) - col(base)) / F.when(size > zero, size)


def month_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def right_closed_bin(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval ``(a, b]`` holding x; one label more than edges."""
    out = F.when(x <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(x <= edge, label)
    return out.when(x > edges[-1], labels[-1])


def left_closed_bin(x: Column, edges: list[float], labels: list[str], missing: str) -> Column:
    out = F.when(x.isNull(), missing)
    for edge, label in zip(edges, labels):
        out = out.when(x < edge, label)
    return out.otherwise(labels[-1])


def score_band(x: Column | str) -> Column:
    return left_closed_bin(number(x), SCORE_BANDS, SCORE_BAND_LABELS, "MISSING")


def steps_reached(x: Column, edges: list[float]) -> Column:
    """How many ascending edges x has reached: 0 .. len(edges); NULL reads as 0."""
    parts = [is_true(x >= F.lit(float(e))).cast("int") for e in edges]
    return reduce(lambda a, b: a + b, parts)


def consequence(value: Column, ref: Column | None, mode: str = "LOG") -> Column:
    """Cost of a wrong execution relative to a train-only reference value."""
    v = F.coalesce(F.abs(value), F.lit(0.0))
    if mode == "UNIFORM":
        return F.lit(1.0)
    # a missing or non-positive reference is an error: a null cost would drop out of means unseen
    good = F.when(ref > 0, ref).otherwise(F.raise_error(F.lit("the consequence reference must be positive")).cast("double"))
    if mode == "LOG":
        return F.log1p(v) / F.log1p(good)
    if mode == "LINEAR":
        return v / good
    if mode == "CAPPED":
        return F.least(v / good, F.lit(10.0))
    raise ValueError(f"unknown consequence mode {mode}")


def entropy(probs: list[Column]) -> Column:
    """Entropy over k classes scaled to [0, 1]; probabilities clipped at 1e-15."""
    from math import log

    terms = [
        (lambda p: p * F.log(p))(F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0))) for p in probs
    ]
    return -reduce(lambda a, b: a + b, terms) / F.lit(log(len(probs)))


def first_largest(names: list[str], probs: list[Column]) -> Column:
    """Name of the largest probability, the first one on ties."""
    arr = F.array(*probs)
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(arr, F.array_max(arr)).cast("int"))


def intervention_family(c: Column | str) -> Column:
    """Later rules win, so they are tested first."""
    z = upper_text(c)
    return (
        F.when(z.contains("SEVERE") | z.contains("MULTI"), "SEVERE_EVIDENCE_LOSS")
        .when(z.contains("CONTRAD") | z.contains("PERTURB"), "CONTRADICTION")
        .when(z.contains("MISSING") | z.contains("HIDE"), "MISSINGNESS")
        .when(z.isin(NATURAL_TYPES), "NATURAL")
        .otherwise("OTHER")
    )


def synthetic_flag(df: DataFrame) -> Column:
    """Explicit flag column if the table has one, else read from the type text."""
    for name in ("synthetic_intervention", "is_synthetic_intervention"):
        if name in df.columns:
            return truthy(name)
    if "intervention_type" in df.columns:
        return ~upper_text("intervention_type").isin(NATURAL_TYPES)
    return F.lit(False)


def hash_number(key: Column, seed: str, digits: int) -> Column:
    text = F.concat(F.lit(seed), key.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("bigint")


def hash_half(key: Column, seed: int | str) -> Column:
    return (hash_number(key, str(seed), 8) % 2).cast("int")


def hash_unit(key: Column, seed: str) -> Column:
    return hash_number(key, seed, 12) / F.lit(float(16**12))


def differs(a: Column, b: Column, null_counts: bool = False) -> Column:
    """Did the field change? ``null_counts`` also reports missing on both sides."""
    changed = ~a.eqNullSafe(b)
    return changed | (a.isNull() & b.isNull()) if null_counts else changed


def number_changed(a: Column, b: Column, atol: float, rtol: float) -> Column:
    one_sided = a.isNull() != b.isNull()
    return one_sided | is_true(F.abs(a - b) > atol + rtol * F.abs(b))


def severity_rank(c: Column | str) -> Column:
    out = None
    for name, rank in SEVERITY.items():
        out = F.when(col(c) == name, rank) if out is None else out.when(col(c) == name, rank)
    return out


def evidence_complete(required: Column | str, available: Column | str) -> Column:
    return ~truthy(required) | truthy(available)


def calendar_regime(t: Column, spans: list[tuple[str, str, str]]) -> Column:
    """``spans`` holds (label, from, before); a time in no span is ``unused``."""
    out = None
    for label, start, stop in spans:
        inside = (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(stop).cast("timestamp_ntz"))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out.otherwise("unused")
