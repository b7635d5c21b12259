"""Secret scans with linking of multipart credentials, in DataFrame operations only.

Base kinds are reported wherever their check holds: assign (a named value of 8
characters or more), access (an AKIA identifier of 16 or more) and hex (32 or
more hex digits). Weak parts are no finding by themselves: a 40-character
key-like token (weak_secret), a short hex token (weak_hex) and a service
address (endpoint). An interval join links parts within a scope of SCOPE code
points on either side: a weak secret or hex token is reported where an access
identifier lies in scope, an endpoint where both an identifier and a secret do.

Defined cases: a null text counts as empty and gives no spans; offsets are code
points; repeated rows give equal results; an empty table gives an empty
result; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .pii import base_spans, count_kind
from .spans import find_if, tagged, written

# The patterns of the base kinds, written to run in linear time.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]++"
# The patterns of weak parts.
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-]))(?=[^a-z]{0,39}[a-z])(?=[^A-Z]{0,39}[A-Z])(?=[^0-9]{0,39}[0-9])[A-Za-z0-9+/]{40}"
WEAK_HEX = r"(?<![A-Za-z0-9])(?=[0-9a-f]{16,31}(?![A-Za-z0-9]))(?=[a-f]{0,31}[0-9])[0-9a-f]{16,31}"
ENDPOINT = r"https?://[A-Za-z0-9.:-]++(?:/[A-Za-z0-9._~%/-]*+)?"
SCOPE = 200
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "weak_secret", "weak_hex", "endpoint"]


def parts(text: Column) -> dict[str, Column]:
    """Spans of every kind, weak ones too."""
    name = text.rlike("(?i)passw|secret|token|api_?key")
    value = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1))
    size = lambda s: s["end"] - s["start"]
    access = F.contains(text, F.lit("AKIA"))
    return {
        "assign": F.filter(find_if(text, name, ASSIGN), lambda s: value(s) >= 8),
        "access": F.filter(find_if(text, access, ACCESS), lambda s: size(s) >= 16),
        "hex": F.filter(find_if(text, text.rlike("[0-9a-f]{32}"), HEX), lambda s: size(s) >= 32),
        # weak parts count only beside an identifier, so other texts are not searched
        "weak_secret": find_if(text, access, WEAK_SECRET),
        "weak_hex": find_if(text, access, WEAK_HEX),
        "endpoint": find_if(text, access & F.contains(text, F.lit("://")), ENDPOINT),
    }


def _blocks(spans: Column) -> Column:
    """The blocks of SCOPE code points that a span's scope can reach; without repeats."""
    reach = F.transform(spans, lambda s: F.sequence(F.floor(s["start"] / SCOPE) - 1, F.floor(s["end"] / SCOPE) + 1))
    return F.array_distinct(F.flatten(reach))


def in_scope(spans: Column, others: Column) -> Column:
    """Of ``spans`` those with one of ``others`` at most SCOPE code points away.

    An interval join inside the document: the blocks that a span touches and
    those that a partner reaches are matched by hashing, and only spans in matched blocks are compared, up to the first partner.
    """
    touched = lambda s: F.sequence(F.floor(s["start"] / SCOPE), F.floor(s["end"] / SCOPE))
    matched = F.array_intersect(F.flatten(F.transform(spans, touched)), _blocks(others))
    near = lambda s, o: (o["start"] <= s["end"] + SCOPE) & (s["start"] <= o["end"] + SCOPE)
    return let(matched, lambda m: F.filter(spans, lambda s: F.arrays_overlap(m, touched(s)) & F.exists(others, lambda o: near(s, o))))


def _clear_of(weak: Column, base: Column) -> Column:
    return F.filter(weak, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secrets``: (start, rank, end, kind, score) of every reported span, sorted.

    A weak part that overlaps a base span is left out: it is reported already.
    """
    found = parts(F.col("_body"))
    rows = docs.withColumn("_body", F.coalesce(F.col(text), F.lit(""))).withColumns({f"_{k}": v for k, v in found.items()})
    rows = rows.withColumns({f"_{k}": tagged(F.col(f"_{k}"), k, i) for i, k in enumerate(KINDS)})
    rows = rows.withColumn("_base", F.concat(*[F.col(f"_{k}") for k in BASE]))
    rows = rows.withColumns({f"_{k}": in_scope(_clear_of(F.col(f"_{k}"), F.col("_base")), F.col("_access")) for k in ("weak_secret", "weak_hex")})
    rows = rows.withColumn("_secret", F.concat("_assign", "_hex", "_weak_secret", "_weak_hex"))
    rows = rows.withColumn("_endpoint", in_scope(in_scope(_clear_of(F.col("_endpoint"), F.col("_base")), F.col("_access")), F.col("_secret")))
    out = rows.withColumn("secrets", F.array_sort(F.concat("_base", "_weak_secret", "_weak_hex", "_endpoint")))
    return out.drop("_body", "_base", "_secret", *[f"_{k}" for k in KINDS])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``find_secrets``' output."""
    spans = F.col("secrets")
    return docs.select(
        "doc_id",
        *[count_kind(spans, k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(base_spans(spans, BASE)), 256).alias("base_sha256"),
        written(spans).alias("spans"),
    )
