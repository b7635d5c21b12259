"""Event logs in the XES XML format, read with Spark's XML source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cases import CASE_ATTRIBUTES, CASE_FLAGS

_PAIR = "array<struct<_key: string, _value: string>>"
_KINDS = ["string", "date", "int", "float", "boolean"]
_ATTRS = ", ".join(f"{k}: {_PAIR}" for k in _KINDS)
SCHEMA = ", ".join(f"`{k}` {_PAIR}" for k in _KINDS) + f", event array<struct<{_ATTRS}>>"


def _attributes(owner: str) -> Column:
    empty = F.array().cast(_PAIR)
    at = lambda k: F.col(f"{owner}.{k}") if owner else F.col(k)
    return F.concat(*[F.coalesce(at(k), empty) for k in _KINDS])


def _read(attrs: Column, key: str) -> Column:
    return F.get(F.filter(attrs, lambda a: a["_key"] == key), 0)["_value"]


def read_log(spark: SparkSession, path: str, case_fields: list[str] | None = None, event_fields: list[str] | None = None) -> DataFrame:
    """One row per event; ``ord`` is the position inside its trace.

    Case fields carry the ``case:`` prefix. Unreadable times become NULL.
    """
    from .tables import utc

    case_fields = case_fields or [c.removeprefix("case:") for c in [*CASE_ATTRIBUTES, *CASE_FLAGS]]
    event_fields = event_fields or ["User", "org:resource"]
    value = "Cumulative net worth (EUR)"
    traces = utc(spark).read.format("xml").option("rowTag", "trace").schema(SCHEMA).load(path)
    own = traces.withColumn("_own", _attributes(""))
    cases = own.select(_read(F.col("_own"), "concept:name").alias("case:concept:name"),
                       *[_read(F.col("_own"), f).alias(f"case:{f}") for f in case_fields], F.posexplode("event").alias("ord", "_event"))
    events = cases.withColumn("_attrs", _attributes("_event"))
    keep = [c for c in cases.columns if c not in ("_event", "ord")]
    return events.select(
        *[F.col(f"`{c}`") for c in keep], "ord", _read(F.col("_attrs"), "concept:name").alias("concept:name"),
        F.try_to_timestamp(_read(F.col("_attrs"), "time:timestamp")).alias("time:timestamp"),
        _read(F.col("_attrs"), value).try_cast("double").alias(value),
        *[_read(F.col("_attrs"), f).alias(f) for f in event_fields])
