"""Spans of regular expressions in texts, as column expressions.

Patterns must be written so that Java's matcher runs in linear time and
without recursion: runs are possessive, and a lookbehind (or the end of the
last match) says where a run can begin.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

BLOCK = 128
SPAN = "array<struct<start:int,end:int,value:string>>"


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value), code points, end exclusive.

    The matches and the gaps between them give the places; running sums are
    kept per block of matches, so that many matches in a long text stay cheap.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def places(both: Column) -> Column:
        found, between = both["m"], both["g"]
        n = F.size(found)
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.length(F.get(between, i)).alias("g"), F.length(F.get(found, i)).alias("m"), F.get(found, i).alias("v")))
        return let(pairs, lambda z: let(totals(z, n), lambda t: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(z, t, i))))

    def totals(z: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(z, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x["g"] + x["m"]))

    def at(z: Column, t: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        base = F.aggregate(F.slice(t, F.lit(1), block), F.lit(0), lambda a, x: a + x)
        start = F.aggregate(F.slice(z, block * BLOCK + 1, i - block * BLOCK), base, lambda a, x: a + x["g"] + x["m"]) + F.get(z, i)["g"]
        return F.struct(start.alias("start"), (start + F.get(z, i)["m"]).alias("end"), F.get(z, i)["v"].alias("value"))

    return let(F.struct(matches.alias("m"), gaps.alias("g")), lambda b: F.when(F.size(b["m"]) > 0, places(b)).otherwise(F.array().cast(SPAN)))


def find_if(text: Column, needed: Column, pattern: str) -> Column:
    """``find`` where the cheap test holds, else no spans."""
    return F.when(needed, find(text, pattern)).otherwise(F.array().cast(SPAN))


def tagged(spans: Column, kind: str, rank: int, score: Column | None = None) -> Column:
    """Spans as (start, rank, end, kind, score), which sort by start and then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(1.0).alias("score")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start, then kind in the order of its rank."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
