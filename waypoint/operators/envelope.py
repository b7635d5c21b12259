"""Parameter grids without a copy of a row per grid point.

Over a grid of costs or thresholds the least-loss action of a row changes at a
few values only: its losses are straight lines, and which is lowest is a lower
envelope. So rows fall into few kinds, each with its own list of actions over
the grid. Rows are counted and summed per kind in one aggregate; only kinds meet
the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = {"EXECUTE": "E", "GATHER": "G", "ESCALATE": "H", "ABSTAIN": "A"}


def letter(action: Column, later: Column | None = None) -> Column:
    """One letter per action; with ``later`` a gathered row has the small letter of what it does afterwards."""
    out = F.lit("-")
    for name, mark in LETTERS.items():
        out = F.when(action == name, F.lit(mark)).otherwise(out)
    return out if later is None else F.when(action == "GATHER", F.lower(letter(later))).otherwise(out)


def kinds(df: DataFrame, letters: list[Column], sums: dict[str, Column]) -> DataFrame:
    """(actions, n, sums): rows by their list of actions over the grid."""
    rows = df.select(F.concat(*letters).alias("actions"), *[c.cast("double").alias(n) for n, c in sums.items()])
    return rows.groupBy("actions").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in sums])


def on_grid(cells: DataFrame, points: list[dict[str, float]]) -> DataFrame:
    """The kinds at every grid point: its fields, ``act`` (one letter), n and the sums."""
    at = F.array(*[F.struct(F.lit(i + 1).alias("_i"), *[F.lit(v).alias(k) for k, v in p.items()]) for i, p in enumerate(points)])
    return cells.select("*", F.inline(at)).withColumn("act", F.expr("substring(actions, _i, 1)")).drop("actions", "_i")


def count_of(*letters: str) -> Column:
    return F.sum(F.when(F.col("act").isin(*letters), F.col("n")).otherwise(0))
