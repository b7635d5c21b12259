"""Isotonic calibration over range partitions.

Equal scores are added up first, so a score that a third of the rows share is
one row. The rows are range-partitioned by (group, score); each task pools
adjacent violators of its range into blocks. Pooling is mergeable: pooling the
blocks of two neighbours gives what pooling their rows would give. So blocks are
dealt anew, by other range borders, and pooled again until no border parts two
blocks in the wrong order; every such round lessens the blocks. Up to TASK_ROWS
blocks are settled by one task. All groups (value bins, classes) are fitted in
the same pass, and only range borders and at most CUTS scores per group reach
the driver.

The fitted map is a table of blocks. A score meets its block by an equi-join on
a cell, found by binary search among at most CUTS starts, and is interpolated
between the end of its block and the start of the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_true
from ..session import materialize, ship_package
from .ordered import SMALL_ROWS, prefix

#: Distinct scores or blocks that one task settles.
TASK_ROWS = 200_000
#: Cells per group by which scores meet blocks.
CUTS = 4096

_BLOCKS = "grp int, lo double, hi double, total double, weight double, part int"
_PLACED = "grp int, place bigint, lo double, hi double, value double, next_lo double, next_value double"


def _stacks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The blocks (lo, hi, total, weight), with rising means, of each group of sorted (grp, lo, hi, total, weight) rows."""
    group, blocks = None, []
    for batch in batches:
        for g, lo, hi, total, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != group:
                if blocks:
                    yield group, blocks
                group, blocks = g, []
            while blocks and blocks[-1][2] * weight >= total * blocks[-1][3]:
                before = blocks.pop()
                lo, total, weight = before[0], before[2] + total, before[3] + weight
            blocks.append((lo, hi, total, weight))
    if blocks:
        yield group, blocks


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"grp": pa.int32(), "part": pa.int32(), "place": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.float64())) for n, v in columns.items()], list(columns))


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a range."""
    part = TaskContext.get().partitionId()
    for group, blocks in _stacks(batches):
        lo, hi, total, weight = map(list, zip(*blocks, strict=True))
        yield _batch({"grp": [group] * len(lo), "lo": lo, "hi": hi, "total": total, "weight": weight, "part": [part] * len(lo)})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map itself, where one task sees all blocks."""
    for group, blocks in _stacks(batches):
        lo, hi, total, weight = map(list, zip(*blocks, strict=True))
        value = [t / w for t, w in zip(total, weight, strict=True)]
        yield _batch({"grp": [group] * len(lo), "place": list(range(len(lo))), "lo": lo, "hi": hi, "value": value, "next_lo": [*lo[1:], None], "next_value": [*value[1:], None]})


def _violated(blocks: DataFrame) -> bool:
    """Whether two neighbouring blocks of different tasks stand in the wrong order."""
    ends = blocks.groupBy("grp", "part").agg(
        F.min(F.struct("lo", "total", "weight")).alias("first"), F.max(F.struct("lo", "total", "weight")).alias("last")
    )
    # one row per task and group
    rows = sorted(ends.collect(), key=lambda r: (r["grp"], r["first"]["lo"]))
    return any(a["grp"] == b["grp"] and a["last"]["total"] * b["first"]["weight"] >= b["first"]["total"] * a["last"]["weight"] for a, b in zip(rows, rows[1:], strict=False))


def fitted_map(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(grp, lo, hi, total, weight) rows of single scores as the map of the isotonic fit, written."""
    ship_package(rows.sparkSession)
    names = ["grp", "lo", "hi", "total", "weight"]
    now, round_ = materialize(rows.select(*names)), 0
    while True:
        n = -(-now.count() // task_rows)
        if n <= 1:
            return materialize(now.repartition(1).sortWithinPartitions("grp", "lo").mapInArrow(_finish, _PLACED))
        # a changing number of tasks moves the borders from round to round
        dealt = now.repartitionByRange(n + round_ % 2, "grp", "lo").sortWithinPartitions("grp", "lo")
        now = materialize(dealt.select(*names).mapInArrow(_pool, _BLOCKS))
        if not _violated(now):
            break
        now, round_ = now.select(*names), round_ + 1
    ranked = prefix(now.select("grp", "lo", "hi", (F.col("total") / F.col("weight")).alias("value")), [F.col("lo")], by=["grp"], rank="place")
    ranked = materialize(ranked.withColumn("place", F.col("place") - 1))
    after = ranked.select(F.col("grp").alias("_grp"), (F.col("place") - 1).alias("_place"), F.col("lo").alias("next_lo"), F.col("value").alias("next_value"))
    table = ranked.join(after, (ranked["grp"] == after["_grp"]) & (ranked["place"] == after["_place"]), "left").drop("_grp", "_place")
    return materialize(table.select("grp", "place", "lo", "hi", "value", "next_lo", "next_value"))


@dataclass
class Isotonic:
    """Blocks (grp, place, lo, hi, value, next_lo, next_value) and the starts that cut them into cells."""

    blocks: DataFrame
    size: int
    step: dict[int, int]
    cuts: dict[int, list[float]]

    def apply(self, df: DataFrame, scores: dict[int, str], names: dict[int, str], group: Column | None = None) -> DataFrame:
        """Adds the value of ``scores[g]`` under the map of group g as ``names[g]``, within 0 and 1.

        With ``group`` a row is judged by its own group's map alone and all
        ``names`` are the same column. Missing scores have no value.
        """
        marked = df.withColumns({f"_s{g}": F.col(c).cast("double") for g, c in scores.items()})
        wide = {g: self.cuts[g] for g in scores if self.cuts[g]}
        if wide:
            inf = float("inf")
            cut = Bucketizer(splitsArray=[[-inf, *c, inf] for c in wide.values()], inputCols=[f"_s{g}" for g in wide], outputCols=[f"_b{g}" for g in wide], handleInvalid="keep")
            marked = cut.transform(marked)
        cells = {g: F.col(f"_b{g}").cast("int") if g in wide else F.lit(0) for g in scores}
        if group is not None:
            score, cell = F.lit(None).cast("double"), F.lit(None).cast("int")
            for g in scores:
                score, cell = F.when(group == g, F.col(f"_s{g}")).otherwise(score), F.when(group == g, cells[g]).otherwise(cell)
            out = self._join(marked.withColumns({"_g": group.cast("int"), "_s": score, "_c": cell}), next(iter(names.values())))
        else:
            out = marked
            for g, name in names.items():
                out = self._join(out.withColumns({"_g": F.lit(g), "_s": F.col(f"_s{g}"), "_c": cells[g]}), name)
        return out.drop(*[f"_{x}{g}" for g in scores for x in "sb"])

    def _join(self, rows: DataFrame, name: str) -> DataFrame:
        step = F.lit(1)
        for g, s in self.step.items():
            step = F.when(F.col("grp") == g, F.lit(s)).otherwise(step)
        b = self.blocks.withColumn("cell", F.floor(F.col("place") / step).cast("int"))
        b = F.broadcast(b) if self.size <= SMALL_ROWS else b
        s = F.col("_s")
        inside = ((F.col("place") == 0) | (s >= F.col("lo"))) & (F.col("next_lo").isNull() | (s < F.col("next_lo")))
        joined = rows.join(b, (F.col("_g") == F.col("grp")) & (F.col("_c") == F.col("cell")) & inside & s.isNotNull() & ~F.isnan(s), "left")
        between = F.col("value") + (F.col("next_value") - F.col("value")) * (s - F.col("hi")) / (F.col("next_lo") - F.col("hi"))
        value = F.when((s <= F.col("hi")) | F.col("next_lo").isNull(), F.col("value")).otherwise(between)
        clipped = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
        return joined.withColumn(name, clipped).drop("_g", "_s", "_c", *b.columns)


def fit(df: DataFrame, scores: dict[int, str], positive: dict[int, Column], group: Column | None = None, task_rows: int = TASK_ROWS) -> Isotonic:
    """Isotonic maps of all groups: of ``scores[g]`` against ``positive[g]``, over all rows or, with ``group``, over the group's rows."""
    pairs = F.array(*[
        F.struct(F.lit(g).alias("grp"), F.col(c).cast("double").alias("lo"), is_true(positive[g]).cast("double").alias("y"), (F.lit(True) if group is None else group == g).alias("own"))
        for g, c in scores.items()
    ])
    long = df.select(F.inline(pairs)).where("own and lo is not null and not isnan(lo)")
    counts = long.groupBy("grp", "lo").agg(F.sum("y").alias("total"), F.count("*").cast("double").alias("weight"))
    table = fitted_map(counts.select("grp", "lo", F.col("lo").alias("hi"), "total", "weight"), task_rows)
    sizes = {r["grp"]: r["n"] for r in table.groupBy("grp").agg((F.max("place") + 1).alias("n")).collect()}  # one row per group
    step = {g: max(1, -(-sizes.get(g, 0) // CUTS)) for g in scores}
    every = F.lit(1)
    for g, s in step.items():
        every = F.when(F.col("grp") == g, F.lit(s)).otherwise(every)
    cuts: dict[int, list[float]] = {g: [] for g in scores}
    if any(n > 1 for n in sizes.values()):
        starts = table.where((F.col("place") > 0) & (F.col("place") % every == 0)).select("grp", "lo").collect()  # at most CUTS rows per group
        for r in sorted(starts):
            cuts[r["grp"]].append(r["lo"])
    return Isotonic(table, sum(sizes.values()), step, cuts)
