"""Connected components: union-find inside partitions, star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.session import ship_package

from .common import stage


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's edges as (node, smallest node joined to it)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            parent.setdefault(a, ra), parent.setdefault(b, rb)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                parent.setdefault(min(ra, rb), min(ra, rb))
    found = [(x, r) for x in parent if (r := root(x)) != x]
    for at in range(0, len(found), 50_000):
        part = found[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["u", "v"])


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node with an edge to another; component is the smallest id reachable.

    Each round reattaches nodes to smaller neighbours' neighbours; the number
    of rounds is logarithmic in the longest chain. Minima are reduced before
    the shuffle; rows are written to the shared folder each round.
    """
    ship_package(edges.sparkSession)
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = stage(pairs.mapInArrow(_forest, "u long, v long").distinct(), "forest")
    mark = None
    while True:
        # every edge runs from the larger node u to the smaller v
        lowest = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("low"))
        large = now.join(lowest, "v", "left").select("u", F.least("v", F.coalesce("low", "v")).alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = stage(low.select("u", F.col("low").alias("v")).unionByName(small).distinct(), "stars")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
