"""Exact ranks, running sums and percentiles that never need one big task.

``prefix`` range-partitions on the full order (ties end on a unique column, so a
value held by a third of the rows is still spread), writes the sorted rows once,
and adds each partition's starting offset. A row's place in its partition is
part of the written row, so ranks need no window; running sums need one, over
(group, partition). The offset table has one row per partition and group at
most; it is written and counted first and broadcast only up to SMALL_ROWS rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_true
from ..session import materialize


def null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def scalars(one_row: DataFrame) -> Column:
    """A one-row table as a struct column (scalar subquery, checked to be one row)."""
    return one_row.select(F.struct(*one_row.columns)).scalar()


SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The written rows, with a broadcast hint when their counted number allows it."""
    kept = materialize(df)
    return F.broadcast(kept) if kept.count() <= SMALL_ROWS else kept


def prefix(
    df: DataFrame,
    order: list[Column],
    by: list[str] | None = None,
    sums: list[str] | None = None,
    rank: str = "rank",
    totals: dict[str, str | None] | None = None,
    order_only: list[str] | None = None,
) -> DataFrame:
    """Adds ``rank`` (1-based) and ``cum_<x>`` (inclusive) within each group.

    ``totals`` adds group totals on every row: name -> one of ``sums``, or None
    for the number of rows. They come from the offset table, not from the rows.
    Columns named in ``order_only`` decide the order and are not written.
    """
    by, sums, totals = by or [], sums or [], totals or {}
    ordered = df.orderBy(*[F.col(b).asc_nulls_first() for b in by], *order).drop(*(order_only or []))
    columns = [c for c in df.columns if c not in (order_only or [])]
    placed = materialize(ordered.withColumn("_seq", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_seq", 33)).withColumn("_row", F.col("_seq") % (1 << 33))

    keys = [*by, "_part"]
    per_part = placed.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_row").alias("_first"), *[F.sum(s).alias(f"_t_{s}") for s in sums]
    )
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = per_part.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums],
        *[F.sum("_n" if s is None else f"_t_{s}").over(group).alias(f"_a_{name}") for name, s in totals.items()],
    )
    if sums:
        run = Window.partitionBy(*keys).orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.select("*", *[F.sum(s).over(run).alias(f"_c_{s}") for s in sums])
    start = small(start)
    match = reduce(lambda a, b: a & b, [placed[k].eqNullSafe(start[f"_k_{k}"]) for k in by], placed["_part"] == start["_k__part"])
    return placed.join(start, match).select(
        *columns,
        (F.col("_row") + F.col("_shift")).cast("bigint").alias(rank),
        *[(F.col(f"_b_{s}") + F.coalesce(F.col(f"_c_{s}"), F.lit(0))).alias(f"cum_{s}") for s in sums],
        *[F.col(f"_a_{name}").alias(name) for name in totals],
    )


def hash_ranks(
    df: DataFrame, key: Column, unique: str, by: list[str] | None = None, rank: str = "rank", limit: int | None = None
) -> DataFrame:
    """Row number in the order of a 64-character hash, without a global sort.

    The hash is uniform, so its first three digits cut the rows into 4,096 even
    buckets; ranks inside a bucket are shifted by the counts of earlier buckets.
    With ``limit`` only buckets that can hold one of the first rows are sorted.
    """
    by = by or []
    keyed = df.withColumn("_h", key).withColumn("_hb", F.substring("_h", 1, 3))
    counts = keyed.groupBy(*by, "_hb").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col("_hb").alias("_kb"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    if limit is not None:
        # few buckets are left: they go to the rows, so rows of other buckets are not shuffled
        start = small(start.where(F.col("_n0") < limit))
    elif not by:
        start = F.broadcast(start)  # at most 4,096 rows
    match = reduce(lambda a, b: a & b, [keyed[b].eqNullSafe(start[f"_k_{b}"]) for b in by],
                   keyed["_hb"] == start["_kb"])
    local = Window.partitionBy(*by, "_hb").orderBy("_h", unique)
    placed = keyed.join(start, match).withColumn("_r", F.row_number().over(local))
    out = placed.select(*df.columns, (F.col("_n0") + F.col("_r")).cast("bigint").alias(rank))
    return out if limit is None else out.where(F.col(rank) <= limit)


def percentiles(
    df: DataFrame, value: str | Column, probs: dict[str, float], by: list[str] | None = None, weight: Column | None = None
) -> DataFrame:
    """Exact interpolated percentiles per group (one row in all when ``by`` is empty).

    Equal values are counted before the sort, so hot values cost one row.
    Groups without any value are absent. ``weight`` is a whole-number repeat count.
    """
    return weighted_percentiles(df, value, probs, by, {"": F.lit(1) if weight is None else weight})


def weighted_percentiles(df: DataFrame, value: str | Column, probs: dict[str, float], by: list[str] | None, weights: dict[str, Column]) -> DataFrame:
    """As ``percentiles``, under several weights from one sort: a column <name><weight> each, NULL where a weight is zero throughout."""
    by = by or []
    x = F.col(value) if isinstance(value, str) else value
    own = {s: f"_w{i}" for i, s in enumerate(weights)}
    counts = df.select(*by, x.cast("double").alias("_x"), *[w.cast("bigint").alias(own[s]) for s, w in weights.items()]).where(F.col("_x").isNotNull())
    counts = counts.groupBy(*by, "_x").agg(*[F.sum(w).alias(w) for w in own.values()])
    placed = prefix(counts, [F.col("_x")], by=by, sums=list(own.values()), rank="_rank", totals={f"_total{w}": w for w in own.values()})

    def value_at(position: Column, w: str) -> Column:
        here = (position >= F.col(f"cum_{w}") - F.col(w)) & (position < F.col(f"cum_{w}"))
        return F.max(F.when(here, F.col("_x")))

    aggs = []
    for s, w in own.items():
        for name, p in probs.items():
            at = F.lit(float(p)) * (F.col(f"_total{w}") - 1)
            aggs += [
                value_at(F.floor(at), w).alias(f"_lo_{name}{s}"),
                value_at(F.ceil(at), w).alias(f"_hi_{name}{s}"),
                F.max(at - F.floor(at)).alias(f"_f_{name}{s}"),
            ]
    rows = placed.groupBy(*by).agg(*aggs)
    return rows.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in [f"{name}{s}" for s in weights for name in probs]
        ],
    )


def grid_column(fields: dict[str, list]) -> Column:
    """A literal parameter list as an exploded struct column."""
    n = len(next(iter(fields.values())))
    rows = [F.struct(*[F.lit(v[i]).alias(k) for k, v in fields.items()]) for i in range(n)]
    return F.explode(F.array(*rows))


def at_thresholds(
    df: DataFrame,
    score: Column,
    thresholds: list[float],
    sums: dict[str, Column],
    by: list[str] | None = None,
    name: str = "threshold",
) -> DataFrame:
    """``sum(x) where score >= t`` for every t, and ``all_<x>`` over all rows.

    Rows are counted once per step between thresholds; only that small table
    meets the threshold list.
    """
    from ..functions.scalars import steps_reached

    by = by or []
    ts = sorted(float(t) for t in thresholds)
    steps = df.select(*by, steps_reached(score, ts).alias("_step"), *[c.alias(n) for n, c in sums.items()])
    steps = steps.groupBy(*by, "_step").agg(*[F.sum(n).alias(n) for n in sums])
    grid = steps.withColumn("_g", grid_column({"i": list(range(1, len(ts) + 1)), "t": ts}))
    reached = F.col("_step") >= F.col("_g.i")
    return grid.groupBy(*by, F.col("_g.t").alias(name)).agg(
        *[F.coalesce(F.sum(F.when(reached, F.col(n))), F.lit(0)).alias(n) for n in sums],
        *[F.sum(n).alias(f"all_{n}") for n in sums],
    )


def prefix_by_value(df: DataFrame, value: str, sums: list[str], by: list[str] | None = None, descending: bool = True, totals: dict[str, str | None] | None = None) -> DataFrame:
    """One row per distinct value with its own sums and running sums over values."""
    by = by or []
    per_value = df.groupBy(*by, value).agg(*[F.sum(s).alias(s) for s in sums])
    order = F.col(value).desc() if descending else F.col(value).asc()
    return prefix(per_value, [order], by=by, sums=sums, totals=totals)


def count_if(c: Column) -> Column:
    return F.sum(F.when(is_true(c), 1).otherwise(0)).cast("bigint")


def with_totals(df: DataFrame, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Group totals on every row; the totals are aggregated first and joined back."""
    if not by:
        one = df.agg(*[c.alias(n) for n, c in aggs.items()])
        packed = df.withColumn("_one", one.select(F.struct(*aggs)).scalar())
        return packed.select(*df.columns, *[F.col("_one")[n].alias(n) for n in aggs])
    t = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    t = small(t.select(*[F.col(b).alias(f"_t_{b}") for b in by], *aggs))
    match = reduce(lambda a, b: a & b, [df[b].eqNullSafe(t[f"_t_{b}"]) for b in by])
    return df.join(t, match).drop(*[f"_t_{b}" for b in by])
