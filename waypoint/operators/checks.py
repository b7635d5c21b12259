"""Join cardinality, probability and invariant checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_of, is_true
from .ordered import count_if


def probability_checks(df: DataFrame, probs: list[str]) -> DataFrame:
    cols = [F.col(p) for p in probs]
    total = reduce(lambda a, b: a + b, cols)
    return df.agg(
        F.count("*").alias("n"),
        count_if(any_of([c.isNull() for c in cols])).alias("n_null"),
        count_if(any_of([(c < 0) | (c > 1) for c in cols])).alias("n_out_of_range"),
        count_if(F.abs(total - 1) > 1e-6).alias("n_bad_sum"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def assert_empty(violations: DataFrame, message: str) -> None:
    """Looks at one row only; the rest of the table is never brought to the driver."""
    bad = violations.take(1)
    if bad:
        raise ValueError(f"{message}: {bad[0].asDict()}")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], validate: str, how: str = "left", marker: str | None = None) -> DataFrame:
    """Equi-join after checking that the sides named unique by ``validate`` are.

    ``validate`` is many_to_one, one_to_many or one_to_one; ``marker`` adds a
    boolean telling whether the row found a partner.
    """
    if validate in ("one_to_one", "one_to_many"):
        assert_empty(duplicate_keys(left, keys), "left keys repeat")
    if validate in ("one_to_one", "many_to_one"):
        assert_empty(duplicate_keys(right, keys), "right keys repeat")
    if marker is None:
        return left.join(right, keys, how)
    out = left.join(right.withColumn(marker, F.lit(True)), keys, how)
    return out.withColumn(marker, is_true(F.col(marker)))


def conflicts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys holding more than one distinct value (missing counts as a value).

    Two steps: distinct values per key are bounded by the domain of the column,
    so a key with very many rows never meets one task whole.
    """
    long = df.select(key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    return (
        long.distinct().groupBy(key, "column").agg(F.count("*").alias("n_values"))
        .where(F.col("n_values") > 1)
    )


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str], sample: int | None = None) -> DataFrame:
    out = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")
    return out.orderBy(*keys).limit(sample) if sample else out


def check_rows(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per named (condition, measure): rows seen, rows that break the condition, and the sum of the measure.

    The sum ties a check to the values it looked at, so a check over wrong or missing rows differs too.
    """
    one = [F.count("*").alias("rows")]
    for name, (condition, measure) in checks.items():
        one += [count_if(~is_true(condition)).alias(f"_v_{name}"), F.coalesce(F.sum(measure.cast("double")), F.lit(0.0)).alias(f"_m_{name}")]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col("rows"), F.col(f"_v_{n}").alias("violations"), F.col(f"_m_{n}").alias("measured")) for n in checks])
    return df.agg(*one).select(F.inline(rows))


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same row for uniqueness: rows seen, keys that repeat, and the number of keys."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per_key.agg(F.sum("_n").alias("rows"), count_if(F.col("_n") > 1).alias("violations"), F.count("*").cast("double").alias("measured")).select(F.lit("unique").alias("check"), "rows", "violations", "measured")
