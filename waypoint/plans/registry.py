from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]
BUILDS: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        if name in BUILDS:
            raise ValueError(f"query {name} registered twice")
        BUILDS[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return keep


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rs(expr: str, digits: int = 6) -> str:
    """The SQL form of ``r``."""
    return f"(round({expr}, {digits}) + 0.0)"


def rounded(df: DataFrame, names: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Round the named double columns, or every double column."""
    chosen = names or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: r(n, digits) for n in chosen})
