"""Registered queries: each one reads the given tables and has a plain SQL twin
wherever SQL can say the same thing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def all_queries():
    from . import case_queries, curve_queries, model_queries, policy_queries, population_queries, scalar_queries, selection_queries  # noqa: F401
    from .registry import BUILDS, SQL

    return dict(BUILDS), dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    builds, _ = all_queries()
    return builds["e13_case_state"](spark, sf_dir)
