"""Policy parameter files and parameter grids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import Params

SCHEMA = """
status string,
gate_delta double,
costs struct<c_G: double, c_H: double, c_A: double, rho_H: double>,
risk struct<tau0: double, beta0: double, tau1: double, beta1: double>,
grid struct<tau0: array<double>, beta0: array<double>, tau1: array<double>, beta1: array<double>>
"""


def read_spec(spark: SparkSession, path: str, status: str = "FROZEN", delta: float = 0.05) -> DataFrame:
    """One-row typed parameter table; a spec that is not frozen or has another delta is refused."""
    spec = spark.read.schema(SCHEMA).json(path, multiLine=True)
    row = spec.select("status", "gate_delta", F.count("*").over(_all()).alias("n")).take(1)
    if not row or row[0]["n"] != 1:
        raise ValueError("a spec file holds exactly one object")
    if row[0]["status"] != status:
        raise ValueError(f"spec status is {row[0]['status']}, expected {status}")
    if row[0]["gate_delta"] is None or abs(row[0]["gate_delta"] - delta) > 1e-12:
        raise ValueError(f"gate delta is {row[0]['gate_delta']}, expected {delta}")
    return spec


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def reference_params(spec: DataFrame) -> Params:
    r = spec.first()
    return Params(r.costs.c_G, r.costs.c_H, r.costs.c_A, r.costs.rho_H, r.risk.tau0, r.risk.beta0, r.risk.tau1, r.risk.beta1)


def frontier_grid(spec: DataFrame) -> DataFrame:
    """Every combination of the four lists, one row per grid point."""
    out = spec.select("grid.*")
    for name in ("tau0", "beta0", "tau1", "beta1"):
        out = out.withColumn(name, F.explode(name))
    return out


def cost_points(c_g: list[float], c_h: list[float], c_a: list[float]) -> list[tuple[float, float, float]]:
    """Cost combinations with c_G < c_H < c_A."""
    return [(g, h, a) for g, h, a in product(c_g, c_h, c_a) if g < h < a]
