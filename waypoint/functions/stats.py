"""Binomial tail probabilities over small result tables.

Spark has no incomplete beta function, and summing u terms per row would grow
with the data, so the tail is a vectorised continued fraction inside a pandas
UDF. It only ever sees candidate rows (thresholds, grid nodes), never cases.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _fraction(p: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (p + q) * x / (p + 1.0))
    total = d.copy()
    steps = int(200 + 8 * math.sqrt(float(np.max(np.maximum(p, q), initial=1.0))))
    for m in range(1, steps):
        for num in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1.0 / guard(1.0 + num * d)
            c = guard(1.0 + num / c)
            change = c * d
            total = total * change
        if np.all(np.abs(change - 1.0) < 1e-15):
            return total
    if np.any(np.abs(change - 1.0) > 1e-10):
        raise ArithmeticError("the continued fraction did not converge")
    return total


def incomplete_beta(p: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    p, q, x = (np.asarray(v, dtype=float) for v in (p, q, x))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp((_lgamma(p + q) - _lgamma(p) - _lgamma(q)).astype(float) + p * np.log(x) + q * np.log1p(-x))
        swap = x > (p + 1.0) / (p + q + 2.0)
        a, b, y = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1.0 - x, x)
        part = front * _fraction(a, b, y) / a
    return np.clip(np.where(swap, 1.0 - part, part), 0.0, 1.0)


def lower_tail(u: np.ndarray, n: np.ndarray, a: np.ndarray) -> np.ndarray:
    """P(X <= u) for X ~ Binomial(n, a); an empty selection counts as 1."""
    u, n, a = (np.asarray(v, dtype=float) for v in (u, n, a))
    out = np.where(u < 0, 0.0, 1.0)
    ok = (n > 0) & (u < n) & (u >= 0)
    if ok.any():
        out[ok] = incomplete_beta(n[ok] - u[ok], u[ok] + 1.0, 1.0 - a[ok])
    return out


def exact_bound(u: np.ndarray, n: np.ndarray, alpha: float, upper: bool) -> np.ndarray:
    """Clopper-Pearson bound by bisection on the tail."""
    u, n = np.asarray(u, dtype=float), np.asarray(n, dtype=float)
    lo, hi = np.zeros(len(u)), np.ones(len(u))
    for _ in range(60):
        mid = (lo + hi) / 2
        tail = lower_tail(u, n, mid) if upper else 1.0 - np.where(u > 0, lower_tail(u - 1, n, mid), 0.0)
        go_up = tail > alpha / 2 if upper else tail < alpha / 2
        lo, hi = np.where(go_up, mid, lo), np.where(go_up, hi, mid)
    edge = (u >= n) if upper else (u <= 0)
    out = np.where(edge, 1.0 if upper else 0.0, (lo + hi) / 2)
    return np.where(n > 0, out, np.nan)


def binomial_tail(u: Column, n: Column, a: Column) -> Column:
    def tail(us: pd.Series, ns: pd.Series, caps: pd.Series) -> pd.Series:
        return pd.Series(lower_tail(us.to_numpy(), ns.to_numpy(), caps.to_numpy()))

    return F.pandas_udf(tail, "double")(u.cast("double"), n.cast("double"), a.cast("double"))


def exact_interval(u: Column, n: Column, alpha: float) -> Column:
    """Struct of the lower and upper Clopper-Pearson bound."""
    def interval(us: pd.Series, ns: pd.Series) -> pd.DataFrame:
        a, b = us.to_numpy(dtype=float), ns.to_numpy(dtype=float)
        return pd.DataFrame({"lower": exact_bound(a, b, alpha, False), "upper": exact_bound(a, b, alpha, True)})

    return F.pandas_udf(interval, "struct<lower: double, upper: double>")(u.cast("double"), n.cast("double"))
