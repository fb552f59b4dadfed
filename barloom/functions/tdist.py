"""Two-sided Student-t p-value for a handful of aggregated rows (Arrow batches)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), tiny) * math.copysign(1.0, 1.0 - (a + b) * x / (a + 1.0))
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return out


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, dof: float) -> float:
    if t is None or dof is None or not math.isfinite(t) or dof <= 0:
        return math.nan
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def p_value(t, dof):
    @F.pandas_udf("double")
    def run(ts: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(a, b) for a, b in zip(ts, ds)])

    p = run(t, dof)
    return F.when(~F.isnan(p), p)


def stars(p):
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")
