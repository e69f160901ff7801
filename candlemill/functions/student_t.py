"""Student-t tail and quantile as Arrow UDFs (no scipy on the executors)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

NORMAL_975 = 1.959963984540054  # fixed value: 97.5% quantile of the normal distribution


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_tail(t: float, df: float) -> float:
    """P(T > t)."""
    half = 0.5 * incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


def t_quantile(p: float, df: float) -> float:
    """Value with P(T <= value) = p, by bisection on the tail."""
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    low, high = 0.0, 1.0
    while t_tail(high, df) > 1.0 - p:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        if t_tail(mid, df) > 1.0 - p:
            low = mid
        else:
            high = mid
        if high - low <= 1e-15 * high:
            break
    return 0.5 * (low + high)


@F.pandas_udf(T.DoubleType())
def _tail_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = np.full(len(t), np.nan)
    out[ok.to_numpy()] = [t_tail(float(a), float(b)) for a, b in zip(t[ok], df[ok])]
    return pd.Series(out).where(~np.isnan(out), None)


@F.pandas_udf(T.DoubleType())
def _quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    known = {k: t_quantile(*k) for k in set(zip(p, df)) if k[1] > 0}
    return pd.Series([known.get(k) for k in zip(p, df)], dtype="float64")


def mean_ci(n: Column, mean: Column, sd: Column, confidence: float = 0.95) -> tuple[Column, Column, Column]:
    """(mean, low, high). NULL mean without data, NULL bounds for one value, a point when sd is 0."""
    critical = _quantile_udf(F.lit(0.5 + confidence / 2.0), (n - 1).cast("double"))
    half = critical * sd / F.sqrt(n.cast("double"))
    low = F.when(n < 2, F.lit(None).cast("double")).when(sd == 0, mean).otherwise(mean - half)
    high = F.when(n < 2, F.lit(None).cast("double")).when(sd == 0, mean).otherwise(mean + half)
    return mean, low, high


def positive_mean_p(n: Column, mean: Column, sd: Column) -> Column:
    """One-sided p-value of a positive mean: 1 for n < 2, 0 or 1 when every value is equal."""
    t = F.try_divide(mean, sd / F.sqrt(n.cast("double")))
    p = _tail_udf(t, (n - 1).cast("double"))
    return (
        F.when(n < 2, F.lit(1.0))
        .when(sd == 0, F.when(mean > 0, F.lit(0.0)).otherwise(F.lit(1.0)))
        .otherwise(F.coalesce(p, F.lit(1.0)))
    )
