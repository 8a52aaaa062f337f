"""Special functions Spark lacks: tails of the normal and Student's t distribution, log factorials."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz's method), vectorised."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-14):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|); NaN where t or df is."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    if ok.any():
        v, x = df[ok], df[ok] / (df[ok] + t[ok] ** 2)
        a, b = v / 2, np.full_like(v, 0.5)
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(np.maximum(x, 1e-320)) + b * np.log1p(-np.minimum(x, 1 - 1e-16)))
        flip = x > (a + 1) / (a + b + 2)
        p = np.where(flip, 1 - front * _beta_fraction(b, a, 1 - x) / b, front * _beta_fraction(a, b, x) / a)
        out[ok] = np.where(t[ok] == 0, 1.0, np.clip(p, 0, 1))
    out[np.isinf(t) & ~np.isnan(df)] = 0.0
    return out


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def z_pvalue(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else x)


def log_factorial(n: Column) -> Column:
    """ln n!, inside the JVM: a sum up to 20, beyond that Stirling's series (error under 1e-13)."""
    x = (n + 1).cast("double")
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(20), n.cast("int")))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return F.when(n <= 20, small).otherwise(series)


def hypergeom_tail(k: Column, in_set: Column, drawn: Column, total: Column) -> Column:
    """P(X >= k) of drawing ``drawn`` from ``total`` of which ``in_set`` count."""
    choose = lambda n, r: log_factorial(n) - log_factorial(r) - log_factorial(n - r)
    lo, hi = F.greatest(k, drawn - (total - in_set)), F.least(in_set, drawn)
    terms = F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda i: F.exp(choose(in_set, i) + choose(total - in_set, drawn - i) - choose(total, drawn)))
    return F.when(k <= 0, 1.0).when(k > hi, 0.0).otherwise(F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))
