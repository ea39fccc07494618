"""Tail probabilities for tests: Student's t, chi-squared and the normal distribution, as numpy pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated from the front (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
    return out


_LOG_GAMMA = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    x = np.clip(x, 0, 1)
    front = np.exp(_LOG_GAMMA(a + b) - _LOG_GAMMA(a) - _LOG_GAMMA(b) + a * np.log(np.maximum(x, 1e-300)) + b * np.log(np.maximum(1 - x, 1e-300)))
    near = x < (a + 1) / (a + b + 2)
    one = front * _beta_fraction(a, b, np.where(near, x, 0.5)) / a
    two = 1 - front * _beta_fraction(b, a, np.where(near, 0.5, 1 - x)) / b
    return np.where(x == 0, 0.0, np.where(x == 1, 1.0, np.where(near, one, two)))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def chi2_tail(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail, by the series of the incomplete gamma function or its continued fraction."""
    a, x = df / 2, np.maximum(x / 2, 0)
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - _LOG_GAMMA(a))
    total, term, n = 1 / a, 1 / a, a.copy()
    for _ in range(500):
        n = n + 1
        term = term * x / n
        total = total + term
    b = x + 1 - a
    c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for i in range(1, 500):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
    return np.where(x < a + 1, 1 - front * total, front * h)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided; null or without degrees of freedom: null."""
    ok = t.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = t_two_sided(t[ok].to_numpy(float), df[ok].to_numpy(float))
    return out


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    ok = x.notna() & (df > 0)
    out = pd.Series(np.nan, index=x.index)
    if ok.any():
        out[ok] = chi2_tail(x[ok].to_numpy(float), df[ok].to_numpy(float))
    return out


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if pd.notna(v) else np.nan)
