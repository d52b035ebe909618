"""Beta, beta-binomial, Student and negative binomial distributions: arrays in NumPy, and the same as columns by Arrow functions.

All rest on the regularised incomplete beta function, by its continued fraction (modified Lentz), and on its inverse by bisection. Parameters outside their range give NaN (null as a column).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_log_gamma = np.frompyfunc(math.lgamma, 1, 1)
_TINY = 1e-300
STEPS = 20_000


def log_gamma(x) -> np.ndarray:
    return np.asarray(_log_gamma(np.asarray(x, float)), float)


def log_beta(a, b) -> np.ndarray:
    return log_gamma(a) + log_gamma(b) - log_gamma(np.add(a, b))


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function; quick for x < (a + 1) / (a + b + 2)."""
    away = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / away(1 + even * d), away(1 + even / c)
        out = out * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / away(1 + odd * d), away(1 + odd / c)
        out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return out


def beta_cdf(x, a, b) -> np.ndarray:
    """P(X <= x) of a beta distribution: the regularised incomplete beta function."""
    x, a, b = (np.array(v, float) for v in np.broadcast_arrays(x, a, b))
    right = (a > 0) & (b > 0) & np.isfinite(x)
    inside = right & (x > 0) & (x < 1)
    p, q, t = np.where(inside, a, 1.0), np.where(inside, b, 1.0), np.where(inside, x, 0.5)
    turned = t > (p + 1) / (p + q + 2)
    p, q, t, u = np.where(turned, q, p), np.where(turned, p, q), np.where(turned, 1 - t, t), np.where(turned, t, 1 - t)
    part = np.exp(p * np.log(t) + q * np.log(u) - log_beta(p, q)) / p * _fraction(p, q, t)
    out = np.clip(np.where(turned, 1 - part, part), 0, 1)
    return np.where(right, np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out)), np.nan)


def beta_quantile(p, a, b) -> np.ndarray:
    """The x with P(X <= x) = p."""
    p, a, b = (np.array(v, float) for v in np.broadcast_arrays(p, a, b))
    low, high = np.zeros_like(p), np.ones_like(p)
    for _ in range(110):
        mid = (low + high) / 2
        below = beta_cdf(mid, a, b) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where((a > 0) & (b > 0) & (p >= 0) & (p <= 1), np.where(p == 0, 0.0, np.where(p == 1, 1.0, (low + high) / 2)), np.nan)


def t_cdf(t, df) -> np.ndarray:
    t, df = (np.array(v, float) for v in np.broadcast_arrays(t, df))
    tail = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return np.where(t < 0, tail, 1 - tail)


def t_quantile(p, df) -> np.ndarray:
    """Student's t with df degrees of freedom; its square over df + its square is beta(1/2, df/2)."""
    p, df = (np.array(v, float) for v in np.broadcast_arrays(p, df))
    y = beta_quantile(np.abs(2 * p - 1), 0.5, df / 2)
    with np.errstate(divide="ignore"):
        return np.sign(p - 0.5) * np.sqrt(df * y / (1 - y))


def beta_binomial_pmf(k, n, a, b) -> np.ndarray:
    """P(X = k) of n trials whose rate is beta(a, b)."""
    k, n, a, b = (np.array(v, float) for v in np.broadcast_arrays(k, n, a, b))
    right = (k >= 0) & (k <= n) & (a > 0) & (b > 0)
    c = np.where(right, k, 0.0)
    with np.errstate(invalid="ignore"):
        choose = log_gamma(n + 1) - log_gamma(c + 1) - log_gamma(n - c + 1)
        return np.where(right, np.exp(choose + log_beta(c + a, n - c + b) - log_beta(a, b)), 0.0)


def beta_binomial_bounds(low: float, high: float, n: int, a: float, b: float) -> tuple[int, int]:
    """The least counts whose P(X <= k) reaches `low` and `high`: n + 1 terms by their ratios, for one n."""
    k = np.arange(n)
    ratios = (n - k) * (k + a) / ((k + 1) * (n - k - 1 + b))
    logs = log_gamma(n + b) + log_gamma(a + b) - log_gamma(b) - log_gamma(n + a + b) + np.concatenate(([0.0], np.cumsum(np.log(ratios))))
    cdf = np.cumsum(np.exp(logs))
    at = np.minimum(np.searchsorted(cdf, [low, high]), n)
    return int(at[0]), int(at[1])


def negative_binomial_cdf(k, r, p) -> np.ndarray:
    """P(X <= k) failures before r successes of probability p."""
    k, r, p = (np.array(v, float) for v in np.broadcast_arrays(k, r, p))
    return np.where(k < 0, 0.0, beta_cdf(p, r, np.floor(np.maximum(k, 0)) + 1))


def column(f, *columns: Column | float) -> Column:
    """A function of this module over columns: one call for each Arrow batch. Null or wrong parameters give null."""

    def apply(values: pd.DataFrame) -> pd.Series:
        return pd.Series(f(*(values[c].to_numpy(float) for c in values.columns)))

    parts = [(F.lit(float(c)) if isinstance(c, (int, float)) else c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]
    made = F.pandas_udf(apply, "double")(F.struct(*parts))
    return F.when(~F.isnan(made), made)
