"""Short daily series, many at a time: the rows of a matrix. Seasonal-trend smoothing by local regression (Cleveland et al. 1990), forecasts from it, and penalised segmentation."""

from __future__ import annotations

import numpy as np

PERIOD, SEASONAL, TREND, LOW, PASSES = 7, 15, 21, 9, 5
#: Last trend points through which the forecast's line goes.
POINTS = 14


def filled(y: np.ndarray) -> np.ndarray:
    """A series with its gaps (NaN) on straight lines, edges on the nearest value; all NaN where nothing is known."""
    known = np.isfinite(y)
    if not known.any():
        return np.full(len(y), np.nan)
    at = np.arange(len(y))
    return np.interp(at, at[known], y[known])


def _weights(n: int, at: np.ndarray, span: int) -> np.ndarray:
    """Tricube weights of the points 0..n-1 for each place: the `span` nearest count; where there are fewer, the width grows by half of what is missing."""
    away = np.abs(at[:, None] - np.arange(n)[None, :]).astype(float)
    width = np.sort(away, axis=1)[:, min(span, n) - 1] + max(span - n, 0) / 2
    return np.clip(1 - (away / width[:, None]) ** 3, 0, None) ** 3


def loess(y: np.ndarray, trust: np.ndarray, at: np.ndarray, span: int, degree: int) -> np.ndarray:
    """Local means (degree 0) or lines (degree 1) of each row of y at the places, with a weight of trust for each point."""
    n = y.shape[1]
    w, x = _weights(n, at, span).T, np.arange(n)
    total = np.maximum(trust @ w, 1e-300)
    mean = (trust * y) @ w / total
    if not degree:
        return mean
    centre, square = (trust * x) @ w / total, (trust * x * x) @ w / total
    spread = square - centre**2
    slope = np.where(spread > (0.001 * n) ** 2, ((trust * x * y) @ w / total - centre * mean) / np.where(spread > 0, spread, 1), 0.0)
    return mean + slope * (at - centre)


def _moving(y: np.ndarray, width: int) -> np.ndarray:
    sums = np.cumsum(np.concatenate([np.zeros((len(y), 1)), y], axis=1), axis=1)
    return (sums[:, width:] - sums[:, :-width]) / width


def stl(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal part of each row: a constant for each weekday, smoothed over the weeks, and a trend of three weeks; PASSES more passes in which far residuals lose their weight."""
    n = y.shape[1]
    at, trust = np.arange(n), np.ones_like(y)
    trend, seasonal = np.zeros_like(y), np.zeros_like(y)
    for left in range(PASSES, -1, -1):
        for _ in range(2):
            rest = y - trend
            cycle = np.empty((len(y), n + 2 * PERIOD))
            for day in range(PERIOD):
                own = rest[:, day::PERIOD]
                cycle[:, day::PERIOD] = loess(own, trust[:, day::PERIOD], np.arange(-1, own.shape[1] + 1), SEASONAL, 0)
            low = loess(_moving(_moving(_moving(cycle, PERIOD), PERIOD), 3), np.ones_like(y), at, LOW, 1)
            seasonal = cycle[:, PERIOD : PERIOD + n] - low
            trend = loess(y - seasonal, trust, at, TREND, 1)
        if left:
            away = np.abs(y - trend - seasonal)
            width = 6 * np.median(away, axis=1, keepdims=True)
            trust = np.where(width > 0, np.clip(1 - (away / np.where(width > 0, width, 1)) ** 2, 0, None) ** 2, 1.0)
    return trend, seasonal


def forecast(y: np.ndarray, days: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (without gaps): the next days, and the residuals of the fit. The trend goes on along the line through its last POINTS values; each weekday repeats its last seasonal value."""
    n = y.shape[1]
    trend, seasonal = stl(y)
    x = np.arange(max(n - POINTS, 0), n) - (n - 1)
    last = trend[:, -len(x) :]
    slope = ((x - x.mean()) * (last - last.mean(axis=1, keepdims=True))).sum(axis=1) / ((x - x.mean()) ** 2).sum()
    ahead = np.arange(1, days + 1)
    line = last.mean(axis=1)[:, None] + slope[:, None] * (ahead - x.mean())[None, :]
    return line + seasonal[:, n - PERIOD + (ahead - 1) % PERIOD], y - trend - seasonal


def segments(x: np.ndarray, penalty: float, least: int) -> list[int]:
    """Where a series breaks: the segmentation into runs of at least so many points with the least sum of squares about the runs' means plus a penalty for each break. Exact dynamic programme.

    A start that cannot win against the best segmentation up to t is dropped for ends from t + least on, where a break at t is allowed (Killick et al. 2012).
    """
    n = len(x)
    if n < 2 * least:
        return []
    one, two = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    cost = np.full(n + 1, np.inf)
    cost[0], before = -penalty, np.zeros(n + 1, int)
    until = np.full(n + 1, n + 1)
    starts = np.array([0])
    for end in range(least, n + 1):
        if end - least >= least:
            starts = np.append(starts, end - least)
        starts = starts[until[starts] > end]
        sizes = end - starts
        inside = two[end] - two[starts] - (one[end] - one[starts]) ** 2 / sizes
        totals = cost[starts] + inside + penalty
        k = int(np.argmin(totals))
        cost[end], before[end] = totals[k], starts[k]
        lost = starts[(cost[starts] + inside > cost[end]) & (until[starts] > end + least)]
        until[lost] = end + least
    out, end = [], int(before[n])
    while end > 0:
        out.append(end)
        end = int(before[end])
    return out[::-1]
