"""What a change did to one series, told by others: convex weights of controls, equal weights, and their bands. For one small panel in NumPy; Spark makes the panels and deals them over tasks."""

from __future__ import annotations

import numpy as np

from millrace.functions.distributions import t_quantile

RIDGE, DRAWS, BLOCK, LEVEL = 0.01, 500, 4, 0.90


def simplex_ridge(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The w >= 0 with sum 1 that makes w'Gw - 2b'w least, for positive definite G: an active set that grows by the steepest coordinate and steps back to the border when a weight would turn negative."""
    n = len(b)
    w = np.zeros(n)
    w[int(np.argmin(np.diag(g) - 2 * b))] = 1.0
    free = w > 0
    scale = np.abs(g).max() + np.abs(b).max()
    for _ in range(10 * n + 20):
        slope = g @ w - b
        slope = slope - w @ slope  # by how much a shift of weight to each coordinate lowers the target
        enter = int(np.argmin(np.where(free, np.inf, slope))) if not free.all() else -1
        if enter < 0 or slope[enter] >= -1e-12 * scale:
            return w
        free[enter] = True
        while True:
            at = np.flatnonzero(free)
            k = len(at)
            system = np.zeros((k + 1, k + 1))
            system[:k, :k], system[:k, k], system[k, :k] = g[np.ix_(at, at)], 1, 1
            aim = np.zeros(n)
            aim[at] = np.linalg.solve(system, np.append(b[at], 1.0))[:k]
            low = at[aim[at] <= 0]
            if not len(low):
                w = aim
                break
            step = (w[low] / np.maximum(w[low] - aim[low], 1e-300)).min()
            w = w + step * (aim - w)
            free[low[w[low] <= 1e-14]] = False
            w[~free] = 0.0
    return w


def _fit(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    g = x.T @ x
    return simplex_ridge(g + RIDGE * max(np.trace(g), 1e-12) / len(g) * np.eye(len(g)), x.T @ y)


def paths(rest: np.ndarray, days: int, draws: int, rng: np.random.Generator, block: int = BLOCK) -> np.ndarray:
    """Residuals drawn anew in blocks of neighbours: draws x days."""
    size = min(block, len(rest))
    starts = rng.integers(0, len(rest) - size + 1, (draws, -(-days // size)))
    return rest[(starts[:, :, None] + np.arange(size)).reshape(draws, -1)[:, :days]]


def smape(y: np.ndarray, made: np.ndarray) -> float:
    return float(np.mean(2 * np.abs(y - made) / np.maximum(np.abs(y) + np.abs(made), 1e-300)))


def synthetic(y: np.ndarray, x: np.ndarray, fit: int, hold: int, weigh: np.ndarray, rng: np.random.Generator, draws: int = DRAWS) -> dict:
    """Logarithms y (times) and x (times x controls): `fit` times to fit, `hold` to judge the fit, the rest after the change.

    Each series is taken about its own mean of the fit, so levels need not match. The effect is a ratio of sums weighed by `weigh`, less 1. Every draw of the band makes the fit's values anew from what was fitted and a path
    of residuals, fits weights and level to them, and adds another path after the change; residuals of the fit are widened by its degrees of freedom.
    """
    level, means = y[:fit].mean(), x[:fit].mean(axis=0)
    away = x - means
    w = _fit(y[:fit] - level, away[:fit])
    made = level + away @ w
    after = slice(fit + hold, len(y))
    seen, expected = float(weigh @ np.exp(y[after])), float(weigh @ np.exp(made[after]))
    rest = (y - made)[: fit + hold].copy()
    rest[:fit] *= np.sqrt(fit / max(fit - int((w > 1e-6).sum()) - 1, 1))
    early, late = paths(rest, fit, draws, rng), paths(rest, len(y) - fit - hold, draws, rng)
    sums = np.empty(draws)
    for k in range(draws):
        again = made[:fit] + early[k]
        own = _fit(again - again.mean(), away[:fit])
        sums[k] = weigh @ np.exp(again.mean() + away[after] @ own + late[k])
    low, high = np.quantile(seen / sums - 1, [(1 - LEVEL) / 2, (1 + LEVEL) / 2])
    return {"effect": seen / expected - 1, "low": float(low), "high": float(high), "smape": smape(np.exp(y[fit : fit + hold]), np.exp(made[fit : fit + hold])), "weights": w, "expected": expected}


def trend_error(d: np.ndarray, lags: int) -> tuple[float, float]:
    """The slope of a series on time, and its standard error: Newey and West's with Bartlett weights, or the classical one where that is wider."""
    n = len(d)
    t = np.arange(n) - (n - 1) / 2
    sxx = float(t @ t)
    slope = float(t @ (d - d.mean())) / sxx
    u = d - d.mean() - slope * t
    score = t * u
    wide = float(score @ score) + sum(2 * (1 - k / (lags + 1)) * float(score[k:] @ score[:-k]) for k in range(1, min(lags, n - 1) + 1))
    return slope, max(np.sqrt(max(wide, 0.0) * n / (n - 2)) / sxx, np.sqrt(float(u @ u) / (n - 2) / sxx))


def parallel(y: np.ndarray, x: np.ndarray, fit: int, hold: int, rng: np.random.Generator, most: float = 0.02, draws: int = DRAWS, block: int = BLOCK) -> dict:
    """The same by equal weights of the controls: difference in differences of the logarithms, its band by blocks of residuals, and whether the trend before the change speaks against it.

    The trend passes where its band holds 0 and it stays below `most` a time.
    """
    c, before = x.mean(axis=1), fit + hold
    d = y - c
    delta = float(d[before:].mean() - d[:before].mean())
    slope, error = trend_error(d[:before], block - 1)
    reach = float(t_quantile((1 + LEVEL) / 2, before - 2)) * error
    rest = d[:before] - d[:before].mean()
    drawn = delta + paths(rest, len(y) - before, draws, rng, block).mean(axis=1) - paths(rest, before, draws, rng, block).mean(axis=1)
    low, high = np.exp(np.quantile(drawn, [(1 - LEVEL) / 2, (1 + LEVEL) / 2])) - 1
    held = slice(fit, before)
    return {"effect": float(np.exp(delta) - 1), "low": float(low), "high": float(high), "smape": smape(np.exp(y[held]), np.exp(c[held] + d[:fit].mean())), "slope": slope, "error": float(error), "passed": abs(slope) <= reach and abs(slope) < most}
