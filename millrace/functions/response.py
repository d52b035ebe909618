"""Response curves: spend that lingers (adstock), saturates (Hill) and adds to a base, fitted by bounded least squares. Small arrays in NumPy, one unit at a time; Spark deals the units over tasks.

Values are in units of their own median (spend x, revenue y) or mean (base b): a_t = x_t + theta a_(t-1), y_t = beta a_t^S / (K^S + a_t^S) + gamma b_t.
"""

from __future__ import annotations

import numpy as np

NAMES = ("beta", "k", "s", "theta", "gamma")
#: What each parameter may be.
LOW, HIGH = np.array([1e-6, 0.2, 0.5, 0.0, 0.0]), np.array([100.0, 5.0, 3.0, 0.7, 100.0])


def adstock(x: np.ndarray, theta: float, before: float) -> tuple[np.ndarray, np.ndarray]:
    """The lingering spend and its derivative by theta."""
    a, slope = np.empty(len(x)), np.empty(len(x))
    held, moved = before, 0.0
    for t, v in enumerate(x):
        moved = held + theta * moved
        held = v + theta * held
        a[t], slope[t] = held, moved
    return a, slope


def curve(p: np.ndarray, x: np.ndarray, b: np.ndarray, before: float) -> tuple[np.ndarray, np.ndarray]:
    """Values and their derivatives by the five parameters (times x 5)."""
    beta, k, s, theta, gamma = p
    a, lingers = adstock(x, theta, before)
    a = np.maximum(a, 1e-12)
    rate = 1 / (1 + (k / a) ** s)
    bend = rate * (1 - rate)
    return beta * rate + gamma * b, np.column_stack([rate, -beta * bend * s / k, beta * bend * np.log(a / k), beta * bend * s / a * lingers, b])


def fit(x: np.ndarray, y: np.ndarray, b: np.ndarray, before: float, start: np.ndarray | None = None, steps: int = 200) -> dict:
    """Least squares by Levenberg and Marquardt's steps, cut at the bounds; parameters that lie at a bound and would leave it stay out of the step."""
    p = np.array([max(2 * y.mean(), 1e-3), 1.0, 1.5, 0.1, 0.1]) if start is None else np.array(start, float)
    p = np.clip(p, LOW + 1e-9, HIGH - 1e-9)
    made, jac = curve(p, x, b, before)
    rest = made - y
    loss, damp, done = float(rest @ rest), 1e-3, False
    for _ in range(steps):
        slope = jac.T @ rest
        free = ~(((p <= LOW) & (slope > 0)) | ((p >= HIGH) & (slope < 0)))
        if not free.any() or np.abs(slope[free]).max() < 1e-10 * max(loss, 1e-12):
            done = True
            break
        j = jac[:, free]
        normal = j.T @ j
        move = np.zeros(len(p))
        move[free] = -np.linalg.solve(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12)), slope[free])
        tried = np.clip(p + move, LOW, HIGH)
        new, new_jac = curve(tried, x, b, before)
        new_loss = float((new - y) @ (new - y))
        if new_loss < loss:
            small = loss - new_loss < 1e-10 * loss
            p, made, jac, rest, loss, damp = tried, new, new_jac, new - y, new_loss, max(damp / 3, 1e-12)
            if small:
                done = True
                break
        else:
            damp *= 4
            if damp > 1e12:
                done = True
                break
    spread = float(((y - y.mean()) ** 2).sum())
    return {"p": p, "fitted": made, "r2": 1 - loss / spread if spread > 0 else np.nan, "done": done, "condition": float(np.linalg.cond(jac))}


def blocks(n: int, size: int, draws: int, seed: int) -> np.ndarray:
    """Places of residuals for each draw, in blocks of neighbours; units that share the seed share the draws."""
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, max(n - size + 1, 1), (draws, -(-n // size)))
    return np.minimum((starts[:, :, None] + np.arange(size)).reshape(draws, -1)[:, :n], n - 1)


def refits(x: np.ndarray, y: np.ndarray, b: np.ndarray, before: float, base: dict, at: np.ndarray) -> np.ndarray:
    """Parameters fitted to the base's curve and its residuals in the drawn order: draws x 5."""
    rest = y - base["fitted"]
    return np.array([fit(x, base["fitted"] + rest[k], b, before, base["p"], 60)["p"] for k in at])


def marginal(p: np.ndarray, spend: float) -> float:
    """What one more unit of a constant spend brings in the end, lingering included."""
    beta, k, s, theta, _ = p
    a = max(spend / (1 - theta), 1e-12)
    rate = 1 / (1 + (k / a) ** s)
    return float(beta * rate * (1 - rate) * s / a / (1 - theta))
