"""Distribution functions on plain floats."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1 or math.isnan(x):
        return x if math.isnan(x) else float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, max(0.0, front * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_part(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else math.nan


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_part(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f >= 0 and d1 > 0 and d2 > 0 else math.nan


def chi2_tail(x: float, df: float) -> float:
    """Upper regularised gamma function of df/2 and x/2."""
    a, y = df / 2, x / 2
    if y <= 0 or df <= 0:
        return 1.0
    scale = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= y / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = y + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


@lru_cache(4096)
def chi2_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, max(10.0, 4 * df)
    while chi2_tail(hi, df) > 1 - p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, df) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return (last - (count - 1) / 2)[inverse]


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, inverse of X'X, residual sum of squares."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    return beta, np.linalg.pinv(x.T @ x), float(rest @ rest)


def nelder_mead(f, start: np.ndarray, steps: int = 2000, size: float = 0.25, tol: float = 1e-9) -> tuple[np.ndarray, float]:  # noqa: ANN001
    n = len(start)
    points = np.vstack([start, start + np.diag(np.where(start == 0, size, np.maximum(np.abs(start) * size, 0.05)))])
    values = np.array([f(p) for p in points])
    for _ in range(steps):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if abs(values[-1] - values[0]) < tol * (abs(values[0]) + tol):
            break
        centre = points[:-1].mean(0)
        tried = centre + (centre - points[-1])
        value = f(tried)
        if value < values[0]:
            further = centre + 2 * (centre - points[-1])
            v = f(further)
            points[-1], values[-1] = (further, v) if v < value else (tried, value)
        elif value < values[-2]:
            points[-1], values[-1] = tried, value
        else:
            inner = centre + 0.5 * ((tried if value < values[-1] else points[-1]) - centre)
            v = f(inner)
            if v < min(value, values[-1]):
                points[-1], values[-1] = inner, v
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], float(values[best])
