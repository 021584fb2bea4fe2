"""Rank-based rhythm detection: Kendall's tau of a series with templates of many periods and lags."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from tidewheel.functions import stats


def triangle(t: np.ndarray, period: float, lag: float, peak: float) -> np.ndarray:
    x = np.mod(t - lag, period) / period
    return np.where(x < peak, x / peak, (1 - x) / (1 - peak))


def cosine(t: np.ndarray, period: float, lag: float, peak: float = 0.5) -> np.ndarray:
    return np.cos(2 * np.pi * (t - lag) / period)


def _ties(x: np.ndarray) -> np.ndarray:
    n = np.unique(np.round(x, 9), return_counts=True)[1].astype(float)
    return n[n > 1]


def _moments(n: np.ndarray) -> tuple[float, float, float, float]:
    return (n * (n - 1)).sum(), (n * (n - 1) * (n - 2)).sum(), (n * (n - 1) * (2 * n + 5)).sum(), (n * (n - 1)).sum() / 2


@lru_cache(64)
def _exact(n: int) -> tuple[float, ...]:
    """Number of permutations of n by inversions, as shares."""
    row = np.ones(1)
    for k in range(2, n + 1):
        row = np.convolve(row, np.ones(k) / k)
    return tuple(row)


def p_value(s: float, n: int, x_ties: np.ndarray, y_ties: np.ndarray) -> float:
    """Two-sided p of a concordance sum: exact without ties up to 33 points, else normal with correction for ties."""
    if not len(x_ties) and not len(y_ties) and n <= 33:
        share = np.array(_exact(n))
        total = n * (n - 1) / 2
        sums = total - 2 * np.arange(len(share))
        return float(min(1.0, share[np.abs(sums) >= abs(s) - 1e-9].sum()))
    a2, a3, a5, _ = _moments(x_ties)
    b2, b3, b5, _ = _moments(y_ties)
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - a5 - b5) / 18 + a2 * b2 / (2 * m) + (a3 * b3 / (9 * m * (n - 2)) if n > 2 else 0)
    return math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0


class Templates:
    """Signs of all pairs of times under every template, made once for each set of times."""

    def __init__(self, t: np.ndarray, tests: Sequence[tuple[float, float, float]], kind: str) -> None:
        self.t, self.tests, self.n = t, tests, len(t)
        shape = triangle if kind == "triangle" else cosine
        self.values = np.array([np.round(shape(t, p, lag, peak), 9) for p, lag, peak in tests])
        self.ties = [_ties(v) for v in self.values]
        pairs = self.n * (self.n - 1) / 2
        self.untied = np.array([pairs - _moments(x)[3] for x in self.ties])

    def sums(self, ys: np.ndarray) -> np.ndarray:
        """Concordance sums (series x tests) of series at these times."""
        out = np.zeros((len(ys), len(self.tests)))
        for i in range(self.n - 1):  # a row of pairs at a time keeps memory in proportion to the points
            out += np.sign(ys[:, i + 1 :] - ys[:, i, None]) @ np.sign(self.values[:, i + 1 :] - self.values[:, i, None]).T
        return out


@lru_cache(8)
def _templates(times: bytes, tests: tuple[tuple[float, float, float], ...], kind: str) -> Templates:
    return Templates(np.frombuffer(times), tests, kind)


def tests(periods: Sequence[float], peaks: Sequence[float] = (0.5,), step: float = 1.0) -> tuple[tuple[float, float, float], ...]:
    """(period, lag, peak) in the order of periods, peaks and lags."""
    return tuple((float(p), float(lag), float(a)) for p in periods for a in peaks for lag in np.arange(0, p, step))


def detect(
    t: np.ndarray, y: np.ndarray, periods: Sequence[float] = tuple(range(20, 29)), peaks: Sequence[float] = (0.5,), step: float = 1.0,
    kind: str = "triangle", permutations: int = 0, seed: int = 42, by_period: bool = False,
) -> list[dict[str, float]]:
    """The best test (the first of the least p), or the best of every period.

    p_bonferroni multiplies by the number of tests; p_bh is the step-up value over all tests. With permutations the
    p-values are the share of permuted series whose greatest tau is as large.
    """
    order = np.argsort(t, kind="stable")
    t, r = t[order].astype(float), stats.ranks(y[order])
    if len(np.unique(r)) < 2:
        raise ValueError("constant series")
    grid = tests(periods, peaks, step)
    tp = _templates(t.tobytes(), grid, kind)
    y_ties = _ties(r)
    n = len(t)
    pairs = n * (n - 1) / 2
    scale = np.sqrt(np.maximum(tp.untied * (pairs - _moments(y_ties)[3]), 1e-12))
    s = tp.sums(r[None])[0]
    tau = s / scale
    p = np.array([p_value(x, n, ties, y_ties) for x, ties in zip(s, tp.ties, strict=True)])
    rank = np.argsort(np.argsort(p, kind="stable"), kind="stable") + 1
    up = np.minimum.accumulate((np.sort(p) * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    null = None
    if permutations:
        rng = np.random.default_rng(seed)
        shuffled = np.array([rng.permutation(r) for _ in range(permutations)])
        null = np.abs(tp.sums(shuffled) / scale).max(1)
    lo, hi = np.percentile(y, [10, 90])
    out = []
    for group in [[i for i, g in enumerate(grid) if g[0] == q] for q in dict.fromkeys(g[0] for g in grid)] if by_period else [range(len(grid))]:
        i = min(group, key=lambda k: (p[k], k))
        period, lag, peak = grid[i]
        top = lag + (peak * period if kind == "triangle" else 0.0) + (period / 2 if tau[i] < 0 else 0)
        raw, bon, bh = p[i], min(1.0, p[i] * len(p)), min(1.0, float(up[rank[i] - 1]))
        if null is not None:
            raw = bon = bh = (1 + (null >= abs(tau[i]) - 1e-12).sum()) / (permutations + 1)
        out.append({"period": period, "lag": lag, "peak": peak, "tau": float(tau[i]), "acrophase": float(top % period), "amplitude": float((hi - lo) / 2), "p_value": float(raw), "p_bonferroni": float(bon), "p_bh": float(bh), "n_tests": float(len(p))})
    return out


def ljung_box(e: np.ndarray, lag: int = 10) -> float:
    n = len(e)
    lag = min(lag, n - 2)
    if lag < 1:
        return 1.0
    e = e - e.mean()
    total = e @ e
    if total <= 0:
        return 1.0
    q = n * (n + 2) * sum((float(e[k:] @ e[:-k]) / total) ** 2 / (n - k) for k in range(1, lag + 1))
    return stats.chi2_tail(q, lag)


def detect_whitened(t: np.ndarray, y: np.ndarray, ar_lag: int = 1, lb_lag: int = 10, alpha: float = 0.05, **how) -> list[dict[str, float]]:
    """As detect(); where the residual ranks are autocorrelated they are whitened, and the p-values are those of a second run. Period and phase stay."""
    first = detect(t, y, **how)
    order = np.argsort(t, kind="stable")
    t, y = t[order], y[order]
    best = min(first, key=lambda f: f["p_value"])
    shape = triangle if how.get("kind", "triangle") == "triangle" else cosine
    sign = -1 if best["tau"] < 0 else 1
    ref = stats.ranks(np.round(sign * shape(t, best["period"], best["lag"], best["peak"]), 9))
    e = stats.ranks(y) - ref
    if len(e) <= ar_lag + 4 or ljung_box(e, lb_lag) > alpha:
        return [{**f, "whitened": 0.0} for f in first]
    lagged = np.column_stack([e[ar_lag - k - 1 : len(e) - k - 1] for k in range(ar_lag)])
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(lagged)), lagged]), e[ar_lag:], rcond=None)
    white = e.copy()
    white[ar_lag:] = e[ar_lag:] - lagged @ beta[1:]
    second = detect(t, ref + white, **how)
    again = {f["period"]: f for f in second}
    least = min(second, key=lambda f: f["p_value"])
    ps = ("p_value", "p_bonferroni", "p_bh")
    return [{**f, **{k: (again.get(f["period"], least) if len(first) > 1 else least)[k] for k in ps}, "whitened": 1.0} for f in first]
