"""Filters of one series: numpy arrays in and out, NaN for missing values."""

from __future__ import annotations

import numpy as np


def filled(v: np.ndarray) -> np.ndarray:
    """Gaps get the line between their neighbours, ends the nearest value."""
    known = np.flatnonzero(~np.isnan(v))
    return np.interp(np.arange(len(v)), known, v[known]) if len(known) else v


def detrend_polynomial(t: np.ndarray, v: np.ndarray, degree: int) -> np.ndarray:
    ok = ~np.isnan(v) & ~np.isnan(t)
    if ok.sum() < 3:
        return v
    degree = int(np.clip(degree, 1, ok.sum() - 2))
    x = (t - t[ok].mean()) / (np.ptp(t[ok]) or 1.0)
    return v - np.polyval(np.polyfit(x[ok], v[ok], degree), x)


def detrend_hours(t: np.ndarray, v: np.ndarray, hours: float) -> np.ndarray:
    """Without the centred mean of as many samples as fill so many hours at the median spacing, 3 at least; missing values are skipped."""
    gap = float(np.median(np.diff(np.sort(t)))) if len(t) > 1 else 0.0
    if (~np.isnan(v)).sum() < 4 or gap <= 0:
        return v
    n = max(3, int(round(hours / gap)))
    ok = ~np.isnan(v)
    sums, counts = np.concatenate([[0.0], np.cumsum(np.where(ok, v, 0.0))]), np.concatenate([[0], np.cumsum(ok)])
    at = np.arange(len(v))
    lo, hi = np.maximum(at - n // 2, 0), np.minimum(at + -(-n // 2), len(v))
    with np.errstate(invalid="ignore"):
        return v - (sums[hi] - sums[lo]) / (counts[hi] - counts[lo])


def savitzky_golay(v: np.ndarray, window: int, degree: int = 3) -> np.ndarray:
    """Least-squares polynomial in a centred odd window; at the ends the first and last windows' polynomials."""
    window = max(5, window | 1)
    ok = ~np.isnan(v)
    if len(v) < window or not ok.any():
        return v
    half, x = window // 2, filled(v)
    degree = min(degree, window - 2)
    powers = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True).astype(float)
    solve = np.linalg.pinv(powers)
    out = np.convolve(x, solve[0][::-1], "same")
    out[:half] = (powers @ (solve @ x[:window]))[:half]
    out[-half:] = (powers @ (solve @ x[-window:]))[half + 1 :]
    return np.where(ok, out, np.nan)


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a low-pass filter by the bilinear transform; cutoff in units of half the sampling rate."""
    warped = 4 * np.tan(np.pi * cutoff / 2)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    z = (4 + poles) / (4 - poles)
    gain = (np.prod(-poles) / np.prod(4 - poles)).real
    return gain * np.poly(-np.ones(order)).real, np.poly(z).real


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed."""
    out, s = np.empty_like(x), np.append(state, 0.0)
    for i, u in enumerate(x):
        y = b[0] * u + s[0]
        s[:-1] = b[1:] * u - a[1:] * y + s[1:]
        out[i] = y
    return out


def low_pass(t: np.ndarray, v: np.ndarray, cutoff_hours: float, order: int = 2) -> np.ndarray:
    """Forward and backward Butterworth filter with odd padding; a series too short or a cutoff out of range leaves it as it is."""
    ok = ~np.isnan(v)
    gaps = np.diff(np.unique(t[~np.isnan(t)]))
    if ok.sum() < 6 or not len(gaps):
        return v
    cutoff = 2 * float(np.median(gaps)) / cutoff_hours
    order = min(order, (len(v) - 2) // 3)
    if not 0 < cutoff < 1 or order < 1:
        return v
    b, a = butterworth(order, cutoff)
    x = filled(v)
    pad = min(3 * len(a), len(x) - 1)
    x = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    n = len(a) - 1
    step = np.linalg.solve(np.eye(n) - np.column_stack([-a[1:], np.eye(n)[:, :-1]]), b[1:] - a[1:] * b[0])  # the state of a constant input
    y = _filter(b, a, x, step * x[0])
    y = _filter(b, a, y[::-1], step * y[-1])[::-1]
    return np.where(ok, y[pad : len(y) - pad], np.nan)
