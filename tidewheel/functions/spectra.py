"""Spectra of one series: Fourier score, periodograms, and a wavelet scalogram."""

from __future__ import annotations

import numpy as np


def averaged(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unique times and the mean at each."""
    u, at, n = np.unique(t, return_inverse=True, return_counts=True)
    return u, np.bincount(at, y) / n


def uniform(t: np.ndarray, tol: float = 0.01) -> bool:
    gaps = np.diff(t)
    mid = np.median(gaps) if len(gaps) else 0.0
    return bool(mid > 0 and (np.abs(gaps - mid) <= tol * mid).all())


def resampled(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The series on an even grid of the median spacing, by straight lines."""
    t, y = averaged(t, y)
    if len(t) < 3 or uniform(t):
        return t, y
    grid = np.linspace(t[0], t[-1], int(np.ceil((t[-1] - t[0]) / np.median(np.diff(t)))) + 1)
    return grid, np.interp(grid, t, y)


def fourier_score(t: np.ndarray, y: np.ndarray, period: float = 24.0, permutations: int = 1000, seed: int = 42) -> dict[str, float]:
    """Power at the frequency nearest to the period's, over its mean in permuted series."""
    t, y = resampled(t, y)
    n, dt = len(y), float(np.median(np.diff(t)))
    f = np.fft.rfftfreq(n, dt)[1:]
    k = int(np.argmin(np.abs(f - 1 / period)))
    power = lambda x: np.abs(np.fft.rfft(x - x.mean(-1, keepdims=True), axis=-1)[..., 1 + k]) ** 2 / n
    rng = np.random.default_rng(seed)
    null = power(np.array([rng.permutation(y) for _ in range(permutations)]))
    seen = float(power(y))
    return {"score": seen / (float(null.mean()) + 1e-10), "power": seen, "period": float(1 / f[k]), "p_value": float((1 + (null >= seen).sum()) / (permutations + 1))}


def paired_fourier_score(t: np.ndarray, a: np.ndarray, b: np.ndarray, period: float = 24.0, permutations: int = 1000, seed: int = 42) -> dict[str, float]:
    """Two replicates at the same times: the mean of their power spectra at the frequency nearest to the period's, over its mean when both are permuted.

    agreement is the sign with which real and imaginary parts of the two coefficients go together: a correlation of two points is 1 or -1."""
    n, dt = len(a), float(np.median(np.diff(t)))
    f = np.fft.fftfreq(n, dt)[: n // 2]
    k = int(np.argmin(np.abs(f - 1 / period)))
    at = lambda x: np.fft.fft(x - x.mean(-1, keepdims=True), axis=-1)
    power = lambda x: np.abs(at(x)[..., : n // 2]) ** 2 / n
    mean = (power(a) + power(b)) / 2
    rng = np.random.default_rng(seed)
    null = np.array([(power(rng.permutation(a))[k] + power(rng.permutation(b))[k]) / 2 for _ in range(permutations)])
    x, y = at(a)[k], at(b)[k]
    return {
        "score": float(mean[k] / (null.mean() + 1e-10)), "power": float(mean[k]), "period": float(1 / f[k]) if f[k] > 0 else float("nan"), "p_value": float((1 + (null >= mean[k]).sum()) / (permutations + 1)),
        "dominant_period": float(1 / f[1 + int(mean[1:].argmax())]) if n >= 4 else float("nan"), "agreement": float(np.sign((x.real - x.imag) * (y.real - y.imag))),
    }


def first_two(t: np.ndarray, y: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The times that the first two replicates (by name) share, evenly spaced, and their values."""
    names = sorted(set(who.tolist()))[:2]
    if len(names) < 2:
        raise ValueError("two replicates are needed")
    (ta, a), (tb, b) = (averaged(t[who == k], y[who == k]) for k in names)
    both, i, j = np.intersect1d(ta, tb, return_indices=True)
    if len(both) < 4 or not uniform(both):
        raise ValueError("replicates share fewer than 4 times, or uneven ones")
    return both, a[i], b[j]


def power_at(t: np.ndarray, y: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Normalised Lomb-Scargle power of the centred series at each period."""
    y = y - y.mean()
    w = 2 * np.pi / periods[:, None]
    tau = np.arctan2(np.sin(2 * w * t).sum(1), np.cos(2 * w * t).sum(1))[:, None] / (2 * w)
    c, s = np.cos(w * (t - tau)), np.sin(w * (t - tau))
    total = y @ y
    return ((c @ y) ** 2 / np.maximum((c * c).sum(1), 1e-12) + (s @ y) ** 2 / np.maximum((s * s).sum(1), 1e-12)) / total if total > 0 else np.zeros(len(periods))


def lomb_scargle(t: np.ndarray, y: np.ndarray, lowest: float = 18.0, highest: float = 32.0, points: int = 1000) -> dict[str, float]:
    periods = np.linspace(lowest, highest, points)
    power = power_at(t, y, periods)
    k, n = int(np.argmax(power)), len(t)
    single = (1 - power[k]) ** ((n - 3) / 2)
    return {"period": float(periods[k]), "power": float(power[k]), "p_value": float(np.clip(1 - (1 - single) ** n, 0, 1))}


def spectrum(t: np.ndarray, y: np.ndarray, method: str = "per", longest: float = 240.0, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray, float, list[int]]:
    """(periods, powers, threshold, peaks) of the medians at each time: 'per', 'welch' or 'lombscargle'."""
    u, at = np.unique(t, return_inverse=True)
    y = np.array([np.median(y[at == i]) for i in range(len(u))])
    if method == "lombscargle":
        f = np.linspace(1 / longest, 0.5, 1000)
        p = power_at(u, y, 1 / f) * ((y - y.mean()) ** 2).sum() / 2
    else:
        dt = float(np.median(np.diff(u)))
        size = len(y) if method == "per" else min(256, len(y))
        window = np.ones(size) if method == "per" else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        starts = range(0, len(y) - size + 1, max(1, size // 2))
        p = np.mean([np.abs(np.fft.rfft((y[i : i + size] - y[i : i + size].mean()) * window)) ** 2 for i in starts], axis=0) * dt / (window**2).sum()
        p[1 : -1 if size % 2 == 0 else None] *= 2
        f, p = np.fft.rfftfreq(size, dt)[1:], p[1:]
    n = len(y)
    line = (1 - (alpha / n) ** (1 / max(n - 1, 1))) * p.sum()
    tall = [i for i in range(len(p)) if p[i] >= line]
    if len(p) >= 10:
        tall = [i for i in tall if 0 < i < len(p) - 1 and p[i] > p[i - 1] and p[i] >= p[i + 1]]
    return 1 / f, p, float(line), sorted(tall, key=lambda i: -p[i])


def scalogram(t: np.ndarray, y: np.ndarray, step: float = 0.25, bandwidth: float = 1.5, centre: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, periods, power) of complex Morlet wavelets; periods from two spacings to a third of the span."""
    t, y = resampled(t, y)
    dt, span = float(np.median(np.diff(t))), float(t[-1] - t[0])
    periods = np.arange(2 * dt, span / 3 + 1e-9, step)
    if len(periods) < 5:
        periods = np.arange(2 * dt, span / 3 + 1e-9, 0.1)
    if not len(periods):
        raise ValueError("fewer than three cycles")
    n = len(y)
    size = 1 << int(np.ceil(np.log2(2 * n)))
    f = np.fft.fft(y - y.mean(), size)
    w = 2 * np.pi * np.fft.fftfreq(size, dt)
    scales = periods * centre
    kernel = np.sqrt(scales[:, None] / dt) * np.exp(-bandwidth * (scales[:, None] * w - 2 * np.pi * centre) ** 2 / 4)
    return t, periods, np.abs(np.fft.ifft(f * kernel, axis=1)[:, :n]) ** 2


def wavelet(t: np.ndarray, y: np.ndarray, **how) -> dict[str, float]:
    _, periods, power = scalogram(t, y, **how)
    mean = power.mean(1)
    inner = mean[1:-1]
    return {
        "period": float(periods[mean.argmax()]), "power": float(mean.max()), "period_sd": float(periods[power.argmax(0)].std()),
        "n_peaks": float(((inner > mean[:-2]) & (inner > mean[2:])).sum()),
    }
