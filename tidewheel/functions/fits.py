"""Parametric fits of one series or two groups: harmonic, robust, damped, mixed and count models, in numpy."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from tidewheel.functions import stats
from tidewheel.functions.stats import least_squares, nelder_mead

TAU = 2 * np.pi


def design(t: np.ndarray, period: float, harmonics: int = 1) -> np.ndarray:
    return np.column_stack([np.ones(len(t)), *(f(TAU * k * t / period) for k in range(1, harmonics + 1) for f in (np.cos, np.sin))])


def polar(c: float, s: float) -> tuple[float, float]:
    return math.hypot(c, s), math.atan2(s, c) % TAU


def harmonic(t: np.ndarray, y: np.ndarray, periods: Sequence[float], harmonics: int = 2) -> dict:
    """The period with the greatest R2; harmonics by amplitude, and the F test of the harmonics beyond the first."""
    best = None
    total = float(((y - y.mean()) ** 2).sum())
    if total <= 0:
        raise ValueError("constant series")
    for period in periods:
        beta, _, rss = least_squares(design(t, period, harmonics), y)
        if best is None or rss < best[2] - 1e-12:
            best = (period, beta, rss)
    period, beta, rss = best
    n, k = len(y), 2 * harmonics
    r2 = 1 - rss / total
    base = least_squares(design(t, period, 1), y)[2]
    parts = sorted(((*polar(beta[2 * i + 1], beta[2 * i + 2]), i + 1) for i in range(harmonics)), reverse=True)
    extra = stats.f_tail(((base - rss) / (k - 2)) / (rss / (n - k - 1)), k - 2, n - k - 1) if harmonics > 1 and rss > 0 else math.nan
    return {
        "period": float(period), "mesor": float(beta[0]), "r2": r2, "p_value": stats.f_tail((r2 / k) / ((1 - r2) / (n - k - 1)), k, n - k - 1) if r2 < 1 else 0.0,
        "p_extra": extra, "amplitudes": [a for a, _, _ in parts], "acrophases": [ph / TAU * period for _, ph, _ in parts], "orders": [i for _, _, i in parts],
    }


WEIGHTS = {
    "linear": lambda z: np.ones_like(z),
    "soft_l1": lambda z: 1 / np.sqrt(1 + z),
    "huber": lambda z: np.where(z <= 1, 1.0, 1 / np.sqrt(np.maximum(z, 1e-300))),
    "cauchy": lambda z: 1 / (1 + z),
    "arctan": lambda z: 1 / (1 + z * z),
}


def reweighted(x: np.ndarray, y: np.ndarray, loss: str = "huber", rounds: int = 200) -> np.ndarray:
    """Coefficients under a robust loss of the residuals (scale 1), from least squares on: a start that is always the same."""
    beta = least_squares(x, y)[0]
    for _ in range(rounds if loss != "linear" else 0):
        w = np.sqrt(WEIGHTS[loss]((y - x @ beta) ** 2))
        new = least_squares(x * w[:, None], y * w)[0]
        if np.abs(new - beta).max() < 1e-10 * (1 + np.abs(beta).max()):
            return new
        beta = new
    return beta


def _errors(jac: np.ndarray, rest: np.ndarray, dof: int) -> np.ndarray:
    rmse = math.sqrt(float(rest @ rest) / max(dof, 1))
    return np.sqrt(np.maximum(np.diag(np.linalg.pinv(jac.T @ jac)), 0)) * rmse


def single(t: np.ndarray, y: np.ndarray, period: float = 24.0, loss: str = "huber", strict_dof: bool = False) -> dict:
    """y = M + A cos(2 pi t / P - phi) under a loss. Standard errors divide by n - 2, or with strict_dof by n - 3."""
    x = design(t, period)
    m, c, s = reweighted(x, y, loss)
    a, phi = polar(c, s)
    w = TAU * t / period
    jac = np.column_stack([np.ones(len(t)), np.cos(w - phi), a * np.sin(w - phi)])
    rest = y - x @ np.array([m, c, s])
    se = _errors(jac, rest, len(y) - (3 if strict_dof else 2))
    out = {"mesor": m, "amplitude": a, "acrophase": phi, "peak_hour": phi * period / TAU, "rmse": math.sqrt(float(np.mean(rest**2)))}
    for name, v, e in zip(("mesor", "amplitude", "acrophase"), (m, a, phi), se, strict=True):
        out |= {f"{name}_se": float(e), f"{name}_lo": v - 1.96 * e, f"{name}_hi": v + 1.96 * e}
    return {k: float(v) for k, v in out.items()}


def one_group(t: np.ndarray, y: np.ndarray, period: float = 24.0, loss: str = "huber") -> dict:
    """What two_groups() and pooled() need of a group: parameters, their Jacobian's products, residual sum, and the moments of the linear model."""
    x = design(t, period)
    m, c, s = reweighted(x, y, loss)
    a, phi = polar(c, s)
    w = TAU * t / period
    jac = np.column_stack([np.ones(len(y)), np.cos(w - phi), a * np.sin(w - phi)])
    rest = y - x @ np.array([m, c, s])
    return {"n": len(y), "fit": np.array([m, a, phi]), "jtj": jac.T @ jac, "rss": float(rest @ rest), "xtx": x.T @ x, "xty": x.T @ y, "yty": float(y @ y)}


def two_groups(g0: dict, g1: dict, period: float = 24.0, strict_dof: bool = False) -> dict:
    """Parameters of group 0 and their differences in group 1; a difference is significant if its interval leaves 0 out.

    The joint model's two halves share no parameter, so that they are fitted apart (once for all pairs of a group) and the errors joined."""
    (m0, a0, p0), (m1, a1, p1) = g0["fit"], g1["fit"]
    jtj = np.block([[g0["jtj"] + g1["jtj"], g1["jtj"]], [g1["jtj"], g1["jtj"]]])
    rmse = math.sqrt((g0["rss"] + g1["rss"]) / max(g0["n"] + g1["n"] - (6 if strict_dof else 2), 1))
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(jtj)), 0)) * rmse
    values = [m0, a0, p0, m1 - m0, a1 - a0, (p1 - p0 + np.pi) % TAU - np.pi]
    out: dict = {}
    for name, v, e in zip(("mesor", "amplitude", "acrophase", "d_mesor", "d_amplitude", "d_acrophase"), values, se, strict=True):
        out |= {name: float(v), f"{name}_lo": float(v - 1.96 * e), f"{name}_hi": float(v + 1.96 * e)}
        if name[0] == "d":
            out[f"{name}_differs"] = bool(abs(v) > 1.96 * e)
    return out | {"d_hours": float(values[5] * period / TAU)}


def pooled(g0: dict, g1: dict) -> dict:
    """One regression for both groups with interactions: tests of any rhythm, of a difference in rhythm, and of a difference in mean, from the groups' moments."""
    k = len(g0["xty"])
    n = g0["n"] + g1["n"]
    # columns: the first group's, then those of the second group times its indicator
    a = np.block([[g0["xtx"] + g1["xtx"], g1["xtx"]], [g1["xtx"], g1["xtx"]]])
    b = np.concatenate([g0["xty"] + g1["xty"], g1["xty"]])
    total = g0["yty"] + g1["yty"]

    def rest(columns: list[int]) -> float:
        return total - float(b[columns] @ np.linalg.lstsq(a[np.ix_(columns, columns)], b[columns], rcond=None)[0])

    every = list(range(2 * k))
    rss, dof = rest(every), n - 2 * k

    def test(columns: list[int]) -> float:
        d = 2 * k - len(columns)
        return stats.f_tail((rest(columns) - rss) / d / (rss / dof), d, dof) if dof > 0 and rss > 1e-12 * total else math.nan

    return {"p_rhythm": test([0, k]), "p_difference": test([*range(k), k]), "p_mean": test([x for x in every if x != k])}


def damped(t: np.ndarray, y: np.ndarray, period: float = 24.0, rounds: int = 200) -> dict:
    """y = A + B exp(C t) cos(2 pi t / P + phi) + D t by Levenberg and Marquardt from the linear fit; P is fitted too."""
    x = np.column_stack([design(t, period), t])
    b = least_squares(x, y)[0]
    theta = np.array([b[0], math.hypot(b[1], b[2]), 0.0, period, math.atan2(-b[2], b[1]), b[3]])

    def model(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, e = TAU * t / q[3] + q[4], np.exp(np.clip(q[2] * t, -50, 50))
        c, s = np.cos(w), np.sin(w)
        return q[0] + q[1] * e * c + q[5] * t, np.column_stack([np.ones_like(t), e * c, q[1] * t * e * c, q[1] * e * s * TAU * t / q[3] ** 2, -q[1] * e * s, t])

    lam = 1e-2
    f, jac = model(theta)
    rss = float(((y - f) ** 2).sum())
    for _ in range(rounds):
        a = jac.T @ jac
        step = np.linalg.lstsq(a + lam * np.diag(np.diag(a) + 1e-12), jac.T @ (y - f), rcond=None)[0]
        new = theta + step
        f2, j2 = model(new)
        rss2 = float(((y - f2) ** 2).sum())
        if rss2 < rss and new[3] > 0:
            done = rss - rss2 < 1e-12 * rss
            theta, f, jac, rss, lam = new, f2, j2, rss2, lam / 3
            if done:
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    total, n = float(((y - y.mean()) ** 2).sum()), len(y)
    r2 = 1 - rss / total if total > 0 else math.nan
    base = least_squares(np.column_stack([np.ones(n), t]), y)[2]
    p = stats.f_tail(((base - rss) / 4) / (rss / (n - 6)), 4, n - 6) if n > 6 and rss > 0 else math.nan
    sign = -1 if theta[1] < 0 else 1
    se = _errors(jac, y - f, n - 6) if n > 6 else np.full(6, math.nan)
    errors = dict(zip(("mesor_se", "amplitude_se", "damping_se", "period_se", "acrophase_se", "slope_se"), map(float, se), strict=True))
    return errors | {"mesor": theta[0], "amplitude": abs(theta[1]), "damping": theta[2], "period": theta[3], "acrophase": (theta[4] + (np.pi if sign < 0 else 0)) % TAU, "slope": theta[5], "r2": r2, "p_value": p}


def dummies(column: np.ndarray) -> np.ndarray:
    """A column of numbers as it is; of anything else an indicator for each level but the first in order."""
    try:
        return column.astype(float)[:, None]
    except (TypeError, ValueError):
        levels = sorted({str(v) for v in column})
        return np.column_stack([np.zeros((len(column), 0)), *((np.array([str(v) for v in column]) == x).astype(float) for x in levels[1:])])


def mixed(t: np.ndarray, y: np.ndarray, group: np.ndarray, period: float = 24.0, covariates: np.ndarray | None = None, reml: bool = True) -> dict:
    """y ~ cosine + sine (+ covariates) + (1 | group): profile likelihood over the ratio of variances.

    The test of rhythm compares the likelihoods with and without the cosine terms: p = exp(-LR / 2) on two degrees of freedom. With reml these are restricted
    likelihoods, which are made for one design and not for the comparison of two; reml=False takes maximum likelihoods, for which the test holds."""
    _, at = np.unique(group, return_inverse=True)
    size = np.bincount(at)
    full = design(t, period)
    if covariates is not None:
        full = np.column_stack([full, covariates])
    null = np.delete(full, [1, 2], axis=1)
    n = len(y)

    def fit(x: np.ndarray) -> tuple[float, np.ndarray, float, float]:
        dof = n - np.linalg.matrix_rank(x) if reml else n

        def at_ratio(log_ratio: float) -> tuple[float, np.ndarray, float]:
            r = math.exp(log_ratio)
            shrink = 1 - 1 / np.sqrt(1 + r * size)
            centre = lambda v: v - (shrink[:, None] * np.array([np.bincount(at, c, len(size)) for c in v.T]).T / size[:, None])[at]
            xs, ys = centre(x), centre(y[:, None])[:, 0]
            beta, _, rss = least_squares(xs, ys)
            ll = -0.5 * (dof * math.log(TAU * rss / dof) + dof + np.log(1 + r * size).sum())
            return ll - (0.5 * float(np.log(np.maximum(np.linalg.svd(xs, compute_uv=False), 1e-12)).sum() * 2) if reml else 0.0), beta, rss / dof

        lo, hi, g = -12.0, 8.0, (math.sqrt(5) - 1) / 2
        for _ in range(60):
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if at_ratio(a)[0] > at_ratio(b)[0] else (a, hi)
        ll, beta, var = at_ratio((lo + hi) / 2)
        return ll, beta, var, math.exp((lo + hi) / 2)

    ll1, beta, var, ratio = fit(full)
    ll0 = fit(null)[0]
    lr = max(0.0, 2 * (ll1 - ll0))
    a, phi = polar(beta[1], beta[2])
    k = full.shape[1] + 2
    return {
        "mesor": float(beta[0]), "amplitude": a, "acrophase": phi, "peak_hour": phi * period / TAU, "group_variance": var * ratio, "residual_variance": var, "lr": lr, "p_value": math.exp(-lr / 2),
        "aic": 2 * k - 2 * ll1, "bic": k * math.log(n) - 2 * ll1, "covariates": [float(v) for v in beta[3:]],
    }


def _gamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: Stirling's series beyond 8, reached by the recurrence."""
    x = np.asarray(x, float)
    low = np.where(x < 8, x, 8.0)
    product = low * (low + 1) * (low + 2) * (low + 3) * (low + 4) * (low + 5) * (low + 6) * (low + 7)
    z = np.where(x < 8, x + 8, x)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(TAU) + series - np.where(x < 8, np.log(product), 0.0)


MODELS = ("poisson", "gen_poisson", "zero_poisson", "nb", "zero_nb")


def _loglik(kind: str, mu: np.ndarray, y: np.ndarray, alpha: float, zero: np.ndarray | None) -> np.ndarray:
    if kind == "gen_poisson":
        scale = 1 + alpha  # variance scale^2 mu
        theta = np.maximum(mu / scale + (1 - 1 / scale) * y, 1e-300)
        return np.log(mu / scale) + (y - 1) * np.log(theta) - theta - _gamma(y + 1)
    if kind.endswith("nb"):
        r = mu / max(alpha, 1e-9)  # variance (1 + alpha) mu
        base = _gamma(y + r) - _gamma(r) - _gamma(y + 1) + r * np.log(1 / (1 + alpha)) + y * np.log(max(alpha, 1e-300) / (1 + alpha))
    else:
        base = y * np.log(mu) - mu - _gamma(y + 1)
    if zero is None:
        return base
    return np.where(y == 0, np.log(zero + (1 - zero) * np.exp(np.minimum(base, 0))), np.log1p(-zero) + base)


def count_model(t: np.ndarray, y: np.ndarray, kind: str = "poisson", components: int = 1, period: float = 24.0) -> dict:
    """A count regression with log link on harmonics: Poisson by scoring, the others by Nelder and Mead from there; zero inflation has the same regressors."""
    if (y < 0).any() or (y != np.round(y)).any():
        raise ValueError("counts must be whole and not negative")
    x = design(t, period, components)
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(max(y.mean(), 1e-3))
    for _ in range(100):
        mu = np.exp(np.clip(x @ beta, -30, 30))
        step = np.linalg.lstsq(x * np.sqrt(mu)[:, None], (y - mu) / np.sqrt(mu), rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    k, inflated, spread = len(beta), kind.startswith("zero"), kind in ("gen_poisson", "nb", "zero_nb")

    def split(q: np.ndarray) -> tuple[np.ndarray, float, np.ndarray | None]:
        alpha = math.exp(min(q[k], 20)) if spread else 0.0
        zero = 1 / (1 + np.exp(-np.clip(x @ q[k + spread :], -30, 30))) if inflated else None
        return np.exp(np.clip(x @ q[:k], -30, 30)), alpha, zero

    def loss(q: np.ndarray) -> float:
        mu, alpha, zero = split(q)
        v = -float(_loglik(kind, mu, y, alpha, zero).sum())
        return v if math.isfinite(v) else 1e300

    q = beta
    if spread or inflated:
        start = np.concatenate([beta, [-1.0] if spread else [], np.r_[-1.0, np.zeros(k - 1)] if inflated else []])
        for _ in range(3):
            start, _ = nelder_mead(loss, start, 800)
        q = start
    mu, alpha, zero = split(q)
    each = _loglik(kind, mu, y, alpha, zero)
    ll, n, p = float(each.sum()), len(y), len(q)
    grid = np.linspace(0, period, int(period) * 10, endpoint=False)
    gx = design(grid, period, components)
    curve = np.exp(np.clip(gx @ q[:k], -30, 30)) * ((1 - 1 / (1 + np.exp(-np.clip(gx @ q[k + spread :], -30, 30)))) if inflated else 1)
    around = np.concatenate([curve[-1:], curve, curve[:1]])
    tops = np.flatnonzero((curve > around[:-2]) & (curve >= around[2:]) & (curve >= 0.75 * curve.max()))
    fitted = mu * (1 - zero) if zero is not None else mu
    base = float((y * math.log(max(y.mean(), 1e-12)) - y.mean() - _gamma(y + 1)).sum())
    return {
        "model": kind, "components": components, "loglik": ll, "aic": 2 * p - 2 * ll, "bic": p * math.log(n) - 2 * ll, "rss": float(((y - fitted) ** 2).sum()), "n": n, "n_parameters": p,
        "llr_p": stats.chi2_tail(2 * (ll - base), p - 1) if ll > base else 1.0, "mcfadden_r2": 1 - ll / base if base else math.nan,
        "amplitude": float(np.ptp(curve) / 2), "mesor": float(curve.min() + np.ptp(curve) / 2), "peaks": [float(grid[i]) for i in tops], "heights": [float(curve[i]) for i in tops], "dispersion": alpha, "each": each,
    }


def vuong(a: dict, b: dict) -> float:
    """z of a against b, both with each observation's log-likelihood; positive values favour a."""
    d = a["each"] - b["each"]
    sd = d.std()
    return float(math.sqrt(len(d)) * d.mean() / sd) if sd > 0 else 0.0


def prefers(new: dict, old: dict, semantics: str = "corrected") -> bool:
    """Whether Vuong's test takes new instead of old at the level 0.05.

    "corrected" is the one-sided test of the standardised difference. "reference" takes half the difference of the numbers of cosine parameters times log10(n) off
    the likelihood ratio, divides by the root of the sum of squared differences, and compares with a normal distribution whose mean is that difference and whose standard deviation is the old number."""
    if semantics == "corrected":
        return vuong(new, old) > 1.645
    if semantics != "reference":
        raise ValueError(f"semantics is corrected or reference, not {semantics}")
    df = 2 * old["components"] + 1
    more = 2 * new["components"] + 1 - df
    square = float(((new["each"] - old["each"]) ** 2).sum())
    if square <= 0:
        return False
    z = (new["loglik"] - old["loglik"] - more / 2 * math.log10(new["n"])) / math.sqrt(square)
    return stats.normal_tail((z - more) / df) < 0.05


def count_models(t: np.ndarray, y: np.ndarray, kinds: Sequence[str] = MODELS, components: Sequence[int] = (1, 2), period: float = 24.0) -> list[dict]:
    """Every distribution with every number of components."""
    return [count_model(t, y, kind, c, period) for kind in sorted(kinds) for c in sorted(components)]


def best_count_model(t: np.ndarray, y: np.ndarray, kinds: Sequence[str] = MODELS, components: Sequence[int] = (1, 2), period: float = 24.0, by: str = "aic", semantics: str = "corrected") -> dict:
    """For each distribution the number of components that an F test on the residual sums asks for; of these the best by aic, bic or vuong, in alphabetical order."""
    winners = []
    for kind in sorted(kinds):
        best = None
        for c in sorted(components):
            new = count_model(t, y, kind, c, period)
            if best is None:
                best = new
                continue
            d1, d2 = new["n_parameters"] - best["n_parameters"], new["n"] - new["n_parameters"]
            if d2 > 0 and new["rss"] > 0 and new["rss"] < best["rss"] and stats.f_tail((best["rss"] - new["rss"]) / d1 / (new["rss"] / d2), d1, d2) < 0.05:
                best = new
        winners.append(best)
    out = winners[0]
    for new in winners[1:]:
        if prefers(new, out, semantics) if by == "vuong" else new[by] < out[by]:
            out = new
    return out


def resampled_intervals(t: np.ndarray, y: np.ndarray, best: dict, period: float = 24.0, rounds: int = 20, tolerance: float = 2.0, seed: int = 0) -> dict:
    """1.96 standard deviations around the means of amplitude, mesor, and the time and height of each of best's peaks over fits of two thirds of the points.

    A peak of a resample belongs to one of best's within tolerance hours around the cycle; peaks that no resample has get NaN."""
    rng = np.random.default_rng(seed)
    fits = []
    for _ in range(rounds):
        i = rng.choice(len(y), max(4, len(y) - len(y) // 3), replace=False)
        fits.append(count_model(t[i], y[i], best["model"], best["components"], period))

    def interval(v: Sequence[float]) -> tuple[float, float]:
        return (float(np.mean(v) - 1.96 * np.std(v)), float(np.mean(v) + 1.96 * np.std(v))) if len(v) else (math.nan, math.nan)

    out = {}
    for name in ("amplitude", "mesor"):
        out[f"{name}_lo"], out[f"{name}_hi"] = interval([f[name] for f in fits])
    times, heights, matched = [], [], []
    for peak in best["peaks"]:
        near = [(p + period * round((peak - p) / period), h) for f in fits for p, h in zip(f["peaks"], f["heights"], strict=True)]
        near = [(p, h) for p, h in near if abs(p - peak) <= tolerance]
        times.append(interval([p for p, _ in near]))
        heights.append(interval([h for _, h in near]))
        matched.append(len(near))
    return out | {"peaks_lo": [x[0] for x in times], "peaks_hi": [x[1] for x in times], "heights_lo": [x[0] for x in heights], "heights_hi": [x[1] for x in heights], "peaks_matched": matched}


def harmonic_coefficients(t: np.ndarray, y: np.ndarray, period: float = 24.0, harmonics: int = 1) -> dict:
    """The least-squares coefficients: mesor, then cosine and sine of each harmonic."""
    if len(y) < 2 * harmonics + 2:
        raise ValueError(f"{2 * harmonics + 2} points are needed")
    beta, _, rss = least_squares(design(t, period, harmonics), y)
    return {"coefficients": [float(v) for v in beta], "rss": rss}


def bootstrap(t: np.ndarray, y: np.ndarray, period: float = 24.0, harmonics: int = 1, rounds: int = 200, seed: int = 0) -> dict:
    """Cosinor with percentile intervals over resampled points: amplitude (half the curve's range), mesor and the peak's hour, the last around its mean direction."""
    rng = np.random.default_rng(seed)
    x = design(t, period, harmonics)
    grid = np.linspace(0, period, 480, endpoint=False)
    gx = design(grid, period, harmonics)

    def of(beta: np.ndarray) -> tuple[float, float, float]:
        curve = gx @ beta
        return float(beta[0]), float(np.ptp(curve) / 2), float(grid[int(curve.argmax())])

    m, a, peak = of(least_squares(x, y)[0])
    rows = []
    for _ in range(rounds):
        i = rng.integers(0, len(y), len(y))
        if np.linalg.matrix_rank(x[i]) == x.shape[1]:
            rows.append(of(least_squares(x[i], y[i])[0]))
    if len(rows) < rounds // 2:
        raise ValueError("too few resamples tell the harmonics apart")
    v = np.array(rows)
    v[:, 2] = (v[:, 2] - peak + period / 2) % period - period / 2 + peak
    lo, hi = np.percentile(v, [2.5, 97.5], axis=0)
    out = {}
    for k, (name, value) in enumerate((("mesor", m), ("amplitude", a), ("peak_hour", peak))):
        out |= {name: value, f"{name}_lo": float(lo[k]), f"{name}_hi": float(hi[k]), f"{name}_se": float(v[:, k].std())}
    return out


def components(t: np.ndarray, y: np.ndarray, periods: Sequence[float], most: int = 3, alpha: float = 0.05) -> dict:
    """The best period with one harmonic, then as many harmonics at it as nested F tests ask for."""
    best = harmonic(t, y, periods, 1)
    period, n = best["period"], len(y)
    rss, k = least_squares(design(t, period, 1), y)[2], 1
    for more in range(2, most + 1):
        new = least_squares(design(t, period, more), y)[2]
        dof = n - 2 * more - 1
        if dof <= 0 or new <= 0 or stats.f_tail((rss - new) / (2 * (more - k)) / (new / dof), 2 * (more - k), dof) >= alpha:
            break
        rss, k = new, more
    ll = -n / 2 * (math.log(TAU * rss / n) + 1) if rss > 0 else math.inf
    return harmonic(t, y, [period], k) | {"components": k, "aic": 2 * (2 * k + 1) - 2 * ll, "bic": (2 * k + 1) * math.log(n) - 2 * ll}
