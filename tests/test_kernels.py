"""Numpy kernels against naive versions, closed forms and known truth."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.functions import concordance, filters, fits, spectra, stats

T = np.arange(0, 48, 2.0)


def series(period=24.0, peak=6.0, amplitude=3.0, noise=0.3, seed=0, t=T):
    return 10 + amplitude * np.cos(2 * np.pi * (t - peak) / period) + np.random.default_rng(seed).normal(0, noise, len(t))


def integral(f, a, b, n=200_000):
    x = a + (np.arange(n) + 0.5) * (b - a) / n
    return f(x).sum() * (b - a) / n


@pytest.mark.parametrize(("x", "d1", "d2"), [(3.2, 2, 20), (0.4, 5, 7), (9.0, 4, 3)])
def test_f_tail(x, d1, d2):
    c = math.exp(math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2)) * (d1 / d2) ** (d1 / 2)
    pdf = lambda v: c * v ** (d1 / 2 - 1) * (1 + d1 * v / d2) ** (-(d1 + d2) / 2)
    u = lambda s: pdf(x / s) * x / s**2
    assert stats.f_tail(x, d1, d2) == pytest.approx(integral(u, 0, 1), rel=1e-4)


@pytest.mark.parametrize(("x", "df"), [(5.0, 3), (20.0, 10), (0.5, 1), (90.0, 60)])
def test_chi2_tail(x, df):
    c = math.exp(-math.lgamma(df / 2) - df / 2 * math.log(2))
    assert stats.chi2_tail(x, df) == pytest.approx(integral(lambda s: c * (x / s) ** (df / 2 - 1) * np.exp(-x / s / 2) * x / s**2, 0, 1), rel=1e-3)


def test_quantile_and_even_case():
    assert stats.chi2_quantile(0.95, 10) == pytest.approx(18.307038, abs=1e-5)
    assert stats.chi2_tail(7.0, 2) == pytest.approx(math.exp(-3.5))
    assert stats.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)


def test_concordance_sums_are_the_pairs():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 5, 15).astype(float)
    t = np.arange(15.0)
    tp = concordance.Templates(t, concordance.tests([8, 9]), "triangle")
    want = [sum(np.sign(y[j] - y[i]) * np.sign(v[j] - v[i]) for i in range(15) for j in range(i + 1, 15)) for v in tp.values]
    assert tp.sums(y[None])[0].tolist() == want


def test_exact_p_is_the_share_of_permutations():
    from itertools import permutations

    none = np.array([])
    sums = [sum(np.sign(p[j] - p[i]) for i in range(6) for j in range(i + 1, 6)) for p in permutations(range(6))]
    for s in (3, 7, 15):
        assert concordance.p_value(s, 6, none, none) == pytest.approx(np.mean(np.abs(sums) >= s))


def test_rank_methods_find_the_period():
    best = concordance.detect(T, series())[0]
    assert abs(best["period"] - 24) <= 1 and best["n_tests"] == 216 and best["p_value"] < 1e-6
    assert abs((best["acrophase"] - 6 + 12) % 24 - 12) < 1.6
    sweep = concordance.detect(T, series(), by_period=True)
    assert [f["period"] for f in sweep] == list(range(20, 29)) and min(f["p_value"] for f in sweep) == best["p_value"]
    assert concordance.detect(T, series(), permutations=99)[0]["p_value"] == pytest.approx(0.01)
    assert concordance.detect_whitened(T, series())[0]["period"] == best["period"]
    with pytest.raises(ValueError, match="constant"):
        concordance.detect(T, np.ones(len(T)))


@settings(max_examples=25, deadline=None)
@given(st.floats(0.1, 50), st.floats(-100, 100), st.integers(0, 10**6))
def test_scale_and_order_do_not_matter(scale, shift, seed):
    y = series(seed=seed)
    a, b = concordance.detect(T, y)[0], concordance.detect(T, y * scale + shift)[0]
    assert a["p_value"] == b["p_value"] and a["acrophase"] == b["acrophase"]
    order = np.random.default_rng(seed).permutation(len(T))
    assert concordance.detect(T[order], y[order])[0]["tau"] == a["tau"]
    assert fits.single(T, y * scale + shift, loss="linear")["amplitude"] == pytest.approx(scale * fits.single(T, y, loss="linear")["amplitude"])


def test_spectra():
    y = series()
    assert spectra.fourier_score(T, y)["score"] > 5 and spectra.fourier_score(T, np.random.default_rng(0).normal(size=24))["score"] < 4
    assert abs(spectra.lomb_scargle(T, y)["period"] - 24) < 0.7
    t = np.arange(0, 240, 1.0)
    assert abs(spectra.wavelet(t, series(t=t))["period"] - 24) < 1
    periods, power, line, peaks = spectra.spectrum(t, series(t=t))
    assert periods[peaks[0]] == pytest.approx(24) and power[peaks[0]] > line


def test_fits():
    y = series()
    h = fits.harmonic(T, y, [22, 24, 26])
    assert h["period"] == 24 and h["orders"][0] == 1 and h["p_value"] < 1e-10
    s = fits.single(T, np.append(y[:-1], 60.0))
    assert abs(s["peak_hour"] - 6) < 0.6 and abs(s["amplitude"] - 3) < 0.5
    two = fits.two_groups(fits.one_group(T, y), fits.one_group(T, series(peak=12, amplitude=4, seed=1)))
    assert two["d_hours"] == pytest.approx(6, abs=0.3) and two["d_amplitude_differs"] and not two["d_mesor_differs"]
    t = np.arange(0, 96, 1.0)
    d = fits.damped(t, 5 + 4 * np.exp(-0.02 * t) * np.cos(2 * np.pi * t / 25 + 1) + 0.1 * t)
    assert (d["damping"], d["period"], d["slope"]) == pytest.approx((-0.02, 25, 0.1), abs=1e-4)
    m = fits.mixed(np.tile(T, 3), np.concatenate([y, y + 5, y - 3]), np.repeat(list("abc"), len(T)))
    assert m["amplitude"] == pytest.approx(3, abs=0.2) and m["p_value"] < 1e-10 and m["group_variance"] > 1


def test_components_and_pooled_tests():
    t = np.arange(0, 96, 1.0)
    y = series(t=t, seed=3) + 1.5 * np.cos(2 * np.pi * (t - 2) / 12)
    c = fits.components(t, y, [22, 24, 26])
    assert (c["period"], c["components"]) == (24, 2) and fits.components(t, series(t=t, seed=3), [24])["components"] == 1
    first = fits.one_group(t, series(t=t))
    same = fits.pooled(first, fits.one_group(t, series(t=t, seed=5)))
    other = fits.pooled(first, fits.one_group(t, 2 + series(t=t, peak=9, seed=5)))
    assert same["p_difference"] > 0.01 > other["p_difference"] and same["p_rhythm"] < 1e-9 and other["p_mean"] < 1e-9


def test_groups_fitted_apart_are_the_joint_model():
    t, y0, y1 = np.arange(0, 48, 2.0), series(), series(peak=9, amplitude=2, seed=2)
    g, tt, y = np.repeat([0, 1], 24), np.tile(np.arange(0, 48, 2.0), 2), np.append(y0, y1)
    base = fits.design(tt, 24)
    full = np.column_stack([base, base * g[:, None]])
    rss = lambda x: stats.least_squares(x, y)[2]
    f = lambda x, d: stats.f_tail((rss(x) - rss(full)) / d / (rss(full) / 42), d, 42)
    got = fits.pooled(fits.one_group(t, y0), fits.one_group(t, y1))
    assert got["p_rhythm"] == pytest.approx(f(full[:, [0, 3]], 4), rel=1e-6)
    assert got["p_difference"] == pytest.approx(f(full[:, :4], 2), rel=1e-6) and got["p_mean"] == pytest.approx(f(full[:, [0, 1, 2, 4, 5]], 1), rel=1e-6)
    # the errors of the joint Jacobian
    two = fits.two_groups(fits.one_group(t, y0, loss="linear"), fits.one_group(t, y1, loss="linear"), strict_dof=True)
    beta, cov, r = stats.least_squares(full, y)
    assert two["d_mesor"] == pytest.approx(beta[3]) and (two["d_mesor_hi"] - two["d_mesor"]) / 1.96 == pytest.approx(math.sqrt(cov[3, 3] * r / 42))


def test_count_models():
    rng = np.random.default_rng(4)
    t = np.tile(np.arange(0, 48, 1.0), 4)
    mu = np.exp(1.5 + 0.8 * np.cos(2 * np.pi * (t - 8) / 24))
    p = fits.count_model(t, rng.poisson(mu).astype(float))
    assert abs(p["peaks"][0] - 8) < 0.7 and p["llr_p"] < 1e-6
    wide = rng.negative_binomial(mu / 3, 0.25).astype(float)
    assert fits.best_count_model(t, wide, ("poisson", "nb"), (1,))["model"] == "nb"
    with pytest.raises(ValueError, match="negative"):
        fits.count_model(t, t - 5)


def test_mixed_models_against_the_dense_likelihood():
    rng = np.random.default_rng(5)
    group = np.repeat(np.arange(5), [9, 12, 7, 10, 12])
    t = rng.random(50) * 48
    age = rng.random(50)
    y = 4 + 2 * np.cos(2 * np.pi * (t - 5) / 24) + 3 * age + rng.normal(0, 2, 5)[group] + rng.normal(0, 1, 50)
    for reml in (True, False):
        m = fits.mixed(t, y, group, covariates=age[:, None], reml=reml)
        x = np.column_stack([fits.design(t, 24), age])

        def dense(x, ratio, reml=reml):
            v = np.eye(50) + ratio * (group[:, None] == group[None, :])
            w = np.linalg.inv(v)
            beta = np.linalg.solve(x.T @ w @ x, x.T @ w @ y)
            rest = y - x @ beta
            dof = 50 - x.shape[1] if reml else 50
            s2 = rest @ w @ rest / dof
            ll = -0.5 * (dof * math.log(2 * math.pi * s2) + dof + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(x.T @ w @ x)[1] if reml else 0))
            return ll, beta, s2

        ratios = np.exp(np.linspace(-8, 4, 1500))
        at = max(ratios, key=lambda r: dense(x, r)[0])
        ll, beta, s2 = dense(x, at)
        ll0 = max(dense(x[:, [0, 3]], r)[0] for r in ratios)
        assert m["mesor"] == pytest.approx(beta[0], rel=1e-3) and m["covariates"] == pytest.approx([beta[3]], rel=1e-2)
        assert m["residual_variance"] == pytest.approx(s2, rel=1e-2) and m["group_variance"] == pytest.approx(at * s2, rel=3e-2)
        assert m["lr"] == pytest.approx(2 * (ll - ll0), rel=1e-3) and m["p_value"] < 1e-6
    assert fits.dummies(np.array(["b", "a", "b", "c"], object)).tolist() == [[1, 0], [0, 0], [1, 0], [0, 1]] and fits.dummies(np.array([1, 2.5])).tolist() == [[1], [2.5]]


def test_two_replicates():
    t = np.arange(0, 48, 2.0)
    a, b = series(), series(seed=9)
    got = spectra.paired_fourier_score(t, a, b, permutations=300)
    power = lambda y: np.abs(((y - y.mean()) * np.exp(-2j * np.pi * 2 * np.arange(24) / 24)).sum()) ** 2 / 24
    assert got["power"] == pytest.approx((power(a) + power(b)) / 2) and got["score"] > 5 and got["agreement"] == 1 and got["dominant_period"] == 24
    assert spectra.paired_fourier_score(t, a, -b, permutations=10)["agreement"] == -1
    noise = np.random.default_rng(3)
    assert spectra.paired_fourier_score(t, noise.normal(size=24), noise.normal(size=24))["score"] < 4
    times, x, y = spectra.first_two(np.tile(t, 2), np.append(a, b), np.repeat(["r2", "r1"], 24))
    assert (times == t).all() and (x == b).all() and (y == a).all()
    with pytest.raises(ValueError, match="two replicates"):
        spectra.first_two(t, a, np.repeat(["r1"], 24))


def test_intervals_of_count_models():
    rng = np.random.default_rng(8)
    t = np.tile(np.arange(0, 48, 2.0), 5)
    y = rng.poisson(np.exp(2 + 0.9 * np.cos(2 * np.pi * (t - 1) / 24))).astype(float)
    best = fits.best_count_model(t, y, ("poisson",), (1,))
    got = fits.resampled_intervals(t, y, best, rounds=8)
    assert got["amplitude_lo"] < best["amplitude"] < got["amplitude_hi"] and got["mesor_lo"] - 0.5 < best["mesor"] < got["mesor_hi"] + 0.5
    assert got["peaks_matched"] == [8] and got["peaks_lo"][0] < best["peaks"][0] < got["peaks_hi"][0] and got["heights_hi"][0] > best["heights"][0] > got["heights_lo"][0]
    late = fits.resampled_intervals(t, y, best | {"peaks": [0.0, 12.0]}, rounds=4, tolerance=3)
    assert late["peaks_matched"] == [4, 0] and math.isnan(late["peaks_lo"][1]) and late["peaks_lo"][0] > -1
    all_ = fits.count_models(t, y, ("nb", "poisson"), (1, 2))
    assert [(m["model"], m["components"]) for m in all_] == [("nb", 1), ("nb", 2), ("poisson", 1), ("poisson", 2)]


def test_vuong_both_ways():
    rng = np.random.default_rng(4)
    t = np.tile(np.arange(0, 48, 1.0), 3)
    wide = rng.negative_binomial(np.exp(1.5 + 0.8 * np.cos(2 * np.pi * t / 24)) / 3, 0.25).astype(float)
    p, nb = fits.count_model(t, wide, "poisson"), fits.count_model(t, wide, "nb")
    assert fits.prefers(nb, p) and not fits.prefers(p, nb)
    z = (nb["loglik"] - p["loglik"]) / math.sqrt(((nb["each"] - p["each"]) ** 2).sum())
    assert fits.prefers(nb, p, "reference") == (0.5 * math.erfc(z / 3 / math.sqrt(2)) < 0.05)


def test_bootstrap_and_coefficients():
    t = np.arange(0, 96, 1.0)
    y = series(t=t) + np.cos(2 * np.pi * (t - 3) / 12)
    b = fits.bootstrap(t, y, harmonics=2, rounds=60)
    assert b["mesor_lo"] < b["mesor"] < b["mesor_hi"] and b["amplitude_lo"] < b["amplitude"] < b["amplitude_hi"] and b["peak_hour_hi"] - b["peak_hour_lo"] < 1.5
    night = fits.bootstrap(t, series(t=t, peak=0.02, noise=2.0), rounds=60)
    assert night["peak_hour_hi"] - night["peak_hour_lo"] < 3
    c = fits.harmonic_coefficients(t, y, harmonics=2)["coefficients"]
    assert math.hypot(c[3], c[4]) == pytest.approx(1, abs=0.1)
    with pytest.raises(ValueError, match="points"):
        fits.harmonic_coefficients(t[:5], y[:5], harmonics=2)


def test_filters():
    b, a = filters.butterworth(2, 0.3)
    assert b == pytest.approx([0.13110644, 0.26221288, 0.13110644]) and a == pytest.approx([1, -0.74778918, 0.27221494])
    cubic = 1 + T - 0.1 * T**2 + 0.002 * T**3
    assert filters.savitzky_golay(cubic, 7) == pytest.approx(cubic)
    assert filters.detrend_polynomial(T, cubic, 3) == pytest.approx(np.zeros(len(T)), abs=1e-8)
    slow, fast = np.cos(2 * np.pi * T / 40), np.cos(2 * np.pi * T / 4.5)
    kept = filters.low_pass(T, slow + fast, 12, 3)
    assert np.abs(kept - slow)[4:-4].max() < 0.2
    assert np.isnan(filters.savitzky_golay(np.where(T == 10, np.nan, cubic), 7)).sum() == 1
