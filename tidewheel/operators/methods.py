"""Rhythm methods by name, each over all series in one grouped pass.

A kernel gets a series' times and values (and groups) and returns rows; an exception becomes a row with success = false
and its message, so that one series never fails a job. Seeds come from the series' key.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import concordance, fits, spectra
from tidewheel.functions.columns import normal_two_sided, present
from tidewheel.operators.model import SERIES


@dataclass(frozen=True)
class Method:
    kernel: Callable[..., list[dict]]
    columns: str  # DDL of a row
    least: int = 4
    average: bool = False  # replicates at one time are averaged first
    extra: tuple[str, ...] = ()  # further columns that the kernel gets


_RANK = "period double, lag double, peak double, tau double, acrophase double, amplitude double, p_value double, p_bonferroni double, p_bh double, n_tests double"
_SINGLE = ", ".join(["mesor double, amplitude double, acrophase double, peak_hour double, rmse double", *(f"{n}_{e} double" for n in ("mesor", "amplitude", "acrophase") for e in ("se", "lo", "hi"))])
_COUNT = "model string, components int, loglik double, aic double, bic double, rss double, llr_p double, mcfadden_r2 double, amplitude double, mesor double, peaks array<double>, dispersion double, heights array<double>"
_INTERVALS = ", amplitude_lo double, amplitude_hi double, mesor_lo double, mesor_hi double, peaks_lo array<double>, peaks_hi array<double>, heights_lo array<double>, heights_hi array<double>, peaks_matched array<int>"
_DAMPED = ("mesor", "amplitude", "damping", "period", "acrophase", "slope")


def _spectrum(t: np.ndarray, y: np.ndarray, seed: int, **how) -> list[dict]:
    periods, power, line, peaks = spectra.spectrum(t, y, **how)
    top = int(np.argmax(power))
    return [{"period": float(periods[top]), "power": float(power[top]), "threshold": line, "significant": bool(power[top] >= line), "peaks": [float(periods[i]) for i in peaks]}]


def _paired(t: np.ndarray, y: np.ndarray, seed: int, subject: np.ndarray, **how) -> list[dict]:
    return [spectra.paired_fourier_score(*spectra.first_two(t, y, subject), seed=seed, **how)]


def _count_intervals(t: np.ndarray, y: np.ndarray, seed: int, period: float = 24.0, rounds: int = 20, tolerance: float = 2.0, **how) -> list[dict]:
    best = fits.best_count_model(t, y, period=period, **how)
    return [best | fits.resampled_intervals(t, y, best, period, rounds, tolerance, seed)]


def _count(t: np.ndarray, y: np.ndarray, seed: int, best: bool = False, **how) -> list[dict]:
    return [fits.best_count_model(t, y, **how) if best else fits.count_model(t, y, **how)]


METHODS: dict[str, Method] = {
    "jtk": Method(lambda t, y, seed, **how: concordance.detect(t, y, **how), _RANK),
    "jtk_sweep": Method(lambda t, y, seed, **how: concordance.detect(t, y, by_period=True, **how), _RANK),
    "asymmetric_jtk": Method(lambda t, y, seed, **how: concordance.detect(t, y, **{"peaks": tuple(np.round(np.arange(0.2, 0.81, 0.1), 1)), **how}), _RANK),
    "ar_jtk": Method(lambda t, y, seed, **how: concordance.detect_whitened(t, y, **how), _RANK + ", whitened double", average=True),
    "cosine_kendall": Method(lambda t, y, seed, **how: concordance.detect(t, y, **{"periods": tuple(np.arange(20, 28.1, 0.5)), "kind": "cosine", **how}), _RANK),
    "harmonic_cosinor": Method(
        lambda t, y, seed, periods=tuple(np.arange(20, 28.1, 0.5)), **how: [fits.harmonic(t, y, periods, **how)],
        "period double, mesor double, r2 double, p_value double, p_extra double, amplitudes array<double>, acrophases array<double>, orders array<int>", 6,
    ),
    "components": Method(
        lambda t, y, seed, periods=tuple(np.arange(20, 28.1, 0.5)), **how: [fits.components(t, y, periods, **how)],
        "period double, components int, mesor double, r2 double, p_value double, amplitudes array<double>, acrophases array<double>, orders array<int>, aic double, bic double", 6,
    ),
    "fourier_score": Method(lambda t, y, seed, **how: [spectra.fourier_score(t, y, seed=seed, **how)], "score double, power double, period double, p_value double", average=True),
    "lomb_scargle": Method(lambda t, y, seed, **how: [spectra.lomb_scargle(t, y, **how)], "period double, power double, p_value double"),
    "spectral": Method(_spectrum, "period double, power double, threshold double, significant boolean, peaks array<double>"),
    "wavelet": Method(lambda t, y, seed, **how: [spectra.wavelet(t, y, **how)], "period double, power double, period_sd double, n_peaks double", 12, True),
    "mixed": Method(
        lambda t, y, seed, subject, **how: [fits.mixed(t, y, subject, **how)],
        "mesor double, amplitude double, acrophase double, peak_hour double, group_variance double, residual_variance double, lr double, p_value double, aic double, bic double, covariates array<double>", 5, extra=("subject",),
    ),
    "robust": Method(lambda t, y, seed, **how: [fits.single(t, y, **how)], _SINGLE),
    "damped": Method(lambda t, y, seed, **how: [fits.damped(t, y, **how)], "mesor double, amplitude double, damping double, period double, acrophase double, slope double, r2 double, p_value double, " + ", ".join(f"{n}_se double" for n in _DAMPED), 8),
    "count": Method(_count, _COUNT, 6),
    "count_models": Method(lambda t, y, seed, **how: fits.count_models(t, y, **how), _COUNT, 6),
    "count_intervals": Method(_count_intervals, _COUNT + _INTERVALS, 6),
    "paired_fourier_score": Method(_paired, "score double, power double, period double, p_value double, dominant_period double, agreement double", extra=("subject",)),
    "harmonic_coefficients": Method(lambda t, y, seed, **how: [fits.harmonic_coefficients(t, y, **how)], "coefficients array<double>, rss double"),
    "bootstrap": Method(lambda t, y, seed, **how: [fits.bootstrap(t, y, seed=seed, **how)], ", ".join(f"{n}{e} double" for n in ("mesor", "amplitude", "peak_hour") for e in ("", "_lo", "_hi", "_se")), 6),
    "best_count": Method(lambda t, y, seed, **how: _count(t, y, seed, best=True, **how), _COUNT, 6),
}


def detect(long: DataFrame, method: str, keys: list[str] = SERIES, covariates: Sequence[str] = (), **how) -> DataFrame:
    """One or more rows for each series: keys, n, success, message and the method's columns.

    covariates: further columns as fixed effects, for methods that take them (mixed); numbers count as they are, other values by level. A series is
    fitted in one task."""
    m = METHODS[method]
    fields = [c.split()[0] for c in m.columns.split(", ")]
    kinds = dict(c.split(" ", 1) for c in m.columns.split(", "))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        message = ""
        try:
            if len(pdf) < m.least:
                raise ValueError(f"{len(pdf)} points; {m.least} are needed")
            pdf = pdf.sort_values(["time", *m.extra], kind="stable")
            t, y = pdf["time"].to_numpy(float), pdf["value"].to_numpy(float)
            if m.average:
                t, y = spectra.averaged(t, y)
            if covariates:
                how_ = how | {"covariates": np.column_stack([fits.dummies(pdf[c].to_numpy()) for c in covariates])}
            else:
                how_ = how
            rows = m.kernel(t, y, zlib.crc32(repr(key).encode()), **{c: pdf[c].astype(str).to_numpy() for c in m.extra}, **how_)
        except Exception as e:  # a series that can't be fitted is a row
            message = f"{type(e).__name__}: {e}"[:300]
        success = bool(rows)
        out = [{f: r.get(f) for f in fields} for r in rows] or [dict.fromkeys(fields)]
        frame = pd.DataFrame(out)
        for f in fields:
            if kinds[f] == "double":
                frame[f] = pd.to_numeric(frame[f]).astype(float)
                frame[f] = frame[f].where(np.isfinite(frame[f]))
        frame.insert(0, "message", message)
        frame.insert(0, "success", success)
        frame.insert(0, "n", len(pdf))
        for i, k in enumerate(keys):
            frame.insert(i, k, key[i])
        return frame

    cols = [*keys, "time", "value", *m.extra, *covariates]
    given = long.filter(present(F.col("time")) & present(F.col("value"))).select(*dict.fromkeys(cols)).dropna(subset=list(covariates) or ["time"])
    schema = ", ".join([*(f"{k} {long.schema[k].dataType.simpleString()}" for k in keys), "n long, success boolean, message string", m.columns])
    out = given.groupBy(*keys).applyInPandas(run, schema)
    return out.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


_PAIR = ", ".join(f"{n} double, {n}_lo double, {n}_hi double" for n in ("mesor", "amplitude", "acrophase", "d_mesor", "d_amplitude", "d_acrophase"))


_GROUP = "n long, fit array<double>, jtj array<double>, rss double, xtx array<double>, xty array<double>, yty double, fitted boolean, why string"


def fitted_groups(long: DataFrame, period: float = 24.0, loss: str = "huber") -> DataFrame:
    """What comparisons need of each variable's conditions: one fit for each, whatever the number of pairs."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row: dict = {"fit": None, "jtj": None, "rss": None, "xtx": None, "xty": None, "yty": None, "fitted": False, "why": ""}
        try:
            if len(pdf) < 4:
                raise ValueError("either condition needs 4 points")
            pdf = pdf.sort_values(["time", "value"])
            got = fits.one_group(pdf["time"].to_numpy(float), pdf["value"].to_numpy(float), period, loss)
            row |= {k: v.ravel().tolist() if isinstance(v, np.ndarray) else v for k, v in got.items()} | {"fitted": True}
        except Exception as e:  # a condition that can't be fitted makes its pairs fail
            row["why"] = f"{type(e).__name__}: {e}"[:300]
        return pd.DataFrame([{"variable": key[0], "condition": key[1], **row, "n": len(pdf)}])[["variable", "condition", *(c.split()[0] for c in _GROUP.split(", "))]]

    rows = long.filter(present(F.col("time")) & present(F.col("value"))).select("variable", "condition", "time", "value")
    return rows.groupBy("variable", "condition").applyInPandas(run, f"variable string, condition string, {_GROUP}")


def compare(long: DataFrame, pairs: DataFrame, period: float = 24.0, loss: str = "huber", strict_dof: bool = False) -> DataFrame:
    """Two-group fits of every pair of conditions (condition_0, condition_1) for every variable, with the tests of the pooled regression.

    Each condition is fitted once; pairs join the fits, and rows aren't copied for them. A series is fitted in one task."""
    tests = ["p_rhythm", "p_difference", "p_mean"]
    flags = [f"d_{n}_differs" for n in ("mesor", "amplitude", "acrophase")]
    names = [c.split()[0] for c in _PAIR.split(", ")] + ["d_hours", *tests]
    groups = fitted_groups(long, period, loss)
    cols = [c.split()[0] for c in _GROUP.split(", ")]
    side = lambda i: groups.select("variable", F.col("condition").alias(f"condition_{i}"), F.struct(*cols).alias(f"g{i}"))
    met = pairs.join(side(0), "condition_0").join(side(1), ["variable", "condition_1"]).select("variable", "condition_0", "condition_1", "g0", "g1")

    def group(row: dict) -> dict:
        square = lambda x: np.array(x).reshape(3, 3)
        return dict(row) | {"fit": np.array(row["fit"]), "xty": np.array(row["xty"]), "jtj": square(row["jtj"]), "xtx": square(row["xtx"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                row: dict = dict.fromkeys([*names, *flags])
                message = r["g0"]["why"] or r["g1"]["why"]
                if not message:
                    try:
                        g0, g1 = group(r["g0"]), group(r["g1"])
                        row |= fits.two_groups(g0, g1, period, strict_dof)
                        row |= {k: v if np.isfinite(v) else None for k, v in fits.pooled(g0, g1).items()}
                    except Exception as e:  # a pair that can't be fitted is a row
                        message = f"{type(e).__name__}: {e}"[:300]
                out.append({"variable": r["variable"], "condition_0": r["condition_0"], "condition_1": r["condition_1"], "success": not message, "message": message, **row})
            kinds = [("variable", pa.string()), ("condition_0", pa.string()), ("condition_1", pa.string()), ("success", pa.bool_()), ("message", pa.string())]
            kinds += [(n, pa.float64()) for n in names] + [(f, pa.bool_()) for f in flags]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    schema = f"variable string, condition_0 string, condition_1 string, success boolean, message string, {_PAIR}, d_hours double, {', '.join(f'{c} double' for c in tests)}, " + ", ".join(f"{f} boolean" for f in flags)
    return met.mapInArrow(run, schema)


def compare_damped(long: DataFrame, pairs: DataFrame, period: float = 24.0) -> DataFrame:
    """Differences of the damped fits of every pair of conditions, with z tests from the fits' standard errors; each condition is fitted once."""
    found = detect(long, "damped", ["variable", "condition"], period=period)
    return _differences(found, pairs, _DAMPED)


def compare_bootstrap(long: DataFrame, pairs: DataFrame, period: float = 24.0, **how) -> DataFrame:
    """Differences of resampled cosinors of every pair of conditions, with z tests from the resamples' spread."""
    return _differences(detect(long, "bootstrap", ["variable", "condition"], period=period, **how).withColumn("period", F.lit(float(period))), pairs, ("mesor", "amplitude", "peak_hour"))


def _differences(found: DataFrame, pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    side = lambda i: found.select("variable", F.col("condition").alias(f"condition_{i}"), F.struct(*dict.fromkeys(["success", "period", *names, *(f"{n}_se" for n in names)])).alias(f"f{i}"))
    met = pairs.join(side(0), "condition_0").join(side(1), ["variable", "condition_1"])
    ok = F.col("f0.success") & F.col("f1.success")
    cols = []
    for n in names:
        d = F.col(f"f1.{n}") - F.col(f"f0.{n}")
        if n in ("acrophase", "peak_hour"):
            cycle = F.lit(2 * np.pi) if n == "acrophase" else F.col("f0.period")
            d = F.pmod(d + cycle / 2, cycle) - cycle / 2
        se = F.sqrt(F.pow(F.col(f"f0.{n}_se"), F.lit(2.0)) + F.pow(F.col(f"f1.{n}_se"), F.lit(2.0)))
        cols += [F.when(ok, d).alias(f"d_{n}"), F.when(ok, normal_two_sided(d / F.nullif(se, F.lit(0.0)))).alias(f"p_{n}")]
    return met.select("variable", "condition_0", "condition_1", ok.alias("success"), *cols)


def population(long: DataFrame, method: str = "harmonic", period: float = 24.0, harmonics: int = 1) -> DataFrame:
    """Mean parameters of each series' subjects: "harmonic" averages coefficients of several harmonics and reads amplitude (half the range) and peak from the
    mean curve, "damped" averages the damped fits' parameters, the phase by its direction, with standard errors over subjects."""
    keys = [*SERIES, "subject"]
    if method == "harmonic":
        each = detect(long, "harmonic_coefficients", keys, period=period, harmonics=harmonics).filter("success")
        n = 2 * harmonics + 1
        mean = each.groupBy(*SERIES).agg(F.count("*").alias("n_subjects"), F.array(*(F.avg(F.get("coefficients", F.lit(i))) for i in range(n))).alias("coefficients"), (F.stddev_samp(F.get("coefficients", F.lit(0))) / F.sqrt(F.count("*"))).alias("mesor_se"))
        at = F.sequence(F.lit(0), F.lit(479))
        curve = F.transform(at, lambda i: F.struct(sum((F.get("coefficients", F.lit(2 * k - 1)) * F.cos(2 * np.pi * k * i / 480) + F.get("coefficients", F.lit(2 * k)) * F.sin(2 * np.pi * k * i / 480) for k in range(1, harmonics + 1)), F.lit(0.0)).alias("v"), (-i).alias("i")))
        top, low = F.array_max("_curve"), F.array_min("_curve")
        return mean.withColumn("_curve", curve).select(*SERIES, "n_subjects", F.get("coefficients", F.lit(0)).alias("mesor"), "mesor_se", ((top.v - low.v) / 2).alias("amplitude"), (-top.i * period / 480).alias("peak_hour"), "coefficients")
    if method != "damped":
        raise ValueError(f"unknown method {method}; known: harmonic, damped")
    each = detect(long, "damped", keys, period=period).filter("success")
    mean = lambda n: [F.avg(n).alias(n), (F.stddev_samp(n) / F.sqrt(F.count(n))).alias(f"{n}_se")]
    phase = F.pmod(F.atan2(F.avg(F.sin("acrophase")), F.avg(F.cos("acrophase"))), F.lit(2 * np.pi)).alias("acrophase")
    spread = F.hypot(F.avg(F.sin("acrophase")), F.avg(F.cos("acrophase")))
    wide = (F.sqrt(-2 * F.log(F.least(spread, F.lit(1.0)))) / F.sqrt(F.count("*"))).alias("acrophase_se")
    return each.groupBy(*SERIES).agg(F.count("*").alias("n_subjects"), *(c for n in _DAMPED if n != "acrophase" for c in mean(n)), phase, wide).withColumn("success", F.lit(True))


def compare_populations(long: DataFrame, pairs: DataFrame, period: float = 24.0) -> DataFrame:
    """Differences of the populations' damped parameters of every pair of conditions, with z tests from the spread over subjects."""
    return _differences(population(long, "damped", period), pairs, _DAMPED)
