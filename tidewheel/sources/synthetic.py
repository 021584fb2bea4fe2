"""Labelled synthetic series: rhythmic families and arrhythmic ones, with a seed for each instance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RHYTHMIC = ("cosine", "damped", "square", "saw", "peaked", "multi", "modulated", "trended", "asymmetric", "spiky")
ARRHYTHMIC = ("white", "pink", "brown", "bimodal", "autoregressive", "trend", "step", "ultradian")
SAMPLINGS = ((2.0, 48.0), (4.0, 48.0), (1.0, 48.0), (3.0, 72.0))
PERIODS = (20.0, 22.0, 24.0, 26.0, 28.0)
SCHEMA = "instance long, kind string, rhythmic boolean, period double, time double, value double"


def wave(kind: str, t: np.ndarray, period: float, phase: float, r: np.random.Generator) -> np.ndarray:
    w = 2 * np.pi * (t - phase) / period
    x = np.mod(t - phase, period) / period
    n = len(t)
    return {
        "cosine": lambda: np.cos(w),
        "damped": lambda: np.cos(w) * np.exp(-0.015 * t),
        "square": lambda: np.sign(np.cos(w)),
        "saw": lambda: 2 * x - 1,
        "peaked": lambda: np.exp(3 * (np.cos(w) - 1)) * 2 - 0.6,
        "multi": lambda: np.cos(w) + 0.5 * np.cos(2 * w + 1),
        "modulated": lambda: np.cos(w) * (1 + 0.4 * np.cos(w / 3)),
        "trended": lambda: np.cos(w) + 0.03 * t,
        "asymmetric": lambda: np.where(x < 0.3, x / 0.3, (1 - x) / 0.7) * 2 - 1,
        "spiky": lambda: np.where(np.cos(w) > 0.8, 1.5, -0.3),
        "white": lambda: r.normal(0, 1, n),
        "pink": lambda: np.fft.irfft(np.fft.rfft(r.normal(0, 1, n)) / np.sqrt(np.maximum(np.arange(n // 2 + 1), 1)), n) * 2,
        "brown": lambda: np.cumsum(r.normal(0, 0.5, n)),
        "bimodal": lambda: np.where(r.random(n) < 0.5, -1, 1) + r.normal(0, 0.3, n),
        "autoregressive": lambda: _ar(r, n),
        "trend": lambda: 0.06 * t + r.normal(0, 0.3, n),
        "step": lambda: np.where(t > t[n // 2], 1.0, -1.0),
        "ultradian": lambda: np.cos(2 * np.pi * t / 7.3),
    }[kind]()


def _ar(r: np.random.Generator, n: int) -> np.ndarray:
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = 0.5 * x[i - 1] + r.normal()
    return x


def instance(i: int, seed: int) -> pd.DataFrame:
    r = np.random.default_rng([seed, i])
    rhythmic = bool(i % 2)
    kind = str(r.choice(RHYTHMIC if rhythmic else ARRHYTHMIC))
    dt, span = SAMPLINGS[r.integers(len(SAMPLINGS))]
    period = float(r.choice(PERIODS))
    t = np.repeat(np.arange(0, span, dt), int(r.choice([1, 3])))
    y = wave(kind, t, period, r.uniform(0, period), r) + r.normal(0, r.choice([0.2, 0.5, 0.9]), len(t))
    if r.random() < 0.15:
        at = r.choice(len(t), max(1, len(t) // 20), False)
        y[at] += r.choice([-4, 4], len(at))
    return pd.DataFrame({"instance": i, "kind": kind, "rhythmic": rhythmic, "period": period if rhythmic else np.nan, "time": t, "value": 10 + 3 * y})


def instances(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n labelled series, half of them rhythmic; made on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                yield instance(int(i), seed)

    return spark.range(n).mapInPandas(run, SCHEMA)
