"""Column expressions that several operators share."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions import stats


def angle(time: Column, period: Column | float) -> Column:
    """Hours as radians of a cycle."""
    period = period if isinstance(period, Column) else F.lit(float(period))
    return 2 * F.pi() * time / period


def hours(radians: Column, period: Column | float) -> Column:
    """Radians as hours in [0, period)."""
    period = period if isinstance(period, Column) else F.lit(float(period))
    return F.pmod(radians * period / (2 * F.pi()), period)


def wrapped(radians: Column) -> Column:
    """An angle in [0, 2 pi)."""
    return F.pmod(radians, 2 * F.pi())


def triangle(time: Column, period: float, lag: float = 0.0, peak: float = 0.5) -> Column:
    """Rises from 0 to 1 until the given part of the cycle and falls to 0 at its end."""
    x = F.pmod(time - lag, F.lit(float(period))) / period
    return F.when(x < peak, x / peak).otherwise((1 - x) / (1 - peak))


def day(time: Column) -> Column:
    """Day number from 1 of a time in hours."""
    return (F.floor(time / 24) + 1).cast("long")


def zeitgeber(time: Column) -> Column:
    return F.pmod(time, F.lit(24.0))


def f_tail(r2: Column, harmonics: int, n: Column) -> Column:
    """Upper tail of the F test of a least-squares fit with two columns for each harmonic, in closed form.

    With a = (n - 2k - 1) / 2 it is (1 - R2)^a * sum over j < k of (a)_j / j! * R2^j."""
    a = (n - (2 * harmonics + 1)) / 2
    total, term = F.lit(1.0), F.lit(1.0)
    for j in range(1, harmonics):
        term = term * (a + (j - 1)) / j * r2
        total = total + term
    return F.when(a > 0, F.pow(1 - r2, a) * total)


def _on_floats(f: Callable[..., float]) -> Callable[..., Column]:
    """A column function of doubles by an Arrow batch at a time; null for what is null or not finite."""

    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        out = [None if any(x is None or x != x for x in r) else f(*r) for r in rows]
        return pa.array([x if x is not None and math.isfinite(x) else None for x in out], pa.float64())

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t. For rows of results, not of data: it leaves the JVM."""
    return _on_floats(stats.t_two_sided)(t, df)


def normal_two_sided(z: Column) -> Column:
    return _on_floats(lambda v: 2 * stats.normal_tail(abs(v)))(z)


def chi2_tail(x: Column, df: Column) -> Column:
    return _on_floats(stats.chi2_tail)(x, df.cast("double"))


def chi2_quantile(p: float, df: Column) -> Column:
    return _on_floats(lambda d: stats.chi2_quantile(p, d))(df.cast("double"))


def present(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
