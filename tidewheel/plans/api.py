"""One call for a whole analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidewheel.operators import activity, aggregate, cosinor, methods, prep
from tidewheel.operators.model import SERIES

#: Methods that are aggregates; the others are kernels of operators.methods.
AGGREGATES = {
    "cosinor": lambda long, keys, periods=(24.0,), **_: cosinor.cosinor(long, periods, keys),
    "cosinor_best": lambda long, keys, periods=tuple(cosinor.grid(20, 28, 0.5)), **_: cosinor.best_period(cosinor.cosinor(long, periods, keys), keys),
    "population_cosinor": lambda long, keys, period=24.0, **_: cosinor.population(long, period),
    "periodogram": lambda long, keys, periods=tuple(cosinor.grid(18, 32, 0.1)), **_: cosinor.lomb_scargle(long, periods, keys),
}


def methods_known() -> list[str]:
    return sorted([*AGGREGATES, *methods.METHODS])


def analyze(long: DataFrame, method: str, keys: list[str] = SERIES, steps: prep.Steps | None = None, variables: Sequence[str] | None = None, conditions: Sequence[str] | None = None, **how) -> DataFrame:
    """Filter, clean and run a method over every series at once; p-values get q-values over all series."""
    if variables:
        long = long.filter(long["variable"].isin(*variables))
    if conditions:
        long = long.filter(long["condition"].isin(*conditions))
    if steps:
        long = prep.clean(long, steps, keys)
    if method in AGGREGATES:
        out = AGGREGATES[method](long, keys, **how)
    elif method in methods.METHODS:
        out = methods.detect(long, method, keys, **how)
    else:
        raise ValueError(f"unknown method {method}; known: {', '.join(methods_known())}")
    return aggregate.adjusted(out) if "p_value" in out.columns else out


def compare(long: DataFrame, how: str = "robust", period: float = 24.0, **more) -> DataFrame:
    """All pairs of conditions. 'robust' fits both groups and tests the pooled regression, 'least_squares' joins fits, 'bootstrap' and 'damped' test differences of
    such fits, 'populations' and 'damped_populations' compare the means over subjects."""
    pairs = aggregate.condition_pairs(long)
    if how == "least_squares":
        return cosinor.pair_differences(cosinor.cosinor(long, [period]), pairs)
    ways = {"robust": methods.compare, "bootstrap": methods.compare_bootstrap, "damped": methods.compare_damped, "populations": cosinor.compare_populations, "damped_populations": methods.compare_populations}
    if how not in ways:
        raise ValueError(f"unknown comparison {how}; known: {', '.join(sorted([*ways, 'least_squares']))}")
    return ways[how](long, pairs, period, **more)


def activity_profile(rows: DataFrame, periods: Sequence[float] = tuple(cosinor.grid(18, 32, 0.1)), bin_hours: float = 0.5) -> dict[str, DataFrame]:
    return dict(activity.profile(rows, periods, bin_hours))
