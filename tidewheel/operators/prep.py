"""Cleaning of series: outliers, then trend, then smoothing. Each step keeps rows and replaces values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions import filters
from tidewheel.operators.model import SERIES


def mask_iqr(long: DataFrame, k: float = 1.5, keys: list[str] = SERIES) -> DataFrame:
    """Values beyond k interquartile ranges from the quartiles become null, in series of 4 values or more."""
    q = long.groupBy(*keys).agg(F.expr("percentile(value, array(0.25, 0.75))").alias("_q"), F.count("value").alias("_n"))
    lo, hi = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    fine = (F.col("_n") < 4) | F.col("value").between(lo - k * (hi - lo), hi + k * (hi - lo))
    return _with_stats(long, q, keys).withColumn("value", F.when(fine, F.col("value"))).drop("_q", "_n")


def mask_z(long: DataFrame, k: float = 1.5, keys: list[str] = SERIES) -> DataFrame:
    """Values more than k population standard deviations from the mean become null; a constant series stays."""
    s = long.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count("value").alias("_n"))
    fine = (F.col("_n") < 4) | (F.col("_s") == 0) | (F.abs(F.col("value") - F.col("_m")) <= k * F.col("_s"))
    return _with_stats(long, s, keys).withColumn("value", F.when(fine, F.col("value"))).drop("_m", "_s", "_n")


def _with_stats(long: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    names = {k: f"_k_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return long.join(stats.withColumnsRenamed(names), on).drop(*names.values())


def detrend_linear(long: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """The least-squares line over time is subtracted."""
    s = long.groupBy(*keys).agg(F.expr("regr_slope(value, time)").alias("_b"), F.expr("regr_intercept(value, time)").alias("_a"))
    line = F.col("_a") + F.col("_b") * F.col("time")
    return _with_stats(long, s, keys).withColumn("value", F.coalesce(F.col("value") - line, F.col("value"))).drop("_a", "_b")


def _around(n: int) -> tuple[int, int]:
    """Rows before and after in a centred window of n rows; one of an even number begins n/2 rows before."""
    return -(n // 2), -(-n // 2) - 1


def moving_average(long: DataFrame, n: int, keys: list[str] = SERIES, order: list[str] | None = None) -> DataFrame:
    """long with _mean, the mean of the values in a centred window of n rows."""
    w = Window.partitionBy(*keys).orderBy(*(order or ["time", "subject", "value"])).rowsBetween(*_around(n))
    return long.withColumn("_mean", F.avg("value").over(w))


def detrend_moving_average(long: DataFrame, n: int, keys: list[str] = SERIES, order: list[str] | None = None) -> DataFrame:
    return moving_average(long, n, keys, order).withColumn("value", F.col("value") - F.col("_mean")).drop("_mean")


def interpolate(long: DataFrame, keys: list[str] = SERIES, order: list[str] | None = None) -> DataFrame:
    """Null values get the line between their neighbours by position in the series; at the ends, the nearest value."""
    by = Window.partitionBy(*keys).orderBy(*(order or ["time", "subject"]))
    at = F.row_number().over(by)
    known = lambda c: F.when(F.col("value").isNotNull(), c)
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    x = long.withColumn("_i", at)
    x = x.withColumns({
        "_i0": F.last(known(F.col("_i")), True).over(back), "_v0": F.last("value", True).over(back),
        "_i1": F.first(known(F.col("_i")), True).over(ahead), "_v1": F.first("value", True).over(ahead),
    })
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_i") - F.col("_i0")) / F.nullif(F.col("_i1") - F.col("_i0"), F.lit(0))
    return x.withColumn("value", F.coalesce("value", line, "_v0", "_v1")).drop("_i", "_i0", "_v0", "_i1", "_v1")


def smooth_moving_average(long: DataFrame, n: int, keys: list[str] = SERIES, order: list[str] | None = None) -> DataFrame:
    """Gaps are interpolated for the window and null again afterwards."""
    order = order or ["time", "subject"]
    filled = interpolate(long.withColumn("_was", F.col("value").isNotNull()), keys, order)
    return moving_average(filled, n, keys, order).withColumn("value", F.when(F.col("_was"), F.col("_mean"))).drop("_was", "_mean")


@dataclass(frozen=True)
class Steps:
    """What clean() does; everything is off by default."""

    outliers: str | None = None  # iqr, z
    outlier_k: float = 1.5
    detrend: str | None = None  # linear, moving_average, polynomial
    trend_rows: int = 25
    trend_hours: float | None = None  # the moving average's window in hours instead of rows
    degree: int = 2
    smooth: str | None = None  # moving_average, savitzky_golay, butterworth
    smooth_rows: int = 5
    cutoff_hours: float = 8.0
    filter_order: int = 2


def clean(long: DataFrame, steps: Steps, keys: list[str] = SERIES) -> DataFrame:
    """Outliers, trend and smoothing in this order. Steps with built-in expressions stay in the JVM."""
    if steps.outliers:
        long = {"iqr": mask_iqr, "z": mask_z}[steps.outliers](long, steps.outlier_k, keys)
    if steps.detrend == "linear":
        long = detrend_linear(long, keys)
    elif steps.detrend == "moving_average" and steps.trend_hours:
        long = by_kernel(long, lambda t, v: filters.detrend_hours(t, v, steps.trend_hours), keys)
    elif steps.detrend == "moving_average":
        long = detrend_moving_average(long, steps.trend_rows, keys)
    elif steps.detrend == "polynomial":
        long = by_kernel(long, lambda t, v: filters.detrend_polynomial(t, v, steps.degree), keys)
    if steps.smooth == "moving_average":
        long = smooth_moving_average(long, steps.smooth_rows, keys)
    elif steps.smooth == "savitzky_golay":
        long = by_kernel(long, lambda t, v: filters.savitzky_golay(v, steps.smooth_rows), keys)
    elif steps.smooth == "butterworth":
        long = by_kernel(long, lambda t, v: filters.low_pass(t, v, steps.cutoff_hours, steps.filter_order), keys)
    return long


def new_nulls(before: DataFrame, after: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """(keys, n_removed): values of each series that a cleaning made null."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("value").alias(name))
    names = {k: f"_k_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return count(before, "_n").join(count(after, "_m").withColumnsRenamed(names), on).select(*keys, (F.col("_n") - F.col("_m")).alias("n_removed"))


def by_kernel(long: DataFrame, kernel, keys: list[str] = SERIES) -> DataFrame:  # noqa: ANN001
    """Replace the values of each series, ordered by time, by kernel(times, values); NaN in and out is null."""

    def run(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values("time", kind="stable")
        return pdf.assign(value=kernel(pdf["time"].to_numpy(float), pdf["value"].to_numpy(float)))

    out = long.groupBy(*keys).applyInPandas(run, long.schema)
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
