"""Least-squares rhythms as aggregates: every fit of every period comes from sums that a shuffle combines partially."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.columns import angle, f_tail, hours, t_tail, wrapped
from tidewheel.operators.model import SERIES, drop_missing


def grid(first: float, last: float, step: float) -> list[float]:
    return [round(first + i * step, 10) for i in range(int(round((last - first) / step)) + 1)]


def over_periods(long: DataFrame, periods: Sequence[float], keys: list[str], sums: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """(keys, period, n, my, vy and the sums of cosine and sine) in one scan: rows meet the periods in a generator, and partial sums leave each task before the shuffle."""
    grid_ = F.explode(F.array(*(F.lit(float(p)) for p in periods))).alias("period")
    at = angle(F.col("time"), F.col("period"))
    rows = drop_missing(long).select(*keys, "time", "value", grid_).withColumn("_c", F.cos(at)).withColumn("_s", F.sin(at))
    return rows.groupBy(*keys, "period").agg(F.count("*").alias("n"), F.avg("value").alias("my"), F.var_pop("value").alias("vy"), *sums(F.col("_c"), F.col("_s")))


def cosinor(long: DataFrame, periods: Sequence[float] = (24.0,), keys: list[str] = SERIES, semantics: str = "corrected") -> DataFrame:
    """One row for each series and period: n, mesor, amplitude, acrophase (radians and hours), r2, p_value and the F test's adjustment for
    the periods, standard errors and 1.96 intervals by the delta method, and the t tests of the cosine's and sine's coefficients (amplitude_p, acrophase_p).

    With fewer than 4 points, constant values or times that don't tell cosine from sine the results are null and success is false.
    semantics: "reference" exchanges the variances of the two coefficients in the amplitude's error, "corrected" doesn't.
    """
    y = F.col("value")
    moments = over_periods(long, periods, keys, lambda c, s: [
        F.avg(c).alias("mc"), F.avg(s).alias("ms"), F.var_pop(c).alias("cc"), F.var_pop(s).alias("ss"),
        F.covar_pop(c, s).alias("cs"), F.covar_pop(c, y).alias("cy"), F.covar_pop(s, y).alias("sy"),
    ])
    return solved(moments.withColumnRenamed("vy", "yy"), keys, len(periods), semantics)


def solved(sums: DataFrame, keys: list[str], n_periods: int = 1, semantics: str = "corrected") -> DataFrame:
    """The fits from the moments of value, cosine and sine."""
    if semantics not in ("corrected", "reference"):
        raise ValueError(f"semantics is corrected or reference, not {semantics}")
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    fine = (F.col("n") >= 4) & (det > 1e-12) & (F.col("yy") > 0)
    b = F.when(fine, (F.col("cy") * F.col("ss") - F.col("sy") * F.col("cs")) / det)
    g = F.when(fine, (F.col("sy") * F.col("cc") - F.col("cy") * F.col("cs")) / det)
    beta, gamma = F.col("_b"), F.col("_g")
    r2 = F.when(beta.isNotNull(), F.least(F.greatest((beta * F.col("cy") + gamma * F.col("sy")) / F.col("yy"), F.lit(0.0)), F.lit(1.0)))
    phase = wrapped(F.atan2("_g", "_b"))
    unit = F.col("yy") * (1 - F.col("r2")) / (F.col("n") - 3)  # residual variance over n
    cov = [("_vb", unit * F.col("ss") / det), ("_vg", unit * F.col("cc") / det), ("_vbg", -unit * F.col("cs") / det)]
    vb, vg, vbg = F.col("_vb"), F.col("_vg"), F.col("_vbg")
    square = beta * beta + gamma * gamma
    first, second = (vb, vg) if semantics == "corrected" else (vg, vb)
    amp_se = F.sqrt(F.greatest((beta * beta * first + gamma * gamma * second + 2 * beta * gamma * vbg) / F.nullif(square, F.lit(0.0)), F.lit(0.0)))
    phase_se = F.sqrt(F.greatest((gamma * gamma * vb + beta * beta * vg - 2 * beta * gamma * vbg) / F.nullif(square * square, F.lit(0.0)), F.lit(0.0)))
    mesor_se = F.sqrt(F.greatest(unit + F.col("mc") * F.col("mc") * vb + F.col("ms") * F.col("ms") * vg + 2 * F.col("mc") * F.col("ms") * vbg, F.lit(0.0)))
    out = sums.withColumn("_b", b).withColumn("_g", g).withColumn("r2", r2).withColumns(dict(cov))
    t_p = lambda x, v: t_tail(F.abs(x) / F.sqrt(F.nullif(v, F.lit(0.0))), (F.col("n") - 3).cast("double"))
    out = out.withColumn("p_value", f_tail(F.col("r2"), 1, F.col("n").cast("double"))).select(
        *keys, "period", "n", (F.col("my") - beta * F.col("mc") - gamma * F.col("ms")).alias("mesor"),
        F.sqrt(square).alias("amplitude"), phase.alias("acrophase"),
        hours(phase, F.col("period")).alias("peak_hour"), beta.alias("beta_cos"), gamma.alias("beta_sin"), "r2", "p_value",
        F.when(F.col("p_value").isNotNull(), F.least(F.col("p_value") * n_periods, F.lit(1.0))).alias("p_adjusted"), beta.isNotNull().alias("success"),
        mesor_se.alias("mesor_se"), amp_se.alias("amplitude_se"), phase_se.alias("acrophase_se"), t_p(beta, vb).alias("amplitude_p"), t_p(gamma, vg).alias("acrophase_p"),
    )
    for name in ("mesor", "amplitude", "acrophase"):
        out = out.withColumn(f"{name}_lo", F.col(name) - 1.96 * F.col(f"{name}_se")).withColumn(f"{name}_hi", F.col(name) + 1.96 * F.col(f"{name}_se"))
    return out


def best_period(fits: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Of each series the period with the greatest r2, which with equal points has the least AIC as well; the shorter period of equal ones."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("r2"), "period"))
    return fits.withColumn("_r", rank).filter("_r = 1").drop("_r")


def population(long: DataFrame, period: float = 24.0) -> DataFrame:
    """Fits of each subject, then the mean coefficients of each series' subjects; amplitude and phase are those of the mean coefficients."""
    fits = cosinor(long, [period], [*SERIES, "subject"]).filter("success")
    mean = fits.groupBy(*SERIES).agg(F.count("*").alias("n_subjects"), F.avg("mesor").alias("mesor"), F.avg("beta_cos").alias("_b"), F.avg("beta_sin").alias("_g"), (F.stddev_samp("mesor") / F.sqrt(F.count("*"))).alias("mesor_se"))
    phase = wrapped(F.atan2("_g", "_b"))
    return mean.select(*SERIES, "n_subjects", "mesor", "mesor_se", F.sqrt(F.col("_b") * F.col("_b") + F.col("_g") * F.col("_g")).alias("amplitude"), hours(phase, period).alias("peak_hour"))


def compare_populations(long: DataFrame, pairs: DataFrame, period: float = 24.0) -> DataFrame:
    """Two populations of subjects, for every pair of conditions of a variable: each subject is fitted, and their coefficients are compared.

    p_mesor: pooled t test; p_rhythm: Hotelling's test of the cosine's and sine's mean coefficients, whose F tail on two degrees of freedom is closed. It takes
    two subjects of either population and three more than the coefficients in all; with fewer the tests are null."""
    keys = ["variable", "condition"]
    fits = cosinor(long, [period], [*keys, "subject"]).filter("success")
    m = fits.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("mesor").alias("m"), F.avg("beta_cos").alias("b"), F.avg("beta_sin").alias("g"),
        *((F.covar_samp(x, y) * (F.count("*") - 1)).alias(f"s{i}{j}") for i, x in enumerate(("mesor", "beta_cos", "beta_sin")) for j, y in enumerate(("mesor", "beta_cos", "beta_sin")) if i <= j),
    )
    side = lambda i: m.select("variable", F.col("condition").alias(f"condition_{i}"), F.struct(*(c for c in m.columns if c not in keys)).alias(f"p{i}"))
    a, z = (lambda c: F.col(f"p0.{c}")), (lambda c: F.col(f"p1.{c}"))
    dof = a("n") + z("n") - 2
    cov = lambda c: F.when((a("n") > 1) & (z("n") > 1), (F.coalesce(a(c), F.lit(0.0)) + F.coalesce(z(c), F.lit(0.0))) / dof)
    scale = a("n") * z("n") / (a("n") + z("n"))
    d_m, d_b, d_g = (z(c) - a(c) for c in ("m", "b", "g"))
    det = cov("s11") * cov("s22") - cov("s12") * cov("s12")
    t2 = scale * (d_b * d_b * cov("s22") + d_g * d_g * cov("s11") - 2 * d_b * d_g * cov("s12")) / F.nullif(det, F.lit(0.0))
    f = (dof - 1) / (2 * dof) * t2
    amplitude = lambda s: F.sqrt(s("b") * s("b") + s("g") * s("g"))
    hour = lambda s: hours(wrapped(F.atan2(s("g"), s("b"))), period)
    half = period / 2
    return pairs.join(side(0), "condition_0").join(side(1), ["variable", "condition_1"]).select(
        "variable", "condition_0", "condition_1", a("n").alias("n_0"), z("n").alias("n_1"), d_m.alias("d_mesor"), (amplitude(z) - amplitude(a)).alias("d_amplitude"),
        (F.pmod(hour(z) - hour(a) + half, F.lit(float(period))) - half).alias("d_peak_hour"),
        t_tail(F.abs(d_m) * F.sqrt(scale / F.nullif(cov("s00"), F.lit(0.0))), dof.cast("double")).alias("p_mesor"),
        F.when(dof > 1, F.pow(1 + 2 * f / (dof - 1), -(dof - 1) / 2)).alias("p_rhythm"),
    )


def pair_differences(fits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differences of two conditions' fits of one variable; the phase difference lies within half a period. Each condition is fitted once."""
    side = lambda i: fits.select("variable", "period", F.col("condition").alias(f"condition_{i}"), *(F.col(c).alias(f"{c}_{i}") for c in ("mesor", "amplitude", "peak_hour")))
    both = pairs.join(side(0), "condition_0").join(side(1), ["variable", "period", "condition_1"])
    half = F.col("period") / 2
    return both.select(
        "variable", "condition_0", "condition_1", "period",
        (F.col("mesor_1") - F.col("mesor_0")).alias("d_mesor"), (F.col("amplitude_1") - F.col("amplitude_0")).alias("d_amplitude"),
        (F.pmod(F.col("peak_hour_1") - F.col("peak_hour_0") + half, F.col("period")) - half).alias("d_peak_hour"),
    )


def predict(fits: DataFrame, points: int = 100, keys: list[str] = SERIES) -> DataFrame:
    """The fitted curves over one period: (keys, period, time, fitted)."""
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    curve = fits.filter("success").withColumn("_i", at).withColumn("time", F.col("_i") * F.col("period") / points)
    return curve.select(*keys, "period", "time", (F.col("mesor") + F.col("amplitude") * F.cos(angle(F.col("time") - F.col("peak_hour"), F.col("period")))).alias("fitted"))


def lomb_scargle(long: DataFrame, periods: Sequence[float], keys: list[str] = SERIES) -> DataFrame:
    """One row for each series and period: the normalised power of the time-shifted, mean-centred periodogram, and its false-alarm probability over n frequencies.

    power = (YC^2 / CC + YS^2 / SS) / YY with the shift that makes cosine and sine orthogonal; it needs moments only.
    """
    y = F.col("value")
    out = over_periods(long, periods, keys, lambda c, s: [
        F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"), F.sum(c).alias("c"), F.sum(s).alias("s"), F.sum(c * y).alias("cy"), F.sum(s * y).alias("sy"),
    ])
    tau = F.atan2(2 * F.col("cs"), F.col("cc") - F.col("ss")) / 2
    ct, st = F.cos("_t"), F.sin("_t")
    yc, ys = F.col("cy") - F.col("my") * F.col("c"), F.col("sy") - F.col("my") * F.col("s")
    cc = F.col("cc") * ct * ct + 2 * F.col("cs") * ct * st + F.col("ss") * st * st
    power = (F.pow(yc * ct + ys * st, F.lit(2.0)) / F.nullif(cc, F.lit(0.0)) + F.pow(ys * ct - yc * st, F.lit(2.0)) / F.nullif(F.col("n") - cc, F.lit(0.0))) / (F.col("n") * F.nullif(F.col("vy"), F.lit(0.0)))
    single = F.pow(1 - F.col("power"), (F.col("n") - 3) / 2)
    return (
        out.withColumn("_t", tau)
        .withColumn("power", F.when((F.col("n") >= 4) & (F.col("vy") > 0), F.least(F.greatest(power, F.lit(0.0)), F.lit(1.0))))
        .withColumn("fap", F.when(F.col("power").isNotNull(), F.least(F.greatest(1 - F.pow(1 - single, F.col("n")), F.lit(0.0)), F.lit(1.0))))
        .select(*keys, "period", "n", "power", "fap")
    )


def strongest(spectrum: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("power"), "period"))
    return spectrum.withColumn("_r", rank).filter("_r = 1").drop("_r")
