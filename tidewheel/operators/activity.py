"""Locomotor activity: rows (condition, subject, time, activity) with time in hours from the first lights-on.

All of it is aggregates and windows by subject; the number of rows, not of subjects, may be large."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.columns import chi2_quantile, chi2_tail, day, zeitgeber

WHO = ["condition", "subject"]


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", day(F.col("time"))).withColumn("zt", zeitgeber(F.col("time")))


def dead_channels(rows: DataFrame, hours: float = 6.0) -> DataFrame:
    """(condition, subject, dead_from): channels with a run of zeros or nulls of at least so many hours, counted from the sample before the run."""
    by = Window.partitionBy(*WHO).orderBy("time")
    still = F.coalesce(F.col("activity"), F.lit(0)) == 0
    x = rows.withColumn("_z", still).withColumn("_before", F.lag("time").over(by)).withColumn("_island", F.sum((~still).cast("int")).over(by))
    runs = x.filter("_z").groupBy(*WHO, "_island").agg(F.min("time").alias("start"), F.coalesce(F.min("_before"), F.min("time")).alias("from_"), F.max("time").alias("end"))
    return runs.filter(F.col("end") - F.col("from_") >= hours).groupBy(*WHO).agg(F.min("start").alias("dead_from"))


def alive(rows: DataFrame, hours: float = 6.0) -> DataFrame:
    dead = dead_channels(rows, hours)
    on = F.col("condition").eqNullSafe(F.col("_c")) & F.col("subject").eqNullSafe(F.col("_s"))
    return rows.join(dead.select(F.col("condition").alias("_c"), F.col("subject").alias("_s")), on, "left_anti")


def normalised(rows: DataFrame) -> DataFrame:
    """Activity as a share of the subject's total; without any, 0."""
    total = F.sum("activity").over(Window.partitionBy(*WHO))
    return rows.withColumn("activity", F.coalesce(F.col("activity") / F.nullif(total.cast("double"), F.lit(0.0)), F.lit(0.0)))


def resampled(rows: DataFrame, minutes: float = 30.0) -> DataFrame:
    """Means of bins; empty bins are absent."""
    return rows.groupBy(*WHO, (F.floor(F.col("time") * 60 / minutes) * minutes / 60).alias("time")).agg(F.avg("activity").alias("activity"))


def matrix(rows: DataFrame) -> DataFrame:
    """(condition, day, zt, activity): means over subjects."""
    return with_day(rows).groupBy("condition", "day", "zt").agg(F.avg("activity").alias("activity"))


def actogram(rows: DataFrame) -> DataFrame:
    """The matrix double-plotted in long form: each day, then the next day there is at zt + 24; the last day has no row of its own."""
    m = matrix(rows)
    days = m.select("condition", "day").distinct()
    following = days.withColumn("next", F.lead("day").over(Window.partitionBy("condition").orderBy("day"))).filter("next is not null")
    first = m.join(following, ["condition", "day"]).select("condition", "day", "zt", "activity")
    second = m.withColumnRenamed("day", "next").join(following, ["condition", "next"]).select("condition", "day", (F.col("zt") + 24).alias("zt"), "activity")
    return first.unionByName(second)


def daily_totals(rows: DataFrame) -> DataFrame:
    """Mean and SEM over subjects of each day's total."""
    per = with_day(rows).groupBy(*WHO, "day").agg(F.sum("activity").alias("total"))
    return per.groupBy("condition", "day").agg(F.count("*").alias("n_subjects"), F.avg("total").alias("mean_total"), F.coalesce(F.stddev_samp("total") / F.sqrt(F.count("total")), F.lit(0.0)).alias("sem_total"))


def onset_offset(rows: DataFrame, k: float = 0.5, min_bins: int = 2) -> DataFrame:
    """(condition, subject, day, onset, offset): the start of the first and the end of the last run of at least min_bins bins over the day's mean + k sd."""
    d = with_day(rows)
    of_day = Window.partitionBy(*WHO, "day")
    over = F.coalesce(F.col("activity") > F.avg("activity").over(of_day) + k * F.coalesce(F.stddev_samp("activity").over(of_day), F.lit(0.0)), F.lit(False))
    by = of_day.orderBy("zt")
    x = d.withColumn("_over", over).withColumn("_island", F.sum((~over).cast("int")).over(by))
    runs = x.filter("_over").groupBy(*WHO, "day", "_island").agg(F.count("*").alias("n"), F.min("zt").alias("start"), F.max("zt").alias("end"))
    return runs.filter(F.col("n") >= min_bins).groupBy(*WHO, "day").agg(F.min("start").alias("onset"), F.max("end").alias("offset"))


def chi2_periodogram(rows: DataFrame, periods: Sequence[float], bin_hours: float, keys: list[str] = WHO) -> DataFrame:
    """(keys, period, n_slots, qp): Qp = sum over slots of n (mean - grand mean)^2 / variance.

    Rows meet the periods in a generator, without a join; partial sums by slot leave each task before the shuffle.
    """
    grid = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("period"), F.lit(max(round(p / bin_hours), 2)).alias("n_slots")) for p in periods)))
    stats = rows.filter("activity is not null").groupBy(*keys).agg(F.avg("activity").alias("_m"), F.var_samp("activity").alias("_v"))
    slots = (
        rows.filter("activity is not null").select(*keys, "time", "activity", grid.alias("_g"))
        .select(*keys, "activity", "_g.*", F.pmod(F.floor(F.col("time") / bin_hours), F.col("_g.n_slots")).alias("_slot"))
        .groupBy(*keys, "period", "n_slots", "_slot").agg(F.count("*").alias("_n"), F.avg("activity").alias("_mean"))
    )
    names = {k: f"_k_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    return (
        slots.join(stats.withColumnsRenamed(names), on)
        .groupBy(*keys, "period", "n_slots")
        .agg((F.sum(F.col("_n") * F.pow(F.col("_mean") - F.col("_m"), F.lit(2.0))) / F.nullif(F.max("_v"), F.lit(0.0))).alias("qp"))
    )


def chi2_tested(qp: DataFrame, alpha: float = 0.05, keys: list[str] = WHO, semantics: str = "corrected") -> DataFrame:
    """qp with p_value, threshold (of Qp at alpha) and rhythmic.

    Qp follows chi-square with n_slots - 1 degrees of freedom. semantics: "reference" evaluates p at Qp (n_slots - 1), and has one line for all
    periods, that of the median number of slots, divided by this number; "corrected" takes Qp itself and a line for each period."""
    df = F.col("n_slots") - 1
    if semantics == "corrected":
        out = qp.withColumn("p_value", chi2_tail(F.col("qp"), df)).withColumn("threshold", chi2_quantile(1 - alpha, df))
    elif semantics == "reference":
        slots = qp.groupBy(*keys).agg(F.greatest(F.rint(F.median("n_slots")), F.lit(2.0)).alias("_k"))
        names = {k: f"_k_{k}" for k in keys}
        out = qp.join(slots.withColumnsRenamed(names), [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]).drop(*names.values())
        out = out.withColumn("p_value", chi2_tail(F.col("qp") * df, df)).withColumn("threshold", chi2_quantile(1 - alpha, F.col("_k") - 1) / F.col("_k")).drop("_k")
    else:
        raise ValueError(f"semantics is corrected or reference, not {semantics}")
    return out.withColumn("rhythmic", F.coalesce(F.col("qp") > F.col("threshold"), F.lit(False)))


def group_periodogram(tested: DataFrame) -> DataFrame:
    """(condition, period, n_slots, threshold, qp, qp_sem, n_rhythmic, n_total, tau, tau_sem): means over the subjects whose greatest Qp is over the line.

    tau is the mean of their best periods. A condition without such a subject has a row for each period with nulls in the means."""
    best = tested.withColumn("_r", F.row_number().over(Window.partitionBy(*WHO).orderBy(F.desc_nulls_last("qp"), "period"))).filter("_r = 1")
    per = best.groupBy("condition").agg(F.count("*").alias("n_total"), F.count_if("rhythmic").alias("n_rhythmic"), F.avg(F.when(F.col("rhythmic"), F.col("period"))).alias("tau"), *_sem(F.when(F.col("rhythmic"), F.col("period")), "tau_sem"))
    of = tested.join(best.filter("rhythmic").select(F.col("condition").alias("_c"), F.col("subject").alias("_s"), F.lit(True).alias("_in")), F.col("condition").eqNullSafe(F.col("_c")) & F.col("subject").eqNullSafe(F.col("_s")), "left")
    qp = F.when(F.col("_in"), F.col("qp"))
    lines = of.groupBy("condition", "period", "n_slots").agg(F.max("threshold").alias("threshold"), F.avg(qp).alias("qp"), *_sem(qp, "qp_sem"))
    per = per.withColumnRenamed("condition", "_c")
    return lines.join(per, F.col("condition").eqNullSafe(F.col("_c"))).drop("_c")


def _sem(c, name: str) -> list:  # noqa: ANN001
    """Standard error of the mean; 0 for one value."""
    return [F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c) / F.sqrt(F.count(c)), F.lit(0.0))).alias(name)]


def best_chi2(qp: DataFrame, keys: list[str] = WHO) -> DataFrame:
    return qp.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("qp"), "period"))).filter("_r = 1").drop("_r")


def representative(best: DataFrame) -> DataFrame:
    """Of each condition the subject whose period is nearest to the median one; the first by name of equal ones."""
    median = best.groupBy("condition").agg(F.median("period").alias("median_period"))
    gap = F.abs(F.col("period") - F.col("median_period"))
    return best.join(median, "condition").groupBy("condition", "median_period").agg(F.min_by(F.struct("subject", "period"), F.struct(gap, "subject")).alias("r")).select("condition", "r.subject", "r.period", "median_period")


def is_iv(rows: DataFrame) -> DataFrame:
    """Interdaily stability (complete days, against the mean of all hours) and intradaily variability of hourly means."""
    h = resampled(rows, 60.0).filter("activity is not null")
    h = with_day(h).withColumn("hour", F.floor("zt").cast("int"))
    who = Window.partitionBy(*WHO)
    h = h.withColumn("_mean", F.avg("activity").over(who)).withColumn("_hours", F.count("*").over(Window.partitionBy(*WHO, "day"))).withColumn("_d", F.col("activity") - F.lag("activity").over(who.orderBy("time")))
    iv = h.groupBy(*WHO).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("activity") - F.col("_mean"), F.lit(2.0))).alias("_ss"), F.sum(F.col("_d") * F.col("_d")).alias("_dd"))
    hours = h.filter("_hours = 24").groupBy(*WHO, "hour").agg(F.avg("activity").alias("_a"), F.max("_mean").alias("_m"), F.count("*").alias("_n"), F.sum(F.pow(F.col("activity") - F.col("_mean"), F.lit(2.0))).alias("_s"))
    stable = hours.groupBy(*WHO).agg((F.sum("_n") * F.sum(F.pow(F.col("_a") - F.col("_m"), F.lit(2.0))) / (24 * F.nullif(F.sum("_s"), F.lit(0.0)))).alias("interdaily_stability"))
    on = [F.col("condition").eqNullSafe(F.col("_c")), F.col("subject").eqNullSafe(F.col("_u"))]
    return iv.join(stable.withColumnsRenamed({"condition": "_c", "subject": "_u"}), on, "left").select(
        *WHO, "n", "interdaily_stability", (F.col("n") * F.col("_dd") / ((F.col("n") - 1) * F.nullif(F.col("_ss"), F.lit(0.0)))).alias("intradaily_variability")
    )


def alpha_rho(rows: DataFrame, k: float = 0.0) -> DataFrame:
    """Hours of a day over (alpha) and not over (rho) the subject's mean + k sd."""
    who = Window.partitionBy(*WHO)
    limit = F.avg("activity").over(who) + k * F.coalesce(F.stddev_pop("activity").over(who), F.lit(0.0))
    active = rows.withColumn("_over", F.coalesce(F.col("activity") > limit, F.lit(False)))
    return active.groupBy(*WHO).agg(F.count("*").alias("n_bins"), (24 * F.count_if("_over") / F.count("*")).alias("alpha_hours")).withColumn("rho_hours", 24 - F.col("alpha_hours"))


def days_alpha_rho(rows: DataFrame, threshold: str = "mean", keys: list[str] = WHO) -> DataFrame:
    """(keys, day, alpha_hours, rho_hours, onset, offset): of each day's profile over zt, the hours over its mean ("mean") or lower quartile
    ("percentile25"), and the first and last zt over it (null if none is)."""
    profile_ = with_day(rows).groupBy(*keys, "day", "zt").agg(F.avg("activity").alias("_a"))
    line = F.avg("_a") if threshold == "mean" else F.expr("percentile(_a, 0.25)")
    over = F.coalesce(F.col("_a") > line.over(Window.partitionBy(*keys, "day")), F.lit(False))
    return profile_.withColumn("_over", over).groupBy(*keys, "day").agg(
        (24 * F.count_if("_over") / F.count("*")).alias("alpha_hours"), (24 - 24 * F.count_if("_over") / F.count("*")).alias("rho_hours"),
        F.min(F.when(F.col("_over"), F.col("zt"))).alias("onset"), F.max(F.when(F.col("_over"), F.col("zt"))).alias("offset"),
    )


def alpha_rho_summary(days: DataFrame, keys: list[str] = WHO) -> DataFrame:
    """Means and population standard deviations over days; those of onset and offset tell how regular they are."""
    spread = lambda c: F.coalesce(F.stddev_pop(c), F.lit(0.0))
    return days.groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.avg("alpha_hours").alias("alpha_mean"), spread("alpha_hours").alias("alpha_sd"), F.avg("rho_hours").alias("rho_mean"), spread("rho_hours").alias("rho_sd"),
        spread("onset").alias("onset_sd"), spread("offset").alias("offset_sd"),
    )


def profile(rows: DataFrame, periods: Sequence[float], bin_hours: float) -> Mapping[str, DataFrame]:
    """The tables of an activity analysis; each is lazy."""
    share = normalised(rows)
    qp = chi2_periodogram(rows, periods, bin_hours)
    best = best_chi2(qp)
    return {
        "matrix": matrix(share), "actogram": actogram(share), "daily_totals": daily_totals(rows), "onset_offset": onset_offset(rows),
        "periodogram": qp, "periods": best, "representative": representative(best), "is_iv": is_iv(rows), "alpha_rho": alpha_rho(rows),
        "group_periodogram": group_periodogram(chi2_tested(qp)), "days_alpha_rho": days_alpha_rho(rows), "alpha_rho_summary": alpha_rho_summary(days_alpha_rho(rows)),
    }
