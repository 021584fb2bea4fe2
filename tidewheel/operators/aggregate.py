"""Aggregations, ranks and matchings of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.model import SERIES


def by_timepoint(long: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """n, mean, median, sd and sem of the values at each time; a single value has an sem of 0."""
    return (
        long.groupBy(*keys, "time")
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("sd"))
        .withColumn("sem", F.when(F.col("n") > 0, F.coalesce(F.col("sd") / F.sqrt("n"), F.lit(0.0))))
    )


def mean_series(long: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """One value for each time: replicates averaged."""
    return long.groupBy(*keys, "time").agg(F.avg("value").alias("value"))


def binned(long: DataFrame, minutes: float, how: str = "sum", keys: list[str] = SERIES) -> DataFrame:
    """Values of each bin of time, which begins at the bin's time; bins without rows are absent, bins of nulls are null."""
    return long.groupBy(*keys, (F.floor(F.col("time") * 60 / minutes) * minutes / 60).alias("time")).agg(F.expr(f"{how}(value)").alias("value"))


def average_ranks(long: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Rank of each value in its series; equal values share the mean of their ranks."""
    series = Window.partitionBy(*keys)
    return long.withColumn("rank", F.rank().over(series.orderBy("value")) + (F.count("*").over(Window.partitionBy(*keys, "value")) - 1) / 2)


#: Steps of the classes of p-values: so many for each unit above 1 / P_STEPS, then so many for each halving.
P_STEPS, P_HALVES = 1024, 8


def p_class(p: Column) -> Column:
    """A class of p-values that grows with them; about 10,000 classes in all."""
    small = F.floor(F.log2(F.greatest(p * P_STEPS, F.lit(1e-307))) * P_HALVES)
    return F.when(p * P_STEPS >= 1, F.floor(p * P_STEPS)).otherwise(small).cast("int")


def adjusted(results: DataFrame, p: str = "p_value", family: list[str] | None = None) -> DataFrame:
    """results with q_bonferroni and q_bh (step-up, monotone) over each family of tests; null p-values are not counted.

    Distinct p-values are counted, ranked inside classes of p and shifted by the counts of the classes below; the running minimum from the
    greatest p down goes the same way. No task orders more than a class, and no window spans a family but those over classes."""
    fam = family or []
    v = F.col("_p")
    same = [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in fam]
    named = [F.col(k).alias(f"_f_{k}") for k in fam]
    keys = [f"_f_{k}" for k in fam]
    per = results.filter(F.col(p).isNotNull()).groupBy(*named, F.col(p).alias("_p")).agg(F.count("*").alias("_c")).withColumn("_b", p_class(v))
    inside = Window.partitionBy(*keys, "_b").orderBy("_p")
    per = per.withColumn("_in", F.sum("_c").over(inside))
    below, above = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys).orderBy(F.desc("_b"))  # a row for each class

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        right = right.withColumnsRenamed({k: f"{k}_r" for k in on})
        return left.join(right, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in on]).drop(*(f"{k}_r" for k in on))

    classes = per.groupBy(*keys, "_b").agg(F.sum("_c").alias("_k"))
    offsets = classes.withColumn("_before", F.sum("_k").over(below) - F.col("_k")).withColumn("_m", F.sum("_k").over(Window.partitionBy(*keys)))
    raw = joined(per, offsets, [*keys, "_b"]).withColumn("_q", v * F.col("_m") / (F.col("_before") + F.col("_in")))
    least = raw.groupBy(*keys, "_b").agg(F.min("_q").alias("_least")).withColumn("_higher", F.min("_least").over(above.rowsBetween(Window.unboundedPreceding, -1)))
    up = F.min("_q").over(inside.rowsBetween(0, Window.unboundedFollowing))
    done = joined(raw.withColumn("_up", up), least.drop("_least"), [*keys, "_b"])
    done = done.select(*keys, "_p", F.least(v * F.col("_m"), F.lit(1.0)).alias("q_bonferroni"), F.least("_up", "_higher", F.lit(1.0)).alias("q_bh"))
    return results.join(done, [*same, F.col(p) == v], "left").drop(*keys, "_p")


def kendall_sums(series: DataFrame, keys: list[str]) -> DataFrame:
    """Concordance sum, ties and tau-b of value against time by enumerating pairs: for short series and as a reference for the kernel."""
    a, b = series.alias("a"), series.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.time") < F.col("b.time")]
    sign = F.signum(F.col("b.value") - F.col("a.value"))
    return (
        a.join(b, on)
        .groupBy(*(F.col(f"a.{k}").alias(k) for k in keys))
        .agg(F.sum(sign).cast("long").alias("concordance"), F.count_if(sign != 0).alias("untied"), F.count("*").alias("n_pairs"))
        .withColumn("tau", F.when(F.col("untied") > 0, F.col("concordance") / F.sqrt(F.col("untied").cast("double") * F.col("n_pairs"))))
    )


def condition_pairs(long: DataFrame) -> DataFrame:
    """All unordered pairs of conditions, ordered by where they first appear in time, then by name."""
    seen = long.filter(F.col("condition").isNotNull()).groupBy("condition").agg(F.min("time").alias("t"))
    at = seen.withColumn("i", F.row_number().over(Window.orderBy("t", "condition")))  # a row for each condition
    return at.alias("a").join(at.alias("b"), F.col("a.i") < F.col("b.i")).select(F.col("a.condition").alias("condition_0"), F.col("b.condition").alias("condition_1"))


def nearest_times(series: DataFrame, step: float, keys: list[str]) -> DataFrame:
    """Every step from a series' first time on, up to half a step beyond its last one, the row with the nearest time (the earlier of two as near), each row once.

    Targets stand among the times of their series, and each takes the last time up to it or the first one after it: an as-of match in one window."""
    ends = series.filter("time is not null").groupBy(*keys).agg(F.min("time").alias("_lo"), F.max("time").alias("_hi"))
    most = F.ceil((F.col("_hi") - F.col("_lo")) / step + 0.5) - 1  # the last multiple under the end
    targets = ends.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(most, F.lit(0)).cast("long"))).alias("_k"), "_lo").withColumn("target", F.col("_lo") + F.col("_k") * float(step))
    times = series.filter("time is not null").select(*keys, F.col("time").alias("_at"), F.col("time").cast("double").alias("_t"), F.lit(None).cast("double").alias("target"))
    both = times.unionByName(targets.select(*keys, F.col("target").alias("_at"), F.lit(None).cast("double").alias("_t"), "target"))
    by = Window.partitionBy(*keys).orderBy("_at")
    before, after = F.last("_t", True).over(by.rangeBetween(Window.unboundedPreceding, 0)), F.first("_t", True).over(by.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_a", before).withColumn("_z", after).filter("target is not null")
    time = F.when(F.col("_a").isNull() | (F.col("_z") - F.col("target") < F.col("target") - F.col("_a")), F.col("_z")).otherwise(F.col("_a"))
    return near.withColumn("time", time).groupBy(*keys, "time").agg(F.min("target").alias("target"))


def first_difference(series: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return series.withColumn("difference", F.col("value") - F.lag("value").over(Window.partitionBy(*keys).orderBy("time")))


def best_rows(df: DataFrame, keys: list[str], score: str, tie: list[str], greatest: bool = True, most: int = 1) -> DataFrame:
    """The best rows of each key; the first in the order of tie wins among equals."""
    order = F.col(score).desc_nulls_last() if greatest else F.col(score).asc_nulls_last()
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *tie))).filter(F.col("_r") <= most).drop("_r")


def within_quantiles(long: DataFrame, low: float = 0.15, high: float = 0.85, keys: list[str] = SERIES) -> DataFrame:
    """Rows of whole hours outside the quantiles of their hour go; others stay."""
    hour = F.col("time")
    whole = hour == F.floor(hour)
    bounds = long.filter(whole).groupBy(*keys, "time").agg(F.expr(f"percentile(value, array({low}, {high}))").alias("_q"))
    return long.join(bounds, [*keys, "time"], "left").filter(F.col("_q").isNull() | F.col("value").between(F.get("_q", F.lit(0)), F.get("_q", F.lit(1)))).drop("_q")


def per_ten_thousand(counts: DataFrame, cell: str = "cell_id", value: str = "value") -> DataFrame:
    """counts with tp10k (share of the cell's total, times 10,000) and log1p of it; cells without counts have nulls."""
    total = F.sum(value).over(Window.partitionBy(cell))
    return counts.withColumn("tp10k", F.when(total > 0, F.col(value) / total * 10000)).withColumn("log1p", F.log1p("tp10k"))
