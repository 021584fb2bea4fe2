"""The operators over the driver's tables, each beside the SQL that gives the same rows.

Events become series: the event type is the condition, the user (modulo 5) the subject, hours since 2024 the time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import activity as act
from tidewheel.operators import aggregate as agg
from tidewheel.operators import cosinor as cos
from tidewheel.operators import consensus, methods, model, prep
from tidewheel.operators.model import SERIES
from tidewheel.sources import expression, sinks, synthetic

NUDGE = 1.3e-9
ZERO_US = 1704067200000000
PERIODS = cos.grid(20, 28, 0.5)
LS_PERIODS = cos.grid(18, 32, 0.5)
CHI_PERIODS = cos.grid(18, 32, 1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / F.lit(3600000000.0)
    return e.select(
        F.lit("value").alias("variable"), F.col("event_type").alias("condition"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("subject"),
        hours.alias("time"), "value", "event_id", "user_id",
    )


def hourly(spark: SparkSession, sf_dir: str, keys: list[str] = SERIES) -> DataFrame:
    return agg.binned(raw(spark, sf_dir), 60, "avg", keys)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.binned(raw(spark, sf_dir), 60, "sum", ["condition", "subject"]).withColumnRenamed("value", "activity")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles to so many places, without negative zeros; a little more than the value is rounded, so that no engine meets a tie."""
    return df.select(*(((F.round(F.col(c) + NUDGE, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))


BASE = f"""s AS (SELECT 'value' AS variable, event_type AS condition, 'u' || (user_id % 5) AS subject,
  (epoch_us(ts) - {ZERO_US})::DOUBLE / 3600000000.0 AS time, value, event_id, user_id FROM events),
h AS (SELECT variable, condition, floor(time)::DOUBLE AS time, avg(value) AS value FROM s GROUP BY ALL),
hs AS (SELECT variable, condition, subject, floor(time)::DOUBLE AS time, avg(value) AS value FROM s GROUP BY ALL),
a AS (SELECT condition, subject, floor(time)::DOUBLE AS time, sum(value) AS activity FROM s GROUP BY ALL),
d AS (SELECT *, (floor(time / 24) + 1)::BIGINT AS day, time - 24 * floor(time / 24) AS zt FROM a)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):  # noqa: ANN201
    text = sql

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if text:
            sql = re.sub(r", (\d)\) \+ 0\.0", rf" + {NUDGE}, \1) + 0.0", text)
            ORACLE_SQL[f.__name__] = (f"WITH {BASE} {sql}" if sql.lstrip().startswith("SELECT") else f"WITH {BASE}, {sql}") if base else sql
        return f

    return add


def r(expr: str, name: str, places: int = 4) -> str:
    return f"round({expr}, {places}) + 0.0 AS {name}"


# --- scans, roles, filters


@query("SELECT variable, condition, count(*)::BIGINT AS n_points, count(*) >= 4 AS success FROM h WHERE value IS NOT NULL GROUP BY ALL")
def validate_min_points(spark, sf):  # noqa: ANN001, ANN201
    return model.point_counts(hourly(spark, sf))


@query("SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS null_times, 0::BIGINT AS null_conditions, count(DISTINCT time)::BIGINT AS n_timepoints, count(DISTINCT variable)::BIGINT AS n_variables, true AS valid FROM h")
def validate_long_form(spark, sf):  # noqa: ANN001, ANN201
    return model.check(hourly(spark, sf))


@query("SELECT variable, condition, subject, round(time, 4) + 0.0 AS time, round(value, 4) + 0.0 AS value FROM s WHERE value IS NOT NULL AND time IS NOT NULL AND value > 50")
def drop_missing(spark, sf):  # noqa: ANN001, ANN201
    long = raw(spark, sf).select("variable", "condition", "subject", "time", "value")
    return rounded(model.drop_missing(long.withColumn("value", F.when(F.col("value") > 50, F.col("value")))))


@query("SELECT condition, count(*)::BIGINT AS n, round(avg(value), 4) + 0.0 AS mean FROM s WHERE condition IN ('click', 'view') GROUP BY ALL")
def filter_conditions(spark, sf):  # noqa: ANN001, ANN201
    return rounded(raw(spark, sf).filter(F.col("condition").isin("click", "view")).groupBy("condition").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("SELECT condition, subject, (floor(time / 24) + 1)::BIGINT AS day, count(*)::BIGINT AS n FROM s WHERE floor(time / 24) + 1 BETWEEN 3 AND 9 GROUP BY ALL")
def day_range(spark, sf):  # noqa: ANN001, ANN201
    return act.with_day(model.day_range(raw(spark, sf), 3, 9)).groupBy("condition", "subject", "day").agg(F.count("*").alias("n"))


@query(
    "SELECT 'event_type' AS \"column\", count(DISTINCT event_type)::BIGINT AS n_unique, count(*) FILTER (event_type IS NULL)::BIGINT AS n_missing, min(event_type) AS least, max(event_type) AS greatest FROM events "
    "UNION ALL SELECT 'user_id', count(DISTINCT user_id), count(*) FILTER (user_id IS NULL), min(user_id)::VARCHAR, max(user_id)::VARCHAR FROM events",
    base=False,
)
def role_profile(spark, sf):  # noqa: ANN001, ANN201
    return model.profile(table(spark, sf, "events"), ["event_type", "user_id"])


@query(
    "SELECT 'l_' || v AS variable, l_returnflag AS condition, count(*)::BIGINT AS n, round(avg(x), 4) + 0.0 AS mean FROM "
    "(SELECT l_returnflag, unnest(['quantity', 'discount', 'tax']) AS v, unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem) GROUP BY ALL",
    base=False,
)
def unpivot_wide(spark, sf):  # noqa: ANN001, ANN201
    items = table(spark, sf, "lineitem").select(F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1992-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))").alias("time_h"), F.col("l_returnflag").alias("group"), "l_quantity", "l_discount", "l_tax")
    long = model.to_long(items, model.detect_roles(items))
    return rounded(long.groupBy("variable", "condition").agg(F.count("value").alias("n"), F.avg("value").alias("mean")))


@query(
    "SELECT p_name, min(match_rank)::INTEGER AS match_rank FROM (SELECT p_name, CASE WHEN lower(p_name) = 'red' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1 ELSE 2 END AS match_rank FROM part WHERE contains(lower(p_name), 'red')) GROUP BY p_name ORDER BY match_rank, p_name LIMIT 25",
    base=False,
)
def gene_search_topk(spark, sf):  # noqa: ANN001, ANN201
    names = table(spark, sf, "part").select("p_name").distinct()
    low = F.lower("p_name")
    rank = F.when(low == "red", 0).when(low.startswith("red"), 1).otherwise(2)
    return names.filter(low.contains("red")).withColumn("match_rank", rank).orderBy("match_rank", "p_name").limit(25)


# --- aggregation


@query("SELECT variable, condition, time, round(value, 4) + 0.0 AS value FROM h")
def series_hourly_mean(spark, sf):  # noqa: ANN001, ANN201
    return rounded(hourly(spark, sf))


@query(
    f"SELECT variable, condition, time, count(value)::BIGINT AS n, {r('avg(value)', 'mean')}, {r('median(value)', 'median')}, {r('stddev_samp(value)', 'sd')}, {r('coalesce(stddev_samp(value) / sqrt(count(value)), 0.0)', 'sem')} FROM hs GROUP BY variable, condition, time"
)
def timepoint_summary(spark, sf):  # noqa: ANN001, ANN201
    return rounded(agg.by_timepoint(hourly(spark, sf, [*SERIES, "subject"])))


@query("SELECT condition, count(DISTINCT user_id)::BIGINT AS n_users, count(DISTINCT floor(time))::BIGINT AS n_timepoints FROM s GROUP BY ALL")
def series_count_distinct(spark, sf):  # noqa: ANN001, ANN201
    return raw(spark, sf).groupBy("condition").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct(F.floor("time")).alias("n_timepoints"))


@query("SELECT condition, time, count(*)::BIGINT AS n_replicates FROM hs GROUP BY ALL")
def timepoint_replicates(spark, sf):  # noqa: ANN001, ANN201
    return hourly(spark, sf, [*SERIES, "subject"]).groupBy("condition", "time").agg(F.count("*").alias("n_replicates"))


@query("SELECT condition, subject, floor(time * 60 / 30) * 30 / 60 AS time, round(sum(value), 4) + 0.0 AS value FROM s GROUP BY 1, 2, 3")
def bin_sum(spark, sf):  # noqa: ANN001, ANN201
    return rounded(agg.binned(raw(spark, sf), 30, "sum", ["condition", "subject"]))


@query("SELECT variable, condition, time, round(value, 4) + 0.0 AS value, rank() OVER (PARTITION BY condition ORDER BY value) + (count(*) OVER (PARTITION BY condition, value) - 1) / 2.0 AS rank FROM h")
def rank_average(spark, sf):  # noqa: ANN001, ANN201
    return rounded(agg.average_ranks(hourly(spark, sf)))


@query(
    """f AS (SELECT * FROM h WHERE time < 48),
p AS (SELECT x.condition, sign(y.value - x.value) AS g FROM f x JOIN f y ON x.condition = y.condition AND x.time < y.time)
SELECT condition, sum(g)::BIGINT AS concordance, count(*) FILTER (g <> 0)::BIGINT AS untied, count(*)::BIGINT AS n_pairs,
round(sum(g) / sqrt((count(*) FILTER (g <> 0))::DOUBLE * count(*)), 4) + 0.0 AS tau FROM p GROUP BY condition"""
)
def kendall_tau_small(spark, sf):  # noqa: ANN001, ANN201
    return rounded(agg.kendall_sums(hourly(spark, sf).filter("time < 48"), ["condition"]))


@query(
    """x AS (SELECT a.condition AS c0, min(a.time) AS t FROM s a GROUP BY 1), o AS (SELECT c0, row_number() OVER (ORDER BY t, c0) AS i FROM x)
SELECT p.c0 AS condition_0, q.c0 AS condition_1 FROM o p JOIN o q ON p.i < q.i"""
)
def condition_pairs(spark, sf):  # noqa: ANN001, ANN201
    return agg.condition_pairs(raw(spark, sf))


@query(
    """e AS (SELECT condition, min(time) AS lo, max(time) AS hi FROM h GROUP BY condition),
k AS (SELECT condition, lo + 3.0 * unnest(range(0, ceil((hi - lo) / 3.0 + 0.5)::BIGINT)) AS target FROM e),
m AS (SELECT k.condition, k.target, h.time, row_number() OVER (PARTITION BY k.condition, k.target ORDER BY abs(h.time - k.target), h.time) AS i FROM k JOIN h ON h.condition = k.condition)
SELECT condition, time, min(target)::DOUBLE AS target FROM m WHERE i = 1 GROUP BY ALL"""
)
def nearest_time_subsample(spark, sf):  # noqa: ANN001, ANN201
    return agg.nearest_times(hourly(spark, sf), 3.0, ["condition"])


@query("SELECT condition, time, round(value, 4) + 0.0 AS value, round(value - lag(value) OVER (PARTITION BY condition ORDER BY time), 4) + 0.0 AS difference FROM h")
def first_difference(spark, sf):  # noqa: ANN001, ANN201
    return rounded(agg.first_difference(hourly(spark, sf)).drop("variable"))


@query(
    """q AS (SELECT condition, time, quantile_cont(value, 0.15) AS lo, quantile_cont(value, 0.85) AS hi FROM hs GROUP BY ALL)
SELECT condition, subject, time, round(value, 4) + 0.0 AS value FROM hs JOIN q USING (condition, time) WHERE value BETWEEN lo AND hi"""
)
def quantile_clean(spark, sf):  # noqa: ANN001, ANN201
    return rounded(agg.within_quantiles(hourly(spark, sf, [*SERIES, "subject"])).select("condition", "subject", "time", "value"))


@query("SELECT condition, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY n DESC, user_id) AS i FROM (SELECT condition, user_id, count(*)::BIGINT AS n FROM s GROUP BY ALL)) WHERE i <= 5")
def top_k_per_class(spark, sf):  # noqa: ANN001, ANN201
    return agg.best_rows(raw(spark, sf).groupBy("condition", "user_id").agg(F.count("*").alias("n")), ["condition"], "n", ["user_id"], most=5)


@query("SELECT l_suppkey, l_partkey, round(m, 4) + 0.0 AS mean FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY m DESC, l_partkey) AS i FROM (SELECT l_suppkey, l_partkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL)) WHERE i = 1", base=False)
def max_mean_probe(spark, sf):  # noqa: ANN001, ANN201
    means = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.avg("l_quantity").alias("mean"))
    return rounded(agg.best_rows(means, ["l_suppkey"], "mean", ["l_partkey"]))


@query(
    "SELECT l_orderkey AS cell_id, l_linenumber AS gene, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 10000, 4) + 0.0 AS tp10k, "
    "round(ln(1 + l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 10000), 4) + 0.0 AS log1p FROM lineitem",
    base=False,
)
def tp10k_log1p(spark, sf):  # noqa: ANN001, ANN201
    counts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_linenumber").alias("gene"), F.col("l_quantity").alias("value"))
    return rounded(agg.per_ten_thousand(counts).drop("value"))


@query("SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY ALL", base=False)
def semi_join_annotated(spark, sf):  # noqa: ANN001, ANN201
    marked = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return expression.annotated(table(spark, sf, "orders"), marked, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT user_id, condition, n FROM (SELECT user_id, condition, count(*)::BIGINT AS n FROM s WHERE time < 240 GROUP BY ALL UNION ALL SELECT user_id, condition, count(*) FROM s WHERE time >= 480 GROUP BY ALL)")
def union_sources(spark, sf):  # noqa: ANN001, ANN201
    count = lambda df: df.groupBy("user_id", "condition").agg(F.count("*").alias("n"))
    return count(raw(spark, sf).filter("time < 240")).unionByName(count(raw(spark, sf).filter("time >= 480")))


@query("SELECT DISTINCT user_id FROM s WHERE condition = 'purchase' EXCEPT SELECT user_id FROM s WHERE condition = 'signup' AND value > 80")
def except_labels(spark, sf):  # noqa: ANN001, ANN201
    return raw(spark, sf).filter("condition = 'purchase'").select("user_id").subtract(raw(spark, sf).filter("condition = 'signup' and value > 80").select("user_id"))


@query("SELECT user_id FROM s WHERE condition = 'click' AND value > 90 INTERSECT SELECT user_id FROM s WHERE condition = 'view' AND value > 90")
def intersect_groups(spark, sf):  # noqa: ANN001, ANN201
    hot = lambda c: raw(spark, sf).filter((F.col("condition") == c) & (F.col("value") > 90)).select("user_id")
    return hot("click").intersect(hot("view"))


@query("SELECT condition, '{\"n\":' || count(*) || ',\"first\":' || min(event_id) || '}' AS details, CASE WHEN count(DISTINCT subject) <= 5 THEN '[' || string_agg(DISTINCT '\"' || subject || '\"', ',' ORDER BY '\"' || subject || '\"') || ']' ELSE '[' || count(DISTINCT subject) || ' items]' END AS subjects FROM s GROUP BY condition")
def flatten_export(spark, sf):  # noqa: ANN001, ANN201
    nested = raw(spark, sf).groupBy("condition").agg(F.to_json(F.struct(F.count("*").alias("n"), F.min("event_id").alias("first"))).alias("details"), F.sort_array(F.collect_set("subject")).alias("subjects"))
    return sinks.flat(nested)


# --- cleaning


@query(
    """q AS (SELECT condition AS c, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM h GROUP BY 1)
SELECT variable, condition, time, CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN round(value, 4) + 0.0 END AS value FROM h JOIN q ON condition = c"""
)
def outlier_iqr(spark, sf):  # noqa: ANN001, ANN201
    return rounded(prep.mask_iqr(hourly(spark, sf)))


@query("SELECT variable, condition, time, CASE WHEN abs(value - avg(value) OVER w) <= 1.5 * stddev_pop(value) OVER w THEN round(value, 4) + 0.0 END AS value FROM h WINDOW w AS (PARTITION BY condition)")
def outlier_zscore(spark, sf):  # noqa: ANN001, ANN201
    return rounded(prep.mask_z(hourly(spark, sf)))


@query("q AS (SELECT condition AS c, regr_slope(value, time) AS b, regr_intercept(value, time) AS i FROM h GROUP BY 1) SELECT variable, condition, time, round(value - i - b * time, 4) + 0.0 AS value FROM h JOIN q ON condition = c")
def detrend_linear(spark, sf):  # noqa: ANN001, ANN201
    return rounded(prep.detrend_linear(hourly(spark, sf)))


@query("SELECT variable, condition, time, round(value - avg(value) OVER (PARTITION BY condition ORDER BY time ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), 4) + 0.0 AS value FROM h")
def detrend_moving_average(spark, sf):  # noqa: ANN001, ANN201
    return rounded(prep.detrend_moving_average(hourly(spark, sf), 24, order=["time"]))


GAPS = "g AS (SELECT variable, condition, time, CASE WHEN value BETWEEN 30 AND 70 THEN value END AS value, row_number() OVER (PARTITION BY condition ORDER BY time) AS i FROM h)"
FILLED = f"""{GAPS}, n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, last_value(value IGNORE NULLS) OVER b AS v0,
 first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER f AS i1, first_value(value IGNORE NULLS) OVER f AS v1 FROM g
 WINDOW b AS (PARTITION BY condition ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY condition ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x AS (SELECT variable, condition, time, value AS was, coalesce(value, v0 + (v1 - v0) * (i - i0) / nullif(i1 - i0, 0), v0, v1) AS value FROM n)"""


def gaps(spark, sf):  # noqa: ANN001, ANN201
    return hourly(spark, sf).withColumn("value", F.when(F.col("value").between(30, 70), F.col("value")))


@query(f"{FILLED} SELECT variable, condition, time, round(value, 4) + 0.0 AS value FROM x")
def interpolate_gaps(spark, sf):  # noqa: ANN001, ANN201
    return rounded(prep.interpolate(gaps(spark, sf), order=["time"]))


@query(f"{FILLED} SELECT variable, condition, time, CASE WHEN was IS NOT NULL THEN round(m, 4) + 0.0 END AS value FROM (SELECT *, avg(value) OVER (PARTITION BY condition ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM x)")
def smooth_moving_average(spark, sf):  # noqa: ANN001, ANN201
    return rounded(prep.smooth_moving_average(gaps(spark, sf), 5, order=["time"]))


# --- rhythms


def fits_sql(periods: list[float], source: str = "h", keys: str = "condition") -> str:
    return f"""g AS (SELECT unnest({periods!r})::DOUBLE AS period),
m AS (SELECT {keys}, period, count(*) AS n, avg(value) AS my, var_pop(value) AS yy, avg(c) AS mc, avg(sn) AS ms, var_pop(c) AS cc, var_pop(sn) AS ss,
 covar_pop(c, sn) AS cs, covar_pop(c, value) AS cy, covar_pop(sn, value) AS sy
 FROM (SELECT {source}.*, period, cos(2 * pi() * time / period) AS c, sin(2 * pi() * time / period) AS sn FROM {source}, g) GROUP BY {keys}, period),
w AS (SELECT *, CASE WHEN n >= 4 AND cc * ss - cs * cs > 1e-12 AND yy > 0 THEN (cy * ss - sy * cs) / (cc * ss - cs * cs) END AS b,
 CASE WHEN n >= 4 AND cc * ss - cs * cs > 1e-12 AND yy > 0 THEN (sy * cc - cy * cs) / (cc * ss - cs * cs) END AS g FROM m),
fit AS (SELECT {keys}, period, n::BIGINT AS n, my - b * mc - g * ms AS mesor, sqrt(b * b + g * g) AS amplitude, b, g,
 (atan2(g, b) + 2 * pi()) - 2 * pi() * floor((atan2(g, b) + 2 * pi()) / (2 * pi())) AS phase, least(greatest((b * cy + g * sy) / yy, 0), 1) AS r2, mc, ms, cc, ss, cs, yy FROM w),
fits AS (SELECT *, phase * period / (2 * pi()) AS peak_hour, pow(1 - r2, (n - 3) / 2.0) AS p_value FROM fit)"""


@query(f"{fits_sql([24.0])} SELECT condition, period, n, {r('mesor', 'mesor')}, {r('amplitude', 'amplitude')}, {r('peak_hour', 'peak_hour')}, {r('r2', 'r2')}, {r('p_value', 'p_value')}, true AS success FROM fits")
def cosinor_24h(spark, sf):  # noqa: ANN001, ANN201
    return rounded(cos.cosinor(hourly(spark, sf)).select("condition", "period", "n", "mesor", "amplitude", "peak_hour", "r2", "p_value", "success"))


def t_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t, by the finite sums of whole degrees of freedom."""
    c = f"({df} / ({df} + {t} * {t}))"
    even = f"sqrt(1 - {c}) * list_sum([exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow({c}, j) FOR j IN range(0, ({df} // 2)::BIGINT)])"
    odd = f"2 / pi() * (acos(sqrt({c})) + sqrt({c} * (1 - {c})) * list_sum([exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow({c}, j) FOR j IN range(0, (({df} - 1) // 2)::BIGINT)]))"
    return f"1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END"


ERRORS = f"""{fits_sql([24.0, 12.0])},
v AS (SELECT *, yy * (1 - r2) / (n - 3) AS u, cc * ss - cs * cs AS det FROM fits),
e AS (SELECT *, u * ss / det AS vb, u * cc / det AS vg, -u * cs / det AS vbg, b * b + g * g AS a2, n - 3 AS df FROM v),
er AS (SELECT condition, period, df, abs(b) / sqrt(vb) AS tb, abs(g) / sqrt(vg) AS tg, mesor, amplitude, phase,
 sqrt(u + mc * mc * vb + ms * ms * vg + 2 * mc * ms * vbg) AS mesor_se, sqrt((b * b * vb + g * g * vg + 2 * b * g * vbg) / a2) AS amplitude_se, sqrt((g * g * vb + b * b * vg - 2 * b * g * vbg) / (a2 * a2)) AS acrophase_se FROM e)"""


@query(
    f"{ERRORS} SELECT condition, period, {r('mesor_se', 'mesor_se')}, {r('amplitude_se', 'amplitude_se')}, {r('acrophase_se', 'acrophase_se')}, {r('mesor - 1.96 * mesor_se', 'mesor_lo')}, {r('amplitude - 1.96 * amplitude_se', 'amplitude_lo')}, "
    f"{r('amplitude + 1.96 * amplitude_se', 'amplitude_hi')}, {r('phase + 1.96 * acrophase_se', 'acrophase_hi')}, {r(t_sql('tb', 'df'), 'amplitude_p')}, {r(t_sql('tg', 'df'), 'acrophase_p')} FROM er"
)
def cosinor_errors(spark, sf):  # noqa: ANN001, ANN201
    return rounded(cos.cosinor(hourly(spark, sf), [24.0, 12.0]).select("condition", "period", "mesor_se", "amplitude_se", "acrophase_se", "mesor_lo", "amplitude_lo", "amplitude_hi", "acrophase_hi", "amplitude_p", "acrophase_p"))


@query(f"{fits_sql([24.0])} SELECT condition, period, i * 0.5::DOUBLE AS time, {r('mesor + amplitude * cos(2 * pi() * (i * 0.5 - peak_hour) / 24)', 'fitted')} FROM fits, range(48) AS q(i)")
def cosinor_curve(spark, sf):  # noqa: ANN001, ANN201
    return rounded(cos.predict(cos.cosinor(hourly(spark, sf)), 48).drop("variable"))


@query(f"{fits_sql(PERIODS)} SELECT condition, period, n, {r('mesor', 'mesor')}, {r('amplitude', 'amplitude')}, {r('r2', 'r2')}, {r(f'least(p_value * {len(PERIODS)}, 1)', 'p_adjusted')} FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY r2 DESC, period) AS i FROM fits) WHERE i = 1")
def cosinor_period_search(spark, sf):  # noqa: ANN001, ANN201
    return rounded(cos.best_period(cos.cosinor(hourly(spark, sf), PERIODS)).select("condition", "period", "n", "mesor", "amplitude", "r2", "p_adjusted"))


@query(f"{fits_sql([24.0])}, x AS (SELECT condition, min(time) AS t FROM h GROUP BY 1), o AS (SELECT condition, row_number() OVER (ORDER BY t, condition) AS i FROM x) SELECT p.condition AS condition_0, q.condition AS condition_1, {r('y.mesor - x2.mesor', 'd_mesor')}, {r('y.amplitude - x2.amplitude', 'd_amplitude')}, round((y.peak_hour - x2.peak_hour + 12) - 24 * floor((y.peak_hour - x2.peak_hour + 12) / 24) - 12, 4) + 0.0 AS d_peak_hour FROM o p JOIN o q ON p.i < q.i JOIN fits x2 ON x2.condition = p.condition JOIN fits y ON y.condition = q.condition")
def cosinor_pairs_diff(spark, sf):  # noqa: ANN001, ANN201
    h = hourly(spark, sf)
    return rounded(cos.pair_differences(cos.cosinor(h), agg.condition_pairs(h)).drop("variable", "period"))


@query(f"{fits_sql([24.0], 'hs', 'condition, subject')} SELECT condition, count(*)::BIGINT AS n_subjects, {r('avg(mesor)', 'mesor')}, {r('stddev_samp(mesor) / sqrt(count(*))', 'mesor_se')}, {r('sqrt(avg(b) * avg(b) + avg(g) * avg(g))', 'amplitude')} FROM fits WHERE b IS NOT NULL GROUP BY condition")
def population_cosinor(spark, sf):  # noqa: ANN001, ANN201
    return rounded(cos.population(hourly(spark, sf, [*SERIES, "subject"])).drop("variable", "peak_hour"))


@query(f"{fits_sql([24.0], 'hs', 'condition, subject')}, k AS (SELECT condition, subject, p_value, count(*) OVER () AS m, count(*) OVER (ORDER BY p_value RANGE UNBOUNDED PRECEDING) AS rk FROM fits), b2 AS (SELECT *, least(min(p_value * m / rk) OVER (ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING), 1) AS q FROM k) SELECT condition, subject, {r('p_value', 'p_value')}, {r('least(p_value * m, 1)', 'q_bonferroni')}, {r('q', 'q_bh')} FROM b2")
def bh_adjust(spark, sf):  # noqa: ANN001, ANN201
    fits = cos.cosinor(hourly(spark, sf, [*SERIES, "subject"]), [24.0], [*SERIES, "subject"]).select("condition", "subject", "p_value")
    return rounded(agg.adjusted(fits))


@query(f"{fits_sql([24.0], 'hs', 'condition, subject')} SELECT condition, subject, {r('p_value', 'p_value')} FROM fits WHERE p_value < 0.2")
def significance_filter(spark, sf):  # noqa: ANN001, ANN201
    fits = cos.cosinor(hourly(spark, sf, [*SERIES, "subject"]), [24.0], [*SERIES, "subject"]).select("condition", "subject", "p_value")
    return rounded(model.significant(fits, alpha=0.2))


LS_SQL = f"""g AS (SELECT unnest({LS_PERIODS!r})::DOUBLE AS period), mu AS (SELECT condition, count(*) AS n, avg(value) AS my, var_pop(value) AS vy FROM h GROUP BY 1),
t AS (SELECT condition, period, atan2(sum(sin(4 * pi() * time / period)), sum(cos(4 * pi() * time / period))) / 2 AS tau FROM h, g GROUP BY ALL),
q AS (SELECT h.condition, period, n, vy, sum((value - my) * cos(2 * pi() * time / period - tau)) AS yc, sum((value - my) * sin(2 * pi() * time / period - tau)) AS ys,
 sum(pow(cos(2 * pi() * time / period - tau), 2)) AS cc, sum(pow(sin(2 * pi() * time / period - tau), 2)) AS ss FROM h JOIN mu USING (condition) JOIN t USING (condition) GROUP BY ALL),
pw AS (SELECT condition, period, n::BIGINT AS n, (yc * yc / cc + ys * ys / ss) / (n * vy) AS power FROM q),
f AS (SELECT *, least(greatest(1 - pow(1 - pow(1 - power, (n - 3) / 2.0), n), 0), 1) AS fap FROM pw)"""


@query(f"{LS_SQL} SELECT condition, period, n, {r('power', 'power')}, {r('fap', 'fap')} FROM f")
def lomb_scargle(spark, sf):  # noqa: ANN001, ANN201
    return rounded(cos.lomb_scargle(hourly(spark, sf), LS_PERIODS).drop("variable"))


@query(f"{LS_SQL} SELECT condition, period, {r('power', 'power')} FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY power DESC, period) AS i FROM f) WHERE i = 1")
def lomb_scargle_peak(spark, sf):  # noqa: ANN001, ANN201
    return rounded(cos.strongest(cos.lomb_scargle(hourly(spark, sf), LS_PERIODS)).select("condition", "period", "power"))


# --- activity


@query("SELECT condition, subject, time, day, zt, round(activity, 4) + 0.0 AS activity FROM d")
def zt_day(spark, sf):  # noqa: ANN001, ANN201
    return rounded(act.with_day(activity(spark, sf)))


@query("SELECT condition, subject, time, round(activity / sum(activity) OVER (PARTITION BY condition, subject), 6) + 0.0 AS activity FROM a")
def activity_normalised(spark, sf):  # noqa: ANN001, ANN201
    return rounded(act.normalised(activity(spark, sf)), 6)


@query("SELECT condition, day, zt, round(avg(activity), 4) + 0.0 AS activity FROM d GROUP BY ALL")
def activity_matrix(spark, sf):  # noqa: ANN001, ANN201
    return rounded(act.matrix(activity(spark, sf)))


@query(
    """m AS (SELECT condition, day, zt, avg(activity) AS activity FROM d GROUP BY ALL), f AS (SELECT condition, day, lead(day) OVER (PARTITION BY condition ORDER BY day) AS nx FROM (SELECT DISTINCT condition, day FROM m))
SELECT condition, day, zt, round(activity, 4) + 0.0 AS activity FROM m JOIN f USING (condition, day) WHERE nx IS NOT NULL
UNION ALL SELECT f.condition, f.day, m.zt + 24, round(activity, 4) + 0.0 FROM m JOIN f ON f.condition = m.condition AND f.nx = m.day"""
)
def actogram_long(spark, sf):  # noqa: ANN001, ANN201
    return rounded(act.actogram(activity(spark, sf)))


@query(f"SELECT condition, day, count(*)::BIGINT AS n_subjects, {r('avg(t)', 'mean_total')}, {r('coalesce(stddev_samp(t) / sqrt(count(t)), 0.0)', 'sem_total')} FROM (SELECT condition, subject, day, sum(activity) AS t FROM d GROUP BY ALL) GROUP BY condition, day")
def daily_totals(spark, sf):  # noqa: ANN001, ANN201
    return rounded(act.daily_totals(activity(spark, sf)))


@query(
    """o AS (SELECT *, activity > avg(activity) OVER w + 0.5 * coalesce(stddev_samp(activity) OVER w, 0) AS ov FROM d WINDOW w AS (PARTITION BY condition, subject, day)),
i AS (SELECT *, sum((NOT ov)::INT) OVER (PARTITION BY condition, subject, day ORDER BY zt) AS g FROM o),
u AS (SELECT condition, subject, day, g, count(*) AS n, min(zt) AS st, max(zt) AS en FROM i WHERE ov GROUP BY ALL)
SELECT condition, subject, day, min(st) AS onset, max(en) AS "offset" FROM u WHERE n >= 2 GROUP BY ALL"""
)
def onset_offset(spark, sf):  # noqa: ANN001, ANN201
    return act.onset_offset(activity(spark, sf))


CHI = f"""g AS (SELECT p::DOUBLE AS period, greatest(round_even(p, 0), 2)::INTEGER AS n_slots FROM (SELECT unnest({CHI_PERIODS!r}) AS p)),
st AS (SELECT condition, subject, avg(activity) AS m, var_samp(activity) AS v FROM a GROUP BY 1, 2),
sl AS (SELECT condition, subject, period, n_slots, floor(time)::BIGINT % n_slots AS slot, count(*) AS n, avg(activity) AS mean FROM a, g GROUP BY ALL),
qp AS (SELECT condition, subject, period, n_slots, sum(n * pow(mean - m, 2)) / nullif(max(v), 0) AS qp FROM sl JOIN st USING (condition, subject) GROUP BY ALL)"""


@query(f"{CHI} SELECT condition, subject, period, n_slots, round(qp, 4) + 0.0 AS qp FROM qp")
def chi2_periodogram(spark, sf):  # noqa: ANN001, ANN201
    return rounded(act.chi2_periodogram(activity(spark, sf), CHI_PERIODS, 1.0))


#: With an odd number of slots the degrees of freedom are even and the tail is a finite sum.
ODD_PERIODS = [19.0, 21.0, 23.0, 25.0, 27.0]
CHI_TESTS = f"""{CHI.replace(repr(CHI_PERIODS), repr(ODD_PERIODS))},
te AS (SELECT *, list_sum([exp(-qp / 2 + j * ln(qp / 2) - lgamma(j + 1)) FOR j IN range(0, ((n_slots - 1) // 2)::BIGINT)]) AS p FROM qp WHERE qp > 0)"""


@query(f"{CHI_TESTS} SELECT condition, subject, period, {r('p', 'p_value')}, p < 0.05 AS rhythmic FROM te")
def chi2_significance(spark, sf):  # noqa: ANN001, ANN201
    tested = act.chi2_tested(act.chi2_periodogram(activity(spark, sf), ODD_PERIODS, 1.0).filter("qp > 0"))
    return rounded(tested.select("condition", "subject", "period", "p_value", "rhythmic"))


@query(
    f"""{CHI_TESTS}, be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition, subject ORDER BY qp DESC, period) AS i FROM te) WHERE i = 1),
pe AS (SELECT condition AS c, count(*) AS nt, count(*) FILTER (p < 0.3) AS nr, avg(period) FILTER (p < 0.3) AS tau, coalesce(stddev_samp(period) FILTER (p < 0.3) / sqrt(count(*) FILTER (p < 0.3)), 0) AS tau_sem FROM be GROUP BY 1)
SELECT te.condition, te.period, te.n_slots, {r('avg(te.qp) FILTER (be.p < 0.3)', 'qp')}, {r('coalesce(stddev_samp(te.qp) FILTER (be.p < 0.3) / sqrt(count(*) FILTER (be.p < 0.3)), 0.0)', 'qp_sem')}, max(nr)::BIGINT AS n_rhythmic, max(nt)::BIGINT AS n_total, {r('max(tau)', 'tau')}
FROM te JOIN be ON be.condition = te.condition AND be.subject = te.subject JOIN pe ON pe.c = te.condition WHERE nr > 0 GROUP BY ALL"""
)
def group_periodogram(spark, sf):  # noqa: ANN001, ANN201
    tested = act.chi2_tested(act.chi2_periodogram(activity(spark, sf), ODD_PERIODS, 1.0).filter("qp > 0"), 0.3)
    return rounded(act.group_periodogram(tested).filter("n_rhythmic > 0").drop("threshold", "tau_sem"))


ALPHA_DAYS = """pr AS (SELECT condition, subject, day, zt, avg(activity) AS av FROM d GROUP BY ALL),
ov AS (SELECT *, av > avg(av) OVER (PARTITION BY condition, subject, day) AS o FROM pr),
ad AS (SELECT condition, subject, day, 24.0 * count(*) FILTER (o) / count(*) AS alpha, min(zt) FILTER (o) AS onset, max(zt) FILTER (o) AS fin FROM ov GROUP BY ALL)"""


@query(f'{ALPHA_DAYS} SELECT condition, subject, day, {r("alpha", "alpha_hours")}, {r("24 - alpha", "rho_hours")}, onset, fin AS "offset" FROM ad')
def alpha_rho_days(spark, sf):  # noqa: ANN001, ANN201
    days = act.days_alpha_rho(activity(spark, sf))
    return days.select("condition", "subject", "day", F.round(F.col("alpha_hours") + NUDGE, 4).alias("alpha_hours"), F.round(F.col("rho_hours") + NUDGE, 4).alias("rho_hours"), "onset", "offset")


@query(f"{ALPHA_DAYS} SELECT condition, subject, count(*)::BIGINT AS n_days, {r('avg(alpha)', 'alpha_mean')}, {r('stddev_pop(alpha)', 'alpha_sd')}, {r('24 - avg(alpha)', 'rho_mean')}, {r('stddev_pop(alpha)', 'rho_sd')}, {r('coalesce(stddev_pop(onset), 0.0)', 'onset_sd')}, {r('coalesce(stddev_pop(fin), 0.0)', 'offset_sd')} FROM ad GROUP BY ALL")
def alpha_rho_summary(spark, sf):  # noqa: ANN001, ANN201
    return rounded(act.alpha_rho_summary(act.days_alpha_rho(activity(spark, sf))))


@query(
    f"""{CHI}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition, subject ORDER BY qp DESC NULLS LAST, period) AS i FROM qp) WHERE i = 1),
md AS (SELECT condition, median(period) AS median_period FROM b GROUP BY 1)
SELECT condition, subject, period, median_period FROM (SELECT b.*, median_period, row_number() OVER (PARTITION BY b.condition ORDER BY abs(period - median_period), subject) AS k FROM b JOIN md ON md.condition = b.condition) WHERE k = 1"""
)
def representative_individual(spark, sf):  # noqa: ANN001, ANN201
    return act.representative(act.best_chi2(act.chi2_periodogram(activity(spark, sf), CHI_PERIODS, 1.0)))


@query(
    """x AS (SELECT condition, subject, day, time, zt, activity, avg(activity) OVER w AS m, count(*) OVER (PARTITION BY condition, subject, day) AS k, activity - lag(activity) OVER (PARTITION BY condition, subject ORDER BY time) AS df FROM d WINDOW w AS (PARTITION BY condition, subject)),
iv AS (SELECT condition, subject, count(*) AS n, sum(pow(activity - m, 2)) AS ss, sum(df * df) AS dd FROM x GROUP BY 1, 2),
hr AS (SELECT condition, subject, zt, avg(activity) AS av, max(m) AS m, count(*) AS n, sum(pow(activity - m, 2)) AS s FROM x WHERE k = 24 GROUP BY 1, 2, 3),
st AS (SELECT condition, subject, sum(n) * sum(pow(av - m, 2)) / (24 * nullif(sum(s), 0)) AS stab FROM hr GROUP BY 1, 2)
SELECT iv.condition, iv.subject, iv.n::BIGINT AS n, round(stab, 4) + 0.0 AS interdaily_stability, round(iv.n * dd / ((iv.n - 1) * nullif(ss, 0)), 4) + 0.0 AS intradaily_variability FROM iv LEFT JOIN st USING (condition, subject)"""
)
def is_iv(spark, sf):  # noqa: ANN001, ANN201
    return rounded(act.is_iv(activity(spark, sf)))


@query(f"SELECT condition, subject, count(*)::BIGINT AS n_bins, {r('24.0 * count(*) FILTER (activity > m) / count(*)', 'alpha_hours')}, {r('24 - 24.0 * count(*) FILTER (activity > m) / count(*)', 'rho_hours')} FROM (SELECT *, avg(activity) OVER (PARTITION BY condition, subject) AS m FROM a) GROUP BY ALL")
def alpha_rho(spark, sf):  # noqa: ANN001, ANN201
    return rounded(act.alpha_rho(activity(spark, sf)))


QUIET = "z AS (SELECT condition, subject, time, CASE WHEN activity > 60 THEN activity ELSE 0 END AS activity FROM a)"
DEAD = f"""{QUIET}, y AS (SELECT *, activity = 0 AS still, lag(time) OVER w AS before, sum((activity <> 0)::INT) OVER w AS g FROM z WINDOW w AS (PARTITION BY condition, subject ORDER BY time)),
ru AS (SELECT condition, subject, g, min(time) AS st, coalesce(min(before), min(time)) AS fr, max(time) AS en FROM y WHERE still GROUP BY ALL),
dead AS (SELECT condition, subject, min(st) AS dead_from FROM ru WHERE en - fr >= 24 GROUP BY ALL)"""


def quiet(spark, sf):  # noqa: ANN001, ANN201
    return activity(spark, sf).withColumn("activity", F.when(F.col("activity") > 60, F.col("activity")).otherwise(0.0))


@query(f"{DEAD} SELECT condition, subject, dead_from FROM dead")
def dead_channels(spark, sf):  # noqa: ANN001, ANN201
    return act.dead_channels(quiet(spark, sf), 24.0)


@query(f"{DEAD} SELECT z.condition, z.subject, count(*)::BIGINT AS n FROM z LEFT JOIN dead ON dead.condition = z.condition AND dead.subject = z.subject WHERE dead.condition IS NULL GROUP BY ALL")
def anti_join_dead(spark, sf):  # noqa: ANN001, ANN201
    return act.alive(quiet(spark, sf), 24.0).groupBy("condition", "subject").agg(F.count("*").alias("n"))


# --- methods without SQL: kernels over grouped series


def daily_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Means of every second hour over six days: series of the length that rank methods are made for."""
    h = raw(spark, sf).filter("time < 144").withColumn("time", F.floor(F.col("time") / 2) * 2.0)
    return agg.mean_series(h)


def _method(name: str, method: str, source=daily_shape, **how) -> None:  # noqa: ANN001
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return methods.detect(source(spark, sf), method, **how)

    run.__name__ = name
    query()(run)


def fortnight(spark: SparkSession, sf: str) -> DataFrame:
    """Means of every fourth hour over fourteen days."""
    return agg.mean_series(raw(spark, sf).filter("time < 336").withColumn("time", F.floor(F.col("time") / 4) * 4.0))


def ranks_sql(periods: list[float], peaks: list[float], kind: str, each: str = "condition") -> str:
    """The best template by the normal p of Kendall's concordance with corrections for ties; erfc is 1 minus erf's series of positive terms."""
    x = "((t - lag) - period * floor((t - lag) / period)) / period"
    shape = f"CASE WHEN {x} < peak THEN {x} / peak ELSE (1 - {x}) / (1 - peak) END" if kind == "triangle" else "cos(2 * pi() * (t - lag) / period)"
    top = "lag + peak * period" if kind == "triangle" else "lag"
    erf = "CASE WHEN x > 0 THEN list_sum([exp(-x * x + (2 * j + 1) * ln(x) - lgamma(j + 1.5)) FOR j IN range(0, 150)]) ELSE 0 END"
    tie = lambda c: ", ".join(f"sum({e})::DOUBLE AS {c}{i}" for i, e in ((2, "k * (k - 1)"), (3, "k * (k - 1) * (k - 2)"), (5, "k * (k - 1) * (2 * k + 5)")))
    return f"""y AS (SELECT condition, floor(time / 4) * 4.0 AS t, avg(value) AS y FROM s WHERE time < 336 GROUP BY ALL),
te AS (SELECT *, row_number() OVER (ORDER BY period, peak, lag) AS idx FROM (SELECT period, peak, unnest(range(0, ceil(period)::BIGINT))::DOUBLE AS lag FROM (SELECT unnest({periods!r})::DOUBLE AS period), (SELECT unnest({peaks!r})::DOUBLE AS peak))),
v AS (SELECT idx, t, round({shape}, 9) AS v FROM te, (SELECT DISTINCT t FROM y)),
p AS (SELECT ya.condition, va.idx, sum(sign(yb.y - ya.y) * sign(vb.v - va.v))::DOUBLE AS sm, count(*)::DOUBLE AS np, sum((vb.v <> va.v)::INT)::DOUBLE AS up, sum((yb.y <> ya.y)::INT)::DOUBLE AS uy
      FROM y ya JOIN y yb ON ya.condition = yb.condition AND ya.t < yb.t JOIN v va ON va.t = ya.t JOIN v vb ON vb.t = yb.t AND vb.idx = va.idx GROUP BY ALL),
vt AS (SELECT condition, idx, {tie("a")} FROM (SELECT condition, idx, v, count(*) AS k FROM y JOIN v USING (t) GROUP BY ALL) GROUP BY ALL),
yt AS (SELECT condition, sum(k)::DOUBLE AS n, {tie("b")} FROM (SELECT condition, y, count(*) AS k FROM y GROUP BY ALL) GROUP BY ALL),
z AS (SELECT p.*, n, sm / sqrt(greatest(up * uy, 1e-12)) AS tau, abs(sm) / sqrt((n * (n - 1) * (2 * n + 5) - a5 - b5) / 18 + a2 * b2 / (2 * n * (n - 1)) + a3 * b3 / (9 * n * (n - 1) * (n - 2))) AS z FROM p JOIN vt USING (condition, idx) JOIN yt USING (condition)),
e AS (SELECT *, z / sqrt(2) AS x, count(*) OVER (PARTITION BY condition)::DOUBLE AS m, row_number() OVER (PARTITION BY condition ORDER BY z DESC, idx) AS rk FROM z JOIN te USING (idx)),
q AS (SELECT *, greatest(1 - ({erf}), 0) AS pv FROM e),
u AS (SELECT *, least(min(pv * m / rk) OVER (PARTITION BY condition ORDER BY rk DESC), 1) AS bh, row_number() OVER (PARTITION BY {each} ORDER BY rk) AS best FROM q),
am AS (SELECT condition, (quantile_cont(y, 0.9) - quantile_cont(y, 0.1)) / 2 AS amplitude FROM y GROUP BY 1),
w AS (SELECT *, {top} + CASE WHEN tau < 0 THEN period / 2 ELSE 0 END AS tp FROM u JOIN am USING (condition) WHERE best = 1)
SELECT condition, n::BIGINT AS n, period, lag, {"peak" if kind == "triangle" else "0.5::DOUBLE AS peak"}, {r("tau", "tau")}, {r("tp - period * floor(tp / period)", "acrophase")}, {r("amplitude", "amplitude")}, {r("pv", "p_value")}, {r("least(pv * m, 1)", "p_bonferroni")}, {r("bh", "p_bh")}, m AS n_tests FROM w"""


def _ranked(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(methods.detect(fortnight(spark, sf), name).select("condition", "n", "period", "lag", "peak", "tau", "acrophase", "amplitude", "p_value", "p_bonferroni", "p_bh", "n_tests"))

    run.__name__ = name
    query(sql)(run)


_WHOLE_HOURS, _HALF_HOURS = [float(p) for p in range(20, 29)], [float(p) for p in cos.grid(20, 28, 0.5)]
_ranked("jtk", ranks_sql(_WHOLE_HOURS, [0.5], "triangle"))
_ranked("jtk_sweep", ranks_sql(_WHOLE_HOURS, [0.5], "triangle", "condition, period"))
_ranked("asymmetric_jtk", ranks_sql(_WHOLE_HOURS, [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8], "triangle"))
_ranked("cosine_kendall", ranks_sql(_HALF_HOURS, [0.5], "cosine"))


def projected(columns: list[str], source: str, keys: str, keep: str) -> str:
    """CTEs g0, g1, ..: columns and value centred in each group, then each column without the parts along those before it, and the value's residual and share explained."""
    w = f"WINDOW w AS (PARTITION BY {keys})"
    out = [f"g0 AS (SELECT {keys}, {keep}, count(*) OVER w AS n, value - avg(value) OVER w AS y0, {', '.join(f'{c} - avg({c}) OVER w AS {c}' for c in columns)} FROM {source} {w})"]
    for i, c in enumerate(columns, 1):
        rest = "".join(f", {d} - {c} * sum({d} * {c}) OVER w / nullif(sum({c} * {c}) OVER w, 0) AS {d}" for d in columns[i:])
        before = "".join(f", y{k}" for k in range(i))
        out.append(f"g{i} AS (SELECT {keys}, {keep}, n{before}, y{i - 1} - {c} * sum(y{i - 1} * {c}) OVER w / nullif(sum({c} * {c}) OVER w, 0) AS y{i}{rest} FROM g{i - 1} {w})")
    return ",\n".join(out)


@query(
    f"""y AS (SELECT condition, floor(time / 4) * 4.0 AS time, avg(value) AS value FROM s WHERE time < 336 GROUP BY ALL),
xs AS (SELECT y.*, period, cos(2 * pi() * time / period) AS c1, sin(2 * pi() * time / period) AS s1, cos(4 * pi() * time / period) AS c2, sin(4 * pi() * time / period) AS s2 FROM y, (SELECT unnest({_HALF_HOURS!r})::DOUBLE AS period)),
{projected(["c1", "s1", "c2", "s2"], "xs", "condition, period", "time")},
f AS (SELECT condition, period, max(n) AS n, sum(y4 * y4) AS rss, sum(y2 * y2) AS base, sum(y0 * y0) AS total FROM g4 GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY rss, period) AS i, 1 - rss / total AS r2 FROM f)
SELECT condition, n::BIGINT AS n, period, {r("r2", "r2")}, {r("pow(1 - r2, (n - 5) / 2.0) * (1 + (n - 5) / 2.0 * r2)", "p_value")}, {r("pow(rss / base, (n - 5) / 2.0)", "p_extra")} FROM o WHERE i = 1"""
)
def harmonic_cosinor(spark, sf):  # noqa: ANN001, ANN201
    return rounded(methods.detect(fortnight(spark, sf), "harmonic_cosinor").select("condition", "n", "period", "r2", "p_value", "p_extra"))


@query(
    """y AS (SELECT condition, floor(time / 4) * 4.0 AS t, avg(value) AS y FROM s WHERE time < 336 GROUP BY ALL),
c AS (SELECT condition, t - lag(t) OVER w AS d, y - avg(y) OVER (PARTITION BY condition) AS y, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY condition) AS n FROM y WINDOW w AS (PARTITION BY condition ORDER BY t)),
dt AS (SELECT condition, median(d) AS dt FROM c GROUP BY 1),
k AS (SELECT condition, n, unnest(range(1, n // 2 + 1)) AS k FROM (SELECT DISTINCT condition, n FROM c)),
ft AS (SELECT c.condition, k.k, c.n, sum(y * cos(2 * pi() * k.k * j / c.n)) AS re, sum(y * sin(2 * pi() * k.k * j / c.n)) AS im FROM c JOIN k ON k.condition = c.condition GROUP BY ALL),
po AS (SELECT ft.condition, n * dt / k AS period, n, (re * re + im * im) * dt / n * CASE WHEN 2 * k = n THEN 1 ELSE 2 END AS power FROM ft JOIN dt USING (condition)),
li AS (SELECT *, (1 - pow(0.05 / n, 1.0 / greatest(n - 1, 1))) * sum(power) OVER (PARTITION BY condition) AS line, row_number() OVER (PARTITION BY condition ORDER BY power DESC, period DESC) AS i FROM po)
SELECT condition, n::BIGINT AS n, round(period, 4) + 0.0 AS period, round(power, 4) + 0.0 AS power, round(line, 4) + 0.0 AS threshold, power >= line AS significant FROM li WHERE i = 1"""
)
def spectral(spark, sf):  # noqa: ANN001, ANN201
    return rounded(methods.detect(fortnight(spark, sf), "spectral").select("condition", "n", "period", "power", "threshold", "significant"))


for _name in ("ar_jtk", "components", "fourier_score", "wavelet", "damped", "bootstrap"):
    _method(_name, _name)
_method("paired_fourier_score", "paired_fourier_score", lambda spark, sf: raw(spark, sf).filter("time < 144").groupBy(*SERIES, "subject", (F.floor(F.col("time") / 12) * 12.0).alias("time")).agg(F.avg("value").alias("value")), permutations=200)
_method("robust_single", "robust")


@query(
    f"{ERRORS.replace('[24.0, 12.0]', '[24.0]')} SELECT condition, {r('mesor', 'mesor')}, {r('amplitude', 'amplitude')}, {r('phase', 'acrophase')}, {r('mesor_se * sqrt(df / (df + 1.0))', 'mesor_se')}, {r('amplitude_se * sqrt(df / (df + 1.0))', 'amplitude_se')}, {r('acrophase_se * sqrt(df / (df + 1.0))', 'acrophase_se')} FROM er"
)
def robust_linear(spark, sf):  # noqa: ANN001, ANN201
    return rounded(methods.detect(hourly(spark, sf), "robust", loss="linear").select("condition", "mesor", "amplitude", "acrophase", "mesor_se", "amplitude_se", "acrophase_se"))


@query(
    f"""{fits_sql([24.0], 'hs', 'condition, subject')},
po AS (SELECT condition, count(*)::DOUBLE AS n, avg(mesor) AS m, avg(b) AS b, avg(g) AS g, sum(pow(b, 2)) - count(*) * pow(avg(b), 2) AS bb, sum(pow(g, 2)) - count(*) * pow(avg(g), 2) AS gg, sum(b * g) - count(*) * avg(b) * avg(g) AS bg FROM fits WHERE b IS NOT NULL GROUP BY 1),
x AS (SELECT condition, min(time) AS t FROM hs GROUP BY 1), o AS (SELECT condition, row_number() OVER (ORDER BY t, condition) AS i FROM x),
dd AS (SELECT p.condition AS condition_0, q.condition AS condition_1, u.n + v.n - 2 AS df, u.n * v.n / (u.n + v.n) AS sc, u.n AS n_0, v.n AS n_1, v.m - u.m AS dm, v.b - u.b AS db, v.g - u.g AS dg, u.bb + v.bb AS bb, u.gg + v.gg AS gg, u.bg + v.bg AS bg
      FROM o p JOIN o q ON p.i < q.i JOIN po u ON u.condition = p.condition JOIN po v ON v.condition = q.condition)
SELECT condition_0, condition_1, n_0::BIGINT AS n_0, n_1::BIGINT AS n_1, {r('dm', 'd_mesor')}, {r('pow(1 + 2 * ((df - 1) / (2 * df) * sc * df * (db * db * gg + dg * dg * bb - 2 * db * dg * bg) / (bb * gg - bg * bg)) / (df - 1), -(df - 1) / 2)', 'p_rhythm')} FROM dd"""
)
def compare_populations(spark, sf):  # noqa: ANN001, ANN201
    long = hourly(spark, sf, [*SERIES, "subject"])
    return rounded(cos.compare_populations(long, agg.condition_pairs(long)).select("condition_0", "condition_1", "n_0", "n_1", "d_mesor", "p_rhythm"))


_method("mixed_model", "mixed", lambda spark, sf: hourly(spark, sf, [*SERIES, "subject"]))
_counts = lambda spark, sf: raw(spark, sf).filter("time < 336").groupBy(*SERIES, F.floor("time").cast("double").alias("time")).agg(F.count("*").cast("double").alias("value"))
_method("count_poisson", "count", _counts)
_method("count_best", "best_count", _counts, kinds=("poisson", "nb"), components=(1, 2))


_method("count_models", "count_models", _counts, kinds=("poisson",), components=(1, 2))
_method("count_intervals", "count_intervals", _counts, kinds=("poisson",), components=(1,), rounds=5)
_method("mixed_with_covariates", "mixed", lambda spark, sf: hourly(spark, sf, [*SERIES, "subject"]).withColumn("half", F.when(F.col("time") < 360, "first").otherwise("second")), covariates=["half"])


def _comparison(name: str, compare, source=daily_shape) -> None:  # noqa: ANN001
    def run(spark: SparkSession, sf: str) -> DataFrame:
        long = source(spark, sf)
        return compare(long, agg.condition_pairs(long))

    run.__name__ = name
    query()(run)


_comparison("compare_bootstrap", methods.compare_bootstrap)
_comparison("compare_damped", methods.compare_damped)
_comparison("compare_damped_populations", methods.compare_populations, lambda spark, sf: hourly(spark, sf, [*SERIES, "subject"]))


@query()
def population_harmonics(spark, sf):  # noqa: ANN001, ANN201
    return methods.population(hourly(spark, sf, [*SERIES, "subject"]), harmonics=2)


@query()
def robust_compare(spark, sf):  # noqa: ANN001, ANN201
    long = daily_shape(spark, sf)
    return methods.compare(long, agg.condition_pairs(long))


@query(
    f"""xs AS (SELECT condition, time, value, (time - avg(time) OVER w) / (max(time) OVER w - min(time) OVER w) AS x1 FROM h WINDOW w AS (PARTITION BY condition)),
x3 AS (SELECT *, x1 * x1 AS x2, x1 * x1 * x1 AS x3 FROM xs), {projected(["x1", "x2", "x3"], "x3", "condition", "time")}
SELECT 'value' AS variable, condition, time, {r("y3", "value")} FROM g3"""
)
def detrend_polynomial(spark, sf):  # noqa: ANN001, ANN201
    return rounded(prep.clean(hourly(spark, sf), prep.Steps(detrend="polynomial", degree=3)))


def _cubic(rows: list[list[int]], first: str) -> str:
    return " ".join(f"WHEN {first} = {i} THEN ({' + '.join(f'{c} * l[{k}]' for k, c in enumerate(row, 1))}) / 42.0" for i, row in enumerate(rows, 1))


#: Least-squares cubics over seven points: at the first three of them, and in the middle; in units of 1/42.
_ENDS = [[39, 8, -4, -4, 1, 4, -2], [8, 19, 16, 6, -4, -7, 4], [-4, 16, 19, 12, 2, -4, 1]]


@query(
    f"""i AS (SELECT condition, time, value, row_number() OVER (PARTITION BY condition ORDER BY time) AS i, count(*) OVER (PARTITION BY condition) AS n FROM h),
e AS (SELECT condition, list(value ORDER BY i) FILTER (i <= 7) AS a, list(value ORDER BY i DESC) FILTER (i > n - 7) AS z FROM i GROUP BY 1),
l AS (SELECT *, CASE WHEN i <= 3 THEN a ELSE z END AS l, n + 1 - i AS b, list(value) OVER (PARTITION BY condition ORDER BY time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM i JOIN e USING (condition))
SELECT 'value' AS variable, condition, time, round(CASE WHEN n < 7 THEN value {_cubic(_ENDS, "i")} {_cubic(_ENDS, "b")} ELSE (-2 * m[1] + 3 * m[2] + 6 * m[3] + 7 * m[4] + 6 * m[5] + 3 * m[6] - 2 * m[7]) / 21.0 END, 4) + 0.0 AS value FROM l"""
)
def smooth_savitzky_golay(spark, sf):  # noqa: ANN001, ANN201
    return rounded(prep.clean(hourly(spark, sf), prep.Steps(smooth="savitzky_golay", smooth_rows=7)))


@query()
def smooth_butterworth(spark, sf):  # noqa: ANN001, ANN201
    return prep.clean(hourly(spark, sf), prep.Steps(smooth="butterworth", cutoff_hours=12))


@query()
def synthetic_instances(spark, sf):  # noqa: ANN001, ANN201
    return synthetic.instances(spark, 100)


@query()
def consensus_score(spark, sf):  # noqa: ANN001, ANN201
    return consensus.predict(daily_shape(spark, sf), consensus.train(spark, 240, 60))
