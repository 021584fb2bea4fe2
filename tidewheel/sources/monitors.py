"""Activity monitors: tab-separated beam-break files and one-value-per-line wheel files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _month(name: Column) -> Column:
    """Number of a month by its first three letters; of any other name 1."""
    low = F.lower(F.substring(name, 1, 3))
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), low), F.lit(0)), F.lit(1)).cast("int")


def _stamp(day: Column, month: Column, year: Column, time: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", F.format_string("%04d-%02d-%02d", year, month, day), time), F.lit("yyyy-MM-dd H:mm[:ss]")).cast("timestamp_ntz")


def zeitgeber(ts: Column, first: Column, lights_on: str = "08:00", corrected: bool = True) -> Column:
    """Hours since lights-on of the first day. corrected=False repeats a known misplacement: samples before
    lights-on are put a day late on every day but keep their hour of day."""
    h, m = (int(x) for x in lights_on.split(":"))
    on = (h + m / 60.0) * 3600
    start = F.date_trunc("day", first).cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", start, ts)
    plain = (seconds - on) / 3600
    if corrected:
        return plain
    of_day = F.pmod(seconds, F.lit(86400))
    return F.pmod((of_day - on) / 3600, F.lit(24.0)) + F.floor(seconds / 86400) * 24.0


def read_beams(spark: SparkSession, paths: str | Sequence[str], first_channel: int = 10, channels: int = 32) -> DataFrame:
    """(monitor, ts, subject, activity) of all files in one scan.

    Columns from 0: 1 the date 'd Mon yy', 2 the time, from first_channel - 1 on the counts. Rows whose date or time can't be read are left out.
    """
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    v = F.split("value", "\t")
    stem = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    d = F.split(F.get("v", F.lit(1)), " +")
    year = F.get("d", F.lit(2)).cast("int")
    rows = lines.select(F.coalesce(F.nullif(F.regexp_extract(stem, r"(\d+)", 1), F.lit("")), stem).alias("monitor"), v.alias("v")).filter(F.size("v") > first_channel - 1).withColumn("d", d)
    stamped = rows.withColumn("ts", _stamp(F.expr("try_cast(d[0] as int)"), _month(F.get("d", F.lit(1))), F.when(year < 100, year + 2000).otherwise(year), F.get("v", F.lit(2)))).filter("ts is not null")
    return stamped.select("monitor", "ts", F.posexplode(F.slice("v", first_channel, channels)).alias("i", "n")).select(
        "monitor", "ts", F.format_string("ch%02d", F.col("i") + 1).alias("subject"), F.expr("try_cast(n as bigint)").alias("activity")
    )


def beam_activity(rows: DataFrame, condition: Column | str, minutes: float = 30.0, lights_on: str = "08:00", start: str | None = None, end: str | None = None, corrected: bool = True, dead_hours: float | None = 6.0) -> DataFrame:
    """(condition, subject, time, activity): counts of bins; subjects are prefixed by their monitor; dead channels are left out."""
    from tidewheel.operators.activity import alive

    kept = rows
    if start:
        kept = kept.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        kept = kept.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    first = F.min("ts").over(Window.partitionBy("monitor"))
    timed = kept.withColumn("time", zeitgeber(F.col("ts"), first, lights_on, corrected)).select(
        (F.lit(condition) if isinstance(condition, str) else condition).alias("condition"), F.concat(F.lit("M"), "monitor", F.lit("_"), "subject").alias("subject"), "time", "activity"
    )
    if dead_hours is not None:
        timed = alive(timed, dead_hours)
    return timed.groupBy("condition", "subject", (F.floor(F.col("time") * 60 / minutes) * minutes / 60).alias("time")).agg(F.sum("activity").cast("long").alias("activity"))


def beam_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("monitor").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("subject").alias("channels"), F.sum("activity").alias("total"), F.count_distinct("ts").alias("samples"))


def read_wheels(spark: SparkSession, paths: str | Sequence[str], sample_minutes: float = 6.0) -> DataFrame:
    """(subject, ts, activity): line 0 names the subject, 1 the date 'dd-Mon-yy[yy]', 2 the time; data begin at the first
    of three whole numbers in a row among lines 3 to 19; negative or unreadable values are null. sample_minutes isn't in the file."""
    files = spark.read.option("encoding", "ISO-8859-1").text(list(paths) if not isinstance(paths, str) else paths, wholetext=True)
    lines = F.transform(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n"), F.btrim)
    whole = lambda c: c.rlike(r"^-?\d+$")
    runs = F.filter(F.sequence(F.lit(3), F.lit(19)), lambda i: whole(F.get("l", i)) & whole(F.get("l", i + 1)) & whole(F.get("l", i + 2)))
    date = F.split(F.get("l", F.lit(1)), "-")
    year = F.expr("try_cast(d[2] as int)")
    y = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    parsed = files.select(lines.alias("l")).withColumn("d", date).withColumn("start", F.get(runs, F.lit(0))).filter("start is not null")
    parsed = parsed.withColumn("t0", _stamp(F.expr("try_cast(d[0] as int)"), _month(F.get("d", F.lit(1))), y, F.get("l", F.lit(2)))).filter("t0 is not null")
    values = parsed.select(F.get("l", F.lit(0)).alias("subject"), "t0", F.posexplode(F.slice("l", F.col("start") + 1, F.greatest(F.size("l") - F.col("start"), F.lit(0)))).alias("i", "x"))
    n = F.expr("try_cast(x as bigint)")
    return values.select("subject", F.timestamp_add("SECOND", (F.col("i") * sample_minutes * 60).cast("int"), "t0").alias("ts"), F.when(n >= 0, n).alias("activity"))


def wheel_activity(rows: DataFrame, condition: str, minutes: float = 30.0, lights_on: str = "08:00", corrected: bool = True, start: str | None = None, end: str | None = None) -> DataFrame:
    """(condition, subject, time, activity): counts of bins from start to end, both included; a bin without counts has 0."""
    if start:
        rows = rows.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    first = F.min("ts").over(Window.partitionBy("subject"))
    timed = rows.withColumn("time", zeitgeber(F.col("ts"), first, lights_on, corrected))
    return timed.groupBy(F.lit(condition).alias("condition"), "subject", (F.floor(F.col("time") * 60 / minutes) * minutes / 60).alias("time")).agg(F.coalesce(F.sum("activity"), F.lit(0)).cast("long").alias("activity"))


def wheel_summary(rows: DataFrame) -> DataFrame:
    """(subject, first, last, days, samples, total, missing) of each recording."""
    return rows.groupBy("subject").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), (F.expr("timestampdiff(SECOND, min(ts), max(ts))") / 86400).alias("days"),
        F.count("*").alias("samples"), F.coalesce(F.sum("activity"), F.lit(0)).alias("total"), F.count_if(F.col("activity").isNull()).alias("missing"),
    )
