"""The long form, its roles and its checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.columns import day, present

SERIES = ["variable", "condition"]
#: Fragments of column names by role, tried in this order; the first column with one takes the role.
ROLES = {
    "time": ["time", "hour", "zt", "ct", "timepoint", "hr"],
    "condition": ["condition", "treatment", "group", "genotype", "type"],
    "replicate": ["replicate", "rep", "sample"],
    "subject": ["subject", "animal", "individual", "mouse", "fly", "id"],
}


@dataclass
class Roles:
    time: str | None = None
    condition: str | None = None
    replicate: str | None = None
    subject: str | None = None
    variables: list[str] = field(default_factory=list)


def detect_roles(df: DataFrame, **given: str) -> Roles:
    """Roles from the schema alone: no data is read. Time must be numeric; numeric columns without a role are variables."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    roles, used = Roles(**given), set(given.values())
    for role, fragments in ROLES.items():
        if getattr(roles, role):
            continue
        for fragment in fragments:
            hit = next((c for c in df.columns if c not in used and fragment in c.lower() and (role != "time" or c in numeric)), None)
            if hit:
                setattr(roles, role, hit)
                used.add(hit)
                break
    roles.variables = [c for c in df.columns if c in numeric and c not in used]
    return roles


def to_long(df: DataFrame, roles: Roles) -> DataFrame:
    """Unpivot a wide table; NaN becomes NULL."""
    if not roles.time or not roles.condition or not roles.variables:
        raise ValueError("a time column, a condition column and at least one numeric variable are needed")
    keep = [
        F.col(roles.time).cast("double").alias("time"),
        F.col(roles.condition).cast("string").alias("condition"),
        (F.col(roles.subject) if roles.subject else F.lit(None)).cast("string").alias("subject"),
        (F.col(roles.replicate) if roles.replicate else F.lit(None)).cast("string").alias("replicate"),
    ]
    wide = df.select(*keep, *(F.col(v).cast("double").alias(f"v_{i}") for i, v in enumerate(roles.variables)))
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"v_{i}").alias("value")) for i, v in enumerate(roles.variables))))
    return wide.withColumn("_p", pairs).select("_p.variable", "condition", "subject", "replicate", "time", F.when(present(F.col("_p.value")), F.col("_p.value")).alias("value"))


def drop_missing(long: DataFrame) -> DataFrame:
    return long.filter(present(F.col("time")) & present(F.col("value")))


def point_counts(long: DataFrame, least: int = 4, keys: list[str] = SERIES) -> DataFrame:
    """One row for each series: points, and whether they suffice; a series that doesn't is a row, not an error."""
    return drop_missing(long).groupBy(*keys).agg(F.count("*").alias("n_points")).withColumn("success", F.col("n_points") >= least)


def check(long: DataFrame, timepoints: int = 4) -> DataFrame:
    """One row: counts of what the long form must not have, and whether it is valid."""
    return long.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("time").isNull()).alias("null_times"),
        F.count_if(F.col("condition").isNull()).alias("null_conditions"),
        F.count_distinct("time").alias("n_timepoints"),
        F.count_distinct("variable").alias("n_variables"),
    ).withColumn("valid", (F.col("null_times") == 0) & (F.col("null_conditions") == 0) & (F.col("n_timepoints") >= timepoints) & (F.col("n_variables") > 0))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_unique, n_missing, least, greatest) in one pass over the data."""
    missing = lambda c: F.col(c).isNull() | (F.isnan(c) if df.schema[c].dataType in (T.DoubleType(), T.FloatType()) else F.lit(False))
    one = df.agg(
        *(F.struct(F.count_distinct(c).alias("n_unique"), F.count_if(missing(c)).alias("n_missing"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")).alias(f"c_{i}") for i, c in enumerate(columns))
    )
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c_{i}").alias("p")) for i, c in enumerate(columns))))
    return one.select(rows.alias("r")).select("r.column", "r.p.*")


def day_range(long: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of days first to last, both included, counted from 1."""
    return long.filter(day(F.col("time")).between(first, last))


def significant(results: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    return results.filter(F.col(p) < alpha)


def search_names(df: DataFrame, name: str, text: str, limit: int) -> DataFrame:
    """Rows whose name holds the text: equal ones first, then those that start with it, then the others, by name."""
    low, q = F.lower(F.col(name)), text.lower()
    rank: Column = F.when(low == q, 0).when(low.startswith(q), 1).otherwise(2)
    return df.filter(low.contains(q)).withColumn("match_rank", rank).orderBy("match_rank", name).limit(limit)
