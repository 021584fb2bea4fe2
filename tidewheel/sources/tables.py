"""Delimited tables, spreadsheets and DataFrames as wide data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewheel.operators.model import Roles, detect_roles, to_long


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8", schema: T.StructType | str | None = None) -> DataFrame:
    """A table with a header. Without sep the header's first line decides between ';', tab and ','. Give a schema for large inputs: without one the values are read twice."""
    if sep is None:
        head = spark.read.text(path).limit(1).collect()
        line = head[0].value if head else ""
        sep = next((s for s in (";", "\t") if s in line), ",")
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("nullValue", "NA").option("nanValue", "NaN")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet by way of the driver; pandas needs a reader for the format."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def read_long(spark: SparkSession, path: str, time: str, condition: str, variables: list[str], subject: str | None = None, replicate: str | None = None, **how) -> DataFrame:
    """The long form of a table with known columns; a missing one is an error before anything is read."""
    df = read_csv(spark, path, **how)
    missing = [c for c in [time, condition, subject, replicate, *variables] if c and c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return to_long(df, Roles(time, condition, replicate, subject, variables))


def auto_long(df: DataFrame) -> DataFrame:
    return to_long(df, detect_roles(df))


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)
