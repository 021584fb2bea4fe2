"""Bins of growing activity data: Structured Streaming over files that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "condition string, subject string, ts timestamp, activity double"


def read(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def binned(stream: DataFrame, minutes: int = 30, late: str = "2 hours") -> DataFrame:
    """Sums of bins of event time; rows later than the watermark are left out."""
    bins = F.window("ts", f"{minutes} minutes")
    return stream.withWatermark("ts", late).groupBy("condition", "subject", bins.alias("w")).agg(F.sum("activity").alias("activity")).select("condition", "subject", F.col("w.start").alias("ts"), "activity")


def write(bins: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Closed bins as Parquet, each once; runs over what is there and ends."""
    return bins.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
