"""Streaming ingestion of logs: message lines as they arrive, counted by window with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.sources.logs import messages


def stream_messages(spark: SparkSession, path: str) -> DataFrame:
    """Message rows of a growing folder of logs, with arrival time."""
    lines = spark.readStream.format("text").load(path).withColumn("arrived", F.current_timestamp())
    return messages(lines)


def windowed_counts(found: DataFrame, time: str = "arrived", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    return found.withWatermark(time, late).groupBy(F.window(time, window), "severity", "risk_class").agg(F.count(F.lit(1)).alias("n"))
