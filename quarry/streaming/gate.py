"""Streaming forms of the event queries; an extension, the batch queries being the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as they arrive in a folder of parquet files."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and values by event type and window; rows later than ``late`` are left out, repeats too."""
    unique = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    return unique.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
