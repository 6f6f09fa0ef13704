"""Weekly counts of a stream: an addition of ours, the batch query weekly_activity on rows as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def weekly_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """(week_start, event_type, events) over windows of seven days from Monday; rows later than the watermark don't count."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    # The epoch was a Thursday; Mondays are four days off.
    return rows.groupBy(F.window("at", "7 days", "7 days", "4 days").alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("week_start"), "event_type", "events")


def read_events(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
