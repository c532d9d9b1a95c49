"""Event streams: the same logic for a batch and for Structured Streaming.

``read_events`` opens a folder of Parquet files as a stream with bounded batches. The
operators take batch or streaming frames; a stream needs the watermark, which a batch
ignores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How late an event may be.
LATENESS = "1 hour"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 4) -> DataFrame:
    """A stream of the Parquet files of a folder, a few at a time."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp with a watermark; files hold it without a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)


def tumbling_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, event_type, n): events of each type in windows of event time."""
    return timed(events).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """(user_id, start, stop, n): sessions that end after a gap without events."""
    return timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def latest_steps(events: DataFrame) -> DataFrame:
    """(user_id, event_type, updated, updates): the latest state of each step of a job; a stream runs it in update mode."""
    return events.groupBy("user_id", "event_type").agg(F.max("ts").alias("updated"), F.count(F.lit(1)).alias("updates"))
