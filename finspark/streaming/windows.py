"""Event-time windows over streams of events, the same code for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """Events as they arrive in a folder."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, events, total per window; rows later than ``late`` behind the newest are dropped by a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events.withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """window_start, events per sliding window."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    return e.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, session_start, session_end, events of runs without a gap."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def first_deliveries(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without those delivered again within the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else e.dropDuplicates(["event_id"])
