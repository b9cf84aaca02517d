"""The same session questions over a stream of tool events, with watermarks for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visits(events: DataFrame, gap: str = "6 hours", late: str = "1 day", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, started, ended, n): sessions that end after a gap; state of a session is dropped once the watermark passes it."""
    timed = events.select(key, F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    g = timed.groupBy(key, F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def rates(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """(started, event_type, n, failed) in sliding windows."""
    timed = events.select("event_type", F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    g = timed.groupBy(F.window("at", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return g.select(F.col("w.start").alias("started"), "event_type", "n", "failed")


def write_tables(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a Parquet table, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
