"""Interaction logs as streams: counted pairs per window, late rows within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_interactions(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """events: user_id, item_id, ts, streaming or not. Rows of each window: user_id, item_id, rating (count), ts."""
    # watermarks need an instant; a time without zone is one in the session's zone
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    got = w.groupBy(F.window("ts", window), "user_id", "item_id").agg(F.count("*").cast("double").alias("rating"), F.max("ts").alias("last"))
    return got.select(F.col("window.start").alias("window_start"), "user_id", "item_id", "rating", F.col("last").alias("ts"))


def append_to(stream: DataFrame, folder: str, checkpoint: str):
    """Starts writing windows as they close; a restart goes on where the checkpoint ended."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
