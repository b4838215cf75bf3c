"""Event-time windows and sessions; the plans are the same for a batch and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows of ts. `late`: the watermark of a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", late) if late else events
    g = events.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("starts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a user: events less than `gap` after the one before."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", late) if late else events
    g = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("starts"), "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """Keeps the latest row per key of each micro-batch, appended as Parquet; once per batch id."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
