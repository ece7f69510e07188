"""Event-time windows over streams, with watermarks; late rows beyond the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(rows: DataFrame, at: str, keys: list[str], width: str, lateness: str) -> DataFrame:
    """Rows and mean value per window and key, emitted once the watermark has passed the window."""
    return rows.withWatermark(at, lateness).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def session_counts(rows: DataFrame, at: str, keys: list[str], gap: str, lateness: str) -> DataFrame:
    """Gap-based sessions: the event-time form of contiguous runs, an extension."""
    return rows.withWatermark(at, lateness).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def replay_sink(folder: str):
    """A foreachBatch function that appends every micro-batch once, under its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={number}")

    return write
