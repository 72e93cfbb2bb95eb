"""Trailing activity windows over a stream of actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.activity import hourly_activity, trailing_activity


def activity_windows(
    actions: DataFrame, length: str = "24 hours", slide: str = "1 hour", lateness: str = "1 hour"
) -> DataFrame:
    """Closed windows, each emitted once the watermark has passed it; later rows are dropped."""
    timed = actions.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark(
        "created_at", lateness
    )
    return trailing_activity(hourly_activity(timed), length, slide)
