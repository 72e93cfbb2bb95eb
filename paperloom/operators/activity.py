"""Batch forms of the streamed operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.constants import FINAL_STATUSES
from paperloom.operators.reports import progress_of


def status_changes(events: DataFrame) -> DataFrame:
    """job_id, seq, ts, status -> the events at which a job's status differs from its last one, up to a final status.

    Jobs are skewed, so no step orders a whole job: changes are found within each hour of a job, and only the last
    status of every hour is carried to the next one.
    """
    order = F.struct("ts", "seq")
    finals = events.where(F.col("status").isin(FINAL_STATUSES)).groupBy("job_id").agg(F.min(order).alias("final_at"))
    live = events.join(finals, "job_id", "left").where(F.col("final_at").isNull() | (order <= F.col("final_at")))
    hourly = live.select("job_id", "seq", "ts", "status", F.date_trunc("hour", "ts").alias("hour"))
    within = Window.partitionBy("job_id", "hour").orderBy("ts", "seq")
    candidates = hourly.withColumn("before", F.lag("status").over(within)).where(
        F.col("before").isNull() | (F.col("before") != F.col("status"))
    )
    last = hourly.groupBy("job_id", "hour").agg(F.max_by("status", order).alias("status"))
    carried = last.select(
        "job_id", "hour", F.lag("status").over(Window.partitionBy("job_id").orderBy("hour")).alias("carried")
    )
    return (
        candidates.join(carried, ["job_id", "hour"])
        .where(F.col("before").isNotNull() | F.col("carried").isNull() | (F.col("carried") != F.col("status")))
        .select("job_id", "seq", "ts", "status", progress_of(F.col("status")).alias("progress"))
    )


def status_message() -> Column:
    """JSON message of a status change."""
    return F.to_json(F.struct(F.lit("status_update").alias("type"), "job_id", "status", "progress"))


def hourly_activity(actions: DataFrame) -> DataFrame:
    """Partial counts per hour, from which longer windows are added up."""
    return actions.groupBy(F.window("created_at", "1 hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("successful"),
        F.sum("confidence").alias("confidence_sum"),
        F.count("confidence").alias("confidence_n"),
    )


def trailing_activity(hourly: DataFrame, length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """window_start, window_end, total, successful, success_rate, average_confidence.

    Each hour, not each action, is copied into the windows it belongs to.
    """
    slid = hourly.groupBy(F.window(F.window_time("hour"), length, slide).alias("w")).agg(
        F.sum("total").alias("total"),
        F.sum("successful").alias("successful"),
        F.sum("confidence_sum").alias("confidence_sum"),
        F.sum("confidence_n").alias("confidence_n"),
    )
    return slid.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "total",
        "successful",
        F.round(F.col("successful") * 100 / F.col("total"), 1).alias("success_rate"),
        F.round(F.try_divide("confidence_sum", "confidence_n"), 3).alias("average_confidence"),
    )


def activity_windows(actions: DataFrame, length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    return trailing_activity(hourly_activity(actions), length, slide)
