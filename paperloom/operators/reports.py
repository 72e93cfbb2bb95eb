"""Listings, review queue, metrics and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import APPROVED, DOCUMENT_STATUSES, FINAL_STATUSES
from paperloom.functions.scale import broadcast_if_small


def page_of(filtered: DataFrame, newest: str, id_col: str, limit: int, offset: int) -> DataFrame:
    """One page of rows, newest first, planned as a single top-k; ``total`` counts the whole filtered set."""
    ordered = filtered.orderBy(F.col(newest).desc(), F.col(id_col)).offset(offset).limit(limit)
    total = filtered.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ordered.withColumn("total", total)


def list_documents(
    documents: DataFrame, page: int = 1, page_size: int = 20, discipline: str | None = None, status: str | None = None
) -> DataFrame:
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    chosen = documents.where(F.col("status") == (status or APPROVED))
    if discipline:
        chosen = chosen.where(F.col("discipline") == discipline)
    return page_of(chosen, "created_at", "id", page_size, (page - 1) * page_size)


def get_documents(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with the given ids, and the ids that are unknown."""
    wanted = broadcast_if_small(ids.select("id").distinct())
    return documents.join(wanted, "id", "left_semi"), ids.select("id").distinct().join(
        documents.select("id"), "id", "left_anti"
    )


def progress_of(status: Column) -> Column:
    return F.when(status.isin(FINAL_STATUSES), 100).otherwise(50)


def job_status(documents: DataFrame, job_ids: DataFrame | None = None) -> DataFrame:
    jobs = documents
    if job_ids is not None:
        jobs = jobs.join(broadcast_if_small(job_ids.select("job_id").distinct()), "job_id", "left_semi")
    return jobs.select(
        "job_id", F.col("id").alias("document_id"), "status", progress_of(F.col("status")).alias("progress")
    )


def flagged_regions(regions: DataFrame, document_id: int | None = None, reviewed: bool = False) -> DataFrame:
    """The review queue, oldest first."""
    queue = regions.where(F.col("reviewed") == reviewed)
    if document_id:
        queue = queue.where(F.col("document_id") == document_id)
    return queue.orderBy("created_at", "id")


def apply_reviews(regions: DataFrame, reviews: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Regions with the decisions written in, and the decisions on unknown regions.

    ``reviews`` has region_id, reviewed, reviewed_by, one row per region.
    """
    decision = reviews.select(
        F.col("region_id").alias("id"), F.col("reviewed").alias("decided"), F.col("reviewed_by").alias("decided_by")
    )
    touched = F.col("decided").isNotNull()
    old_time = F.col("reviewed_at") if "reviewed_at" in regions.columns else F.lit(None).cast("timestamp_ntz")
    updated = regions.join(broadcast_if_small(decision), "id", "left").select(
        *[F.col(c) for c in regions.columns if c not in ("reviewed", "reviewed_by", "reviewed_at")],
        F.coalesce("decided", "reviewed").alias("reviewed"),
        F.when(touched, F.col("decided_by")).otherwise(F.col("reviewed_by")).alias("reviewed_by"),
        F.when(touched, now).otherwise(old_time).alias("reviewed_at"),
    )
    unknown = reviews.join(regions.select(F.col("id").alias("region_id")), "region_id", "left_anti")
    return updated, unknown


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100, whole), F.lit(0.0)), 1)


def review_stats(regions: DataFrame) -> DataFrame:
    return regions.agg(
        F.count(F.lit(1)).alias("total_flagged"),
        F.count_if(~F.col("reviewed")).alias("unreviewed"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("average_confidence"),
    ).select(
        "total_flagged",
        "unreviewed",
        (F.col("total_flagged") - F.col("unreviewed")).alias("reviewed"),
        "average_confidence",
        _percent(F.col("total_flagged") - F.col("unreviewed"), F.col("total_flagged")).alias("review_progress"),
    )


def system_metrics(
    documents: DataFrame, regions: DataFrame, actions: DataFrame, qa_log: DataFrame, submissions: DataFrame, as_of: Column
) -> DataFrame:
    """One row; every table is read once and reduced to its counts."""
    since = as_of - F.expr("INTERVAL 24 HOURS")

    def count_of(df: DataFrame, condition: Column | None = None) -> Column:
        counter = F.count(F.lit(1)) if condition is None else F.count_if(condition)
        return df.agg(counter.alias("n")).scalar()

    base = documents.agg(
        F.count(F.lit(1)).alias("total_documents"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in DOCUMENT_STATUSES],
    )
    return (
        base.withColumn("unreviewed_regions", count_of(regions, ~F.col("reviewed")))
        .withColumn("recent_agent_actions", count_of(actions, F.col("created_at") >= since))
        .withColumn("recent_qa_queries", count_of(qa_log, F.col("created_at") >= since))
        .withColumn("total_submissions", count_of(submissions))
    )


def list_actions(
    actions: DataFrame,
    limit: int = 100,
    offset: int = 0,
    action_type: str | None = None,
    document_id: int | None = None,
    job_id: str | None = None,
    success: bool | None = None,
) -> DataFrame:
    if limit < 1 or offset < 0:
        raise ValueError("limit starts at 1 and offset is not negative")
    chosen = actions
    for column, value in (("action_type", action_type), ("document_id", document_id), ("job_id", job_id)):
        if value:
            chosen = chosen.where(F.col(column) == value)
    if success is not None:
        chosen = chosen.where(F.col("success") == success)
    return page_of(chosen, "created_at", "id", limit, offset)


def action_stats(actions: DataFrame, hours: int, as_of: Column) -> DataFrame:
    """Totals, counts by type and by decision in one pass: dimension, key, actions and, in the totals row, rates."""
    if hours < 1:
        raise ValueError("hours starts at 1")
    recent = actions.where(F.col("created_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    grouped = recent.groupingSets(
        [[], [F.col("action_type")], [F.col("decision")]], F.col("action_type"), F.col("decision")
    ).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("actions"),
        F.count_if(F.col("success")).alias("successful"),
        F.avg("confidence").alias("confidence"),
    )
    dimension = F.when(F.col("level") == 3, "total").when(F.col("level") == 1, "action_type").otherwise("decision")
    total = F.col("level") == 3
    rows = grouped.select(
        dimension.alias("dimension"),
        F.when(total, F.lit("all")).otherwise(F.coalesce("action_type", "decision")).alias("key"),
        "actions",
        F.when(total, F.col("successful")).alias("successful"),
        F.when(total, _percent(F.col("successful"), F.col("actions"))).alias("success_rate"),
        F.when(total, F.round("confidence", 3)).alias("average_confidence"),
    )
    # grouping sets give no totals row for an empty period: a zero row stands in and gives way to a real one
    zero = actions.sparkSession.range(1).select(
        F.lit("total").alias("dimension"), F.lit("all").alias("key"), F.lit(0).cast("long").alias("actions"),
        F.lit(0).cast("long").alias("successful"), F.lit(0.0).alias("success_rate"),
        F.lit(None).cast("double").alias("average_confidence"),
    )
    figures = ["actions", "successful", "success_rate", "average_confidence"]
    return rows.unionByName(zero).groupBy("dimension", "key").agg(*[F.max(c).alias(c) for c in figures])


def document_lines(documents: DataFrame, width: int | None = None) -> DataFrame:
    """Printable form of the documents: defaults for missing values, and titles whole or cut at ``width``."""

    def filled(column: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("N/A"))

    return documents.select(
        "id",
        filled("document_number").alias("document_number"),
        (filled("title") if width is None else F.substring(filled("title"), 1, width)).alias("title"),
        "discipline",
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        "status",
    )
