"""Queries on listings, the review queue and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import reports as R
from paperloom.operators.listing import Listing
from paperloom.plans.admission import NOW, now, time_text
from paperloom.plans.registry import query, shared_sql
from paperloom.session import new_folder
from paperloom.sources.tables import table_counts
from paperloom.sources.views import Source


@query(
    "list_documents",
    """SELECT id, document_number, title, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, count(*) OVER () AS total
FROM ref_documents WHERE status = 'Approved' AND discipline = 'MEC' ORDER BY ref_documents.created_at DESC, id LIMIT 20 OFFSET 20""",
)
def list_documents(src: Source):
    page = R.list_documents(src.ref_documents, page=2, page_size=20, discipline="MEC")
    return page.select("id", "document_number", "title", time_text("created_at").alias("created_at"), "total")


@query(
    "get_document",
    """SELECT u.arrival AS id, d.document_number, d.status, d.id IS NOT NULL AS found
FROM uploads u LEFT JOIN ref_documents d ON d.id = u.arrival * 20""".replace("u.arrival AS id", "u.arrival * 20 AS id"),
)
def get_document(src: Source):
    wanted = src.uploads.select((F.col("arrival") * 20).alias("id"))
    found, unknown = R.get_documents(src.ref_documents, wanted)
    return found.select("id", "document_number", "status", F.lit(True).alias("found")).unionByName(
        unknown.select(
            "id",
            F.lit(None).cast("string").alias("document_number"),
            F.lit(None).cast("string").alias("status"),
            F.lit(False).alias("found"),
        )
    )


@query(
    "job_status",
    """SELECT job_id, id AS document_id, status, CAST(CASE WHEN status IN ('Approved', 'Rejected') THEN 100 ELSE 50 END AS INT) AS progress
FROM ref_documents WHERE job_id IN (SELECT job_id FROM status_events)""",
)
def job_status(src: Source):
    return R.job_status(src.ref_documents, src.status_events.select("job_id"))


@query(
    "flagged_regions",
    """SELECT id, document_id, page, text, confidence, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM regions WHERE NOT reviewed""",
)
def flagged_regions(src: Source):
    queue = R.flagged_regions(src.regions)
    return queue.select("id", "document_id", "page", "text", "confidence", time_text("created_at").alias("created_at"))


@query(
    "apply_reviews",
    f"""SELECT r.id, r.document_id, coalesce(v.reviewed, r.reviewed) AS reviewed, v.reviewed_by, CASE WHEN v.region_id IS NOT NULL THEN '{NOW}' END AS reviewed_at, true AS known
FROM regions r LEFT JOIN reviews v ON v.region_id = r.id
UNION ALL SELECT region_id, NULL, reviewed, reviewed_by, NULL, false FROM reviews v WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.id = v.region_id)""",
)
def apply_reviews(src: Source):
    updated, unknown = R.apply_reviews(src.regions, src.reviews, now())
    return updated.select(
        "id", "document_id", "reviewed", "reviewed_by", time_text("reviewed_at").alias("reviewed_at"),
        F.lit(True).alias("known"),
    ).unionByName(
        unknown.select(
            F.col("region_id").alias("id"),
            F.lit(None).cast("long").alias("document_id"),
            "reviewed",
            "reviewed_by",
            F.lit(None).cast("string").alias("reviewed_at"),
            F.lit(False).alias("known"),
        )
    )


@query(
    "review_stats",
    """SELECT count(*) AS total_flagged, count(*) FILTER (NOT reviewed) AS unreviewed, count(*) FILTER (reviewed) AS reviewed,
  round(avg(confidence), 3) AS average_confidence, round(count(*) FILTER (reviewed) * 100e0 / count(*), 1) AS review_progress FROM regions""",
)
def review_stats(src: Source):
    return R.review_stats(src.regions)


@query(
    "system_metrics",
    """SELECT count(*) AS total_documents, count(*) FILTER (status = 'Checking') AS checking, count(*) FILTER (status = 'Approved') AS approved,
  count(*) FILTER (status = 'Rejected') AS rejected, (SELECT count(*) FROM regions WHERE NOT reviewed) AS unreviewed_regions,
  (SELECT count(*) FROM agent_actions WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00') AS recent_agent_actions,
  (SELECT count(*) FROM status_events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' AND status = 'Checking') AS recent_qa_queries,
  (SELECT count(*) FROM controller_responses) AS total_submissions FROM ref_documents""",
)
def system_metrics(src: Source):
    questions = src.status_events.where(F.col("status") == "Checking").select(F.col("ts").alias("created_at"))
    return R.system_metrics(
        src.ref_documents, src.regions, src.agent_actions, questions, src.controller_responses, now()
    )


@query(
    "list_actions",
    """SELECT id, document_id, job_id, action_type, decision, confidence, success, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, count(*) OVER () AS total
FROM agent_actions WHERE action_type = 'click' AND success ORDER BY agent_actions.created_at DESC, id LIMIT 100 OFFSET 50""",
)
def list_actions(src: Source):
    page = R.list_actions(src.agent_actions, limit=100, offset=50, action_type="click", success=True)
    return page.select(
        "id", "document_id", "job_id", "action_type", "decision", "confidence", "success",
        time_text("created_at").alias("created_at"), "total",
    )


RANGES = 16


def laid_out(src: Source, rows, name: str, *filters: str) -> Listing:
    listing = Listing(src.spark, new_folder(src.spark, name), rows.schema, "created_at", "id", filters)
    listing.write(rows, RANGES)
    return listing


@query(
    "list_documents_by_range",
    """SELECT id, document_number, title, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, count(*) OVER () AS total
FROM ref_documents WHERE status = 'Approved' ORDER BY ref_documents.created_at DESC, id LIMIT 20 OFFSET 300""",
)
def list_documents_by_range(src: Source):
    page = laid_out(src, src.ref_documents, "documents", "discipline", "status").page(20, 300, status="Approved")
    return page.select("id", "document_number", "title", time_text("created_at").alias("created_at"), "total")


@query(
    "list_actions_by_range",
    """SELECT id, document_id, action_type, success, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, count(*) OVER () AS total
FROM agent_actions WHERE action_type = 'click' AND success ORDER BY agent_actions.created_at DESC, id LIMIT 100 OFFSET 50""",
)
def list_actions_by_range(src: Source):
    page = laid_out(src, src.agent_actions, "actions", "action_type", "success").page(100, 50, action_type="click", success=True)
    return page.select(
        "id", "document_id", "action_type", "success", time_text("created_at").alias("created_at"), "total"
    )


shared_sql(
    "recent_actions",
    "SELECT * FROM agent_actions WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 168 HOURS",
)


@query(
    "action_stats",
    """SELECT 'total' AS dimension, 'all' AS key, count(*) AS actions, count(*) FILTER (success) AS successful,
  round(count(*) FILTER (success) * 100e0 / count(*), 1) AS success_rate, round(avg(confidence), 3) AS average_confidence FROM recent_actions
UNION ALL SELECT 'action_type', action_type, count(*), NULL, NULL, NULL FROM recent_actions GROUP BY action_type
UNION ALL SELECT 'decision', decision, count(*), NULL, NULL, NULL FROM recent_actions GROUP BY decision""",
)
def action_stats(src: Source):
    return R.action_stats(src.agent_actions, 168, now())


@query(
    "verify_counts",
    """SELECT 'documents' AS table_name, count(*) AS n FROM ref_documents UNION ALL SELECT 'regions', count(*) FROM regions
UNION ALL SELECT 'agent_actions', count(*) FROM agent_actions""",
)
def verify_counts(src: Source):
    return table_counts({"documents": src.ref_documents, "regions": src.regions, "agent_actions": src.agent_actions})


@query(
    "document_lines",
    """SELECT id, coalesce(document_number, 'N/A') AS document_number, title, discipline, page_count, status FROM ref_documents""",
)
def document_lines(src: Source):
    return R.document_lines(src.ref_documents)
