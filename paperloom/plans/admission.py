"""Queries on files, admission and upkeep of the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.constants import FILE_TYPES
from paperloom.functions.text import content_hash, last_part
from paperloom.operators import admission as A
from paperloom.plans.registry import query, shared_sql
from paperloom.session import new_folder, stored
from paperloom.sources import files, tables
from paperloom.sources.views import Source

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def time_text(column):
    return F.date_format(F.col(column) if isinstance(column, str) else column, "yyyy-MM-dd HH:mm:ss")


_TYPES = ", ".join(f"('{e}', '{x}', '{m}')" for e, (x, m) in sorted(FILE_TYPES.items()))
shared_sql("file_types(extension, extractor, mime_type)", f"SELECT * FROM (VALUES {_TYPES}) AS t(a, b, c)")
shared_sql(
    "upload_ext",
    r"SELECT *, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1)) AS extension FROM uploads",
)
_SUPPORTED = ", ".join(sorted(FILE_TYPES))


@query("scan_files")
def scan_files(src: Source):
    """The files of the folder with length and content hash. SQL over tables can't read them; the tests hash them again."""
    found = files.hashed_files(src.spark, src.folder, "*.parquet", files.TURN_BYTES)
    return found.select(last_part(F.col("path")).alias("file_name"), "length", "n_bytes", "file_hash")


@query(
    "route_format",
    f"""SELECT u.arrival, u.path, u.extension, t.extractor,
  CASE WHEN t.extractor IS NULL THEN 'Unsupported file format: ' || u.extension || '. Supported formats: {_SUPPORTED}' END AS reject_reason
FROM upload_ext u LEFT JOIN file_types t ON u.extension = t.extension""",
)
def route_format(src: Source):
    routed = files.route_format(src.uploads)
    return routed.select("arrival", "path", "extension", "extractor", "reject_reason")


@query(
    "supported_formats",
    """SELECT u.extension, count(*) AS files, any_value(t.extractor) AS extractor, any_value(t.mime_type) AS mime_type,
  count(t.extractor) > 0 AS supported
FROM upload_ext u LEFT JOIN file_types t ON u.extension = t.extension GROUP BY u.extension""",
)
def supported_formats(src: Source):
    return files.supported_formats(src.uploads)


shared_sql(
    "judged_uploads",
    f"""SELECT u.*, CASE WHEN t.extension IS NULL THEN 'Unsupported file format: ' || u.extension || '. Supported: {_SUPPORTED}'
  WHEN u.discipline IS NOT NULL AND u.discipline NOT IN ('', 'ELC', 'MEC', 'INS', 'SIM')
  THEN 'Invalid discipline: ' || u.discipline || '. Must be one of: ELC, MEC, INS, SIM' END AS reason
FROM upload_ext u LEFT JOIN file_types t ON u.extension = t.extension""",
)


@query("admit_uploads", "SELECT arrival, path, discipline, reason IS NULL AS accepted, reason FROM judged_uploads")
def admit_uploads(src: Source):
    accepted, refused = A.admit_uploads(src.uploads)
    columns = ["arrival", "path", "discipline"]
    return accepted.select(
        *columns, F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason")
    ).unionByName(refused.select(*columns, F.lit(False).alias("accepted"), "reason"))


@query("content_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_hash_query(src: Source):
    return src.documents.select("doc_id", content_hash(F.col("text")).alias("file_hash"))


@query(
    "dedup_by_hash",
    """SELECT u.arrival, u.file_hash,
  CASE WHEN s.id IS NULL AND u.arrival = first_value(u.arrival) OVER (PARTITION BY u.file_hash ORDER BY u.arrival) THEN 'new' ELSE 'repeat' END AS outcome,
  coalesce(s.id, first_value(u.arrival) OVER (PARTITION BY u.file_hash ORDER BY u.arrival)) AS id,
  coalesce(s.status, 'Checking') AS status
FROM uploads u LEFT JOIN stored_documents s ON u.file_hash = s.file_hash""",
)
def dedup_by_hash(src: Source):
    new, repeats = A.dedup_by_hash(src.uploads, src.stored_documents)
    return new.select(
        "arrival", "file_hash", F.lit("new").alias("outcome"), F.col("arrival").alias("id"), F.lit("Checking").alias("status")
    ).unionByName(repeats.select("arrival", "file_hash", F.lit("repeat").alias("outcome"), "id", "status"))


@query(
    "new_document_records",
    f"""SELECT file_hash, 'store/' || file_hash || extension AS original_path, 'Checking' AS status,
  substr(sha256('job:' || file_hash), 1, 32) AS job_id, discipline, '{NOW}' AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY arrival) AS rn FROM judged_uploads WHERE reason IS NULL) j
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored_documents s WHERE s.file_hash = j.file_hash)""",
)
def new_document_records(src: Source):
    accepted, _ = A.admit_uploads(src.uploads)
    new, _ = A.dedup_by_hash(accepted, src.stored_documents)
    records = A.new_document_records(new, "store", now())
    return records.select(
        "file_hash", "original_path", "status", "job_id", "discipline", time_text("created_at").alias("created_at")
    )


shared_sql(
    "merged_documents",
    f"""SELECT d.id, coalesce(r.document_number, d.document_number) AS document_number, coalesce(r.title, d.title) AS title,
  d.revision, coalesce(r.page_count, d.page_count) AS page_count,
  CASE WHEN r.success THEN 'Approved' WHEN NOT r.success THEN 'Rejected' ELSE d.status END AS status,
  CASE WHEN r.success IS NOT NULL THEN 'deterministic-v1' END AS model_version,
  CASE WHEN r.success IS NOT NULL THEN '{NOW}' ELSE strftime(d.created_at, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM ref_documents d LEFT JOIN processing_results r ON d.id = r.id""",
)
_MERGED = ["id", "document_number", "title", "revision", "page_count", "status", "model_version"]
_MERGED_SQL = f"SELECT {', '.join(_MERGED)}, updated_at FROM merged_documents"


@query("upsert_documents", _MERGED_SQL)
def upsert_documents(src: Source):
    merged = A.upsert_documents(src.ref_documents, src.processing_results, now(), "deterministic-v1")
    return merged.select(*_MERGED, time_text("updated_at").alias("updated_at"))


@query("upsert_written_documents", _MERGED_SQL)
def upsert_written_documents(src: Source):
    """The same on a written table, of which only the partitions with results are replaced."""
    root = new_folder(src.spark, "tables")
    unset = src.ref_documents.withColumns(
        {"model_version": F.lit(None).cast("string"), "updated_at": F.col("created_at")}
    )
    tables.write_tables({"documents": unset}, root)
    before = tables.read_table(src.spark, root, "documents")
    touched = before.join(src.processing_results.select("id"), "id", "left_semi").select(F.col("discipline").alias("part")).distinct()
    # a row per partition; in a shuffle, all documents of a discipline would meet in one task
    affected = before.join(F.broadcast(touched), F.col("discipline").eqNullSafe(F.col("part")), "left_semi")
    merged = stored(A.upsert_documents(affected, src.processing_results, now(), "deterministic-v1"), "merged")
    tables.rewrite_partitions(merged, f"{root}/documents", ["discipline"])
    after = tables.read_table(src.spark, root, "documents")
    return after.select(*_MERGED, time_text("updated_at").alias("updated_at"))


@query(
    "ingest_summary",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY arrival) AS rn FROM judged_uploads WHERE reason IS NULL),
o AS (SELECT CASE WHEN rn = 1 AND NOT EXISTS (SELECT 1 FROM stored_documents s WHERE s.file_hash = a.file_hash) THEN 'successful' ELSE 'already_exists' END AS outcome FROM a
  UNION ALL SELECT 'failed' FROM judged_uploads WHERE reason IS NOT NULL)
SELECT count(*) AS total, count(*) FILTER (outcome = 'successful') AS successful, count(*) FILTER (outcome = 'already_exists') AS already_exists,
  count(*) FILTER (outcome = 'failed') AS failed FROM o""",
)
def ingest_summary(src: Source):
    return A.count_outcomes(src.uploads, src.stored_documents)


@query(
    "write_tables",
    """SELECT 'documents' AS table_name, coalesce(discipline, 'none') AS part, count(*) AS n, count(document_number) AS filled FROM ref_documents GROUP BY ALL
UNION ALL SELECT 'low_confidence_regions', 'none', count(*), count(text) FROM regions""",
)
def write_tables(src: Source):
    root = new_folder(src.spark, "tables")
    tables.write_tables({"documents": src.ref_documents, "low_confidence_regions": src.regions}, root)
    documents = tables.read_table(src.spark, root, "documents")
    regions = tables.read_table(src.spark, root, "low_confidence_regions")
    by_part = documents.groupBy(F.coalesce("discipline", F.lit("none")).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.count("document_number").alias("filled")
    )
    return by_part.select(F.lit("documents").alias("table_name"), "part", "n", "filled").unionByName(
        regions.agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("filled")).select(
            F.lit("low_confidence_regions").alias("table_name"), F.lit("none").alias("part"), "n", "filled"
        )
    )


@query(
    "delete_documents",
    """SELECT 'documents' AS table_name, id AS document_id, count(*) AS n FROM ref_documents WHERE status <> 'Rejected' GROUP BY ALL
UNION ALL SELECT 'regions', document_id, count(*) FROM regions WHERE document_id NOT IN (SELECT id FROM ref_documents WHERE status = 'Rejected') GROUP BY ALL""",
)
def delete_documents(src: Source):
    documents = src.ref_documents
    left = A.delete_documents(
        {"documents": documents, "regions": src.regions}, documents.where(F.col("status") == "Rejected").select("id")
    )
    kept = left["documents"].select(F.lit("documents").alias("table_name"), F.col("id").alias("document_id"))
    kept = kept.unionByName(left["regions"].select(F.lit("regions").alias("table_name"), "document_id"))
    return kept.groupBy("table_name", "document_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "audit_constraints",
    """SELECT 'unique' AS "check", 'uploads' AS table_name, file_hash AS key, count(*) AS violations FROM uploads GROUP BY file_hash HAVING count(*) > 1
UNION ALL SELECT 'unique', 'validation_rules', name, count(*) FROM validation_rules GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'unique', 'regions', CAST(document_id AS VARCHAR) || ',' || CAST(page AS VARCHAR), count(*) FROM regions GROUP BY document_id, page HAVING count(*) > 1
UNION ALL SELECT 'reference', 'agent_actions', CAST(document_id AS VARCHAR), count(*) FROM agent_actions WHERE document_id NOT IN (SELECT id FROM regions) GROUP BY document_id""",
)
def audit_constraints(src: Source):
    return A.audit_constraints(
        [
            ("uploads", src.uploads, ["file_hash"]),
            ("validation_rules", src.validation_rules, ["name"]),
            ("regions", src.regions, ["document_id", "page"]),
        ],
        [("agent_actions", src.agent_actions, "document_id", src.regions, "id")],
    )


@query(
    "audit_lengths",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (length({c}) > {n}) AS too_long, "
        f"count(*) FILTER ({c} IS NULL AND {str(required).lower()}) AS nulls FROM ref_documents"
        for c, n, required in [
            ("document_number", 15, False), ("title", 12, True), ("discipline", 2, True), ("file_hash", 64, True),
        ]
    ),
)
def audit_lengths(src: Source):
    limits = {
        "document_number": (15, False), "title": (12, True), "discipline": (2, True), "file_hash": (64, True),
    }
    return A.audit_lengths(src.ref_documents, limits)
