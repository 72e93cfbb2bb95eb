"""Queries that drive the streams over all present files and return what they wrote, with their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import activity as M
from paperloom.plans.admission import time_text
from paperloom.plans.registry import query, shared_sql
from paperloom.session import new_folder
from paperloom.sources.views import FILES_PER_TRIGGER, Source
from paperloom.streaming import activity, ingest, runs, status
from paperloom.streaming.verdicts import VerdictTable

shared_sql(
    "change_rows",
    """SELECT job_id, seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, status, CAST(CASE WHEN status = 'Checking' THEN 50 ELSE 100 END AS INT) AS progress FROM (
  SELECT *, lag(status) OVER w AS before, coalesce(count(*) FILTER (status <> 'Checking') OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS finals
  FROM status_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)) WHERE finals = 0 AND (before IS NULL OR before <> status)""",
)
shared_sql(
    "window_rows",
    """SELECT w AS window_start, w + INTERVAL 24 HOURS AS window_end, count(*) AS total, count(*) FILTER (success) AS successful,
  round(count(*) FILTER (success) * 100e0 / count(*), 1) AS success_rate, round(avg(confidence), 3) AS average_confidence
FROM (SELECT *, unnest(generate_series(date_trunc('hour', created_at) - INTERVAL 23 HOURS, date_trunc('hour', created_at), INTERVAL 1 HOUR)) AS w FROM agent_actions) GROUP BY w""",
)
_WINDOWS = """SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, total, successful, success_rate, average_confidence
FROM window_rows"""
_CLOSED = " WHERE window_end <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM agent_actions)"


def _finished(src: Source, stream, name: str):
    """Run the stream to the end of the present input and read its output."""
    root = new_folder(src.spark, name)
    runs.append_to(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return src.spark.read.schema(stream.schema).parquet(f"{root}/out")


def _change_columns(df):
    return df.select("job_id", "seq", time_text("ts").alias("ts"), "status", "progress")


@query("status_changes", "SELECT job_id, seq, ts, status, progress FROM change_rows")
def status_changes(src: Source):
    changes = status.status_changes(src.view("status_events", streaming=True))
    return _change_columns(_finished(src, changes, "changes"))


@query("status_changes_batch", "SELECT job_id, seq, ts, status, progress FROM change_rows")
def status_changes_batch(src: Source):
    return _change_columns(M.status_changes(src.status_events))


@query(
    "status_messages",
    """SELECT job_id, seq, '{"type":"status_update","job_id":"' || job_id || '","status":"' || status || '","progress":' || progress || '}' AS message FROM change_rows""",
)
def status_messages(src: Source):
    changes = status.status_changes(src.view("status_events", streaming=True))
    return _finished(src, status.status_messages(changes), "messages")


def _window_columns(df):
    return df.withColumns({c: time_text(c) for c in ("window_start", "window_end")})


@query("activity_windows", _WINDOWS + _CLOSED)
def activity_windows(src: Source):
    windows = activity.activity_windows(src.view("agent_actions", streaming=True))
    return _window_columns(_finished(src, windows, "windows"))


@query("activity_windows_batch", _WINDOWS)
def activity_windows_batch(src: Source):
    return _window_columns(M.activity_windows(src.agent_actions))


@query(
    "ingest_stream",
    """SELECT u.file_hash, 'store/' || u.file_hash || u.extension AS original_path, 'Checking' AS status,
  substr(sha256('job:' || u.file_hash), 1, 32) AS job_id, u.discipline
FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY arrival) AS n FROM upload_ext) u
WHERE n = 1 AND u.file_hash NOT IN (SELECT file_hash FROM stored_documents)""",
)
def ingest_stream(src: Source):
    root = new_folder(src.spark, "ingest")
    rows = src.view("uploads", streaming=True)
    stored = src.stored_documents
    ingest.ingest_stream(rows, lambda: stored, "store", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return src.spark.read.parquet(f"{root}/out").select("file_hash", "original_path", "status", "job_id", "discipline")


@query("continuous_validation", "SELECT document_id, passed, rules_evaluated, rules_failed FROM judgements")
def continuous_validation(src: Source):
    root = new_folder(src.spark, "validation")
    src.validation_rules.write.parquet(f"{root}/rules")
    ingest.continuous_validation(
        src.view("ref_documents", streaming=True, files=FILES_PER_TRIGGER), lambda: src.spark.read.parquet(f"{root}/rules"), f"{root}/out",
        f"{root}/checkpoint",
    ).awaitTermination()
    return src.spark.read.parquet(f"{root}/out").select("document_id", "passed", "rules_evaluated", "rules_failed")


def verdict_table(src: Source) -> VerdictTable:
    """Documents in two batches. With the second one, rules are changed, dropped and added to those the first one met."""
    root = new_folder(src.spark, "verdicts")
    now, one = src.validation_rules, F.col("id") == 1
    before = now.where("id <> 5").select(
        "id", "name", F.when(one, "warning").otherwise(F.col("rule_type")).alias("rule_type"), "discipline", "def_type",
        F.when(F.col("id") == 3, "title").otherwise(F.col("def_field")).alias("def_field"), "def_pattern",
        (F.col("active") | (F.col("id") == 9)).alias("active"),
    )
    half = F.col("id") % 2 == 0
    table = VerdictTable(src.spark, root)
    table.commit(0, src.ref_documents.where(half), before)
    table.commit(1, src.ref_documents.where(~half), now)
    return table


@query(
    "maintained_verdicts",
    "SELECT document_id, passed, rules_evaluated, rules_failed, failed_rules, warnings FROM judgements",
)
def maintained_verdicts(src: Source):
    names = lambda c: F.array_join(F.transform(c, lambda v: v["rule_name"]), ",").alias(c)
    return verdict_table(src).validated().select(
        "document_id", "passed", "rules_evaluated", "rules_failed", names("failed_rules"), names("warnings")
    )


@query(
    "maintained_rule_totals",
    "SELECT rule_id, rule_name, rule_type, count(*) AS evaluated, count(*) FILTER (NOT passed) AS failed FROM verdicts GROUP BY ALL",
)
def maintained_rule_totals(src: Source):
    return verdict_table(src).rule_totals().withColumn("rule_id", F.col("rule_id").cast("int"))
