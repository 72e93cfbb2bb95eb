"""Queries on validation, rejection notes and submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.scale import spread
from paperloom.operators import submission as S
from paperloom.operators import validation as J
from paperloom.plans.admission import NOW, now, time_text
from paperloom.plans.registry import query, shared_sql
from paperloom.sources.views import Source

MODEL = "rules-v1"

shared_sql(
    "rule_pairs",
    """SELECT d.id AS document_id, r.id AS rule_id, r.name AS rule_name, r.rule_type, r.def_type, r.def_field, r.def_pattern,
  CASE r.def_field WHEN 'document_number' THEN d.document_number WHEN 'title' THEN d.title WHEN 'revision' THEN d.revision WHEN 'issue_status' THEN d.issue_status
    WHEN 'contract_number' THEN d.contract_number WHEN 'discipline' THEN d.discipline WHEN 'page_count' THEN CAST(d.page_count AS VARCHAR) END AS value
FROM ref_documents d JOIN validation_rules r ON r.active AND (r.discipline IS NULL OR r.discipline = d.discipline OR d.discipline IS NULL)""",
)
shared_sql(
    "verdicts",
    """SELECT *, CASE WHEN def_type = 'required_field' AND def_field IS NULL THEN 'Rule missing ''field'' definition'
    WHEN def_type = 'required_field' AND coalesce(trim(value), '') = '' THEN 'Required field ''' || def_field || ''' is missing or empty'
    WHEN def_type = 'required_field' THEN 'Required field ''' || def_field || ''' is present'
    WHEN def_type = 'pattern_match' AND regexp_matches(coalesce(value, 'None'), '^(?:' || def_pattern || ')') THEN 'Field ''' || def_field || ''' matches pattern'
    WHEN def_type = 'pattern_match' THEN 'Field ''' || def_field || ''' does not match required pattern'
    WHEN def_type = 'custom' THEN 'Custom validation passed' ELSE 'Unknown rule type: ' || def_type END AS message,
  CASE def_type WHEN 'required_field' THEN coalesce(trim(value), '') <> '' AND def_field IS NOT NULL
    WHEN 'pattern_match' THEN regexp_matches(coalesce(value, 'None'), '^(?:' || def_pattern || ')') WHEN 'custom' THEN true ELSE false END AS passed
FROM rule_pairs""",
)
shared_sql(
    "judgements",
    """SELECT document_id, count(*) FILTER (NOT passed AND rule_type = 'blocking') = 0 AS passed, CAST(count(*) AS INT) AS rules_evaluated,
  CAST(count(*) FILTER (NOT passed AND rule_type = 'blocking') AS INT) AS rules_failed,
  coalesce(string_agg(rule_name, ',' ORDER BY rule_id) FILTER (NOT passed AND rule_type = 'blocking'), '') AS failed_rules,
  coalesce(string_agg(rule_name, ',' ORDER BY rule_id) FILTER (NOT passed AND rule_type <> 'blocking'), '') AS warnings
FROM verdicts GROUP BY document_id""",
)
shared_sql(
    "note_comments",
    """SELECT v.document_id, CAST(row_number() OVER (PARTITION BY v.document_id ORDER BY v.rule_type <> 'blocking', v.rule_id) AS INT) AS seq,
  CASE WHEN v.rule_type = 'blocking' THEN '[' ELSE '[WARNING - ' END || v.rule_name || '] ' || v.message AS client_comment, v.rule_type, v.def_type, v.def_field, v.def_pattern, v.value
FROM verdicts v JOIN judgements j ON j.document_id = v.document_id AND NOT j.passed WHERE NOT v.passed""",
)


def documents_to_judge(src: Source):
    return spread(src.ref_documents, "id")


def validated(src: Source):
    return J.validate_documents(documents_to_judge(src), src.validation_rules)


@query("active_rules", "SELECT document_id, rule_id, rule_name FROM rule_pairs")
def active_rules(src: Source):
    return J.active_rules(src.ref_documents, src.validation_rules)


@query(
    "validation_inputs",
    """SELECT id, unnest(['document_number', 'title', 'revision', 'issue_status', 'contract_number', 'discipline', 'page_count']) AS field,
  unnest([document_number, title, revision, issue_status, contract_number, discipline, CAST(page_count AS VARCHAR)]) AS value FROM ref_documents""",
)
def validation_inputs(src: Source):
    return src.ref_documents.select("id", F.explode(J.validation_inputs()).alias("field", "value"))


def _verdict_query(kind: str, sql_condition: str):
    @query(kind, f"SELECT document_id, rule_name, passed, message FROM verdicts WHERE {sql_condition}")
    def build(src: Source):
        verdicts = J.judged(documents_to_judge(src), src.validation_rules).select(
            F.col("id").alias("document_id"), F.inline("verdicts")
        )
        rules = src.validation_rules.where(sql_condition.replace("rule_pairs.", "")).select("name")
        return verdicts.join(F.broadcast(rules), F.col("rule_name") == F.col("name"), "left_semi").select(
            "document_id", "rule_name", "passed", "message"
        )

    return build


rule_required_field = _verdict_query("rule_required_field", "def_type = 'required_field'")
rule_pattern_match = _verdict_query("rule_pattern_match", "def_type = 'pattern_match'")
rule_custom = _verdict_query("rule_custom", "def_type = 'custom'")
rule_unknown_type = _verdict_query(
    "rule_unknown_type", "def_type NOT IN ('required_field', 'pattern_match', 'custom')"
)


def _names(column: str):
    return F.array_join(F.transform(column, lambda v: v["rule_name"]), ",").alias(column)


@query(
    "validate_documents",
    "SELECT document_id, passed, rules_evaluated, rules_failed, failed_rules, warnings FROM judgements",
)
def validate_documents(src: Source):
    return validated(src).select(
        "document_id", "passed", "rules_evaluated", "rules_failed", _names("failed_rules"), _names("warnings")
    )


@query(
    "rejection_notes",
    f"""SELECT c.document_id, c.seq, c.client_comment, c.rule_type,
  '{{"document_number":' || coalesce('"' || d.document_number || '"', 'null') || ',"rejection_date":"{NOW}","status":"REJECTED","summary":{{"total_issues":' || j.rules_failed
    || ',"total_warnings":' || (count(*) OVER (PARTITION BY c.document_id) - j.rules_failed) || ',"blocking_failures":' || j.rules_failed || '}}' AS note_head,
  CASE WHEN c.def_type = 'pattern_match' THEN '{{"field":"' || c.def_field || '","pattern":"' || c.def_pattern || '","value":' || coalesce('"' || c.value || '"', 'null') || '}}'
    WHEN c.def_field IS NOT NULL THEN '{{"field":"' || c.def_field || '"}}' END AS details
FROM note_comments c JOIN judgements j ON j.document_id = c.document_id JOIN ref_documents d ON d.id = c.document_id""",
)
def rejection_notes(src: Source):
    notes = J.rejection_notes(validated(src), F.lit(NOW))
    rows = notes.select(
        "document_id", F.substring_index("note_json", ',"comments_response"', 1).alias("note_head"),
        F.inline("note.comments_response"),
    )
    return rows.select(
        "document_id", "seq", "client_comment", "rule_type", "note_head",
        F.to_json("details", {"ignoreNullFields": "false"}).alias("details"),
    )


@query(
    "render_rejection",
    f"""SELECT c.document_id, repeat('=', 80) || chr(10) || 'DOCUMENT VALIDATION REJECTION' || chr(10) || repeat('=', 80) || chr(10) || chr(10)
  || coalesce('Document: ' || any_value(d.document_number) || chr(10), '') || 'Date: {NOW}' || chr(10) || 'Status: REJECTED' || chr(10) || chr(10) || 'SUMMARY:' || chr(10)
  || '  - Blocking failures: ' || any_value(j.rules_failed) || chr(10) || '  - Warnings: ' || (count(*) - any_value(j.rules_failed)) || chr(10) || chr(10)
  || repeat('-', 80) || chr(10) || 'CLIENT COMMENT / CONTRACTOR RESPONSE TABLE' || chr(10) || repeat('-', 80) || chr(10) || chr(10)
  || string_agg(c.seq || '. [' || upper(c.rule_type) || '] ' || c.client_comment || chr(10) || '   Contractor Response: [Awaiting response]' || chr(10), chr(10) ORDER BY c.seq)
  || chr(10) || repeat('=', 80) AS report
FROM note_comments c JOIN judgements j ON j.document_id = c.document_id JOIN ref_documents d ON d.id = c.document_id GROUP BY c.document_id""",
)
def render_rejection(src: Source):
    notes = J.rejection_notes(validated(src), F.lit(NOW))
    return notes.select("document_id", J.render_rejection(F.col("note")).alias("report"))


@query(
    "apply_decision",
    "SELECT d.id, CASE WHEN j.passed THEN 'Approved' ELSE 'Rejected' END AS status FROM ref_documents d JOIN judgements j ON j.document_id = d.id",
)
def apply_decision(src: Source):
    return J.apply_decision(src.ref_documents, validated(src)).select("id", "status")


@query(
    "rule_failure_report",
    "SELECT rule_id, rule_name, rule_type, count(*) AS evaluated, count(*) FILTER (NOT passed) AS failed FROM verdicts GROUP BY ALL",
)
def rule_failure_report(src: Source):
    return J.rule_failure_report(documents_to_judge(src), src.validation_rules)


@query(
    "submittable",
    """SELECT id, coalesce(discipline, '') AS discipline, status = 'Approved' AS ready,
  CASE WHEN status <> 'Approved' THEN 'Document must be approved before submission. Current status: ' || status END AS reason FROM ref_documents""",
)
def submittable(src: Source):
    ready, refused = S.submittable(src.ref_documents)
    discipline = F.coalesce("discipline", F.lit("")).alias("discipline")
    return ready.select("id", discipline, F.lit(True).alias("ready"), F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select("id", discipline, F.lit(False).alias("ready"), "reason")
    )


shared_sql("ready_documents", "SELECT * FROM ref_documents WHERE status = 'Approved'")


@query(
    "submission_payloads",
    f"""SELECT id AS document_id, '{{"submission_type":"engineering_document"' || coalesce(',"discipline":"' || discipline || '"', '') || ',"metadata":{{"document_id":' || id || ',"file_hash":"' || file_hash
  || '","file_extension":".pdf"' || coalesce(',"discipline":"' || discipline || '"', '') || ',"model_version":"{MODEL}","submission_timestamp":"{NOW}"'
  || coalesce(',"document_number":"' || document_number || '"', '') || coalesce(',"title":"' || title || '"', '') || coalesce(',"revision":"' || revision || '"', '')
  || coalesce(',"issue_status":"' || issue_status || '"', '') || coalesce(',"contract_number":"' || contract_number || '"', '') || CASE WHEN page_count <> 0 THEN ',"page_count":' || page_count ELSE '' END
  || CASE WHEN page_count > 20 THEN ',"revision_history":[{{"rev":"A"}}]' ELSE '' END
  || '}},"file_info":{{"hash":"' || file_hash || '","extension":".pdf"}}}}' AS payload FROM ready_documents""",
)
def submission_payloads(src: Source):
    ready, _ = S.submittable(src.ref_documents)
    history = F.when(F.col("page_count") > 20, F.array(F.struct(F.lit("A").alias("rev")))).otherwise(
        F.array().cast("array<struct<rev:string>>")
    )
    described = ready.withColumn("original_path", F.concat(F.lit("store/"), "file_hash", F.lit(".pdf"))).withColumn(
        "revision_history", history
    )
    return S.submission_payloads(described, F.lit(NOW), MODEL)


@query(
    "submission_payloads_short",
    f"""SELECT id AS document_id, '{{"document_id":' || id || ',"file_hash":"' || file_hash || '","document_number":' || coalesce('"' || document_number || '"', 'null')
  || ',"discipline":' || coalesce('"' || discipline || '"', 'null') || ',"submitted_at":"{NOW}"}}' AS payload FROM ready_documents""",
)
def submission_payloads_short(src: Source):
    ready, _ = S.submittable(src.ref_documents)
    return S.submission_payloads(ready, F.lit(NOW), MODEL, form="short")


shared_sql(
    "refs",
    """SELECT document_id, CASE document_id % 5 WHEN 0 THEN 'C-' || document_id WHEN 1 THEN 'R-' || document_id WHEN 2 THEN nullif(CAST(document_id AS VARCHAR), '0') END AS ref FROM controller_responses""",
)


@query(
    "confirmation_ref",
    """SELECT document_id, ref, CASE WHEN ref IS NULL THEN 'failed' ELSE 'submitted' END AS status, coalesce(ref, 'MOCK-' || document_id) AS mock_ref,
  CASE WHEN ref IS NULL THEN 'pending' ELSE 'submitted' END AS mock_status FROM refs""",
)
def confirmation_ref(src: Source):
    strict = S.confirmation_ref(src.controller_responses)
    mocked = S.confirmation_ref(src.controller_responses, mock=True).select(
        "document_id", F.col("ref").alias("mock_ref"), F.col("status").alias("mock_status")
    )
    return strict.join(mocked, "document_id")


@query(
    "submission_log",
    f"""SELECT d.id AS document_id, d.discipline, 'pass' AS status, d.file_hash, r.ref AS confirmation_ref, '{MODEL}' AS model_version, '{NOW}' AS submitted_at
FROM ready_documents d JOIN refs r ON r.document_id = d.id WHERE r.ref IS NOT NULL""",
)
def submission_log(src: Source):
    ready, _ = S.submittable(src.ref_documents)
    log = S.submission_log(ready, S.confirmation_ref(src.controller_responses), now(), MODEL)
    return log.withColumn("submitted_at", time_text("submitted_at"))
