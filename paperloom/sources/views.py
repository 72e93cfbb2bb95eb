"""Input views over the test tables, in SQL that Spark and DuckDB both run.

``<<x>>`` stands for the SHA-256 of x, which the two engines spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_HASH = re.compile(r"<<(.*?)>>")

VIEWS = {
    "ref_documents": """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'ARG-E-EL-' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || '-' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') END AS document_number,
  CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE 'Layout ' || o_orderpriority END AS title,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS STRING) END AS revision,
  CASE o_orderkey % 6 WHEN 0 THEN 'IFR' WHEN 1 THEN 'IFA' WHEN 2 THEN 'IFC' WHEN 3 THEN 'ASB' WHEN 4 THEN 'IFI' END AS issue_status,
  'CT-' || CAST(o_custkey AS STRING) AS contract_number,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ELC' WHEN '2' THEN 'MEC' WHEN '3' THEN 'INS' WHEN '4' THEN 'SIM' END AS discipline,
  CAST(o_orderkey % 40 AS INT) AS page_count,
  <<'order-' || CAST(o_orderkey AS STRING)>> AS file_hash,
  CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'P' THEN 'Rejected' ELSE 'Checking' END AS status,
  'job-' || CAST(o_orderkey AS STRING) AS job_id,
  o_orderdate AS created_at
FROM orders""",
    "uploads": """
SELECT doc_id AS arrival,
  source || '/file_' || CAST(doc_id AS STRING) || CASE doc_id % 13 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.dwg' WHEN 3 THEN '.dxf' WHEN 4 THEN '.docx' WHEN 5 THEN '.xlsx' WHEN 6 THEN '.pptx' WHEN 7 THEN '.png' WHEN 8 THEN '.jpeg' WHEN 9 THEN '.tif' WHEN 10 THEN '.exe' WHEN 11 THEN '' ELSE '.tiff' END AS path,
  CASE doc_id % 6 WHEN 0 THEN 'ELC' WHEN 1 THEN 'MEC' WHEN 2 THEN 'INS' WHEN 3 THEN 'SIM' WHEN 4 THEN 'XYZ' END AS discipline,
  <<text>> AS file_hash
FROM documents""",
    # documents that were labelled before count as already stored
    "stored_documents": """
SELECT <<d.text>> AS file_hash, min(d.doc_id) AS id, CASE WHEN max(l.quality) = 1 THEN 'Approved' ELSE 'Rejected' END AS status
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
GROUP BY <<d.text>>""",
    "drawing_texts": """
SELECT p_partkey AS id,
  'Drawing Title:  ' || p_name || '  ' || p_type || chr(10) ||
  'ARG-E-OD-' || lpad(CAST(p_size % 100 AS STRING), 2, '0') || '-' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || chr(10) ||
  'Rev ' || substr('ABCD012', CAST(p_partkey % 7 AS INT) + 1, 1) || chr(10) ||
  CASE p_partkey % 4 WHEN 0 THEN 'IFA IFC' WHEN 1 THEN 'IFR [X] IFC' WHEN 2 THEN 'IFR [x]  As Built' ELSE 'none' END || chr(10) ||
  'Contract: CT-' || CAST(p_size AS STRING) || chr(10) || 'Sheet of ' || CAST(p_size AS STRING) || chr(10) || chr(10) ||
  'Revision Record' || chr(10) || 'A 01/02/24 First issue' || chr(10) || 'B 03/04/2024 ' || p_brand || chr(10) || 'no revision line' || chr(10) || chr(10) ||
  'Comments' || chr(10) || '1. Check ' || p_type || chr(10) || 'Response: Done' || chr(10) || '2) Update ' || p_brand || chr(10) || 'Response: ok' || chr(10) || chr(10) ||
  'Legend' || chr(10) || 'MCB - ' || p_type || chr(10) || 'M - too short' || chr(10) || chr(10) ||
  'EQP-' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || ': ' || CAST(p_size AS STRING) || ' kW set, 230 V, 1-phase, 50 Hz, 2 kW' || chr(10) || chr(10) ||
  'Drawing Index' || chr(10) || '1 - Cover' || chr(10) || '2.1 - ' || p_name || chr(10) || chr(10) ||
  'Signature' || chr(10) || 'Prepared By: ' || p_brand || chr(10) || 'Checked By: QA' AS text
FROM part""",
    "ocr_blocks": """
SELECT l_orderkey AS document_id, l_linenumber AS page, l_partkey AS ord,
  CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE l_returnflag || '-' || CAST(l_partkey AS STRING) END AS text,
  l_quantity / 50e0 AS confidence,
  CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_suppkey % 300 AS DOUBLE) AS y,
  CAST(l_quantity AS DOUBLE) AS w, CAST(10 AS DOUBLE) AS h,
  (l_linestatus = 'F') AS reviewed, l_shipdate AS created_at
FROM lineitem""",
    "elements": """
SELECT l_orderkey AS document_id, l_linenumber AS page, l_partkey AS ord,
  CASE l_partkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'ATTRIB' WHEN 2 THEN 'MTEXT' ELSE 'TEXT' END AS kind,
  CASE l_suppkey % 4 WHEN 0 THEN 'DWG_NO' WHEN 1 THEN 'TITLE1' WHEN 2 THEN 'REVISION' ELSE 'Scale' END AS name,
  CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'part ' || CAST(l_partkey AS STRING) || ' ' || l_returnflag END AS text,
  CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_suppkey % 300 AS DOUBLE) AS y,
  CAST(l_quantity AS DOUBLE) AS w, CAST(10 AS DOUBLE) AS h
FROM lineitem""",
    "agent_actions": """
SELECT event_id AS id, user_id AS document_id, 'job-' || CAST(user_id AS STRING) AS job_id, event_type AS action_type,
  CASE event_id % 4 WHEN 0 THEN 'proceed' WHEN 1 THEN 'retry' WHEN 2 THEN 'fallback' ELSE 'flag_for_review' END AS decision,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE value / 500e0 END AS confidence,
  (event_type <> 'error') AS success, ts AS created_at
FROM events""",
    "status_events": """
SELECT 'job-' || CAST(user_id AS STRING) AS job_id, event_id AS seq, ts,
  CASE event_type WHEN 'purchase' THEN 'Approved' WHEN 'error' THEN 'Rejected' ELSE 'Checking' END AS status
FROM events""",
    "search_chunks": """
SELECT vec_id AS chunk_id, CAST((vec_id - vec_id % 5) / 5 AS BIGINT) AS document_id, vec_id % 5 AS pos,
  CASE WHEN vec_id % 5 = 0 THEN 'parent' ELSE 'child' END AS level,
  CASE WHEN vec_id % 5 = 0 THEN NULL ELSE vec_id - vec_id % 5 END AS parent_id,
  'chunk ' || CAST(vec_id AS STRING) || ' of label ' || CAST(label AS STRING) AS content,
  label, embedding
FROM embeddings""",
    # one query vector per label: the stored vector with the smallest id
    "vector_queries": """
SELECT CAST(label AS BIGINT) AS query_id, min_by(embedding, vec_id) AS embedding FROM embeddings GROUP BY label""",
    "llm_responses": """
SELECT p_partkey AS id,
  CASE WHEN p_partkey % 7 = 3 THEN '{broken'
       WHEN p_partkey % 5 = 0 THEN '```json' || chr(10) || '{"general_notes": ["' || p_brand || '"], "specifications": ["IEC"], "complex_comments": [{"comment": "c1", "response": "r1"}]}' || chr(10) || '```'
       WHEN p_partkey % 11 = 4 THEN '["a", "list"]'
       ELSE '{"general_notes": ["n1","n2"], "equipment_details": [{"tag": "TRF-' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || '", "rating": "2 kW"}, {"tag": "EQP-' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || '"}], "legend_descriptions": [{"symbol": "GEN", "description": "Generator"}]}' END AS response
FROM part""",
    "fallback_responses": """
SELECT p_partkey AS id,
  CASE WHEN p_partkey % 2 = 0 THEN '{"general_notes": ["second model"]}' ELSE '{worse' END AS response
FROM part""",
    "validation_rules": """
SELECT * FROM (VALUES
  (1, 'number_present', 'blocking', CAST(NULL AS STRING), 'required_field', 'document_number', CAST(NULL AS STRING), true),
  (2, 'title_present', 'blocking', NULL, 'required_field', 'title', NULL, true),
  (3, 'number_format', 'blocking', 'ELC', 'pattern_match', 'document_number', '^ARG-E-EL-[0-9]{2}-[0-9]{3}', true),
  (4, 'status_known', 'warning', NULL, 'pattern_match', 'issue_status', 'IF[RAC]', true),
  (5, 'revision_present', 'warning', 'MEC', 'required_field', 'revision', NULL, true),
  (6, 'custom_ok', 'blocking', NULL, 'custom', NULL, NULL, true),
  (7, 'unknown_type', 'warning', 'SIM', 'checksum', NULL, NULL, true),
  (8, 'no_field', 'warning', 'INS', 'required_field', NULL, NULL, true),
  (9, 'inactive', 'blocking', NULL, 'required_field', 'revision', NULL, false)
) AS t(id, name, rule_type, discipline, def_type, def_field, def_pattern, active)""",
    "answers": """
SELECT conv_id * 1000 + turn AS query_id,
  CASE conv_id % 3 WHEN 0 THEN 'ANSWER: ' || replace(text, chr(10), ' ') || chr(10) || 'CONFIDENCE: High' || chr(10) || 'CITATIONS: ARG-E-EL-' || lpad(CAST(conv_id % 100 AS STRING), 2, '0') || '-001 · Sheet 2, ZZZ-E-EL-00-999 · Page 4'
    WHEN 1 THEN 'plain answer ' || CAST(conv_id AS STRING)
    ELSE 'ANSWER: x' || chr(10) || 'CONFIDENCE: unsure' END AS response
FROM conversations WHERE role = 'assistant'""",
    # every turn of a conversation stands for one retrieved chunk of each of its answers
    "answer_context": """
SELECT a.conv_id * 1000 + a.turn AS query_id, CAST(c.turn AS INT) AS rank, c.conv_id * 1000 + c.turn AS chunk_id,
  'ARG-E-EL-' || lpad(CAST(c.conv_id % 100 AS STRING), 2, '0') || '-' || lpad(CAST(CAST((c.turn + c.turn % 2) / 2 AS BIGINT) AS STRING), 3, '0') AS document_number,
  'Turn of ' || c.role AS title, c.text AS content
FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.role = 'assistant'""",
    "asked_questions": """
SELECT a.conv_id * 1000 + a.turn AS query_id, max(CASE WHEN c.turn = 0 THEN c.text END) AS query
FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.role = 'assistant' GROUP BY a.conv_id * 1000 + a.turn""",
    "corpus_documents": """
SELECT doc_id AS id,
  'ARG-E-EL-' || lpad(CAST(doc_id % 100 AS STRING), 2, '0') || '-' || lpad(CAST(doc_id % 1000 AS STRING), 3, '0') AS document_number,
  source || ' ' || lang AS title,
  CASE lang WHEN 'en' THEN 'ELC' WHEN 'de' THEN 'MEC' WHEN 'fr' THEN 'INS' ELSE 'SIM' END AS discipline
FROM documents""",
    "text_queries": """
SELECT item_id AS query_id, text AS query FROM benchmark""",
    "processing_results": """
SELECT p_partkey AS id, 'PRT-E-EL-00-' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') AS document_number,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS title, CAST(p_size AS INT) AS page_count, (p_size % 5 <> 0) AS success
FROM part""",
    "reviews": """
SELECT s_suppkey AS region_id, true AS reviewed, s_name AS reviewed_by FROM supplier""",
    "regions": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS document_id, l_linenumber AS page, l_returnflag || '-' || CAST(l_partkey AS STRING) AS text,
  l_quantity / 50e0 AS confidence, (l_linestatus = 'F') AS reviewed, CAST(NULL AS STRING) AS reviewed_by, l_shipdate AS created_at
FROM lineitem WHERE l_quantity / 50e0 < 0.75e0""",
    "controller_responses": """
SELECT o_orderkey AS document_id,
  CASE o_orderkey % 5 WHEN 0 THEN '{"confirmation_ref": "C-' || CAST(o_orderkey AS STRING) || '"}'
    WHEN 1 THEN '{"confirmation_ref": "", "reference": "R-' || CAST(o_orderkey AS STRING) || '"}'
    WHEN 2 THEN '{"id": ' || CAST(o_orderkey AS STRING) || '}'
    WHEN 3 THEN '{"note": "received"}' END AS response
FROM orders""",
}

FILES_PER_TRIGGER = 16


class Source:
    """The tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream_table(self, name: str, files: int | None = None) -> DataFrame:
        """The same table, a file or a folder of files, as a stream of at most ``files`` of them at a time.

        Without that number all present files are one micro-batch: those of a table stand in no order of time, which a stream
        that depends on order would take for late or repeated rows.
        """
        reader = self.spark.readStream.schema(self.table(name).schema)
        if files:
            reader = reader.option("maxFilesPerTrigger", files)
        # a pattern may be met by a file as well as by a folder
        return reader.parquet(f"{self.folder}/[{name[0]}]{name[1:]}.parquet")

    def view(self, name: str, streaming: bool = False, files: int | None = None) -> DataFrame:
        sql = VIEWS[name]
        for base in BASE_TABLES:
            if f"FROM {base}" in sql or f"JOIN {base}" in sql:
                table = self.stream_table(base, files) if streaming else self.table(base)
                table.createOrReplaceTempView(base)
        return self.spark.sql(_HASH.sub(r"sha2(\1, 256)", sql))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)


def duckdb_views() -> dict[str, str]:
    return {name: _HASH.sub(r"sha256(\1)", sql) for name, sql in VIEWS.items()}
