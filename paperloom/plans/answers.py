"""Queries on answers and audit rows.

Answers, citations and the log use recorded answers with the turns of their conversation as context; the assembled
context uses the hits of the hybrid search.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.constants import ASK_LIMIT, NO_CONTEXT_ANSWER
from paperloom.operators import answers as I
from paperloom.operators import audit
from paperloom.operators import hybrid_search as H
from paperloom.operators import parsing as P
from paperloom.operators import text_search as T
from paperloom.plans.admission import NOW, now, time_text
from paperloom.plans.parsing import drawings
from paperloom.plans.registry import query, shared_sql
from paperloom.plans.search import DIM, LIMIT, Corpus, text_tables
from paperloom.plans.validation import MODEL, validated
from paperloom.session import stored
from paperloom.sources.views import Source

_BEFORE, _MIDDLE, _AFTER = (p.replace("\n", "' || chr(10) || '") for p in I.PROMPT)

shared_sql("ask_vector", f"SELECT * FROM vector_hits WHERE rank <= {2 * ASK_LIMIT}")
shared_sql("ask_text", f"SELECT * FROM text_hits WHERE rank <= {2 * ASK_LIMIT}")
shared_sql(
    "ask_fused",
    """SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.chunk_id, t.chunk_id) AS chunk_id,
  round(coalesce(v.score, 0e0) * 0.6e0 + coalesce(t.score, 0e0) * 0.4e0, 12) AS score
FROM ask_vector v FULL JOIN ask_text t ON v.query_id = t.query_id AND v.chunk_id = t.chunk_id""",
)
shared_sql(
    "ask_hits",
    f"""SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ask_fused QUALIFY rank <= {ASK_LIMIT}""",
)
shared_sql(
    "ask_expanded",
    """SELECT query_id, chunk_id, rank, 0 AS place FROM ask_hits
UNION ALL SELECT h.query_id, c.parent_id, h.rank, 1 FROM ask_hits h JOIN child_texts c ON c.chunk_id = h.chunk_id
QUALIFY row_number() OVER (PARTITION BY h.query_id, c.parent_id ORDER BY h.rank) = 1""",
)
shared_sql(
    "ask_context",
    """SELECT h.query_id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank, h.place) AS n, d.document_number, d.title, c.content
FROM ask_expanded h JOIN chunks c ON c.chunk_id = h.chunk_id JOIN corpus_documents d ON d.id = c.document_id""",
)


@query(
    "assemble_context",
    f"""SELECT x.query_id, '{_BEFORE}' || x.context || '{_MIDDLE}' || q.query || '{_AFTER}' AS prompt, x.n_chunks FROM (
  SELECT query_id, string_agg('[' || n || '] Document: ' || document_number || ' - ' || title || ' (Page/Sheet: N/A)' || chr(10) || content || chr(10), chr(10) ORDER BY n) AS context,
    CAST(count(*) AS INT) AS n_chunks FROM ask_context GROUP BY query_id) x JOIN text_queries q ON q.query_id = x.query_id""",
)
def assemble_context(src: Source):
    corpus = Corpus(src)
    hits = H.hybrid_search(
        corpus.queries, corpus.vectors, corpus.documents, corpus.index, corpus.statistics, DIM, ASK_LIMIT,
        frequency=corpus.frequency,
    )
    expanded = stored(H.expand_parents(stored(hits, "hits"), corpus.chunks), "expanded")
    context = I.context_chunks(expanded, corpus.chunks, corpus.documents)
    return I.assemble_context(context, src.text_queries).select("query_id", "prompt", "n_chunks")


_LINES = "list_transform(string_split(trim(response), chr(10)), lambda l: trim(l))"
shared_sql(
    "answer_parts",
    f"""SELECT query_id, trim(response) AS whole, list_transform(list_filter({_LINES}, lambda l: starts_with(l, 'ANSWER:')), lambda l: trim(replace(l, 'ANSWER:', '')))[-1] AS answer,
  list_filter(list_transform(list_filter({_LINES}, lambda l: starts_with(l, 'CONFIDENCE:')), lambda l: lower(trim(replace(l, 'CONFIDENCE:', '')))), lambda c: c IN ('high', 'medium', 'low'))[-1] AS level,
  list_transform(list_filter({_LINES}, lambda l: starts_with(l, 'CITATIONS:')), lambda l: trim(replace(l, 'CITATIONS:', '')))[-1] AS citations_text FROM answers""",
)
shared_sql(
    "parsed_answers",
    """SELECT query_id, coalesce(nullif(answer, ''), whole) AS answer, CASE coalesce(level, 'medium') WHEN 'high' THEN 'High' WHEN 'low' THEN 'Low' ELSE 'Medium' END AS confidence, citations_text FROM answer_parts""",
)
_CITE = r"(?i)([A-Z]{2,4}-[A-Z]-[A-Z]{2}-\d{2}-\d{3})\s*[·•]\s*(?:Sheet|Page)\s*(\d+)"
shared_sql(
    "explicit_citations",
    f"""SELECT c.query_id, c.seq, c.number AS document_number, t.title, c.page_or_sheet FROM (
  SELECT query_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS seq, unnest(a) AS number, CASE WHEN contains(lower(citations_text), 'sheet') THEN 'Sheet ' ELSE 'Page ' END || unnest(b) AS page_or_sheet
  FROM (SELECT query_id, citations_text, regexp_extract_all(citations_text, '{_CITE}', 1) AS a, regexp_extract_all(citations_text, '{_CITE}', 2) AS b FROM parsed_answers)) c
JOIN (SELECT query_id, document_number, min_by(title, rank) AS title FROM answer_context GROUP BY ALL) t ON t.query_id = c.query_id AND t.document_number = c.number""",
)
shared_sql(
    "listed_citations",
    """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS INT) AS seq, document_number, title, 'N/A' AS page_or_sheet FROM (
  SELECT query_id, document_number, min(rank) AS n, min_by(title, rank) AS title FROM answer_context GROUP BY query_id, document_number) QUALIFY seq < 5""",
)
shared_sql(
    "all_citations",
    """SELECT * FROM explicit_citations UNION ALL SELECT l.* FROM listed_citations l JOIN answers a ON a.query_id = l.query_id
WHERE l.query_id NOT IN (SELECT query_id FROM explicit_citations)""",
)


def context(src: Source):
    return src.answer_context.withColumnRenamed("rank", "n").withColumn("page", F.lit(None).cast("int"))


@query("parse_answers", "SELECT query_id, answer, confidence, citations_text FROM parsed_answers")
def parse_answers(src: Source):
    return I.parse_answers(src.answers)


@query("parse_citations", "SELECT query_id, seq, document_number, title, page_or_sheet FROM explicit_citations")
def parse_citations(src: Source):
    return I.parse_citations(I.parse_answers(src.answers), context(src))


@query("context_citations", "SELECT query_id, seq, document_number, title, page_or_sheet FROM listed_citations")
def context_citations(src: Source):
    return I.context_citations(context(src))


def citations(src: Source):
    answered = I.parse_answers(src.answers)
    return I.final_citations(I.parse_citations(answered, context(src)), I.context_citations(context(src)), answered)


@query("final_citations", "SELECT query_id, seq, document_number, title, page_or_sheet FROM all_citations")
def final_citations(src: Source):
    return citations(src)


@query(
    "unanswerable_queries",
    f"""SELECT query_id, '{NO_CONTEXT_ANSWER}' AS answer, 'Low' AS confidence, CAST(0 AS INT) AS context_chunks_used FROM text_queries WHERE query_id NOT IN (SELECT query_id FROM text_hits)""",
)
def unanswerable_queries(src: Source):
    index, statistics, _ = text_tables(src)
    return I.unanswerable_queries(src.text_queries, T.text_topk(src.text_queries, index, statistics, 2 * LIMIT))


shared_sql(
    "conversation_queries",
    "SELECT query_id, query FROM asked_questions",
)
shared_sql(
    "question_log",
    f"""SELECT q.query_id, q.query AS query_text, a.answer, a.confidence AS confidence_level,
  coalesce((SELECT string_agg(document_number, ',' ORDER BY seq) FROM all_citations c WHERE c.query_id = q.query_id), '') AS cited_document_ids,
  (SELECT string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) FROM answer_context c WHERE c.query_id = q.query_id) AS retrieved_chunk_ids, 'answer-v1' AS model_version, '{NOW}' AS created_at
FROM conversation_queries q JOIN parsed_answers a ON a.query_id = q.query_id""",
)


def question_log(src: Source):
    return I.qa_log(src.asked_questions, I.parse_answers(src.answers), citations(src), context(src), now(), "answer-v1")


@query("qa_log", "SELECT * FROM question_log")
def qa_log(src: Source):
    return question_log(src).select(
        "query_id", "query_text", "answer", "confidence_level",
        F.array_join("cited_document_ids", ",").alias("cited_document_ids"),
        F.array_join(F.col("retrieved_chunk_ids").cast("array<string>"), ",").alias("retrieved_chunk_ids"),
        "model_version", time_text("created_at").alias("created_at"),
    )


@query(
    "audit_events",
    f"""SELECT 'ocr' AS event_type, 'document' AS entity_type, document_id AS entity_id, CAST(NULL AS VARCHAR) AS file_hash, 'ocr-v1' AS model_version, round(avg(confidence), 9) AS confidence_score,
  '{{"page":' || page || ',"block_count":' || count(*) || ',"low_confidence_count":' || count(*) FILTER (confidence < 0.75e0) || '}}' AS metadata FROM ocr_blocks GROUP BY document_id, page
UNION ALL SELECT 'parse', 'document', document_id, NULL, 'deterministic-v1', NULL, '{{"parser_type":"deterministic","success":true,"extracted_fields":["' || concat_ws('","', CASE WHEN document_number IS NOT NULL THEN 'document_number' END, CASE WHEN issue_status IS NOT NULL THEN 'issue_status' END) || '"]}}' FROM parsed
UNION ALL SELECT 'validate', 'document', j.document_id, d.file_hash, '{MODEL}', NULL, '{{"passed":' || j.passed || ',"rules_evaluated":' || j.rules_evaluated || ',"rules_failed":' || j.rules_failed || ',"rejection_note":null}}' FROM judgements j JOIN ref_documents d ON d.id = j.document_id
UNION ALL SELECT 'qa', 'query', NULL, NULL, NULL, NULL, '{{"confidence_level":"' || confidence_level || '","cited":"' || cited_document_ids || '","model_version":"answer-v1","question":"' || coalesce(sha256(query_text), '') || '","answer":"' || coalesce(sha256(answer), '') || '"}}' FROM question_log""",
)
def audit_events(src: Source):
    pages = src.ocr_blocks.groupBy(F.col("document_id").alias("entity_id"), "page").agg(
        F.avg("confidence").alias("avg_confidence"),
        F.count(F.lit(1)).alias("block_count"),
        F.count_if(F.col("confidence") < 0.75).alias("low_confidence_count"),
    ).withColumn("model_version", F.lit("ocr-v1"))
    names = F.array(*[F.when(F.col(c).isNotNull(), c) for c in ("document_number", "issue_status")])
    parsed = P.parse_documents(drawings(src)).select(
        F.col("document_id").alias("entity_id"), F.lit("deterministic-v1").alias("model_version"),
        F.lit("deterministic").alias("parser_type"), F.lit(True).alias("success"),
        F.array_compact(names).alias("extracted_fields"),
    )
    hashes = src.ref_documents.select(F.col("id").alias("document_id"), "file_hash")
    judged = validated(src).join(hashes, "document_id").select(
        F.col("document_id").alias("entity_id"), "file_hash", F.lit(MODEL).alias("model_version"), "passed",
        "rules_evaluated", "rules_failed", F.lit(None).cast("string").alias("rejection_note"),
    )
    events = audit.audit_events(pages, parsed, judged, question_log(src), now())
    text_hash = lambda path: F.coalesce(F.sha2(F.get_json_object("metadata", path), 256), F.lit(""))
    short = F.to_json(
        F.struct(
            F.get_json_object("metadata", "$.confidence_level").alias("confidence_level"),
            F.array_join(F.from_json(F.get_json_object("metadata", "$.cited_document_ids"), "array<string>"), ",").alias("cited"),
            F.get_json_object("metadata", "$.model_version").alias("model_version"),
            text_hash("$.query_text").alias("question"),
            text_hash("$.answer").alias("answer"),
        )
    )
    # questions and answers are compared by hash: JSON escapes differ between engines
    return events.withColumn("metadata", F.when(F.col("event_type") == "qa", short).otherwise(F.col("metadata"))).select(
        "event_type", "entity_type", "entity_id", "file_hash", "model_version",
        F.round("confidence_score", 9).alias("confidence_score"), "metadata",
    )
