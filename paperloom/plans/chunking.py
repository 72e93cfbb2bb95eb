"""Queries on chunking. The test texts separate their sections by single line breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.constants import CHUNK_LIMITS
from paperloom.functions.scale import spread
from paperloom.functions.text import estimate_tokens, overlap_tail, split_sections
from paperloom.operators import chunking as C
from paperloom.operators.admission import audit_lengths
from paperloom.plans.registry import query, shared_sql
from paperloom.sources.views import Source

_BLANKS = r"' ' || chr(9) || chr(10) || chr(13)"


def texts(src: Source):
    return spread(src.documents.select(F.col("doc_id").alias("document_id"), "text"), "document_id")


def _sections_sql(source: str, keys: str, text: str, sep: str) -> str:
    return f"""
SELECT {keys}, s AS section, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS n, len(string_split_regex(s, '\\s+')) AS w
FROM (SELECT {keys}, trim(p, {_BLANKS}) AS s, i FROM (SELECT {keys}, unnest(parts) AS p, generate_subscripts(parts, 1) AS i
  FROM (SELECT {keys}, string_split({text}, {sep}) AS parts FROM {source}))) WHERE s <> ''"""


def _pack_sql(name: str, source: str, keys: str, size: int, overlap: int) -> tuple[str, str]:
    """A recursive walk over the sections; ``closed`` is the chunk that the step finished."""
    columns = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"s.{k} = p.{k}" for k in columns)
    p_keys, s_keys = ", ".join(f"p.{k}" for k in columns), ", ".join(f"s.{k}" for k in columns)
    head = f"{name}({keys}, n, held, tokens, closed, closed_tokens)"
    full = f"p.tokens + CAST(floor(s.w * 1.3e0) AS INT) > {size}"
    words = "string_split_regex(p.held, '\\s+')"
    tail = f"CASE WHEN len({words}) <= {overlap} THEN p.held ELSE array_to_string(list_slice({words}, len({words}) - {overlap} + 1, len({words})), ' ') END"
    body = f"""
SELECT {s_keys}, s.n, s.section, CAST(floor(s.w * 1.3e0) AS INT), CAST(NULL AS VARCHAR), CAST(NULL AS INT) FROM {source} s WHERE s.n = 1
UNION ALL
SELECT {p_keys}, s.n,
  CASE WHEN {full} THEN {tail} || chr(10) || chr(10) || s.section ELSE p.held || chr(10) || chr(10) || s.section END,
  CASE WHEN {full} THEN CAST(floor((least(len({words}), {overlap}) + s.w) * 1.3e0) AS INT) ELSE p.tokens + CAST(floor(s.w * 1.3e0) AS INT) END,
  CASE WHEN {full} THEN p.held END, CASE WHEN {full} THEN p.tokens END
FROM {name} p JOIN {source} s ON {same} AND s.n = p.n + 1"""
    return head, body


def _chunks_sql(walk: str, keys: str) -> str:
    return f"""
SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY n) - 1 AS INT) AS chunk_index, content, token_count FROM (
  SELECT {keys}, n, closed AS content, closed_tokens AS token_count FROM {walk} WHERE closed IS NOT NULL
  UNION ALL
  SELECT {keys}, n + 1, held, tokens FROM {walk} QUALIFY n = max(n) OVER (PARTITION BY {keys}))"""


shared_sql("doc_texts", "SELECT doc_id AS document_id, text FROM documents")
shared_sql("doc_sections", _sections_sql("doc_texts", "document_id", "text", "chr(10)"))
shared_sql(*_pack_sql("parent_walk", "doc_sections", "document_id", 1024, 128))
shared_sql("parents", _chunks_sql("parent_walk", "document_id"))
shared_sql("parent_texts", "SELECT document_id, chunk_index AS parent_index, content FROM parents")
shared_sql(
    "parent_sections", _sections_sql("parent_texts", "document_id, parent_index", "content", "chr(10) || chr(10)")
)
shared_sql(*_pack_sql("child_walk", "parent_sections", "document_id, parent_index", 256, 32))
shared_sql("children", _chunks_sql("child_walk", "document_id, parent_index"))
shared_sql(
    "chunks",
    """SELECT CAST(document_id AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR) AS chunk_id, document_id, CAST(NULL AS VARCHAR) AS parent_id, 'parent' AS level, chunk_index, content, token_count FROM parents
UNION ALL SELECT CAST(document_id AS VARCHAR) || ':' || CAST(parent_index AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR), document_id,
  CAST(document_id AS VARCHAR) || ':' || CAST(parent_index AS VARCHAR), 'child', chunk_index, content, token_count FROM children""",
)


@query("split_sections", "SELECT document_id, CAST(n - 1 AS INT) AS pos, section FROM doc_sections")
def split_sections_query(src: Source):
    return texts(src).select("document_id", F.posexplode(split_sections(F.col("text"), "\n")).alias("pos", "section"))


@query(
    "estimate_tokens",
    f"""SELECT document_id, CASE WHEN trim(text, {_BLANKS}) = '' THEN CAST(0 AS INT)
  ELSE CAST(floor(len(string_split_regex(trim(text, {_BLANKS}), '\\s+')) * 1.3e0) AS INT) END AS tokens FROM doc_texts""",
)
def estimate_tokens_query(src: Source):
    return texts(src).select("document_id", estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "overlap_tail",
    f"""SELECT document_id, CASE WHEN len(w) <= 128 THEN text ELSE array_to_string(list_slice(w, len(w) - 127, len(w)), ' ') END AS tail
FROM (SELECT document_id, text, string_split_regex(trim(text, {_BLANKS}), '\\s+') AS w FROM doc_texts)""",
)
def overlap_tail_query(src: Source):
    return texts(src).select("document_id", overlap_tail(F.col("text"), 128).alias("tail"))


@query("parent_chunks", "SELECT document_id, chunk_index, content, token_count FROM parents")
def parent_chunks(src: Source):
    return C.parent_chunks(texts(src), sep="\n")


@query("child_chunks", "SELECT document_id, parent_index, chunk_index, content, token_count FROM children")
def child_chunks(src: Source):
    return C.child_chunks(C.parent_chunks(texts(src), sep="\n"))


@query("link_parents", "SELECT chunk_id, parent_id, level FROM chunks")
def link_parents(src: Source):
    parents = C.parent_chunks(texts(src), sep="\n")
    return C.link_parents(parents, C.child_chunks(parents)).select("chunk_id", "parent_id", "level")


def corpus_chunks(src: Source):
    return C.chunk_corpus(texts(src), sep="\n")


@query(
    "chunk_corpus",
    """SELECT chunk_id, document_id, parent_id, level, chunk_index, sha256(content) AS content_hash, token_count FROM chunks""",
)
def chunk_corpus(src: Source):
    return corpus_chunks(src).select(
        "chunk_id", "document_id", "parent_id", "level", "chunk_index", F.sha2("content", 256).alias("content_hash"),
        "token_count",
    )


@query(
    "chunk_counts",
    """SELECT document_id, count(*) FILTER (level = 'parent') AS parents, count(*) FILTER (level = 'child') AS children FROM chunks GROUP BY document_id""",
)
def chunk_counts(src: Source):
    return C.chunk_counts(corpus_chunks(src))


@query(
    "audit_chunk_lengths",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {f'count(*) FILTER (length({c}) > {n})' if n else 'CAST(0 AS BIGINT)'} AS too_long, "
        f"count(*) FILTER ({c} IS NULL) AS nulls FROM chunks"
        for c, (n, _) in CHUNK_LIMITS.items()
    ),
)
def audit_chunk_lengths(src: Source):
    return audit_lengths(corpus_chunks(src), CHUNK_LIMITS)
