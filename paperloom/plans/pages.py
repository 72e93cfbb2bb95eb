"""Queries on the pages of chunks: texts assembled from pages, chunked, searched, and cited by page.

Three lines of a test text stand on a page.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from paperloom.constants import ASK_LIMIT
from paperloom.functions.scale import spread
from paperloom.operators import answers as I
from paperloom.operators import assembly as B
from paperloom.operators import chunking as C
from paperloom.operators import hybrid_search as H
from paperloom.operators import text_search as T
from paperloom.plans.answers import _AFTER, _BEFORE, _MIDDLE
from paperloom.plans.chunking import _chunks_sql, _pack_sql, _sections_sql
from paperloom.plans.registry import SHARED_SQL, query, shared_sql
from paperloom.session import stored
from paperloom.sources.views import Source

LINES_PER_PAGE = 3

shared_sql(
    "page_texts",
    f"""SELECT document_id, string_agg(part, chr(10) ORDER BY page) AS text FROM (
  SELECT document_id, page, chr(10) || '[Page ' || page || ']' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS part FROM (
    SELECT doc_id AS document_id, i, (i - 1) // {LINES_PER_PAGE} + 1 AS page, line FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))) WHERE line <> '' GROUP BY document_id, page) GROUP BY document_id""",
)
shared_sql("page_sections", _sections_sql("page_texts", "document_id", "text", "chr(10)"))
shared_sql(*_pack_sql("page_walk", "page_sections", "document_id", 1024, 128))


def _pages_sql(chunks: str, keys: str, overlap: int, before: str) -> str:
    """The page of a chunk: its marker in front, else what the chunks before it left, else ``before``, else its first marker."""
    words = "string_split_regex(content, '\\s+')"
    tail = f"CASE WHEN len({words}) <= {overlap} THEN content ELSE array_to_string(list_slice({words}, len({words}) - {overlap} + 1, len({words})), ' ') END"
    marks = lambda text: f"list_transform(regexp_extract_all({text}, '(?i)\\[Page\\s+(\\d+)\\]', 1), lambda n: CAST(n AS INT))"
    return f"""
SELECT * EXCLUDE (markers, left_page), list_sort(list_distinct(list_filter(list_append(markers, page), lambda p: p IS NOT NULL))) AS pages FROM (
  SELECT *, CASE WHEN regexp_matches(content, '(?i)^\\[Page\\s+\\d+\\]') THEN markers[1]
    ELSE coalesce(last_value(left_page IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {before}, markers[1]) END AS page
  FROM (SELECT *, CASE WHEN len(markers) > len({marks(tail)}) THEN markers[len(markers) - len({marks(tail)})] END AS left_page
    FROM (SELECT *, {marks('content')} AS markers FROM {chunks})))"""


shared_sql("page_packed", _chunks_sql("page_walk", "document_id"))
shared_sql("page_parents", _pages_sql("page_packed", "document_id", 128, "CAST(NULL AS INT)"))
shared_sql(
    "page_parent_texts", "SELECT document_id, chunk_index AS parent_index, content FROM page_parents"
)
shared_sql(
    "page_parent_sections",
    _sections_sql("page_parent_texts", "document_id, parent_index", "content", "chr(10) || chr(10)"),
)
shared_sql(*_pack_sql("page_child_walk", "page_parent_sections", "document_id, parent_index", 256, 32))
shared_sql("page_child_packed", _chunks_sql("page_child_walk", "document_id, parent_index"))
shared_sql(
    "page_child_started",
    "SELECT c.*, p.page AS start FROM page_child_packed c JOIN page_parents p ON p.document_id = c.document_id AND p.chunk_index = c.parent_index",
)
shared_sql("page_children", _pages_sql("page_child_started", "document_id, parent_index", 32, "start"))
shared_sql(
    "paged_chunks",
    """SELECT CAST(document_id AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR) AS chunk_id, document_id, CAST(NULL AS VARCHAR) AS parent_id, 'parent' AS level, chunk_index, content, page, pages FROM page_parents
UNION ALL SELECT CAST(document_id AS VARCHAR) || ':' || CAST(parent_index AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR), document_id,
  CAST(document_id AS VARCHAR) || ':' || CAST(parent_index AS VARCHAR), 'child', chunk_index, content, page, pages FROM page_children""",
)

# the SQL of text search once more, over these chunks
_SEARCH = ["child_texts", "text_index", "text_stats", "term_frequency", "text_matches", "text_scores", "chunks"]
for _name in _SEARCH[:-1]:
    shared_sql(f"paged_{_name}", re.sub(rf"\b(?={'|'.join(rf'{n}\b' for n in _SEARCH)})", "paged_", SHARED_SQL[_name]))
shared_sql(
    "paged_hits",
    f"""SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM paged_text_scores QUALIFY rank <= {ASK_LIMIT}""",
)
shared_sql(
    "paged_expanded",
    """SELECT query_id, chunk_id, rank, 0 AS place FROM paged_hits
UNION ALL SELECT h.query_id, c.parent_id, h.rank, 1 FROM paged_hits h JOIN paged_child_texts c ON c.chunk_id = h.chunk_id
QUALIFY row_number() OVER (PARTITION BY h.query_id, c.parent_id ORDER BY h.rank) = 1""",
)
shared_sql(
    "paged_context",
    """SELECT h.query_id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank, h.place) AS n, d.document_number, d.title, c.page, c.content
FROM paged_expanded h JOIN paged_chunks c ON c.chunk_id = h.chunk_id JOIN corpus_documents d ON d.id = c.document_id""",
)


def paged_texts(src: Source):
    """Lines of the test texts as elements of pages, put together again with their page headers."""
    lines = src.documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return B.assemble_pages(
        lines.select(
            "document_id", F.expr(f"ord div {LINES_PER_PAGE} + 1").cast("int").alias("page"), "ord",
            F.lit("text").alias("kind"), F.lit(None).cast("string").alias("name"), "text",
            F.lit(None).cast("array<array<string>>").alias("cells"),
        )
    ).select("document_id", "text")


def paged_chunks(src: Source):
    # few partitions come out of the grouping of a small corpus, and chunking is the work here
    return C.chunk_corpus(spread(stored(paged_texts(src), "texts"), "document_id"), sep="\n", pages=True)


@query("chunk_pages", "SELECT chunk_id, sha256(content) AS content_hash, page, array_to_string(pages, ',') AS pages FROM paged_chunks")
def chunk_pages(src: Source):
    return paged_chunks(src).select(
        "chunk_id", F.sha2("content", 256).alias("content_hash"), "page",
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
    )


def paged_context(src: Source):
    chunks = stored(paged_chunks(src), "chunks")
    index = stored(T.build_text_index(chunks), "index")
    hits = stored(T.text_topk(src.text_queries, index, T.text_statistics(chunks), ASK_LIMIT), "hits")
    expanded = stored(H.expand_parents(hits.withColumn("search_type", F.lit("text")), chunks), "expanded")
    return I.context_chunks(expanded, chunks, src.corpus_documents)


@query(
    "assemble_context_paged",
    f"""SELECT x.query_id, '{_BEFORE}' || x.context || '{_MIDDLE}' || q.query || '{_AFTER}' AS prompt, x.n_chunks FROM (
  SELECT query_id, string_agg('[' || n || '] Document: ' || document_number || ' - ' || title || ' (Page/Sheet: ' || coalesce(CAST(page AS VARCHAR), 'N/A') || ')' || chr(10) || content || chr(10), chr(10) ORDER BY n) AS context,
    CAST(count(*) AS INT) AS n_chunks FROM paged_context GROUP BY query_id) x JOIN text_queries q ON q.query_id = x.query_id""",
)
def assemble_context_paged(src: Source):
    return I.assemble_context(paged_context(src), src.text_queries).select("query_id", "prompt", "n_chunks")


@query(
    "context_citations_paged",
    """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first_n) - 1 AS INT) AS seq, document_number, title, coalesce('Sheet ' || page, 'N/A') AS page_or_sheet FROM (
  SELECT query_id, document_number, n AS first_n, title, page FROM paged_context QUALIFY row_number() OVER (PARTITION BY query_id, document_number ORDER BY n) = 1) QUALIFY seq < 5""",
)
def context_citations_paged(src: Source):
    return I.context_citations(paged_context(src))
