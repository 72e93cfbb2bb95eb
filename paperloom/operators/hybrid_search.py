"""Fusion of vector and text hits, parent expansion, and flat results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.constants import SEARCH_LIMIT, TEXT_WEIGHT, VECTOR_WEIGHT
from paperloom.functions.scale import broadcast_if_small
from paperloom.operators.text_search import text_topk
from paperloom.operators.vector_search import metadata_filters, rank_hits, vector_topk


def hybrid_fuse(
    vector_hits: DataFrame,
    text_hits: DataFrame,
    limit: int = SEARCH_LIMIT,
    vector_weight: float = VECTOR_WEIGHT,
    text_weight: float = TEXT_WEIGHT,
) -> DataFrame:
    """Weighted sum of both scores, a missing one counting 0: query_id, chunk_id, score, search_type, rank."""
    left = vector_hits.select("query_id", "chunk_id", F.col("score").alias("v"))
    right = text_hits.select("query_id", "chunk_id", F.col("score").alias("t"))
    joined = left.join(right, ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce("v", F.lit(0.0)) * vector_weight + F.coalesce("t", F.lit(0.0)) * text_weight
    fused = joined.select(
        "query_id", "chunk_id", F.round(score, 12).alias("score"), F.lit("hybrid").alias("search_type")
    )
    return rank_hits(fused, limit)


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    index: DataFrame,
    statistics: DataFrame,
    dim: int,
    limit: int = SEARCH_LIMIT,
    discipline: str | None = None,
    document_ids: DataFrame | None = None,
    frequency: DataFrame | None = None,
    candidates: int | None = None,
    bitmap: DataFrame | None = None,
) -> DataFrame:
    """Both branches, then fusion of their ``candidates`` best hits each, 2 x limit unless given.

    queries: query_id, query, embedding. chunks: chunk_id, document_id, level, embedding. Both branches return chunks of
    existing documents that pass the filters only; terms are weighted over the whole index. With a ``bitmap`` of those documents,
    vectors and matches are tested where they are.
    """
    candidates = candidates or 2 * limit
    vector_hits = vector_topk(queries, chunks, documents, candidates, dim, discipline, document_ids, bitmap=bitmap)
    # the filters meet what has matched: neither vectors nor the index are shuffled for them
    allowed = metadata_filters(chunks.drop("embedding"), documents, discipline, document_ids, bitmap)
    text_hits = text_topk(queries, index, statistics, candidates, frequency, allowed=allowed)
    return hybrid_fuse(vector_hits, text_hits, limit)


def expand_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits followed by their parents, each parent once per query and with the score of its best child.

    Adds ``place``: 0 for the hit itself, 1 for its parent.
    """
    links = chunks.where(F.col("parent_id").isNotNull()).select("chunk_id", "parent_id")
    with_parent = links.join(broadcast_if_small(hits), "chunk_id")
    first = Window.partitionBy("query_id", "parent_id").orderBy("rank")
    parents = (
        with_parent.withColumn("n", F.row_number().over(first))
        .where(F.col("n") == 1)
        .select(
            "query_id",
            F.col("parent_id").alias("chunk_id"),
            "score",
            F.lit("parent_expansion").alias("search_type"),
            "rank",
            F.lit(1).alias("place"),
        )
    )
    own = hits.select("query_id", "chunk_id", "score", "search_type", "rank", F.lit(0).alias("place"))
    return own.unionByName(parents)


def flatten_hits(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their text and document fields; ``total`` counts the hits of the query.

    Texts are fetched for the hits only: nothing wide went through the ranking.
    """
    small = broadcast_if_small(hits.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("query_id"))))
    content = chunks.select("chunk_id", "document_id", "content").join(small, "chunk_id")
    fields = documents.select(F.col("id").alias("document_id"), "document_number", "title", "discipline")
    return content.join(fields, "document_id")
