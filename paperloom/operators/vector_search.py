"""Nearest chunks for a batch of query vectors, exact or over coarse lists.

Pairs of query and chunk are never written out. Each task multiplies its Arrow batches with the query matrix and keeps
the best ``k`` per query, so a task hands at most queries x k rows to the final ranking.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from paperloom.constants import CHILD, VECTOR_LISTS
from paperloom.functions.bitmaps import bitmap_of, common, in_bitmap
from paperloom.functions.scale import broadcast_if_small, salt_of
from paperloom.session import stored

# Queries that may be sent to every task: 4096 vectors of 384 doubles are 12 MB.
MAX_SENT_QUERIES = 4096
BLOCK_CHUNKS = 20_000
_ROUND = 12  # equal vectors must tie whatever the order of summation
_CELLS = 4_000_000
# Rows with a vector that a task makes or multiplies at once: 1 MB of 64 floats, or 6 MB of 384.
_ROWS = 4096


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


class _Best:
    """The k best (score, id) per query seen so far; equal scores go to the smaller id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.kept: list[list] = [[] for _ in range(n_queries)]
        self.floor = np.full(n_queries, -np.inf)

    def add(self, ids: np.ndarray, chunks: np.ndarray, queries: np.ndarray, which: np.ndarray) -> None:
        step = max(1, _CELLS // max(1, len(which)))
        for start in range(0, len(ids), step):
            part_ids = ids[start : start + step]
            scores = chunks[start : start + step] @ queries[which].T
            np.round(scores, _ROUND, out=scores)
            floor = self.floor[which]
            if len(scores) > self.k:
                floor = np.fmax(floor, np.partition(scores, -self.k, axis=0)[-self.k])
            hopeful = scores >= floor
            for column in np.flatnonzero(hopeful.any(axis=0)):
                rows = np.flatnonzero(hopeful[:, column])
                q = which[column]
                found = list(zip(-scores[rows, column], part_ids[rows]))
                self.kept[q] = heapq.nsmallest(self.k, self.kept[q] + found)
                if len(self.kept[q]) == self.k:
                    self.floor[q] = -self.kept[q][-1][0]

    def rows(self) -> list[tuple]:
        return [(q, chunk_id, -negative) for q, kept in enumerate(self.kept) for negative, chunk_id in kept]


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows; they must all be there and of one length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or len(np.unique(lengths)) > 1:
        raise ValueError("vectors of one length are wanted")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _hits_table(best: _Best, query_ids: list, query_type: pa.DataType, chunk_type: pa.DataType) -> pa.Table:
    found = best.rows()
    return pa.table(
        {
            "query_id": pa.array([query_ids[q] for q, _, _ in found], query_type),
            "chunk_id": pa.array([c for _, c, _ in found], chunk_type),
            "score": pa.array([float(s) for _, _, s in found], pa.float64()),
        }
    )


def usable_chunks(chunks: DataFrame, dim: int) -> DataFrame:
    """Children that have a vector of the right length."""
    return chunks.where((F.col("level") == CHILD) & (F.size("embedding") == dim))


def metadata_filters(
    chunks: DataFrame,
    documents: DataFrame | None,
    discipline: str | None = None,
    document_ids: DataFrame | None = None,
    bitmap: DataFrame | None = None,
) -> DataFrame:
    """Chunks whose document exists and passes the filters; without a filter every document does.

    A ``bitmap`` of the documents that pass (see ``document_bitmap``) stands for documents and filters. A chunk table that carries ``discipline`` itself is filtered in its scan. With it, or without ``documents`` (chunks
    known to be free of orphans), vectors are not shuffled to meet their documents.
    """
    if bitmap is not None:
        return in_bitmap(chunks, "document_id", bitmap)
    allowed = None
    if "discipline" in chunks.columns or documents is None:
        if discipline:
            chunks = chunks.where(F.col("discipline") == discipline)
    else:
        kept = documents.where(F.col("discipline") == discipline) if discipline else documents
        allowed = kept.select(F.col("id").alias("document_id"))
    if document_ids is not None:
        wanted = broadcast_if_small(document_ids.select(F.col("id").alias("document_id")).distinct())
        allowed = wanted if allowed is None else allowed.join(wanted, "document_id", "left_semi")
    return chunks if allowed is None else chunks.join(allowed, "document_id", "left_semi")


def document_bitmap(by_discipline: DataFrame, discipline: str | None = None, document_ids: DataFrame | None = None) -> DataFrame:
    """The documents that pass the filters, from the bitmaps of each discipline (``bitmap_of(documents, "id", "discipline")``)."""
    chosen = by_discipline.where(F.col("discipline") == discipline) if discipline else by_discipline
    known = chosen.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return known if document_ids is None else common(known, bitmap_of(document_ids, "id"))


def rank_hits(scored: DataFrame, k: int) -> DataFrame:
    """The k best per query with their rank; equal scores are ordered by chunk."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _score_sent(
    chunks: DataFrame, query_ids: list, kind: DataType, queries: np.ndarray, k: int, lists_of: np.ndarray | None = None
) -> DataFrame:
    """Scores with the query matrix sent to every task. ``lists_of[q]`` are the lists that query q looks into."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast((query_ids, queries, lists_of))
    schema = f"query_id {kind.simpleString()}, chunk_id {dict(chunks.dtypes)['chunk_id']}, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of_queries, q_matrix, probed = sent.value
        query_arrow = to_arrow_type(kind)
        chunk_arrow = None
        best = _Best(len(ids_of_queries), k)
        everyone = np.arange(len(ids_of_queries))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            chunk_arrow = batch.schema.field(0).type
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = _unit(_matrix(batch.column(1)))
            if probed is None:
                best.add(ids, vectors, q_matrix, everyone)
            else:
                lists = batch.column(2).to_numpy(zero_copy_only=False)
                for number in np.unique(lists):
                    which = np.flatnonzero((probed == number).any(axis=1))
                    if len(which):
                        rows = lists == number
                        best.add(ids[rows], vectors[rows], q_matrix, which)
        if chunk_arrow is not None:
            yield from _hits_table(best, ids_of_queries, query_arrow, chunk_arrow).to_batches()

    columns = ["chunk_id", "embedding"] + ([] if lists_of is None else ["list_id"])
    return chunks.select(*columns).mapInArrow(score, schema)


def _score_blocks(queries: DataFrame, chunks: DataFrame, k: int, block_queries: int, block_chunks: int) -> DataFrame:
    """Scores for more queries than can be sent around. Both sides carry ``list_id``.

    Within a list, queries and chunks are cut into blocks of bounded size by a hash of their ids, and one group holds
    one block of each. A hot list becomes many blocks. Block counts come from the per-list counts, whose number is
    bounded by the number of lists.
    """
    n_chunks = {r["list_id"]: r["count"] for r in chunks.groupBy("list_id").count().collect()}
    n_queries = {r["list_id"]: r["count"] for r in queries.groupBy("list_id").count().collect()}
    shared = sorted(set(n_chunks) & set(n_queries))
    if not shared:
        none = queries.where(F.lit(False)).select("query_id", "list_id")
        return none.join(chunks, "list_id").select("query_id", "chunk_id", F.lit(0.0).alias("score"))
    c_blocks = F.create_map(*[F.lit(x) for n in shared for x in (n, ceil(n_chunks[n] / block_chunks))])
    q_blocks = F.create_map(*[F.lit(x) for n in shared for x in (n, ceil(n_queries[n] / block_queries))])

    def blocks(df: DataFrame, own: str, own_map, other: str, other_map, key: str) -> DataFrame:
        known = df.where(F.col("list_id").isin(shared))
        mine = F.pmod(F.xxhash64(key), F.try_element_at(own_map, F.col("list_id"))).cast("int")
        theirs = F.sequence(F.lit(0), F.try_element_at(other_map, F.col("list_id")) - 1)
        return known.withColumn(own, mine).withColumn(other, F.explode(theirs))

    left = blocks(queries, "qb", q_blocks, "cb", c_blocks, "query_id")
    right = blocks(chunks.select("chunk_id", "embedding", "list_id"), "cb", c_blocks, "qb", q_blocks, "chunk_id")
    types = dict(queries.dtypes) | dict(chunks.dtypes)
    schema = f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, score double"

    def score(q: pa.Table, c: pa.Table) -> pa.Table:
        best = _Best(q.num_rows, k)
        if q.num_rows and c.num_rows:
            asked = _unit(_matrix(q.column("embedding").combine_chunks()))
            for part in c.select(["chunk_id", "embedding"]).to_batches(max_chunksize=_ROWS):
                best.add(part.column(0).to_numpy(zero_copy_only=False), _unit(_matrix(part.column(1))), asked, np.arange(q.num_rows))
        return _hits_table(best, q.column("query_id").to_pylist(), q.schema.field("query_id").type, c.schema.field("chunk_id").type)

    keys = ["list_id", "qb", "cb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


def _no_hits(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    query_id = F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id")
    return chunks.select(query_id, "chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))


def _taken(queries: DataFrame, limit: int) -> list | None:
    """The queries, if there are at most ``limit`` of them."""
    rows = queries.select("query_id", "embedding").limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def vector_topk(
    queries: DataFrame,
    chunks: DataFrame,
    documents: DataFrame | None,
    k: int,
    dim: int,
    discipline: str | None = None,
    document_ids: DataFrame | None = None,
    max_sent: int = MAX_SENT_QUERIES,
    block_chunks: int = BLOCK_CHUNKS,
    bitmap: DataFrame | None = None,
) -> DataFrame:
    """Exact search over children by cosine similarity: query_id, chunk_id, score, rank.

    queries: query_id, embedding. chunks: chunk_id, document_id, level, embedding. Filters apply before the cut.
    """
    allowed = metadata_filters(usable_chunks(chunks, dim), documents, discipline, document_ids, bitmap)
    rows = _taken(queries.where(F.size("embedding") == dim), max_sent)
    if rows == []:
        return _no_hits(queries, allowed)
    if rows is None:
        listed = queries.where(F.size("embedding") == dim).withColumn("list_id", F.lit(0))
        scored = _score_blocks(listed, allowed.withColumn("list_id", F.lit(0)), k, max_sent, block_chunks)
    else:
        matrix = _unit(np.array([r["embedding"] for r in rows], dtype=np.float64))
        scored = _score_sent(allowed, [r["query_id"] for r in rows], queries.schema["query_id"].dataType, matrix, k)
    return rank_hits(scored.where(~F.isnan("score")), k)


def train_lists(vectors: DataFrame, lists: int = VECTOR_LISTS, seed: int = 42) -> np.ndarray:
    """Unit centres of the coarse lists, by k-means with cosine distance over all vectors."""
    features = vectors.select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=10, initSteps=2).fit(features)
    return _unit(np.array(model.clusterCenters(), dtype=np.float64))


def with_list(batch: pa.RecordBatch, centres: np.ndarray) -> pa.RecordBatch:
    """The batch with list_id, the nearest centre of each vector."""
    vectors = _unit(_matrix(batch.column("embedding")))
    numbers = np.argmax(np.nan_to_num(vectors @ centres.T, nan=-2.0), axis=1).astype(np.int32)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], [*batch.schema.names, "list_id"])


def assign_lists(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds list_id, the nearest centre, to the chunks that have a vector of the centres' length; others are left out.

    Written partitioned by list_id, a search reads the probed lists only.
    """
    chunks = chunks.where(F.size("embedding") == centres.shape[1])
    sent = chunks.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_list(batch, sent.value)

    columns = ", ".join(f"{name} {kind}" for name, kind in chunks.dtypes)
    return chunks.mapInArrow(nearest, f"{columns}, list_id int")


def write_lists(listed: DataFrame, path: str, salts: int = 16) -> None:
    """Lay the chunks out by list, so that a search reads the probed lists only. A hot list is written by many tasks."""
    spread_out = listed.repartition(F.col("list_id"), salt_of(F.col("chunk_id"), salts=salts))
    spread_out.write.partitionBy("list_id").parquet(path)


def nearest_lists(matrix: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes]


def vector_topk_lists(
    queries: DataFrame,
    listed: DataFrame,
    documents: DataFrame | None,
    centres: np.ndarray,
    k: int,
    dim: int,
    probes: int = 10,
    discipline: str | None = None,
    document_ids: DataFrame | None = None,
    max_sent: int = MAX_SENT_QUERIES,
    block_chunks: int = BLOCK_CHUNKS,
    reach: np.ndarray | None = None,
) -> DataFrame:
    """Search over lists: each query looks into its ``probes`` nearest lists of the chunks from ``assign_lists``.

    With the ``reach`` of the lists, a second pass looks into every other list that can still hold one of the k best, and
    the hits are those of :func:`vector_topk`. Without it they are approximate: what lies in other lists is not found.
    """
    allowed = metadata_filters(usable_chunks(listed, dim), documents, discipline, document_ids)
    right = queries.where(F.size("embedding") == dim)
    rows = _taken(right, max_sent)
    if rows == []:
        return _no_hits(queries, allowed)
    if rows is None:
        spread = assign_probes(right, centres, probes)
        scored = _score_blocks(spread, allowed, k, max_sent, block_chunks)
    else:
        ids, kind = [r["query_id"] for r in rows], queries.schema["query_id"].dataType
        matrix = _unit(np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(rows), dim))
        probed = nearest_lists(matrix, centres, probes)
        scored = _score_sent(_of_lists(allowed, probed), ids, kind, matrix, k, probed)
    hits = rank_hits(scored.where(~F.isnan("score")), k)
    if reach is None or probes >= len(centres):
        return hits
    hits = stored(hits, "probed-hits")
    floors = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    if rows is None:
        spread = assign_probes(right.join(floors, "query_id", "left"), centres, probes, reach)
        more = _score_blocks(stored(spread, "further-probes"), allowed, k, max_sent, block_chunks)
    else:
        known = {r["query_id"]: r["floor"] for r in floors.collect()}
        further = further_lists(matrix, centres, probes, reach, np.array([known.get(q, -np.inf) for q in ids]))
        if not further.any():
            return hits
        # lists that a query does not look into are numbered -1
        wanted = np.where(further, np.arange(len(centres)), -1)
        more = _score_sent(_of_lists(allowed, wanted), ids, kind, matrix, k, wanted)
    return rank_hits(hits.drop("rank").union(more.where(~F.isnan("score"))), k)


def _of_lists(chunks: DataFrame, numbers: np.ndarray) -> DataFrame:
    return chunks.where(F.col("list_id").isin(np.unique(numbers).tolist()))


def list_reach(listed: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Per list the largest angle between its centre and a vector in it; below zero for a list without any.

    One pass over the lists, made once for a layout. Filters leave out vectors only, so that it bounds filtered searches too.
    """
    sent = listed.sparkSession.sparkContext.broadcast(centres)

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(sent.value), np.inf)
        for batch in batches:
            if batch.num_rows:
                numbers = batch.column(1).to_numpy(zero_copy_only=False)
                near = (_unit(_matrix(batch.column(0))) * sent.value[numbers]).sum(axis=1)
                np.fmin.at(least, numbers, near)
        some = np.flatnonzero(np.isfinite(least))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(least[some])], ["list_id", "near"])

    right = listed.where(F.size("embedding") == centres.shape[1]).select("embedding", "list_id")
    reach = np.full(len(centres), -1.0)
    for r in right.mapInArrow(farthest, "list_id int, near double").groupBy("list_id").agg(F.min("near").alias("near")).collect():
        reach[r["list_id"]] = np.arccos(np.clip(r["near"], -1.0, 1.0))
    return reach


def further_lists(matrix: np.ndarray, centres: np.ndarray, probes: int, reach: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """For each query and list: whether the list is not probed and can hold a vector as good as the query's floor.

    No vector is nearer to the query than the angle to its list's centre less the list's reach.
    """
    near = np.arccos(np.clip(matrix @ centres.T, -1.0, 1.0)) - reach
    best = np.where(near > 0, np.cos(np.maximum(near, 0.0)), 1.0)
    # as much as rounding can move an angle near zero, and equal scores count
    able = (reach >= 0) & ~(best < floors[:, None] - 1e-6)
    np.put_along_axis(able, nearest_lists(matrix, centres, probes), False, axis=1)
    return able


def assign_probes(queries: DataFrame, centres: np.ndarray, probes: int, reach: np.ndarray | None = None) -> DataFrame:
    """One row per query and list to look into; with ``reach``, the lists to look into after that, given the ``floor``."""
    sent = queries.sparkSession.sparkContext.broadcast((centres, reach))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from probes_of_batch(batch, *sent.value, probes)

    kinds = dict(queries.dtypes)
    return queries.select("query_id", "embedding", *["floor"] * (reach is not None)).mapInArrow(
        spread, f"query_id {kinds['query_id']}, embedding {kinds['embedding']}, list_id int"
    )


def probes_of_batch(batch: pa.RecordBatch, centres: np.ndarray, reach: np.ndarray | None, probes: int) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`assign_probes` for a batch of queries. The vector is repeated per list, so few queries are taken at once."""
    step = max(1, _ROWS // len(centres))
    for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
        matrix = _unit(_matrix(part.column(1)))
        if reach is None:
            near = nearest_lists(matrix, centres, probes)
            rows, numbers = np.repeat(np.arange(part.num_rows), near.shape[1]), near.reshape(-1)
        else:
            floors = part.column(2).to_numpy(zero_copy_only=False)
            rows, numbers = np.nonzero(further_lists(matrix, centres, probes, reach, np.nan_to_num(floors, nan=-np.inf)))
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(numbers.astype(np.int32))],
            ["query_id", "embedding", "list_id"],
        )


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found: one row with hits, found, recall."""
    found = approximate.select("query_id", "chunk_id", F.lit(1).alias("found"))
    return (
        exact.join(found, ["query_id", "chunk_id"], "left")
        .agg(F.count(F.lit(1)).alias("hits"), F.count("found").alias("found"))
        .withColumn("recall", F.round(F.try_divide("found", "hits"), 4))
    )
