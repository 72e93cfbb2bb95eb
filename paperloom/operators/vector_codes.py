"""Exact search that reads short codes of all vectors and full vectors of the few that can be among the k best.

A unit vector is stored a second time as one signed byte per dimension with a scale, and with its ``miss``, the length of what the
code leaves out. A query of unit length meets the vector with the product of query and code, give or take the miss: an upper and a
lower bound of the score that always hold. A search reads the codes, which are Parquet columns of their own, keeps per query the
pairs whose upper bound reaches the k-th best lower bound, and fetches full vectors for these only.

Lists make the first floor: the codes of the probed lists are read first, then those of every other list whose reach does not rule
it out. On vectors without clusters, where no list can be ruled out, what is read is a quarter of the vectors' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from paperloom.constants import CHILD
from paperloom.functions.scale import broadcast_if_small
from paperloom.operators.vector_search import (
    _CELLS,
    _ROUND,
    MAX_SENT_QUERIES,
    _matrix,
    _no_hits,
    _of_lists,
    _taken,
    _unit,
    further_lists,
    metadata_filters,
    nearest_lists,
    rank_hits,
    vector_topk_lists,
    with_list,
)
from paperloom.session import stored

LEVELS = 127
_CODES = "code binary, scale double, miss double"
# More than products and sums of doubles can lose, and more than the rounding of scores.
SLACK = 1e-9


def with_codes(chunks: DataFrame, dim: int) -> DataFrame:
    """Adds code, scale and miss; null for vectors of another length or without direction."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _coded(batch, dim)

    return chunks.mapInArrow(encode, f"{_named(chunks)}, {_CODES}")


def coded_lists(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """``with_codes`` of ``assign_lists``, by one Python worker a task instead of two."""
    chunks = chunks.where(F.size("embedding") == centres.shape[1])
    sent = chunks.sparkSession.sparkContext.broadcast(centres)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _coded(with_list(batch, sent.value), sent.value.shape[1])

    return chunks.mapInArrow(listed, f"{_named(chunks)}, list_id int, {_CODES}")


def _named(chunks: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in chunks.dtypes)


def _coded(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    column = batch.column("embedding")
    right = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    vectors = _unit(_matrix(column.take(pa.array(right))).reshape(-1, dim))
    directed = np.isfinite(vectors).all(axis=1)
    right, vectors = right[directed], vectors[directed]
    scale = np.abs(vectors).max(axis=1, initial=0.0) / LEVELS
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    miss = np.linalg.norm(vectors - codes * scale[:, None], axis=1)
    place = np.full(batch.num_rows, -1)
    place[right] = np.arange(len(right))
    place = pa.array(place, mask=place < 0)
    packed = pa.array([c.tobytes() for c in codes], pa.binary())
    return pa.RecordBatch.from_arrays(
        [*batch.columns, packed.take(place), pa.array(scale).take(place), pa.array(miss).take(place)],
        [*batch.schema.names, "code", "scale", "miss"],
    )


class _Hopeful:
    """Pairs of query and chunk whose upper bound reaches the k-th best lower bound seen so far."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.copy()
        self.best = np.full((k, len(floors)), -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = self.most = 0

    def add(self, ids: np.ndarray, near: np.ndarray, miss: np.ndarray, which: np.ndarray) -> None:
        """``near`` has a row per chunk and a column per query of ``which``."""
        lower = near - miss[:, None]
        both = np.concatenate((self.best[:, which], lower))
        self.best[:, which] = np.partition(both, len(both) - self.k, axis=0)[len(both) - self.k :]
        self.floors[which] = np.maximum(self.floors[which], self.best[:, which].min(axis=0))
        row, column = np.nonzero(near + miss[:, None] + SLACK >= self.floors[which])
        self.parts.append((which[column], ids[row], lower[row, column], (near + miss[:, None])[row, column]))
        self.held += len(row)
        if self.held > 2 * self.most + _CELLS // 10:
            self.pairs()

    def pairs(self) -> tuple[np.ndarray, ...]:
        """Queries, chunks, lower and upper bounds of what is still hopeful."""
        if not self.parts:
            return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, float, float))
        found = tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))
        left = found[3] + SLACK >= self.floors[found[0]]
        found = tuple(x[left] for x in found)
        self.parts, self.held, self.most = [found], len(found[0]), len(found[0])
        return found


def _alone(column: pa.Array) -> pa.Array:
    """A copy of a column; the column itself keeps its whole batch, codes and all, in memory."""
    return column.take(pa.array(np.arange(len(column))))


def _bounded(chunks: DataFrame, queries: np.ndarray, k: int, lists_of: np.ndarray, floors: np.ndarray) -> DataFrame:
    """(query, chunk_id, list_id, lower, upper) of the pairs that a task can't rule out. ``lists_of[q]`` are the lists of query q."""
    sent = chunks.sparkSession.sparkContext.broadcast((queries, lists_of, floors))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, probed, floors = sent.value
        hopeful, kinds, lists, chunk_ids = _Hopeful(floors, k), None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.schema.field(0).type
            numbers = batch.column(1).to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.int8).reshape(batch.num_rows, -1)
            scale, miss = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            first = sum(map(len, lists))
            lists.append(numbers.copy())
            chunk_ids.append(_alone(batch.column(0)))
            for number in np.unique(numbers):
                which = np.flatnonzero((probed == number).any(axis=1))
                rows = np.flatnonzero(numbers == number)
                step = max(1, _CELLS // max(1, len(which)))
                for part in (rows[i : i + step] for i in range(0, len(rows), step)) if len(which) else ():
                    near = (codes[part] * scale[part, None]) @ matrix[which].T
                    hopeful.add(first + part, near, miss[part], which)
        if kinds is None:
            return
        query, place, lower, upper = hopeful.pairs()
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.concat_arrays(chunk_ids).take(pa.array(place)), pa.array(np.concatenate(lists)[place].astype(np.int32)),
             pa.array(lower), pa.array(upper)],
            ["query", "chunk_id", "list_id", "lower", "upper"],
        )

    kind = dict(chunks.dtypes)["chunk_id"]
    return chunks.select("chunk_id", "list_id", "code", "scale", "miss").mapInArrow(
        bound, f"query int, chunk_id {kind}, list_id int, lower double, upper double"
    )


def _hopeful_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs whose upper bound reaches the query's k-th best lower bound over all tasks."""
    best = Window.partitionBy("query").orderBy(F.desc("lower"))
    floor = pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query", F.col("lower").alias("floor"))
    known = pairs.join(broadcast_if_small(floor), "query", "left")
    return known.where(F.col("floor").isNull() | (F.col("upper") + SLACK >= F.col("floor"))).drop("floor")


def _exact(pairs: DataFrame, listed: DataFrame, ids: list, kind: DataType, matrix: np.ndarray) -> DataFrame:
    """query_id, chunk_id and score of the pairs, from the full vectors of their chunks."""
    # a chunk is asked for by at most all queries that are sent around
    wanted = stored(pairs.groupBy("list_id", "chunk_id").agg(F.collect_list("query").alias("asked")), "hopeful-chunks")
    lists = [r["list_id"] for r in wanted.select("list_id").distinct().collect()]
    vectors = listed.where(F.col("list_id").isin(lists)).select("list_id", "chunk_id", "embedding").join(broadcast_if_small(wanted), ["list_id", "chunk_id"])
    sent = listed.sparkSession.sparkContext.broadcast(matrix)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
            query = asked.flatten().to_numpy(zero_copy_only=False)
            scores = np.round((_unit(_matrix(batch.column(1)))[owner] * sent.value[query]).sum(axis=1), _ROUND)
            yield pa.RecordBatch.from_arrays([pa.array(query), batch.column(0).take(pa.array(owner)), pa.array(scores)], ["query", "chunk_id", "score"])

    scored = vectors.select("chunk_id", "embedding", "asked").mapInArrow(score, f"query int, chunk_id {dict(listed.dtypes)['chunk_id']}, score double")
    names = listed.sparkSession.createDataFrame(list(enumerate(ids)), f"query int, query_id {kind.simpleString()}")
    return scored.join(F.broadcast(names), "query").select("query_id", "chunk_id", "score")


def hopeful_chunks(
    queries: np.ndarray,
    listed: DataFrame,
    documents: DataFrame | None,
    centres: np.ndarray,
    reach: np.ndarray,
    k: int,
    probes: int = 10,
    discipline: str | None = None,
    document_ids: DataFrame | None = None,
) -> DataFrame:
    """Pairs of query number and chunk that can be among the k best of the query, found from codes alone."""
    coded = listed.where((F.col("level") == CHILD) & F.col("code").isNotNull())
    allowed = metadata_filters(coded.drop("embedding"), documents, discipline, document_ids)
    probed = nearest_lists(queries, centres, probes)
    open_floors = np.full(len(queries), -np.inf)
    first = stored(_bounded(_of_lists(allowed, probed), queries, k, probed, open_floors), "bounds-of-probed-lists")
    if probes >= len(centres):
        return _hopeful_pairs(first, k)
    order = Window.partitionBy("query").orderBy(F.desc("lower"))
    # one row per query
    floors = open_floors.copy()
    for r in first.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query", "lower").collect():
        floors[r["query"]] = r["lower"]
    further = further_lists(queries, centres, probes, reach, floors)
    wanted = np.where(further, np.arange(len(centres)), -1)
    second = _bounded(_of_lists(allowed, wanted), queries, k, wanted, floors)
    return _hopeful_pairs(stored(first.union(second), "bounds"), k)


def vector_topk_codes(
    queries: DataFrame,
    listed: DataFrame,
    documents: DataFrame | None,
    centres: np.ndarray,
    reach: np.ndarray,
    k: int,
    dim: int,
    probes: int = 10,
    discipline: str | None = None,
    document_ids: DataFrame | None = None,
    max_sent: int = MAX_SENT_QUERIES,
) -> DataFrame:
    """The hits of an exact search (query_id, chunk_id, score, rank) over lists whose chunks carry codes.

    More queries than can be sent around are met block by block with the full vectors, with the same result.
    """
    right = queries.where(F.size("embedding") == dim)
    rows = _taken(right, max_sent)
    if rows == []:
        return _no_hits(queries, listed)
    if rows is None:
        return vector_topk_lists(queries, listed, documents, centres, k, dim, probes, discipline, document_ids, max_sent, reach=reach)
    ids, kind = [r["query_id"] for r in rows], queries.schema["query_id"].dataType
    matrix = _unit(np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(rows), dim))
    directed = np.flatnonzero(np.isfinite(matrix).all(axis=1))
    if not len(directed):
        return _no_hits(queries, listed)
    matrix, ids = matrix[directed], [ids[i] for i in directed]
    pairs = stored(hopeful_chunks(matrix, listed, documents, centres, reach, k, probes, discipline, document_ids), "hopeful-pairs")
    return rank_hits(_exact(pairs, listed, ids, kind, matrix), k)
