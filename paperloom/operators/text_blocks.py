"""Ranked search over blocks of postings, in which blocks that cannot hold one of the k best are not read.

Chunks are numbered where they stand, and the postings of a term are cut into blocks by stretches of these numbers. A
block knows the first and last number in it and the best BM25 weight that the term reaches there. A search reads these
facts for its terms first: a chunk with all terms can only lie in a stretch in which every term has a block, between the
largest first and the smallest last number, and scores no more than the sum of the best weights. The most promising
stretches are scored, and of the others only those whose bound reaches the k-th score found. The hits are those of
``text_search.text_topk``.

Stretches are aligned over all terms, so blocks meet by equality of (term, stretch) and a frequent term is spread by its
stretches. A block holds at most ``2 ** bits`` postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.constants import CHILD
from paperloom.functions.scale import BROADCAST_ROWS, is_small, replicate, salt_of
from paperloom.functions.text import let, terms
from paperloom.operators.text_search import ROWS_AT_ONCE, SALTS, bm25_weight, inverse_frequency, query_terms, runs_of, term_bucket
from paperloom.operators.vector_search import rank_hits
from paperloom.session import stored

BITS = 12
FIRST = 8
# bounds are sums of rounded numbers
SLACK = 1e-9


def write_text_blocks(chunks: DataFrame, path: str, buckets: int = 256, bits: int = BITS) -> None:
    """The blocks of the children's terms under ``path``/blocks, by bucket of their term, and ``path``/statistics.

    Texts are cut into terms once. A bucket has a file of each task that reads these terms.
    """
    children = chunks.where(F.col("level") == CHILD).select("chunk_id", F.sort_array(terms(F.col("content"))).alias("terms"))
    counted = stored(
        children.select(
            "chunk_id",
            F.size("terms").alias("chunk_terms"),
            F.when(F.size("terms") > 0, let(F.col("terms"), runs_of)).alias("counts"),
        ),
        "terms",
    )
    statistics = counted.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("chunk_terms").alias("mean_terms"))
    statistics = statistics.withColumns({"buckets": F.lit(buckets), "id_type": F.lit(dict(chunks.dtypes)["chunk_id"])})
    statistics.write.parquet(f"{path}/statistics")
    mean_terms = chunks.sparkSession.read.parquet(f"{path}/statistics").first()["mean_terms"]
    blocks = blocks_of(counted, mean_terms, bits).withColumn("bucket", term_bucket(F.col("term"), buckets))
    blocks.sortWithinPartitions("bucket", "term", "stretch").write.partitionBy("bucket").parquet(f"{path}/blocks")


def blocks_of(counted: DataFrame, mean_terms: float | None, bits: int = BITS) -> DataFrame:
    """term, stretch, n, first, last, best, postings of chunk_id, chunk_terms, counts.

    Chunks are numbered by the task that reads them, so a stretch lies in one task, which makes its blocks: postings are not moved.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            stretch = rows.column("number").to_numpy() >> bits
            at = whole = 0
            for whole in (np.flatnonzero(np.diff(stretch)) + 1).tolist():
                if whole - at >= ROWS_AT_ONCE:
                    yield _blocks_of_rows(rows.slice(at, whole - at), mean_terms, bits)
                    at = whole
            if at < whole:
                yield _blocks_of_rows(rows.slice(at, whole - at), mean_terms, bits)
            # the last stretch may go on in the next batch
            rest = rows.slice(whole)
        if rest is not None:
            yield _blocks_of_rows(rest, mean_terms, bits)

    numbered = counted.where(F.col("counts").isNotNull()).select(
        F.monotonically_increasing_id().alias("number"), "chunk_id", "chunk_terms", "counts"
    )
    return numbered.mapInArrow(cut, _columns(dict(counted.dtypes)["chunk_id"]))


def _blocks_of_rows(rows: pa.RecordBatch, mean_terms: float, bits: int) -> pa.RecordBatch:
    """The blocks of whole stretches of chunks, which stand in the order of their numbers."""
    number, chunk_terms = (rows.column(c).to_numpy() for c in ("number", "chunk_terms"))
    counts = rows.column("counts")
    term, tf = counts.flatten().flatten()
    term = term.dictionary_encode()
    row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(counts).to_numpy())
    code = term.indices.to_numpy().astype(np.int64)
    key = ((number[row] >> bits) - (number[0] >> bits)) * len(term.dictionary) + code
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    row, code, tf = row[order], code[order], tf.to_numpy()[order]
    postings = pa.StructArray.from_arrays(
        [pa.array(number[row]), rows.column("chunk_id").take(pa.array(row)), pa.array(tf), pa.array(chunk_terms[row])],
        ["number", "chunk_id", "tf", "chunk_terms"],
    )
    columns = {
        "term": term.dictionary.take(pa.array(code[starts])),
        "stretch": pa.array(number[row[starts]] >> bits),
        "n": pa.array(ends - starts),
        "first": pa.array(number[row[starts]]),
        "last": pa.array(number[row[ends - 1]]),
        "best": pa.array(np.maximum.reduceat(bm25_weight(tf, chunk_terms[row], mean_terms), starts)),
        "postings": pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), postings),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _columns(id_type: str) -> str:
    postings = f"array<struct<number:bigint,chunk_id:{id_type},tf:int,chunk_terms:int>>"
    return f"term string, stretch long, n long, first long, last long, best double, postings {postings}"


class BlockSearch:
    """The blocks that a set of queries needs for its k best hits, and the hits.

    ``first`` stretches of a query are scored before others are ruled out; it changes what is read, not what is found.
    ``allowed`` (chunk_id) bounds the hits, not the weights of terms.
    """

    def __init__(
        self, queries: DataFrame, path: str, k: int, first: int = FIRST, max_rows: int = BROADCAST_ROWS, allowed: DataFrame | None = None
    ):
        spark: SparkSession = queries.sparkSession
        self.k, self.first, self.max_rows, self.allowed = k, first, max_rows, allowed
        self.wanted = stored(query_terms(queries), "wanted")
        statistics = spark.read.parquet(f"{path}/statistics").first()
        self.n_chunks, self.mean_terms = F.lit(statistics["n_chunks"]), F.lit(statistics["mean_terms"]).cast("double")
        self.blocks = self._buckets(spark, path, statistics["buckets"], statistics["id_type"])
        self.found = stored(self._found(), "found")
        self.weights = stored(self._weights(), "weights")
        self.candidates = stored(self._candidates(), "candidates")

    def _buckets(self, spark: SparkSession, path: str, buckets: int, id_type: str) -> DataFrame:
        """The buckets of the wanted terms; at most as many numbers as there are buckets come to the driver."""
        numbers = [r["bucket"] for r in self.wanted.select(term_bucket(F.col("term"), buckets).alias("bucket")).distinct().collect()]
        # an index of no chunks has no file to tell the columns from
        return spark.read.schema(f"{_columns(id_type)}, bucket int").parquet(f"{path}/blocks").where(F.col("bucket").isin(numbers)).drop("bucket")

    def _found(self) -> DataFrame:
        """The facts of the blocks of each query's terms, without their postings."""
        facts = self.blocks.select("term", "stretch", "n", "first", "last", "best")
        if is_small(self.wanted, self.max_rows):
            return facts.join(F.broadcast(self.wanted), "term")
        salted = facts.withColumn("salt", salt_of(F.col("stretch"), salts=SALTS))
        return salted.join(replicate(self.wanted, SALTS), ["term", "salt"]).drop("salt")

    def _weights(self) -> DataFrame:
        """query_id, term, n_terms, idf of the queries of which every term is known."""
        numbers = self.wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
        known = self.found.groupBy("query_id", "term").agg(F.sum("n").alias("df"))
        complete = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms")).join(numbers, ["query_id", "n_terms"])
        return known.join(complete, "query_id").select("query_id", "term", "n_terms", inverse_frequency(F.col("df"), self.n_chunks).alias("idf"))

    def _candidates(self) -> DataFrame:
        """query_id, stretch, low, high, bound: where all terms of a query may meet, and the most they can score there."""
        return (
            self.found.join(self.weights, ["query_id", "term"])
            .groupBy("query_id", "stretch", "n_terms")
            .agg(
                F.count(F.lit(1)).alias("present"),
                F.max("first").alias("low"),
                F.min("last").alias("high"),
                F.sum(F.col("idf") * F.col("best")).alias("s"),
            )
            .where("present = n_terms AND low <= high")
            .select("query_id", "stretch", "low", "high", (_score(F.col("s")) + SLACK).alias("bound"))
        )

    def scored(self, chosen: DataFrame) -> DataFrame:
        """query_id, chunk_id, score of the chunks with all terms in the chosen stretches."""
        needed = chosen.select("query_id", "stretch", "low", "high").join(self.weights, "query_id")
        if is_small(needed, self.max_rows):
            needed = F.broadcast(needed)
        inside = F.filter("postings", lambda p: p["number"].between(F.col("low"), F.col("high")))
        met = self.blocks.select("term", "stretch", "postings").join(needed, ["term", "stretch"])
        weight = F.col("idf") * bm25_weight(F.col("tf"), F.col("chunk_terms"), self.mean_terms)
        summed = (
            met.select("query_id", "n_terms", "idf", F.inline(inside))
            .groupBy("query_id", "chunk_id", "n_terms")
            .agg(F.count(F.lit(1)).alias("present"), F.sum(weight).alias("s"))
            .where("present = n_terms")
        )
        hits = summed.select("query_id", "chunk_id", F.least(F.round(_score(F.col("s")), 12), F.lit(1.0)).alias("score"))
        return hits if self.allowed is None else hits.join(self.allowed.select("chunk_id"), "chunk_id", "left_semi")

    def _passes(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The stretches read first, the best hits in them, and the stretches that can still hold one of the k best."""
        order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "stretch")
        placed = stored(self.candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= self.first), "first")
        best = stored(rank_hits(self.scored(placed), self.k), "best")
        reached = best.where(F.col("rank") == self.k).select("query_id", F.col("score").alias("reached"))
        others = self.candidates.join(placed.select("query_id", "stretch"), ["query_id", "stretch"], "left_anti")
        open_still = others.join(reached, "query_id", "left").where("reached IS NULL OR bound >= reached").drop("reached")
        return placed, best, open_still

    def hits(self) -> DataFrame:
        """query_id, chunk_id, score, rank."""
        _, best, open_still = self._passes()
        rest = self.scored(stored(open_still, "open"))
        return rank_hits(best.drop("rank").unionByName(rest), self.k)

    def blocks_read(self) -> DataFrame:
        """query_id, blocks, read: how many blocks its terms have, and of how many the postings are needed."""
        placed, _, open_still = self._passes()
        n_terms = self.weights.select("query_id", "n_terms").distinct()
        read = placed.select("query_id").unionByName(open_still.select("query_id")).join(n_terms, "query_id")
        read = read.groupBy("query_id").agg(F.sum("n_terms").alias("read"))
        total = self.found.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"))
        return total.join(read, "query_id", "left").select("query_id", "blocks", F.coalesce("read", F.lit(0)).alias("read"))


def _score(s: Column) -> Column:
    return s / (F.lit(1.0) + s)


def text_topk_blocks(queries: DataFrame, path: str, k: int, **more) -> DataFrame:
    """query_id, chunk_id, score (at most 1), rank, over the blocks under ``path``; ``more`` as for :class:`BlockSearch`."""
    return BlockSearch(queries, path, k, **more).hits()
