"""Embedding jobs: each distinct text is encoded once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.constants import EMBEDDING_DIM
from paperloom.functions.text import content_hash, numbered_terms, runs_of_letters
from paperloom.session import stored

Encoder = Callable[[DataFrame], DataFrame]
STORE_BUCKETS = 64
ROWS_AT_ONCE = 2048


def term_bucket(term: str, dim: int) -> int:
    """The bucket of a term: the first 32 bits of its MD5 modulo ``dim``."""
    return int.from_bytes(hashlib.md5(term.encode(), usedforsecurity=False).digest()[:4]) % dim


def encode_text(texts: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    """file_hash, content -> file_hash, embedding: unit-length counts of hashed terms.

    The default encoder, for use without a model. Texts are cut in the JVM; the distinct terms of a batch of rows are hashed once,
    and the batch is counted at once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, ROWS_AT_ONCE) for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
                n = batch.num_rows
                row, number, distinct = numbered_terms(batch.column("runs"))
                bucket = np.array([term_bucket(t, dim) for t in distinct.to_pylist()], dtype=np.int64)
                counts = np.bincount(row * dim + bucket[number], minlength=n * dim).reshape(n, dim).astype(np.float64)
                norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                unit = np.divide(counts, norms, out=counts, where=norms > 0)
                vectors = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(unit.reshape(-1).astype(np.float32))
                )
                yield pa.RecordBatch.from_arrays([batch.column("file_hash"), vectors], ["file_hash", "embedding"])

    cut = texts.select("file_hash", runs_of_letters(F.col("content")).alias("runs"))
    return cut.mapInArrow(count, "file_hash string, embedding array<float>")


def model_encoder(load_model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> Encoder:
    """An encoder around a real model, which every Python worker loads once."""

    def encode(texts: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load_model()
            for frame in frames:
                for start in range(0, len(frame), batch):
                    part = frame.iloc[start : start + batch]
                    vectors = np.asarray(model(part["content"].tolist()), dtype=np.float32)
                    yield pd.DataFrame({"file_hash": part["file_hash"].to_numpy(), "embedding": list(vectors)})

        return texts.select("file_hash", "content").mapInPandas(run, "file_hash string, embedding array<float>")

    return encode


def embed_distinct(
    chunks: DataFrame, encoder: Encoder, known: DataFrame | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """chunk_id, content -> chunk_id, file_hash, embedding, and the columns to ``keep``.

    ``known`` (file_hash, embedding) holds the vectors of earlier runs; only texts that are not in it are encoded.
    Contents meet the shuffle once per distinct text and task; the join back moves ids, hashes and vectors only.
    """
    hashed = chunks.select("chunk_id", *keep, content_hash(F.col("content")).alias("file_hash"), "content")
    # equal hashes have equal contents; a distinct needs no buffers, which texts would turn into a sort
    distinct = hashed.select("file_hash", "content").distinct()
    if known is not None:
        distinct = distinct.join(known.select("file_hash"), "file_hash", "left_anti")
    vectors = encoder(distinct)
    if known is not None:
        vectors = vectors.unionByName(known.select("file_hash", "embedding"))
    return hashed.drop("content").join(vectors, "file_hash").select("chunk_id", *keep, "file_hash", "embedding")


class VectorStore:
    """Vectors of all texts encoded so far, as a table bucketed by hash.

    Look-ups and the join back meet the store bucket by bucket: what is looked up is dealt out to its buckets, the stored vectors are
    not moved. A run adds only hashes that the store lacks, and its files count once they are committed; let one run write at a time.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = STORE_BUCKETS):
        self.spark, self.table, self.buckets = spark, table, buckets

    def vectors(self) -> DataFrame | None:
        """file_hash, embedding; None before the first run."""
        return self.spark.table(self.table) if self.spark.catalog.tableExists(self.table) else None

    def _unknown(self, texts: DataFrame) -> DataFrame:
        known = self.vectors()
        return texts if known is None else texts.join(known.select("file_hash").hint("merge"), "file_hash", "left_anti")

    def embed(self, chunks: DataFrame, encoder: Encoder, keep: tuple[str, ...] = ()) -> DataFrame:
        """As :func:`embed_distinct`; texts that the store lacks are encoded and added to it."""
        hashed = stored(chunks.select("chunk_id", *keep, content_hash(F.col("content")).alias("file_hash"), "content"), "hashed-chunks")
        added = encoder(self._unknown(hashed.select("file_hash", "content").distinct())).select("file_hash", "embedding")
        # one file per bucket and run
        dealt = added.repartition(self.buckets, "file_hash")
        dealt.write.bucketBy(self.buckets, "file_hash").sortBy("file_hash").mode("append").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)
        return hashed.drop("content").join(self.vectors().hint("merge"), "file_hash").select("chunk_id", *keep, "file_hash", "embedding")


def reuse_statistics(chunks: DataFrame) -> DataFrame:
    """How many texts the encoder is spared: total, distinct and the share of repeats."""
    per_text = chunks.groupBy(content_hash(F.col("content")).alias("file_hash")).agg(F.count(F.lit(1)).alias("n"))
    return per_text.agg(F.sum("n").alias("texts"), F.count(F.lit(1)).alias("distinct_texts")).withColumn(
        "reuse_ratio", F.round(F.lit(1.0) - F.try_divide(F.col("distinct_texts"), F.col("texts")), 9)
    )


def check_dimension(vectors: DataFrame, dim: int = EMBEDDING_DIM) -> tuple[DataFrame, DataFrame]:
    """Vectors of the expected length, and the others."""
    right = F.coalesce(F.size("embedding") == dim, F.lit(False))
    return vectors.where(right), vectors.where(~right)
