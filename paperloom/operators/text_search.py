"""Term index, matching of all query terms, and ranking.

Terms are lower-cased words without English stop words, not stemmed. The rank is BM25 mapped to 0..1 by s / (1 + s).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.constants import CHILD
from paperloom.functions.scale import BROADCAST_ROWS, broadcast_if_small, is_small, replicate, salt_of
from paperloom.functions.text import let, numbered_terms, runs_of_letters, terms
from paperloom.operators.vector_search import rank_hits
from paperloom.session import stored

K1, B = 1.2, 0.75
SALTS = 32
# chunks whose terms are counted together
ROWS_AT_ONCE = 2048
# (term, chunk) pairs that may be broadcast: about 60 bytes each
LOOKUP_ROWS = 500_000


def runs_of(ordered: Column) -> Column:
    """array<struct<term, tf>> of a sorted array: the starts of its runs, and the distance to the next start."""
    positions = F.sequence(F.lit(0), F.size(ordered) - 1)
    starts = F.filter(positions, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
    return let(
        starts,
        lambda s: F.transform(
            s,
            lambda p, n: F.struct(
                F.get(ordered, p).alias("term"), (F.coalesce(F.get(s, n + 1), F.size(ordered)) - p).alias("tf")
            ),
        ),
    )


def build_text_index(chunks: DataFrame) -> DataFrame:
    """Postings of the children: term, chunk_id, tf, chunk_terms.

    The terms of a chunk are counted where its row is, a batch of rows at a time, so building the index moves nothing between tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, ROWS_AT_ONCE) for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
                row, number, distinct = numbered_terms(batch.column("runs"))
                key, tf = np.unique(row * len(distinct) + number, return_counts=True)
                at = key // max(1, len(distinct))
                n_terms = np.bincount(row, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [distinct.take(pa.array(key - at * len(distinct))), batch.column("chunk_id").take(pa.array(at)),
                     pa.array(tf.astype(np.int32)), pa.array(n_terms[at].astype(np.int32))],
                    ["term", "chunk_id", "tf", "chunk_terms"],
                )

    lower = chunks.where(F.col("level") == CHILD).select("chunk_id", runs_of_letters(F.col("content")).alias("runs"))
    return lower.mapInArrow(count, f"term string, chunk_id {dict(chunks.dtypes)['chunk_id']}, tf int, chunk_terms int")


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_text_index(index: DataFrame, path: str, buckets: int = 1024) -> None:
    """Lay the index out by term bucket, so that a search reads the buckets of its terms only.

    The bucket of a frequent term is spread over ``SALTS`` tasks and files.
    """
    bucketed = index.withColumn("bucket", term_bucket(F.col("term"), buckets))
    spread_out = bucketed.repartition(F.col("bucket"), salt_of(F.col("chunk_id"), salts=SALTS))
    spread_out.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def read_text_index(spark: SparkSession, path: str, wanted: DataFrame, buckets: int = 1024) -> DataFrame:
    """The buckets that hold the wanted terms. At most ``buckets`` numbers come to the driver."""
    numbers = wanted.select(term_bucket(F.col("term"), buckets).alias("bucket")).distinct().collect()
    stored_index = spark.read.parquet(path)
    return stored_index.where(F.col("bucket").isin([r["bucket"] for r in numbers])).drop("bucket")


def text_statistics(chunks: DataFrame) -> DataFrame:
    """One row: number of children and their mean number of terms."""
    lengths = chunks.where(F.col("level") == CHILD).select(F.size(terms(F.col("content"))).alias("n"))
    return lengths.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("n").alias("mean_terms"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, query -> query_id, term (distinct per query)."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))


def term_frequency(index: DataFrame) -> DataFrame:
    """term, df: in how many chunks a term occurs. Best kept as a table next to the index."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _join_postings(index: DataFrame, side: DataFrame, max_rows: int) -> DataFrame:
    """Equi-join on term: broadcast behind a count, otherwise salted by chunk because terms are skewed."""
    if is_small(side, max_rows):
        return index.join(F.broadcast(side), "term")
    salted = index.withColumn("salt", salt_of(F.col("chunk_id"), salts=SALTS))
    return salted.join(replicate(side, SALTS), ["term", "salt"]).drop("salt")


def text_match(
    index: DataFrame, wanted: DataFrame, frequency: DataFrame | None = None, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Postings of the chunks that hold every term of a query: query_id, chunk_id, term, tf, chunk_terms, df.

    Each query starts from the postings of its rarest term, and only these candidates look up their other terms by
    (term, chunk). The long postings of frequent terms are read, but neither shuffled nor paired with queries, as long
    as the look-ups can be broadcast; beyond that they are shuffled by (term, chunk), which spreads every term.
    """
    if frequency is None:
        frequency = term_frequency(_join_postings(index, wanted.select("term").distinct(), max_rows))
    weighed = stored(wanted.join(frequency, "term", "left"), "terms")
    rarest = (
        weighed.groupBy("query_id")
        .agg(
            F.min(F.struct("df", "term")).alias("rare"),
            F.count(F.lit(1)).alias("n_terms"),
            F.count("df").alias("n_known"),
        )
        .where(F.col("n_terms") == F.col("n_known"))
        .select("query_id", F.col("rare.term").alias("term"), "n_terms")
    )
    candidates = stored(_join_postings(index.select("term", "chunk_id"), rarest, max_rows).drop("term"), "candidates")
    known = weighed.where(F.col("df").isNotNull())
    lookups = candidates.join(broadcast_if_small(known, max_rows), "query_id")
    if is_small(lookups, LOOKUP_ROWS):
        looked_up = index.join(F.broadcast(lookups), ["term", "chunk_id"])
    else:
        needed = _join_postings(index, wanted.select("term").distinct(), max_rows)
        looked_up = needed.join(lookups, ["term", "chunk_id"])
    complete = looked_up.groupBy("query_id", "chunk_id", "n_terms").agg(
        F.collect_list(F.struct("term", "tf", "chunk_terms", "df")).alias("postings")
    )
    return complete.where(F.size("postings") == F.col("n_terms")).select("query_id", "chunk_id", F.inline("postings"))


def inverse_frequency(df: Column, n_chunks: Column) -> Column:
    return F.log(F.lit(1.0) + (n_chunks - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, chunk_terms: Column, mean_terms: Column) -> Column:
    """The weight of a term in a chunk, still to be multiplied with its inverse frequency; of numpy arrays as of columns."""
    length = (1.0 - B) + B * chunk_terms / mean_terms
    return tf * (K1 + 1.0) / (tf + K1 * length)


def text_rank(matches: DataFrame, statistics: DataFrame) -> DataFrame:
    """query_id, chunk_id, score in 0..1."""
    facts = statistics.select(F.struct("n_chunks", "mean_terms").alias("facts")).scalar()
    weight = inverse_frequency(F.col("df"), facts["n_chunks"]) * bm25_weight(F.col("tf"), F.col("chunk_terms"), facts["mean_terms"])
    summed = matches.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("s"))
    return summed.select("query_id", "chunk_id", F.round(F.col("s") / (F.lit(1.0) + F.col("s")), 12).alias("score"))


def text_topk(
    queries: DataFrame,
    index: DataFrame,
    statistics: DataFrame,
    k: int,
    frequency: DataFrame | None = None,
    max_rows: int = BROADCAST_ROWS,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """query_id, chunk_id, score (at most 1), rank. ``allowed`` (chunk_id) bounds the hits, not the weights of terms."""
    matched = text_match(index, query_terms(queries), frequency, max_rows)
    if allowed is not None:
        matched = matched.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    scored = text_rank(matched, statistics)
    return rank_hits(scored.withColumn("score", F.least("score", F.lit(1.0))), k)
