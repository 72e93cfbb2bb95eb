"""Queries on embedding and search.

Two inputs: the vectors of the test tables seen as chunks (``search_chunks``), and the chunked corpus with hashed-term
vectors of 64 dimensions, asked with the passages of ``text_queries``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperloom.constants import STOP_WORDS
from paperloom.functions.bitmaps import bitmap_of
from paperloom.functions.text import content_hash
from paperloom.functions.vectors import cosine_similarity, l2_normalize
from paperloom.operators import embedding as G
from paperloom.operators import hybrid_search as H
from paperloom.operators import text_blocks as B
from paperloom.operators import text_search as T
from paperloom.operators import vector_codes as C
from paperloom.operators import vector_search as V
from paperloom.plans.chunking import corpus_chunks
from paperloom.plans.registry import query, shared_sql
from paperloom.session import new_folder, stored
from paperloom.sources.views import Source

DIM = 64
LIMIT = 10

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _terms_sql(text: str) -> str:
    return (
        rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), "
        f"lambda t: t <> '' AND NOT list_contains({_STOP}, t))"
    )


_BUCKET = f"CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {DIM}"


def _vectors_sql(source: str, key: str, text: str) -> str:
    """Sparse unit vectors, stored as floats: key, bucket, v."""
    return f"""
SELECT {key}, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS v FROM (
  SELECT {key}, {_BUCKET} AS bucket, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT {key}, unnest({_terms_sql(text)}) AS term FROM {source}) GROUP BY ALL)"""


shared_sql("child_texts", "SELECT chunk_id, document_id, parent_id, content FROM chunks WHERE level = 'child'")
shared_sql("child_vectors", _vectors_sql("child_texts", "chunk_id", "content"))
shared_sql("query_vectors", _vectors_sql("text_queries", "query_id", "query"))
shared_sql(
    "text_index",
    f"""SELECT term, chunk_id, count(*) AS tf, any_value(chunk_terms) AS chunk_terms FROM (
  SELECT chunk_id, unnest(ts) AS term, len(ts) AS chunk_terms FROM (SELECT chunk_id, {_terms_sql('content')} AS ts FROM child_texts)) GROUP BY term, chunk_id""",
)
shared_sql(
    "text_stats", f"SELECT count(*) AS n_chunks, avg(len({_terms_sql('content')})) AS mean_terms FROM child_texts"
)
shared_sql(
    "wanted_terms",
    f"SELECT DISTINCT query_id, unnest({_terms_sql('query')}) AS term FROM text_queries",
)
shared_sql("term_frequency", "SELECT term, count(*) AS df FROM text_index GROUP BY term")
shared_sql(
    "text_matches",
    """SELECT q.query_id, i.chunk_id, i.term, i.tf, i.chunk_terms, f.df FROM wanted_terms q JOIN text_index i ON i.term = q.term JOIN term_frequency f ON f.term = q.term
QUALIFY count(*) OVER (PARTITION BY q.query_id, i.chunk_id) = (SELECT count(*) FROM wanted_terms w WHERE w.query_id = q.query_id)""",
)
shared_sql(
    "text_scores",
    """SELECT query_id, chunk_id, round(s / (1e0 + s), 12) AS score FROM (
  SELECT query_id, chunk_id, sum(ln(1e0 + (n_chunks - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * chunk_terms / mean_terms))) AS s
  FROM text_matches CROSS JOIN text_stats GROUP BY query_id, chunk_id)""",
)


def _ranked(source: str, k: int, extra: str = "") -> str:
    return f"""SELECT query_id, chunk_id, score{extra}, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank
FROM {source} QUALIFY rank <= {k}"""


shared_sql("text_hits", _ranked("text_scores", 2 * LIMIT))
shared_sql(
    "corpus_scores",
    """SELECT q.query_id, c.chunk_id, round(sum(q.v * c.v) / (any_value(q.len) * any_value(c.len)), 12) AS score
FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY query_id)) AS len FROM query_vectors) q
JOIN (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY chunk_id)) AS len FROM child_vectors) c ON q.bucket = c.bucket
GROUP BY q.query_id, c.chunk_id""",
)
shared_sql("vector_hits", _ranked("corpus_scores", 2 * LIMIT))
shared_sql(
    "fused_scores",
    """SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.chunk_id, t.chunk_id) AS chunk_id,
  round(coalesce(v.score, 0e0) * 0.6e0 + coalesce(t.score, 0e0) * 0.4e0, 12) AS score
FROM vector_hits v FULL JOIN text_hits t ON v.query_id = t.query_id AND v.chunk_id = t.chunk_id""",
)
shared_sql("hybrid_hits", _ranked("fused_scores", LIMIT))
shared_sql(
    "expanded_hits",
    """SELECT query_id, chunk_id, score, 'hybrid' AS search_type, rank, 0 AS place FROM hybrid_hits
UNION ALL SELECT h.query_id, c.parent_id, h.score, 'parent_expansion', h.rank, 1 FROM hybrid_hits h JOIN child_texts c ON c.chunk_id = h.chunk_id
QUALIFY row_number() OVER (PARTITION BY h.query_id, c.parent_id ORDER BY h.rank) = 1""",
)


def encoder(texts):
    return G.encode_text(texts, DIM)


def children(src: Source):
    return corpus_chunks(src).where(F.col("level") == "child")


class Corpus:
    """The searchable corpus: each table is computed once and kept in the shared folder."""

    def __init__(self, src: Source):
        self.documents = src.corpus_documents
        self.chunks = stored(corpus_chunks(src), "chunks")
        lower = self.chunks.where(F.col("level") == "child")
        self.index = stored(T.build_text_index(self.chunks), "index")
        self.frequency = stored(T.term_frequency(self.index), "frequency")
        self.statistics = stored(T.text_statistics(self.chunks), "statistics")
        vectors = G.embed_distinct(lower, encoder, keep=("document_id", "level"))
        self.vectors = stored(vectors.drop("file_hash"), "vectors")
        self.queries = embedded_queries(src)

    def hits(self, **filters):
        return H.hybrid_search(
            self.queries, self.vectors, self.documents, self.index, self.statistics, DIM, LIMIT,
            frequency=self.frequency, **filters,
        )


def embedded_queries(src: Source):
    asked = src.text_queries.withColumn("file_hash", content_hash(F.col("query")))
    distinct = asked.select("file_hash", F.col("query").alias("content")).dropDuplicates(["file_hash"])
    return asked.join(encoder(distinct), "file_hash").select("query_id", "query", "embedding")


def _nine(column: str = "score"):
    return F.round(column, 9).alias(column)


@query(
    "embed_distinct",
    """SELECT c.chunk_id, sha256(c.content) AS file_hash, (SELECT round(sum(v.v), 5) FROM child_vectors v WHERE v.chunk_id = c.chunk_id) AS mass
FROM child_texts c""",
)
def embed_distinct(src: Source):
    vectors = G.embed_distinct(stored(children(src), "children"), encoder)
    mass = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5)
    return vectors.select("chunk_id", "file_hash", F.when(mass != 0, mass).alias("mass"))


@query(
    "vector_store",
    """SELECT c.chunk_id, sha256(c.content) AS file_hash, (SELECT round(sum(v.v), 5) FROM child_vectors v WHERE v.chunk_id = c.chunk_id) AS mass, c.content IN (SELECT content FROM child_texts p JOIN corpus_documents d ON d.id = p.document_id WHERE d.discipline = 'ELC') AS reused
FROM child_texts c""",
)
def vector_store(src: Source):
    """The texts of one discipline are encoded first; of a run over all texts those that are left."""
    chunks = stored(children(src), "children")
    store = G.VectorStore(src.spark, f"paperloom_vectors_{uuid.uuid4().hex}", buckets=16)
    first = chunks.join(src.corpus_documents.where("discipline = 'ELC'").select(F.col("id").alias("document_id")), "document_id", "left_semi")
    early = stored(store.embed(first, encoder).select("file_hash").distinct().withColumn("early", F.lit(True)), "first-run")
    vectors = store.embed(chunks, encoder).join(early, "file_hash", "left")
    mass = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5)
    return vectors.select("chunk_id", "file_hash", F.when(mass != 0, mass).alias("mass"), F.col("early").isNotNull().alias("reused"))


@query(
    "embedding_reuse",
    """SELECT CAST(count(*) AS BIGINT) AS texts, count(DISTINCT content) AS distinct_texts, round(1e0 - count(DISTINCT content) / CAST(count(*) AS DOUBLE), 9) AS reuse_ratio FROM child_texts""",
)
def embedding_reuse(src: Source):
    return G.reuse_statistics(children(src))


@query(
    "encode_text",
    """SELECT DISTINCT sha256(c.content) AS file_hash, CAST(v.bucket AS INT) AS bucket, round(v.v, 6) AS weight FROM child_texts c JOIN child_vectors v ON v.chunk_id = c.chunk_id""",
)
def encode_text(src: Source):
    texts = children(src).select(content_hash(F.col("content")).alias("file_hash"), "content")
    vectors = encoder(texts.dropDuplicates(["file_hash"]))
    return (
        vectors.select("file_hash", F.posexplode("embedding").alias("bucket", "w"))
        .where(F.col("w") > 0)
        .select("file_hash", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight"))
    )


@query(
    "l2_normalize",
    """SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 9) AS value
FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) * (vec_id + 1) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)""",
)
def l2_normalize_query(src: Source):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))
    return src.embeddings.select("vec_id", F.posexplode(l2_normalize(scaled)).alias("pos", "value")).select(
        "vec_id", "pos", _nine("value")
    )


@query(
    "check_dimension",
    """SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 63 ELSE 64 END AS size, vec_id % 9 <> 0 AS right_size FROM embeddings""",
)
def check_dimension(src: Source):
    cut = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    right, wrong = G.check_dimension(src.embeddings.select("vec_id", cut.alias("embedding")), 64)
    size = F.size("embedding").alias("size")
    return right.select("vec_id", size, F.lit(True).alias("right_size")).unionByName(
        wrong.select("vec_id", size, F.lit(False).alias("right_size"))
    )


shared_sql(
    "label_scores",
    """SELECT q.query_id, c.chunk_id, c.document_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) AS score
FROM vector_queries q CROSS JOIN search_chunks c WHERE c.level = 'child'""",
)


@query(
    "cosine_similarity",
    """SELECT c.chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score
FROM search_chunks c JOIN vector_queries q ON q.query_id = c.label""",
)
def cosine_similarity_query(src: Source):
    asked = src.vector_queries.select(F.col("query_id").alias("label"), F.col("embedding").alias("q"))
    return src.search_chunks.join(asked, "label").select(
        "chunk_id", F.round(cosine_similarity(F.col("q"), F.col("embedding")), 9).alias("score")
    )


def _label_hits(where: str) -> str:
    return f"""SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY label_scores.score DESC, chunk_id) AS INT) AS rank
FROM label_scores WHERE document_id IN (SELECT id FROM ref_documents{where}) QUALIFY rank <= {2 * LIMIT}"""


@query("vector_topk", _label_hits(""))
def vector_topk(src: Source):
    hits = V.vector_topk(src.vector_queries, src.search_chunks, src.ref_documents, 2 * LIMIT, DIM)
    return hits.select("query_id", "chunk_id", _nine(), "rank")


@query("metadata_filters", _label_hits(" WHERE discipline = 'MEC' AND status = 'Approved'"))
def metadata_filters(src: Source):
    approved = src.ref_documents.where(F.col("status") == "Approved").select("id")
    hits = V.vector_topk(
        src.vector_queries, src.search_chunks, src.ref_documents, 2 * LIMIT, DIM, "MEC", approved
    )
    return hits.select("query_id", "chunk_id", _nine(), "rank")


def _layout(src: Source):
    """Lists of chunks with codes, their centres and their reach."""
    chunks = src.search_chunks.select("chunk_id", "document_id", "level", "embedding")
    centres = V.train_lists(V.usable_chunks(chunks, DIM), lists=100)
    path = new_folder(src.spark, "lists")
    V.write_lists(C.coded_lists(chunks, centres), path)
    listed = src.spark.read.parquet(path)
    return listed, centres, V.list_reach(V.usable_chunks(listed, DIM), centres)


def _list_search(src: Source, *asked, **filters):
    """Hits of the queries of each table in ``asked``, over one layout of the lists."""
    listed, centres, reach = _layout(src)
    return [C.vector_topk_codes(q, listed, src.ref_documents, centres, reach, 2 * LIMIT, DIM, probes=20, **filters) for q in asked]


@query("vector_topk_ivf", _label_hits(""))
def vector_topk_ivf(src: Source):
    """Over lists and codes, with the hits of the exact search."""
    return _list_search(src, src.vector_queries)[0].select("query_id", "chunk_id", _nine(), "rank")


@query("vector_topk_ivf_filtered", _label_hits(" WHERE discipline = 'MEC' AND status = 'Approved'"))
def vector_topk_ivf_filtered(src: Source):
    approved = src.ref_documents.where(F.col("status") == "Approved").select("id")
    hits = _list_search(src, src.vector_queries, discipline="MEC", document_ids=approved)[0]
    return hits.select("query_id", "chunk_id", _nine(), "rank")


@query("vector_topk_ivf_recall", f"SELECT count(*) AS hits, count(*) AS found, CAST(1 AS DOUBLE) AS recall FROM ({_label_hits('')})")
def vector_topk_ivf_recall(src: Source):
    exact = V.vector_topk(src.vector_queries, src.search_chunks, src.ref_documents, 2 * LIMIT, DIM)
    return V.recall(_list_search(src, src.vector_queries)[0], exact)


@query("vector_topk_all_lists", _label_hits(""))
def vector_topk_all_lists(src: Source):
    """A search of full vectors that probes every list finds what the exact one does."""
    listed, centres, _ = _layout(src)
    hits = V.vector_topk_lists(src.vector_queries, listed, src.ref_documents, centres, 2 * LIMIT, DIM, probes=100)
    return hits.select("query_id", "chunk_id", _nine(), "rank")


@query(
    "vector_topk_ivf_recall_bound",
    f"""SELECT count(*) AS hits, true AS enough FROM ({_label_hits("")})""",
)
def vector_topk_ivf_recall_bound(src: Source):
    """At least nine tenths of the exact hits are found, for the queries by label and for every 20th vector; hits are the former's."""
    sets = [src.vector_queries, src.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")]
    exact = [V.vector_topk(q, src.search_chunks, src.ref_documents, 2 * LIMIT, DIM) for q in sets]
    by_label, by_vector = (V.recall(found, want) for found, want in zip(_list_search(src, *sets), exact, strict=True))
    other = by_vector.select(F.col("recall").alias("other"))
    return by_label.crossJoin(other).select("hits", (F.least("recall", "other") >= 0.9).alias("enough"))


@query("build_text_index", "SELECT term, chunk_id, CAST(tf AS INT) AS tf, CAST(chunk_terms AS INT) AS chunk_terms FROM text_index")
def build_text_index(src: Source):
    return T.build_text_index(corpus_chunks(src))


def text_tables(src: Source):
    chunks = stored(children(src), "children")
    return stored(T.build_text_index(chunks), "index"), T.text_statistics(chunks), T.query_terms(src.text_queries)


@query("text_match", "SELECT DISTINCT query_id, chunk_id FROM text_matches")
def text_match(src: Source):
    index, _, wanted = text_tables(src)
    return T.text_match(index, wanted).select("query_id", "chunk_id").distinct()


@query("text_rank", "SELECT query_id, chunk_id, round(score, 9) AS score FROM text_scores")
def text_rank(src: Source):
    index, statistics, wanted = text_tables(src)
    return T.text_rank(T.text_match(index, wanted), statistics).select("query_id", "chunk_id", _nine())


@query("text_topk", "SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM text_hits")
def text_topk(src: Source):
    # with the index laid out by term bucket, of which a search reads those of its terms
    chunks = stored(children(src), "children")
    path = new_folder(src.spark, "index")
    T.write_text_index(T.build_text_index(chunks), path, buckets=16)
    index = T.read_text_index(src.spark, path, T.query_terms(src.text_queries), buckets=16)
    return T.text_topk(src.text_queries, index, T.text_statistics(chunks), 2 * LIMIT).select(
        "query_id", "chunk_id", _nine(), "rank"
    )


@query("text_topk_blocks", "SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM text_hits")
def text_topk_blocks(src: Source):
    """Over blocks of postings with their best weights, built in the same run."""
    path = new_folder(src.spark, "blocks")
    B.write_text_blocks(children(src), path, buckets=16)
    return B.text_topk_blocks(src.text_queries, path, 2 * LIMIT).select("query_id", "chunk_id", _nine(), "rank")


shared_sql("all_label_hits", _label_hits(""))
shared_sql("mec_label_hits", _label_hits(" WHERE discipline = 'MEC'"))


@query(
    "hybrid_fuse",
    f"""SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, chunk_id) AS INT) AS rank FROM (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id,
    round(coalesce(a.score, 0e0) * 0.6e0 + coalesce(b.score, 0e0) * 0.4e0, 9) AS score
  FROM all_label_hits a FULL JOIN mec_label_hits b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id) s
QUALIFY rank <= {LIMIT}""",
)
def hybrid_fuse(src: Source):
    # two hit lists that overlap in part: over all documents, and over those of one discipline
    everywhere = V.vector_topk(src.vector_queries, src.search_chunks, src.ref_documents, 2 * LIMIT, DIM)
    within = V.vector_topk(src.vector_queries, src.search_chunks, src.ref_documents, 2 * LIMIT, DIM, "MEC")
    fused = H.hybrid_fuse(everywhere.withColumn("score", F.round("score", 9)), within.withColumn("score", F.round("score", 9)), LIMIT)
    return fused.select("query_id", "chunk_id", _nine(), "rank")


@query("hybrid_search", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hybrid_hits")
def hybrid_search(src: Source):
    return Corpus(src).hits().select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


# chunks of the documents of one discipline that are labelled as good
shared_sql(
    "filtered_chunks",
    """SELECT chunk_id FROM child_texts WHERE document_id IN (SELECT id FROM corpus_documents WHERE discipline = 'ELC') AND document_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
shared_sql("filtered_corpus_scores", "SELECT * FROM corpus_scores WHERE chunk_id IN (SELECT chunk_id FROM filtered_chunks)")
shared_sql("filtered_text_scores", "SELECT * FROM text_scores WHERE chunk_id IN (SELECT chunk_id FROM filtered_chunks)")
shared_sql("filtered_vector_hits", _ranked("filtered_corpus_scores", 2 * LIMIT))
shared_sql("filtered_text_hits", _ranked("filtered_text_scores", 2 * LIMIT))
shared_sql(
    "filtered_fused_scores",
    """SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.chunk_id, t.chunk_id) AS chunk_id,
  round(coalesce(v.score, 0e0) * 0.6e0 + coalesce(t.score, 0e0) * 0.4e0, 12) AS score
FROM filtered_vector_hits v FULL JOIN filtered_text_hits t ON v.query_id = t.query_id AND v.chunk_id = t.chunk_id""",
)
shared_sql("filtered_hits", _ranked("filtered_fused_scores", LIMIT))
_FILTERED = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM filtered_hits"


def _good_documents(src: Source):
    return src.labels.where("quality = 1").select(F.col("doc_id").alias("id"))


@query("hybrid_search_filtered", _FILTERED)
def hybrid_search_filtered(src: Source):
    """Within a discipline and a list of documents, which are a bitmap that vectors and matches are tested with."""
    corpus = Corpus(src)
    by_discipline = stored(bitmap_of(corpus.documents, "id", "discipline"), "bitmaps")
    passing = stored(V.document_bitmap(by_discipline, "ELC", _good_documents(src)), "bitmap")
    return corpus.hits(bitmap=passing).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("hybrid_search_joined_filters", _FILTERED)
def hybrid_search_joined_filters(src: Source):
    """The same by joins with the tables of documents and of their list."""
    found = Corpus(src).hits(discipline="ELC", document_ids=_good_documents(src))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    "expand_parents",
    "SELECT query_id, chunk_id, round(score, 6) AS score, search_type, rank, place FROM expanded_hits",
)
def expand_parents(src: Source):
    corpus = Corpus(src)
    return H.expand_parents(stored(corpus.hits(), "hits"), corpus.chunks).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "search_type", "rank", "place"
    )


@query(
    "flatten_hits",
    """SELECT h.query_id, h.chunk_id, sha256(c.content) AS content_hash, d.id AS document_id, d.document_number, d.title, d.discipline,
  round(h.score, 6) AS score, h.search_type, count(*) OVER (PARTITION BY h.query_id) AS total
FROM expanded_hits h JOIN chunks c ON c.chunk_id = h.chunk_id JOIN corpus_documents d ON d.id = c.document_id""",
)
def flatten_hits(src: Source):
    corpus = Corpus(src)
    hits = stored(H.expand_parents(stored(corpus.hits(), "hits"), corpus.chunks), "expanded")
    return H.flatten_hits(hits, corpus.chunks, corpus.documents).select(
        "query_id", "chunk_id", F.sha2("content", 256).alias("content_hash"), "document_id", "document_number", "title",
        "discipline", F.round("score", 6).alias("score"), "search_type", "total",
    )
