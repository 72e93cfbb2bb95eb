"""Search: both physical paths against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.functions.bitmaps import MAX_BUCKETS, bitmap_of, in_bitmap
from paperloom.functions.text import numbered_terms, runs_of_letters, terms
from paperloom.functions.vectors import cosine_similarity, l2_normalize
from paperloom.operators import embedding as G
from paperloom.operators import hybrid_search as H
from paperloom.operators import text_blocks as B
from paperloom.operators import text_search as T
from paperloom.operators import vector_codes as C
from paperloom.operators import vector_search as V
from paperloom.session import new_folder

DIM = 8


@pytest.fixture(scope="module")
def vectors(spark):
    """300 children, a third of them copies of one vector, and 12 queries."""
    rng = np.random.default_rng(3)
    hot = rng.normal(size=DIM)
    rows = [
        (f"c{i:03d}", i % 10, "child", [float(x) for x in (hot if i % 3 == 0 else rng.normal(size=DIM))]) for i in range(300)
    ]
    rows += [("p0", 1, "parent", [1.0] * DIM), ("short", 1, "child", [1.0]), ("zero", 1, "child", [0.0] * DIM), ("none", 1, "child", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id long, level string, embedding array<double>").repartition(5)
    queries = spark.createDataFrame(
        [(q, [float(x) for x in (hot if q == 0 else rng.normal(size=DIM))]) for q in range(12)], "query_id long, embedding array<double>"
    )
    documents = spark.createDataFrame([(i, "ELC" if i < 5 else "MEC") for i in range(9)], "id long, discipline string")
    return queries, chunks, documents


def brute(queries, chunks, documents, k, allowed):
    found = []
    rows = [r for r in chunks.collect() if r.level == "child" and r.embedding is not None and len(r.embedding) == DIM and any(r.embedding) and r.document_id in allowed]
    for q in queries.collect():
        a = np.array(q.embedding)
        scored = []
        for r in rows:
            b = np.array(r.embedding)
            scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), r.chunk_id))
        found += [(q.query_id, c, n) for n, (_, c) in enumerate(sorted(scored)[:k], 1)]
    return set(found)


def ids(hits):
    return {(r.query_id, r.chunk_id, r["rank"]) for r in hits.collect()}


def test_exact_search_on_both_paths(spark, vectors):
    queries, chunks, documents = vectors
    want = brute(queries, chunks, documents, 7, set(range(9)))
    assert ids(V.vector_topk(queries, chunks, documents, 7, DIM)) == want
    assert ids(V.vector_topk(queries, chunks, documents, 7, DIM, max_sent=3, block_chunks=40)) == want


def test_filters_apply_before_the_cut(spark, vectors):
    queries, chunks, documents = vectors
    some = spark.createDataFrame([(i,) for i in (3, 4, 5, 6)], "id long")
    want = brute(queries, chunks, documents, 7, {3, 4})
    assert ids(V.vector_topk(queries, chunks, documents, 7, DIM, "ELC", some)) == want
    assert V.vector_topk(queries.where("query_id < 0"), chunks, documents, 7, DIM).count() == 0


def test_chunks_with_discipline_need_no_documents(spark, vectors):
    queries, chunks, documents = vectors
    own = chunks.withColumn("discipline", F.when(F.col("document_id") < 5, "ELC").otherwise("MEC"))
    want = ids(V.vector_topk(queries, chunks, documents, 7, DIM, "ELC"))
    assert ids(V.vector_topk(queries, own, None, 7, DIM, "ELC")) == want
    some = spark.createDataFrame([(i,) for i in (3, 4)], "id long")
    want = ids(V.vector_topk(queries, chunks, documents, 7, DIM, "ELC", some))
    assert ids(V.vector_topk(queries, own, None, 7, DIM, "ELC", some)) == want


def test_lists(spark, vectors):
    queries, chunks, documents = vectors
    usable = V.usable_chunks(chunks, DIM).where("chunk_id != 'zero'")
    centres = V.train_lists(usable, lists=6)
    path = new_folder(spark, "lists")
    V.write_lists(V.assign_lists(usable, centres), path)
    listed = spark.read.parquet(path)
    want = brute(queries, chunks, documents, 7, set(range(9)))
    everything = V.vector_topk_lists(queries, listed, documents, centres, 7, DIM, probes=len(centres))
    assert ids(everything) == want
    sent = V.vector_topk_lists(queries, listed, documents, centres, 7, DIM, probes=2)
    blocks = V.vector_topk_lists(queries, listed, documents, centres, 7, DIM, probes=2, max_sent=3, block_chunks=25)
    assert ids(sent) == ids(blocks)
    exact = V.vector_topk(queries, chunks, documents, 7, DIM)
    assert V.recall(sent, exact).collect()[0].recall >= 0.4


def test_recall_on_test_vectors(spark):
    from paperloom.plans.catalogue import spark_queries

    row = spark_queries()["vector_topk_ivf_recall"](spark, "/root/testdata/sf0.01").collect()[0]
    assert row.recall == 1.0


def test_lists_with_their_reach_find_all_hits(spark, vectors):
    queries, chunks, documents = vectors
    usable = V.usable_chunks(chunks, DIM)
    centres = V.train_lists(usable.where("chunk_id != 'zero'"), lists=12)
    listed = V.assign_lists(usable, centres)
    reach = V.list_reach(listed, centres)
    want = brute(queries, chunks, documents, 7, set(range(9)))
    assert ids(V.vector_topk_lists(queries, listed, documents, centres, 7, DIM, probes=1)) != want
    assert ids(V.vector_topk_lists(queries, listed, documents, centres, 7, DIM, probes=1, reach=reach)) == want
    blocks = V.vector_topk_lists(queries, listed, documents, centres, 7, DIM, probes=1, max_sent=3, block_chunks=25, reach=reach)
    assert ids(blocks) == want
    # so few chunks pass that a query's own lists hold less than k of them
    few = spark.createDataFrame([(3,)], "id long")
    filtered = V.vector_topk_lists(queries, listed, documents, centres, 7, DIM, probes=1, document_ids=few, reach=reach)
    assert ids(filtered) == brute(queries, chunks, documents, 7, {3})


@pytest.fixture(scope="module")
def coded(spark, vectors):
    """Lists with codes, their centres and their reach."""
    usable = V.usable_chunks(vectors[1], DIM)
    centres = V.train_lists(usable.where("chunk_id != 'zero'"), lists=12)
    path = new_folder(spark, "lists")
    V.write_lists(C.with_codes(V.assign_lists(usable, centres), DIM), path)
    listed = spark.read.parquet(path)
    return listed, centres, V.list_reach(listed, centres)


def test_codes_bound_every_score(spark, vectors):
    rows = C.with_codes(vectors[1].select("chunk_id", "embedding"), DIM).collect()
    q = np.random.default_rng(1).normal(size=(40, DIM))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    seen = 0
    for r in rows:
        v = None if r.embedding is None else np.array(r.embedding, dtype=float)
        if v is None or len(v) != DIM or not np.linalg.norm(v) > 0:
            assert r.code is None and r.scale is None and r.miss is None
            continue
        near = q @ (np.frombuffer(r.code, dtype=np.int8) * r.scale)
        assert (np.abs(q @ (v / np.linalg.norm(v)) - near) <= r.miss + 1e-12).all() and r.miss < 0.05
        seen += 1
    assert seen > 20


def test_search_by_codes_is_exact(spark, vectors, coded):
    queries, chunks, documents = vectors
    listed, centres, reach = coded
    want = brute(queries, chunks, documents, 7, set(range(9)))
    for probes in (1, 5, len(centres)):
        assert ids(C.vector_topk_codes(queries, listed, documents, centres, reach, 7, DIM, probes=probes)) == want
    assert ids(C.vector_topk_codes(queries, listed, documents, centres, reach, 7, DIM, probes=1, max_sent=3)) == want
    some = spark.createDataFrame([(i,) for i in (3, 4, 5, 6)], "id long")
    filtered = C.vector_topk_codes(queries, listed, documents, centres, reach, 7, DIM, 2, "ELC", some)
    assert ids(filtered) == brute(queries, chunks, documents, 7, {3, 4})
    # more hits asked for than there are chunks
    assert ids(C.vector_topk_codes(queries, listed, documents, centres, reach, 10_000, DIM, 2)) == brute(queries, chunks, documents, 10_000, set(range(9)))
    assert C.vector_topk_codes(queries.limit(0), listed, documents, centres, reach, 7, DIM).count() == 0
    assert C.vector_topk_codes(queries, listed.limit(0), documents, centres, reach, 7, DIM).count() == 0


def test_search_by_codes_with_ties(spark):
    rows = [(i, 1, "child", [1.0, 0.0] if i % 3 else [0.6, 0.8]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, level string, embedding array<float>")
    centres = np.eye(2)
    listed = C.with_codes(V.assign_lists(chunks.repartition(5), centres), 2)
    queries = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0])], "query_id long, embedding array<double>")
    got = C.vector_topk_codes(queries, listed, None, centres, V.list_reach(listed, centres), 5, 2, probes=1).collect()
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == {(0, i, n + 1) for n, i in enumerate([1, 2, 4, 5, 7])} | {(2, 3 * n, n + 1) for n in range(5)}


def test_few_full_vectors_are_read(spark):
    """On the vectors of the test tables, which have no clusters, and for 10 queries."""
    from paperloom.plans.search import _layout
    from paperloom.sources.views import Source

    src = Source(spark, "/root/testdata/sf0.1")
    listed, centres, reach = _layout(src)
    matrix = np.array([r.embedding for r in src.vector_queries.collect()], dtype=float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    pairs = C.hopeful_chunks(matrix, listed, None, centres, reach, 20, probes=20)
    assert pairs.select("chunk_id").distinct().count() < 0.2 * listed.where("level = 'child'").count()
    scans = C._bounded(listed, matrix, 20, np.arange(100)[None].repeat(10, 0), np.zeros(10))._jdf.queryExecution().executedPlan().toString()
    assert "code" in scans.split("ReadSchema")[1] and "embedding" not in scans.split("ReadSchema")[1]


def test_lists_out_of_reach_are_not_read():
    centres = np.eye(3)
    able = V.further_lists(np.array([[1.0, 0.0, 0.0]] * 2), centres, 1, np.array([0.1, 0.2, -1.0]), np.array([0.9, -np.inf]))
    assert able.tolist() == [[False, False, False], [False, True, False]]


def test_list_search_of_the_query_finds_nine_tenths(spark):
    from paperloom.plans.catalogue import spark_queries

    asked = spark_queries()
    row = asked["vector_topk_ivf_recall"](spark, "/root/testdata/sf0.01").collect()[0]
    assert row.recall >= 0.9
    assert asked["vector_topk_ivf_recall_bound"](spark, "/root/testdata/sf0.01").collect()[0].enough


WORDS = ["pump", "valve", "motor", "panel", "cable", "relay"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i:03d}", "child", "common " + " ".join(rng.choice(WORDS, size=rng.integers(1, 9)))) for i in range(120)]
    chunks = spark.createDataFrame(rows, "chunk_id string, level string, content string")
    queries = spark.createDataFrame(
        [(1, "the common Pump"), (2, "relay motor valve"), (3, "pump unknownword"), (4, "common"), (5, "of the")], "query_id long, query string"
    )
    return queries, chunks


def brute_text(queries, chunks):
    rows = chunks.select("chunk_id", terms(F.col("content")).alias("t")).collect()
    lengths = [len(r.t) for r in rows]
    mean, n = sum(lengths) / len(lengths), len(rows)
    scores = {}
    for q in queries.select("query_id", terms(F.col("query")).alias("t")).collect():
        wanted = set(q.t)
        for r in rows:
            if wanted and wanted <= set(r.t):
                total = 0.0
                for t in wanted:
                    df, tf = sum(t in x.t for x in rows), r.t.count(t)
                    total += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(r.t) / mean))
                scores[(q.query_id, r.chunk_id)] = round(total / (1 + total), 9)
    return scores


@pytest.mark.parametrize("max_rows, lookup_rows", [(100_000, 500_000), (0, 0)])
def test_text_search_on_both_paths(spark, texts, monkeypatch, max_rows, lookup_rows):
    queries, chunks = texts
    monkeypatch.setattr(T, "LOOKUP_ROWS", lookup_rows)
    index = T.build_text_index(chunks)
    matches = T.text_match(index, T.query_terms(queries), max_rows=max_rows)
    ranked = T.text_rank(matches, T.text_statistics(chunks)).collect()
    assert {(r.query_id, r.chunk_id): round(r.score, 9) for r in ranked} == brute_text(queries, chunks)


def test_index_counts_and_buckets(spark, texts, tmp_path):
    queries, chunks = texts
    index = T.build_text_index(chunks)
    counted = {(r.term, r.chunk_id): (r.tf, r.chunk_terms) for r in index.collect()}
    for r in chunks.select("chunk_id", terms(F.col("content")).alias("t")).collect():
        assert all(counted[(t, r.chunk_id)] == (r.t.count(t), len(r.t)) for t in set(r.t))
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    T.write_text_index(index, str(tmp_path / "i"), buckets=8)
    wanted = T.query_terms(queries.where("query_id = 2"))
    part = T.read_text_index(spark, str(tmp_path / "i"), wanted, buckets=8)
    have = {(r.term, r.chunk_id) for r in part.collect()}
    assert have <= set(counted) and {k for k in counted if k[0] in ("relay", "motor", "valve")} <= have


def test_fusion_and_parents(spark):
    vector = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.4)], "query_id long, chunk_id long, score double")
    text = spark.createDataFrame([(1, 10, 1.0), (1, 12, 0.9)], "query_id long, chunk_id long, score double")
    hits = H.hybrid_fuse(vector, text, 3)
    assert [(r.chunk_id, round(r.score, 9)) for r in hits.orderBy("rank").collect()] == [(10, 0.7), (12, 0.36), (11, 0.24)]
    chunks = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (1, None), (2, None)], "chunk_id long, parent_id long")
    rows = H.expand_parents(hits, chunks).orderBy("rank", "place").collect()
    assert [(r.chunk_id, r.search_type) for r in rows] == [
        (10, "hybrid"), (1, "parent_expansion"), (12, "hybrid"), (2, "parent_expansion"), (11, "hybrid"),
    ]


def test_embeddings(spark):
    chunks = spark.createDataFrame([(1, "pump a"), (2, "pump a"), (3, "valve"), (4, "")], "chunk_id long, content string")
    encoded = []

    def encoder(df):
        encoded.append(df.count())
        return G.encode_text(df, 16)

    first = G.embed_distinct(chunks, encoder)
    rows = {r.chunk_id: r.embedding for r in first.collect()}
    assert encoded == [3] and rows[1] == rows[2] != rows[3] and not any(rows[4])
    known = first.select("file_hash", "embedding").dropDuplicates(["file_hash"])
    again = {r.chunk_id: r.embedding for r in G.embed_distinct(chunks, encoder, known).collect()}
    assert encoded == [3, 0] and again == rows

    def load():
        return lambda batch: np.array([[len(t), 1.0] for t in batch])

    model = {r.chunk_id: r.embedding for r in G.embed_distinct(chunks, G.model_encoder(load, batch=2)).collect()}
    assert model == {1: [6.0, 1.0], 2: [6.0, 1.0], 3: [5.0, 1.0], 4: [0.0, 1.0]}


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(cosine_similarity(F.col("a"), F.col("b")).alias("c"), l2_normalize(F.col("a")).alias("n")).collect()
    assert rows[0].c == pytest.approx(0.96) and rows[0].n == pytest.approx([0.6, 0.8])
    assert rows[1].c is None and rows[1].n == [0.0, 0.0]


def test_one_schema_whatever_the_number_of_queries(vectors):
    queries, chunks, documents = vectors
    for kind in ("int", "long", "string"):
        asked = queries.withColumn("query_id", F.col("query_id").cast(kind))
        sent = V.vector_topk(asked, chunks, documents, 3, DIM)
        blocked = V.vector_topk(asked, chunks, documents, 3, DIM, max_sent=5, block_chunks=40)
        none = V.vector_topk(asked.limit(0), chunks, documents, 3, DIM)
        assert sent.dtypes == blocked.dtypes == none.dtypes and none.count() == 0


def test_lists_beside_bad_vectors_and_without_queries(spark, vectors):
    queries, chunks, documents = vectors
    centres = np.eye(3)
    rows = [("a", [1.0, 0.0, 0.0]), ("long", [1.0] * 5), ("b", [0.0, 0.0, 1.0]), ("short", [1.0]), ("none", None)]
    frame = spark.createDataFrame([(i, 1, "child", v) for i, v in rows], "chunk_id string, document_id long, level string, embedding array<double>")
    listed = V.assign_lists(frame.coalesce(1), centres)
    assert {r.chunk_id: r.list_id for r in listed.collect()} == {"a": 0, "b": 2}
    known = V.assign_lists(chunks, V._unit(np.random.default_rng(1).normal(size=(4, DIM))))
    hits = V.vector_topk_lists(queries.limit(0), known, documents, np.eye(4, DIM), 3, DIM)
    assert hits.count() == 0


def test_hybrid_search_leaves_orphans_out(spark):
    chunks = spark.createDataFrame(
        [("kept", 1, "child", "blue pump", [1.0, 0.0]), ("orphan", 2, "child", "blue pump", [1.0, 0.0]), ("other", 3, "child", "blue pump", [0.0, 1.0])],
        "chunk_id string, document_id long, level string, content string, embedding array<double>",
    )
    documents = spark.createDataFrame([(1, "ELC"), (3, "MEC")], "id long, discipline string")
    queries = spark.createDataFrame([(1, "blue pump", [1.0, 0.0])], "query_id long, query string, embedding array<double>")
    found = lambda **more: [
        r.chunk_id
        for r in H.hybrid_search(queries, chunks, documents, T.build_text_index(chunks), T.text_statistics(chunks), 2, **more).orderBy("rank").collect()
    ]
    assert found() == ["kept", "other"] and found(discipline="MEC") == ["other"] and found(candidates=1, limit=5) == ["kept"]


def test_stored_vectors_are_not_moved(spark):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    store = G.VectorStore(spark, "stored_vectors_test", buckets=4)
    asked = []

    def encoder(texts):
        asked.append(texts.count())
        return G.encode_text(texts, DIM)

    want = {(r.chunk_id, tuple(r.embedding)) for r in G.embed_distinct(chunks, lambda t: G.encode_text(t, DIM)).collect()}
    assert store.embed(chunks.where("chunk_id < 25"), encoder).count() == 25
    got = store.embed(chunks, encoder)
    assert {(r.chunk_id, tuple(r.embedding)) for r in got.collect()} == want
    assert store.embed(chunks, encoder).count() == 200 and asked == [25, 15, 0] and store.vectors().count() == 40
    # above the scan of the store there is no exchange: one for the chunks is all
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_bitmaps_of_documents(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 5_000_000_000, 98_304, -3, -32768, None]
    documents = spark.createDataFrame([(n, "ELC" if i % 3 else "MEC") for i, n in enumerate(numbers)], "id long, discipline string")
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([*numbers, 2, 9, 40_000, -4, 5_000_000_001])], "chunk_id long, document_id long")
    kept = lambda df: sorted(r.document_id for r in df.collect())
    every = bitmap_of(documents, "id", "discipline")
    elc = [n for i, n in enumerate(numbers) if i % 3 and n is not None]
    for most in (MAX_BUCKETS, 0):  # sent around, and shuffled
        assert kept(in_bitmap(rows, "document_id", V.document_bitmap(every), most)) == sorted(n for n in numbers if n is not None)
        assert kept(in_bitmap(rows, "document_id", V.document_bitmap(every, "ELC"), most)) == sorted(elc)
    some = spark.createDataFrame([(n,) for n in (1, 8, 32768, 2, -3, None)], "id long")
    assert kept(in_bitmap(rows, "document_id", V.document_bitmap(every, "ELC", some))) == sorted({1, 8, 32768, 2, -3} & set(elc))
    assert kept(in_bitmap(rows, "document_id", bitmap_of(documents.limit(0), "id"))) == []


def test_filtered_vectors_are_not_moved(spark, vectors):
    queries, chunks, documents = vectors
    bitmap = V.document_bitmap(bitmap_of(documents, "id", "discipline"), "ELC", spark.createDataFrame([(i,) for i in (3, 4, 5, 6)], "id long"))
    allowed = V.metadata_filters(V.usable_chunks(chunks, DIM), documents, bitmap=bitmap)
    assert "Exchange hashpartitioning" not in allowed._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    want = brute(queries, chunks, documents, 7, {3, 4})
    assert ids(V.vector_topk(queries, chunks, documents, 7, DIM, bitmap=bitmap)) == want


@pytest.fixture(scope="module")
def passages(spark):
    """Chunks of few terms, many of them with equal scores, odd ones among them, and queries of one to three terms."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(12)]
    shares = np.array([2.0**-i for i in range(12)])
    rows = []
    for i in range(900):
        drawn = rng.choice(vocabulary, size=int(rng.integers(1, 9)), p=shares / shares.sum())
        rows.append((f"c{i:04d}", "child", " ".join(drawn)))
    rows += [(f"same{i}", "child", "w0 w1 w5") for i in range(40)]
    rows += [("p", "parent", "w0 w1"), ("none", "child", None), ("empty", "child", ""), ("stop", "child", "the of and")]
    chunks = spark.createDataFrame(rows, "chunk_id string, level string, content string").repartition(3)
    asked = ["w0", "w0 w1", "w5 w0", "w9 w10", "w11 w3 w0", "w0 unknown", "the", "", None, "w0 w0"]
    return chunks, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")


def listed(hits):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 10)) for r in hits.collect())


@pytest.mark.parametrize(("bits", "first", "max_rows"), [(2, 1, 1000), (3, 2, 0), (12, 8, 1000)])
def test_blocks_find_what_the_index_finds(passages, tmp_path, bits, first, max_rows):
    chunks, queries = passages
    B.write_text_blocks(chunks, str(tmp_path / "b"), buckets=4, bits=bits)
    index, statistics = T.build_text_index(chunks), T.text_statistics(chunks)
    want = listed(T.text_topk(queries, index, statistics, 7))
    assert want and listed(B.text_topk_blocks(queries, str(tmp_path / "b"), 7, first=first, max_rows=max_rows)) == want
    allowed = chunks.where("chunk_id LIKE '%3'").select("chunk_id")
    within = listed(T.text_topk(queries, index, statistics, 7, allowed=allowed))
    assert within and listed(B.text_topk_blocks(queries, str(tmp_path / "b"), 7, first=first, max_rows=max_rows, allowed=allowed)) == within


def test_blocks_that_cannot_hold_a_hit_are_not_read(passages, tmp_path):
    chunks, queries = passages
    B.write_text_blocks(chunks, str(tmp_path / "b"), buckets=4, bits=3)
    search = B.BlockSearch(queries, str(tmp_path / "b"), 3, first=2)
    read = {r.query_id: (r.blocks, r.read) for r in search.blocks_read().collect()}
    # the rare terms w9 and w10 meet in few stretches; a query with an unknown term reads nothing
    assert read[3][1] < read[3][0]
    assert read[5][1] == 0
    assert sum(r for _, r in read.values()) * 2 < sum(b for b, _ in read.values())
    assert search.hits().count() > 0


def test_blocks_are_bounded_and_hold_every_posting(spark, passages, tmp_path):
    chunks, _ = passages
    B.write_text_blocks(chunks, str(tmp_path / "b"), buckets=4, bits=4)
    blocks = spark.read.parquet(str(tmp_path / "b/blocks"))
    assert blocks.agg(F.max("n")).first()[0] <= 16
    flat = blocks.select("term", F.inline("postings")).select("term", "chunk_id", "tf", "chunk_terms")
    index = T.build_text_index(chunks)
    assert flat.exceptAll(index).count() == index.exceptAll(flat).count() == 0
    assert blocks.where("first > last OR size(postings) <> n").count() == 0


def test_blocks_of_no_chunks(passages, tmp_path):
    chunks, queries = passages
    B.write_text_blocks(chunks.limit(0), str(tmp_path / "b"), buckets=4)
    assert B.text_topk_blocks(queries, str(tmp_path / "b"), 3).count() == 0


def test_terms_of_a_batch_are_counted_as_those_of_each_text(spark, monkeypatch):
    """Odd texts in slices of two rows: null, empty, stop words only, upper case, other scripts, blanks at the ends."""
    texts = [None, "", "the and of", " Pump PUMP pump-2 Straße ÉTÉ ", " насос насос\t水泵 x", "the pump the", "..."]
    chunks = spark.createDataFrame([(i, "child", t) for i, t in enumerate(texts)], "chunk_id long, level string, content string").coalesce(1)
    monkeypatch.setattr(T, "ROWS_AT_ONCE", 2)
    got = sorted((r.chunk_id, r.term, r.tf, r.chunk_terms) for r in T.build_text_index(chunks).collect())
    listed = {r[0]: r[1] for r in chunks.select("chunk_id", terms("content")).collect()}
    assert got == sorted((i, t, ts.count(t), len(ts)) for i, ts in listed.items() for t in set(ts or []))
    assert listed[3] == ["pump", "pump", "pump", "2", "straße", "été"] and listed[2] == listed[1] == []
    runs = chunks.select(runs_of_letters(F.col("content")).alias("r")).toArrow().column("r").combine_chunks()
    row, number, distinct = numbered_terms(runs)
    assert [distinct[n].as_py() for n in number.tolist()] == [t for i in range(len(texts)) for t in listed[i] or []] and len(row) == len(number)


def test_blocks_are_made_where_their_chunks_are_read(spark):
    """Batches of three rows, stretches of eight: a block goes over batches, and no posting is moved."""
    rows = [(f"c{i}", 2 + i % 3, None if i % 5 == 4 else [("a", 1 + i % 3), (f"t{i % 2}", 1)]) for i in range(40)]
    counted = spark.createDataFrame(rows, "chunk_id string, chunk_terms int, counts array<struct<term:string,tf:int>>").repartition(2)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        blocks = B.blocks_of(counted, 3.0, bits=3)
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        made = blocks.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert plan.count("Exchange") == plan.count("Exchange RoundRobin") == 1
    assert len({(b.term, b.stretch) for b in made}) == len(made)
    flat = sorted((p.chunk_id, b.term, p.tf, p.chunk_terms) for b in made for p in b.postings)
    assert flat == sorted((c, t, tf, n) for c, n, counts in rows for t, tf in counts or [])
    for b in made:
        numbers = [p.number for p in b.postings]
        assert (b.n, b.first, b.last) == (len(numbers), min(numbers), max(numbers)) and {x >> 3 for x in numbers} == {b.stretch}
        assert b.best == max(T.bm25_weight(p.tf, p.chunk_terms, 3.0) for p in b.postings)


def test_queries_are_spread_over_lists_a_few_at_once(monkeypatch):
    """A batch of queries for which no list can be ruled out; their rows come in small batches, and are those of one."""
    monkeypatch.setattr(V, "_ROWS", 64)
    rng = np.random.default_rng(2)
    centres, vectors = V._unit(rng.normal(size=(16, DIM))), rng.normal(size=(50, DIM))
    floors = [None if i % 2 else -1.0 for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(vectors.tolist()), pa.array(floors, pa.float64())], ["query_id", "embedding", "floor"])
    for reach, n in ((None, 3), (np.full(16, 3.0), 13)):
        made = list(V.probes_of_batch(batch, centres, reach, 3))
        assert max(b.num_rows for b in made) <= 64
        rows = pa.Table.from_batches(made).to_pylist()
        nearest = V.nearest_lists(V._unit(vectors), centres, 3)
        want = [(q, x) for q in range(50) for x in range(16) if (x in nearest[q]) == (reach is None)]
        assert sorted((r["query_id"], r["list_id"]) for r in rows) == want and len(rows) == 50 * n
        assert all(r["embedding"] == vectors[r["query_id"]].tolist() for r in rows)


def test_lists_and_codes_are_made_in_one_pass(spark, vectors):
    _, chunks, _ = vectors
    centres = V._unit(np.random.default_rng(4).normal(size=(6, DIM)))
    both = C.coded_lists(chunks, centres)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = C.with_codes(V.assign_lists(chunks, centres), DIM)
    assert both.schema == want.schema and both.exceptAll(want).count() == want.exceptAll(both).count() == 0 < both.count()


def test_ids_that_are_held_do_not_hold_their_codes():
    def batch():
        sink = pa.BufferOutputStream()
        made = pa.record_batch([pa.array(range(1000)), pa.array([bytes(1000)] * 1000, pa.binary())], ["chunk_id", "code"])
        with pa.ipc.new_stream(sink, made.schema) as out:
            out.write_batch(made)
        return pa.ipc.open_stream(pa.BufferReader(sink.getvalue())).read_next_batch()

    before = pa.total_allocated_bytes()
    held = [C._alone(batch().column(0)) for _ in range(5)]
    assert pa.total_allocated_bytes() - before < 500_000
    assert all(h.to_pylist() == list(range(1000)) for h in held)
