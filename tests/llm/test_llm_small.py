"""The operators against brute force on small inputs, with nulls, empty texts, ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm.common import slices_of
from paperloom.llm import chunk_recipes, decontamination, packing, quality_gam, simhash_bytes, suffix_dedup, tokens
from paperloom.llm.components import components
from paperloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, "a", None),
    (3, "One two. Three four five\n" * 40, "en", "b", 1),
    (4, "ONE two. THREE four five\n" * 40, "en", None, 1),
    (4, "ONE two. THREE four five\n" * 40, "en", None, 1),
    (None, "é́ß Straße ① don't 'tis a b\x1cc <|endoftext|> 12,34 ÀÉ", "de", "c", 2),
    (9, "word " * 30000, "en", "b", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_duplicates(odd, none):
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept, r.text_sha256) for r in chunk_recipes.exact_duplicates(odd).collect())
    groups = defaultdict(list)
    for d, t, *_ in ODD:
        groups[low(t)].append(d or 0)
    want = []
    for t, ids in groups.items():
        for n, d in enumerate(sorted(ids, reverse=True)):
            want.append((d, max(ids), len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    assert chunk_recipes.exact_duplicates(none).count() == 0


def test_chunks_join_to_the_text_and_shared_hashes_are_told_apart(spark, odd):
    text = F.coalesce("text", F.lit(""))
    chunks = F.regexp_extract_all(text, F.lit(chunk_recipes.CHUNK), F.lit(0))
    assert odd.where(F.array_join(chunks, "") != text).count() == 0
    shared = spark.createDataFrame([(1, 5, b"x"), (2, 5, b"y"), (3, 6, b"x")], "r long, h long, s binary")
    assert sorted((r.h, bytes(r.s), r.n) for r in chunk_recipes.chunk_dictionary(shared).collect()) == [(5, b"x", 1), (5, b"y", 2), (6, b"x", 1)]


def test_without_duplicates_keeps_rows_as_they_are(odd):
    left = chunk_recipes.without_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["2", "4", "None", "9"])


def brute_contamination(docs, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(name)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d or 0, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block_chars", [8_000_000, 300])
def test_decontamination(spark, monkeypatch, block_chars):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", block_chars)
    draw = random.Random(5)
    text = lambda n: " ".join(draw.choice(["a", "bé", "C", "d1", "e"][: 2 + n % 4]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 13, 14, 20, 40, 1, 2])] + [(7, None), (8, ""), (None, "x y"), (3, "a, a a"), (11, "q " * 30)]
    docs = [(i, text(n) + tail) for i, n in enumerate([0, 1, 5, 30, 200, 400]) for tail in ("", " x, Y!", " z " + items[4][1])]
    docs += [(90, None), (91, ""), (None, items[2][1]), (92, "q " * 5000), (92, "q " * 5000)]
    got = decontamination.contamination_report(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int"),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n_words string"),
    )
    assert sorted((r[0] or 0, *r[1:]) for r in got.collect()) == brute_contamination(docs, items)


def test_decontamination_of_nothing(spark, odd, none):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.contamination_report(odd, nothing).collect()} == {0}
    assert decontamination.contamination_report(none, nothing).count() == 0
    assert decontamination.without_contaminated(odd, nothing).count() == len(ODD)


def test_fm_index_finds_and_locates_every_occurrence():
    draw = np.random.default_rng(1)
    symbols = draw.integers(1, 4, 3000)
    symbols[draw.integers(0, 3000, 150)] = 0
    symbols[-1] = 0
    index = decontamination.ShardIndex(symbols, 3)
    for size in (1, 2, 5):
        windows = np.array([symbols[i : i + size] for i in range(2990) if (symbols[i : i + size] > 0).all()])
        windows = np.unique(windows, axis=0)
        which, lo, hi = index.search(windows)
        assert len(which) == len(windows)
        for w, a, b in zip(windows, lo, hi, strict=True):
            want = [i for i in range(3000 - size) if (symbols[i : i + size] == w).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """Smallest id reachable over fingerprints within 4 bits."""
    fps = np.array([f for _, f in pairs], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = list(range(len(pairs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(pairs)):
            least = min(label[j] for j in np.flatnonzero(near[i]))
            if least < label[i]:
                label[i], changed = least, True
    ids = defaultdict(list)
    for (d, _), g in zip(pairs, label, strict=True):
        ids[g].append(d)
    return [min(ids[g]) for g in label]


def test_near_duplicates_of_the_corpus(table):
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_bytes.near_duplicates(table("documents")).collect()}
    fps = [(d, fingerprint(t)) for d, t in docs]
    assert {d: x[0] for d, x in got.items()} == {d: f"{f:016x}" for d, f in fps}
    assert [got[d][1] for d, _ in docs] == brute_components(fps)


@pytest.mark.parametrize("block", [2048, 16])
def test_components_of_planted_fingerprints(spark, block):
    """Chains, dense clouds and strangers; with a small block, lists meet block by block."""
    draw = random.Random(3)
    fps = {draw.getrandbits(64) for _ in range(150)}
    for _ in range(3):
        at = draw.getrandbits(64)
        for _ in range(40):
            fps.add(at)
            for _ in range(draw.randint(1, 5)):
                at ^= 1 << draw.randrange(64)
    center = draw.getrandbits(64)
    fps |= {center ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(150)}
    pairs = [(i, f) for i, f in enumerate(sorted(fps))]
    rows = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64)), i) for i, f in pairs], "doc_id long, fp long, _row long")
    got = {r.doc_id: r.component_id for r in simhash_bytes._with_components(rows, block).collect()}
    assert [got[i] for i, _ in pairs] == brute_components(pairs)


def test_any_four_positions_contain_a_triple():
    from itertools import combinations

    triples = [set(t) for t in simhash_bytes.position_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_near_duplicates_of_odd_rows(odd, none):
    got = simhash_bytes.near_duplicates(odd).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (9, 9)]
    assert {r.fingerprint for r in got if r.doc_id in (1, 2)} == {"0" * 16}
    left = simhash_bytes.without_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 9]
    assert simhash_bytes.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id as u", "id + 1 as v").union(spark.range(1).selectExpr("1000L as u", "1001L as v"))
    got = {(r.u, r.v) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 301)} | {(1001, 1000)}


def test_tokenizer_equals_the_library(table):
    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = [r.text for r in table("documents").collect()] + [r.html for r in table("pages").limit(20).collect()] + [t for _, t, *_ in ODD[:6]]
    texts += ["<|startoftext|>a", "İI ŞſK ﬁ ½² x́y é 'S I'LL we've", "a b　c\x85d", "日本語 テスト 123 ४५", "a|b<|c'd 'e", "\x0b\x0c\x1f"]
    got = tokens.WordTokenizer(tokens.definition_of(path)).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, dtype="<u2").tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def check_packing(docs, pieces, window=2048):
    plain = Tokenizer.from_file(tokenizer_path())
    ids = [plain.encode(t or "", add_special_tokens=False).ids + [1] for _, t in docs]
    by_doc, places = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[(p.doc_id, p.doc_tokens)].append(p)
        places[p.sequence_id].append((p.offset, p.length))
    for s, spans in places.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == window or s == max(places)
    assert sorted(places) == list(range(len(places)))
    want = defaultdict(list)
    for (d, _), x in zip(docs, ids, strict=True):
        want[(d, len(x))].append(x)
    assert want.keys() == by_doc.keys()
    for key, texts in want.items():
        starts = sorted(p.start for p in by_doc[key])
        assert sum(p.length for p in by_doc[key]) == key[1] * len(texts)
        assert len(starts) == len(by_doc[key])
        crcs = {zlib.crc32(np.array(x[p.start : p.start + p.length], dtype="<u4").tobytes()) for p in by_doc[key] for x in texts}
        assert {p.ids_crc32 for p in by_doc[key]} <= crcs


def test_packing_round_trip_and_mixture(table):
    rows = table("documents").collect()
    pieces = packing.pack(table("documents"), tokenizer_path()).collect()
    check_packing([(r.doc_id, r.text) for r in rows], pieces)
    source = {r.doc_id: r.source for r in rows}
    total, windows = defaultdict(int), max(p.sequence_id for p in pieces) + 1
    sent = defaultdict(lambda: defaultdict(int))
    for p in pieces:
        total[source[p.doc_id]] += p.length
        sent[source[p.doc_id]][p.sequence_id] += p.length
    whole = sum(total.values())
    for s, n in total.items():
        run = 0
        for k in range(windows - 2):
            run += sent[s][k]
            assert abs(run - (k + 1) * 2048 * n / whole) <= (len(total) if n == max(total.values()) else 2)


def test_packing_of_odd_rows_and_other_targets(odd, none):
    docs = [(d, t) for d, t, *_ in ODD]
    for targets in (None, {"a": 0.5, "b": 0.25, "c": 0.25}, {"b": 1.0}):
        check_packing(docs, packing.pack(odd, tokenizer_path(), targets, window=64).collect(), 64)
    check_packing(docs, packing.pack(odd, tokenizer_path(), window=4).collect(), 4)  # two queues for four sources
    assert packing.pack(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("weights", [[5, 1, 0, 7], [1, 1, 1, 1], [0, 0, 3, 0]])
def test_rounds_send_everything_once(weights):
    totals = [1000, 37, 512, 0]
    schedule = packing.Schedule(packing.plan_rounds(totals, weights, 16), 16)
    filled = defaultdict(int)
    for q, n in enumerate(totals):
        at = 0
        while at < n:
            step = min(n - at, 1 + at % 23)
            lengths, window, _ = schedule.pieces(q, at, step)
            assert lengths.sum() == step
            for k, x in zip(window.tolist(), lengths.tolist(), strict=True):
                filled[k] += x
            at += step
    assert sorted(filled) == list(range(-(-sum(totals) // 16)))
    assert all(n == 16 for k, n in filled.items() if k != max(filled))


def sent_by_window(schedule, totals):
    sent = np.zeros((len(totals), -(-sum(totals) // schedule.window)), dtype=np.int64)
    spans = defaultdict(list)
    for q, n in enumerate(totals):
        at = 0
        while at < n:
            step = min(n - at, 1 + (at * 7 + q) % 900)
            lengths, window, place = schedule.pieces(q, at, step)
            assert lengths.sum() == step
            np.add.at(sent[q], window, lengths)
            for k, a, x in zip(window.tolist(), place.tolist(), lengths.tolist(), strict=True):
                spans[k].append((a, x))
            at += step
    for found in spans.values():
        at = 0
        for a, x in sorted(found):
            assert a == at
            at += x
        assert at == schedule.window or found is spans[max(spans)]
    return sent


@pytest.mark.parametrize("queues", [46, 700])
def test_many_sources_keep_their_mixture_in_every_window(queues):
    draw = np.random.default_rng(queues)
    totals = np.maximum(1, draw.pareto(0.7, queues) * 40).astype(int).clip(max=200_000).tolist()
    sent = sent_by_window(packing.Schedule(packing.plan_rounds(totals, totals)), totals)
    whole, run = sum(totals), np.cumsum(sent, axis=1)[:, :-1]
    want = np.outer(totals, np.arange(1, run.shape[1] + 1) * 2048) / whole
    assert np.abs(run - want).max() < 2


def test_sources_not_named_wait_among_many():
    totals, weights = [500 + 11 * i for i in range(90)], [0] * 90
    weights[7], weights[50] = 3, 1
    sent = sent_by_window(packing.Schedule(packing.plan_rounds(totals, weights, 64), 64), totals)
    named = (totals[7] + totals[50]) // 64
    others = np.delete(sent, [7, 50], axis=0).sum(axis=0)
    assert not others[:named].any() and others[named + 1 :].all()
    assert np.abs(3 * sent[50, :9].cumsum() - sent[7, :9].cumsum()).max() <= 8


def test_large_counts_stay_exact():
    totals = [10**12 + 7, 3 * 10**12 + 1, 5, 10**6]
    schedule = packing.Schedule(packing.plan_rounds(totals, totals))
    for q, n in enumerate(totals):
        lengths, window, place = schedule.pieces(q, n - 5, 5)
        assert lengths.sum() == 5 and window.max() <= sum(totals) // 2048 and (place >= 0).all()


def test_packing_of_more_sources_than_the_window_has_room_for(spark):
    docs = [(i, f"word {i} " * (1 + i % 5 * 8), f"s{i % 60}") for i in range(240)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), tokenizer_path(), {"s3": 1.0}).collect()
    check_packing([d[:2] for d in docs], pieces)
    named = [p for p in pieces if p.doc_id % 60 == 3]
    assert sorted((p.sequence_id, p.offset) for p in pieces)[: len(named)] == sorted((p.sequence_id, p.offset) for p in named)


def test_packed_sequences_hold_the_ids_of_all_documents(odd, none):
    plain = Tokenizer.from_file(tokenizer_path())
    want = sorted([*plain.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in ODD)
    packed = packing.pieces(odd, tokenizer_path(), window=64)
    rows, whole = packed.collect(), {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert all(r.n_tokens == 64 for s, r in whole.items() if s != max(whole))
    # a document's ids, read from the sequences at the places of its pieces
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id or 0, r.doc_tokens, r.start, r.sequence_id)):
        at = np.frombuffer(whole[r.sequence_id].ids, dtype="<u4")[r.offset : r.offset + r.length].tolist()
        assert at == np.frombuffer(r.ids, dtype="<u4").tolist()
        found[r.doc_id, r.doc_tokens].append((r.start, at))
    single = [sum((ids for _, ids in x), []) for (d, _), x in found.items() if d != 4]
    assert sorted(single) == sorted([*plain.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in ODD if d != 4)
    assert sum(len(r.ids) // 4 for r in rows) == sum(map(len, want))
    assert packing.sequences(packing.pieces(none, tokenizer_path())).count() == 0


def test_the_pipeline_ends_in_token_ids(spark, odd):
    import corpus_pipeline

    last = corpus_pipeline.STAGES[-1][1](spark, odd, "")
    assert {"ids", "sequence_id", "offset"} <= set(last.columns)


def test_additive_model_learns_single_features_and_a_pair():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.3) + 2 * (x[:, 3] * x[:, 5] > 0) + 0.3 * draw.normal(size=4000) > 1.5).astype(float)
    model = quality_gam.PairwiseAdditiveModel().fit(x[:3000], y[:3000])
    assert (3, 5) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    slow = [
        model.base
        + sum(t[np.searchsorted(c, v, side="right")] for c, t, v in zip(model.cuts, model.tables, row, strict=True))
        + sum(
            t[np.searchsorted(model.pair_cuts[i], row[i], side="right"), np.searchsorted(model.pair_cuts[j], row[j], side="right")]
            for (i, j), t in zip(model.pairs, model.pair_tables, strict=True)
        )
        for row in x[:20]
    ]
    assert np.allclose(model.score(x[:20]), 1 / (1 + np.exp(-np.array(slow))))


def test_quality_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_gam.quality_scores(docs, labels)
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect()} == {True}
    judged = got.where("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in judged) >= 0.95 * len(judged) > 0


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 0), (3, 1), (None, 0), (4, 1)], "doc_id long, quality int")
    got = quality_gam.quality_scores(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == 1 for r in quality_gam.quality_scores(odd, labels.limit(0)).collect())
    assert quality_gam.quality_scores(none, labels).count() == 0
    assert quality_gam.without_low_quality(odd, labels.limit(0)).columns == odd.columns


def brute_repeats(docs, n):
    data = [(t or "").encode() for _, t in docs]
    times = defaultdict(int)
    for x in data:
        for i in range(len(x) - n + 1):
            times[x[i : i + n]] += 1
    out = []
    for (d, _), x in zip(docs, data, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if times[x[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        runs = sum(g and not before for g, before in zip(gone, b"\x00" + bytes(gone), strict=False))
        out.append((d or 0, len(x), len(x) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("n", [12, 200])
def test_repeated_passages(spark, n):
    draw = random.Random(n)
    text = lambda k, letters="abcdefgh é": "".join(draw.choice(letters) for _ in range(k))
    shared = [text(3 * n), text(n), text(n - 1 - n // 12), text(n + 1), "ab" * n, "x" * (3 * n)]
    docs = [(None, None), (0, ""), (1, "short"), (2, text(5 * n)), (2, "y" * n), (3, "é" * (2 * n))]
    for i in range(40):
        docs.append((10 + i, text(draw.randrange(2 * n)) + draw.choice(shared)[draw.randrange(n // 2) :] + text(draw.randrange(n)) + draw.choice(shared)))
    docs += [docs[-1], docs[-1], (99, text(2 * n) * 2), (98, text(60 * n, "ab"))]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, _row string")
    got = suffix_dedup.without_repeats(frame, n)
    assert sorted((r[0] or 0, *r[1:]) for r in got.collect()) == brute_repeats(docs, n)
    assert suffix_dedup.without_repeats(frame.limit(0), n).count() == 0


def test_repeated_passages_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROW_NUMBERS", 0)
    monkeypatch.setattr(suffix_dedup.without_repeats, "__defaults__", (200, 2))
    test_repeated_passages(spark, 12)


def test_repeated_passages_of_the_corpus(table):
    got = suffix_dedup.without_repeats(table("documents")).collect()
    assert sorted(tuple(r) for r in got) == brute_repeats([(r.doc_id, r.text) for r in table("documents").collect()], 200)


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_deduplicated_texts_and_their_columns(spark, monkeypatch, rows):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROW_NUMBERS", rows)
    docs = [(1, "abc" + "repeated é passage" + "xyz", "a", 2**60 + 1), (2, "repeated é passage", None, None), (None, "", "c", 3), (4, None, "d", 4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, _row long")
    got = {r.doc_id: r for r in suffix_dedup.deduplicated(frame, 12).collect()}
    assert suffix_dedup.deduplicated(frame, 12).columns == ["doc_id", "lang", "_row", "n_bytes", "spans", "kept"]
    assert {d: (r.lang, r._row, r.n_bytes, bytes(r.kept), [tuple(s) for s in r.spans]) for d, r in got.items()} == {
        1: ("a", 2**60 + 1, 25, b"abcxyz", [(3, 22)]),
        2: (None, None, 19, b"", [(0, 19)]),
        None: ("c", 3, 0, b"", []),
        4: ("d", 4, 0, b"", []),
    }


def test_slices_of_a_batch_are_bounded():
    """Without its last row, which may be of any size, a slice is smaller than asked for."""
    sizes = np.array([3, 0, 5, 1, 1, 40, 2, 0])
    ranges = list(slices_of(sizes, 6))
    assert [i for low, high in ranges for i in range(low, high)] == list(range(len(sizes)))
    assert all(sizes[low : high - 1].sum() < 6 for low, high in ranges) and len(ranges) > 1
    assert list(slices_of(sizes[:0], 6)) == []


def test_a_document_is_hit_in_whichever_slice_of_its_batch_it_is(spark, monkeypatch):
    """The search holds the index of a few documents at a time, one here, and gives what it gives for the batch."""
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 9 : i % 9 + 14])) for i in range(20)] + [(20, None)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("a", " ".join(words[2:15])), ("b", " ".join(words[8:21]))], "item_id string, text string")
    rows = lambda: sorted(tuple(r) for r in decontamination.contamination_report(docs, bench).collect())
    whole = rows()
    monkeypatch.setattr(decontamination, "SHARD_CHARS", 1)
    assert rows() == whole and {r[5] for r in whole} == {True, False}
