"""Mixing of sources, divergence of sources and repair of conversations, against brute force, with nulls, ties and odd rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from compare import connect, rows_of
from pyspark.sql import functions as F

from paperloom.llm import apportionment, conversation_repair, divergence, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, quota long, number long, term string, stretch long"
CONVERSATIONS = "conv_id long, turn long, role string, text string, part long, audit string, cost string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 0, 7, "x", 1, 2, "y", 3) for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_mix_sources", "op12_source_divergence"])
def test_query_and_sql(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    result = connect(folder).execute(queries.CHECKING_SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in result.description], result.fetchall())


def brute_targets(sizes, weights, most):
    free, targets = dict(weights), {}
    while True:
        rest = sum(sizes.values()) - sum(targets.values())
        share = {s: w * rest / sum(free.values()) for s, w in free.items()}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return targets | share
        for s in above:
            targets[s] = most * sizes[s]
            del free[s]


def test_mix_of_sources(spark):
    rng = random.Random(3)
    rows = [(i, "Wort " * rng.randint(0, 60), "en", rng.choice("aaaaaab")) for i in range(300)]
    rows += [(900, "x " * 9000, None, "long"), (901, "p q r", "en", "small"), (901, "p q r", "en", "small"), (902, None, "en", "blank"), (None, "a\x0bb c d", None, None), (904, "", "en", "")]
    docs = documents(spark, rows)
    mix = apportionment.mix_sources(docs, keep=("doc_id", "source"), shards=16)
    got = mix.withColumn("taken", apportionment.taken_words(mix)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len([w for w in re.split("[\x20\x09-\x0d]+", text or "") if w])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(names)}, 3)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size
        edges = [(s.start, s.start + s.length) for s in r.spans]
        assert all(a < b <= r.size for a, b in edges) and all(x[1] <= y[0] for x, y in zip(edges, edges[1:], strict=False))
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - targets[s]) <= 2 * apportionment.BLOCK_WORDS
    again = apportionment.mix_sources(docs.repartition(7), keep=("doc_id", "source"), shards=16).collect()
    assert Counter(map(str, again)) == Counter(str(r) for r in mix.collect())


def test_targets_are_cut_again_and_again(spark):
    sizes = {"a": 1, "b": 10, "c": 100, "d": 1000, "e": 100_000, "f": 0}
    df = spark.createDataFrame([(s, n, i % 3 + 1) for i, (s, n) in enumerate(sizes.items())], "source string, size long, weight long")
    got = {r.source: r.target for r in apportionment.capped_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(sizes)}, 3))


@pytest.mark.parametrize("house", [0, 1, 5, 40, 1000])
def test_seats_are_those_of_the_highest_quotients(spark, house):
    votes = [5.0, 5.0, 1.0, 80.5, 13.25, 0.0, 40.0, 40.0, 2.0]
    df = spark.createDataFrame(list(enumerate(votes)), "id long, votes double")
    ranked = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(house)))[:house]
    want = Counter(i for _, i in ranked)
    assert {r.id: r.seats for r in apportionment.apportion(df, "votes", house, "id").collect()} == {i: want[i] for i in range(len(votes))}


def test_quotas_within_groups(spark):
    rng = random.Random(5)
    rows = [(g, s, rng.choice([0, 1, 1, 2, 30])) for g in range(6) for s in range(12)]
    total = {g: sum(v for x, _, v in rows if x == g) for g in range(6)}
    house = {g: rng.randint(0, total[g]) for g in range(6)}
    df = spark.createDataFrame([(*r, house[r[0]]) for r in rows], "g long, s long, votes long, house long")
    got = {(r.g, r.s): r.quota for r in apportionment.apportion_within(df, "g", "votes", "house", "s").collect()}
    for g in range(6):
        ranked = sorted((-v / (2 * k + 1), s) for x, s, v in rows if x == g for k in range(v))[: house[g]]
        want = Counter(s for _, s in ranked)
        assert {s: got[g, s] for s in range(12)} == {s: want[s] for s in range(12)}


def test_mixed_texts(spark):
    rows = [(1, "one two three four " * 30, "en", "a"), (2, "five  six\nseven", "en", "b"), (3, None, "en", "c")]
    docs = documents(spark, rows)
    mix = apportionment.mix_sources(docs)
    words = {r.doc_id: r.n for r in mix.select("doc_id", apportionment.taken_words(mix).alias("n")).collect()}
    got = apportionment.mixed_texts(docs).collect()
    counted = Counter()
    for r in got:
        counted[r.doc_id] += len(r.text.split())
        assert r.start > 0 or r.text.split()[0] in ("one", "five")
    assert {d: counted[d] for d in words} == words
    assert "five  six\nseven" in {r.text for r in got}


def test_mix_of_nothing(spark):
    assert apportionment.mix_sources(documents(spark, [])).count() == 0
    still = apportionment.mix_sources(documents(spark, [(1, None, None, None), (2, " ", "en", "a")])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.repeats, r.spans) for r in still) == [(1, 0, 0.0, 0, []), (2, 0, 0.0, 0, [])]


def brute_divergence(rows, least, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        w = words(text)
        counts[lang or "", source or ""].update(w)
        in_docs[lang or ""].update(set(w))
    out = []
    for lang, source in counts:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        v = len(kept)

        def share(count, kept=kept, v=v):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * v) for t in kept}

        def ranked(part, found, most, lang=lang, source=source):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out.extend((lang, source, part, i, value, n + 1) for n, (i, value) in enumerate(found[:most]))

        p = share(counts[lang, source])
        every = Counter()
        for (other, s), c in counts.items():
            if other == lang:
                every.update(c)
        far = []
        for (other, s), c in counts.items():
            if other == lang and s != source:
                q = share(c)
                far.append((s, sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept)))
        ranked("pair", far, None)
        q = share(every)
        ranked("term", [(t, (p[t] - q[t]) ** 2 // (p[t] + q[t])) for t in kept if counts[lang, source][t] > 0 and p[t] > q[t]], top)
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyzéß" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZéß北"]
    rows = []
    for i in range(200):
        text = rng.choice([" ", "\x00", "1", "_"]).join(rng.choices(vocabulary, weights=[1 / (n + 1) for n in range(len(vocabulary))], k=rng.randint(0, 120)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s2", "s2", None, "ß", *map(str, range(9))])))
    rows += [(300, None, "fr", "s1"), (301, "", "fr", "s2"), (302, "alone", "it", "s1"), (303, "word " * 20_000 + "x" * 100_000, "en", "s1"), rows[0]]
    docs = documents(spark, rows)
    want = brute_divergence(rows, 5, 10)
    assert len({r[1] for r in want}) > 12
    for tile in (32, 3):  # sources in one tile, and in several
        got = divergence.source_divergence(docs, least_docs=5, tile=tile)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == want
    assert divergence.source_divergence(documents(spark, [])).count() == 0


def test_tiles_by_bitsets_equal_sums_over_terms():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 4, (6, 150))
    p = 1 + counts * 1000 + np.arange(6)[:, None]
    rows = [(f"s{g}", 0, 1 + g, 150, -1, 0, 0) for g in range(6)]
    for g in range(6):
        cells = defaultdict(int)
        for t in np.flatnonzero(counts[g]):
            cells[t // 64, p[g, t]] |= 1 << int(t % 64)
        rows += [(f"s{g}", 0, 1 + g, 0, w, s, b - (1 << 64) if b >> 63 else b) for (w, s), b in cells.items()]
    frame = pd.DataFrame(rows, columns=["source", "side", "zero", "terms", "word", "share", "bits"])
    got = {(r.a, r.b): r.value for r in divergence.compare_tiles(frame).itertuples()}
    assert got == {(f"s{a}", f"s{b}"): int(divergence.distances(p[a], p[b]).sum()) for a in range(6) for b in range(a + 1, 6)}


def damaged(conv, turn, role, text):
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = (" " if x is None else x for x in (role, text))
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def brute_repair(rows):
    """Cheapest edits by searching paths in the order of (cost, edits)."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.strip(" \t\n\v\f\r")[-1:]
        faults.append("b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, made = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            break
        for r, name in names.items():
            if (state, r) in after:
                heapq.heappush(heap, (cost + 3, audit + "I", i, after[state, r], (*made, f"{name}:")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
            if faults[i] not in ("b", "d"):
                _, role, text = rows[i]
                extra = 3 * (faults[i] == "t")
                if (state, role[:1]) in after:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, after[state, role[:1]], (*made, f"{role}:{text}")))
                for r, name in names.items():
                    if (state, r) in after:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, after[state, r], (*made, f"{name}:{text}")))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    text = "\n".join(made)
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost if rows else 0, audit if rows else "", hashlib.sha256(text.encode()).hexdigest()), text


def conversations():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "ad", "User"]
    texts = ["Yes.", "No", "", " \t\n", None, "Wait!", "é?", " ", "x. \x0b", "long. " * 3000]
    rows = []
    for conv in range(150):
        for _ in range(rng.randint(1, 14)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 9, -4]), rng.choice(roles), rng.choice(texts)))
    rows += [(None, t, r, x) for t, r, x in [(0, "user", "A?"), (1, "assistant", "B."), (2, "user", "A?")]]
    # longer than a run and a part, with texts that come back much later
    rows += [(777, t, rng.choice(roles[:4]), rng.choice([f"n{rng.randint(0, 900)}.", f"turn {t}", f"turn {t}!", ""])) for t in range(2600)]
    rows.append((888, 3, "user", "gone"))
    return rows


def test_repair_of_conversations(spark):
    rows = conversations()
    want, texts = {}, {}
    kept = defaultdict(list)
    for row in rows:
        kept[row[0]] += damaged(*row)
    for conv, left in kept.items():
        want[conv], texts[conv] = brute_repair(left)
    df = spark.createDataFrame([(*r, 5, "x", "y") for r in rows], CONVERSATIONS).repartition(5)
    got = conversation_repair.report_all(queries.damaged_rows(df), df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    assert set(found) == set(want)
    assert {c: found[c] for c in want if found[c] != want[c]} == {}

    turns = defaultdict(list)
    for r in conversation_repair.repaired_turns(queries.damaged_rows(df)).collect():
        turns[r.conv_id].append((r.turn, f"{r.role}:{r.text}", r.edit))
    for conv, text in texts.items():
        made = sorted(turns[conv])
        assert [t for t, _, _ in made] == list(range(len(made)))
        assert "\n".join(t for _, t, _ in made) == text
        assert "".join(e for _, _, e in made) == want[conv][6].replace("D", "")


def test_repair_of_the_given_conversations(spark, folder):
    kept = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        kept[r.conv_id] += damaged(r.conv_id, r.turn, r.role, r.text)
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op13_repair_conversations"](spark, folder).collect()}
    assert got == {conv: brute_repair(left)[0] for conv, left in kept.items()}


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert conversation_repair.report_all(queries.damaged_rows(df), df).count() == 0
    gone = next(t for t in range(99) if not damaged(1, t, "user", "x"))
    df = spark.createDataFrame([(1, gone, "user", "x", 0, "", "")], CONVERSATIONS)
    assert [tuple(r) for r in conversation_repair.report_all(queries.damaged_rows(df), df).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_block_tables_equal_single_symbols():
    known = conversation_repair.tables()
    rng = random.Random(2)
    for length in range(12):
        symbols = bytes(rng.randrange(conversation_repair.SYMBOLS) for _ in range(length))
        to, cost = known.run_map(symbols)
        for n, vector in enumerate(known.vectors):
            costs, total = vector, 0
            for symbol in reversed(symbols):
                costs, _ = conversation_repair.edits_before(costs, symbol)
                total, costs = total + costs[3], tuple(c - costs[3] for c in costs)
            assert (known.vectors[to[n]], cost[n]) == (costs, total)


def test_damage_is_by_whole_rows(spark):
    df = spark.createDataFrame([(*r, 5, "x", "y") for r in conversations()], CONVERSATIONS)
    assert queries.damaged_rows(df).where(F.col("role").isNull() | F.col("text").isNull()).count() == 0
