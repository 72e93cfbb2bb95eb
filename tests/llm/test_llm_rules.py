"""URL rules, revisits, license scans and token rollups against brute force, with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from paperloom.llm import license_scan, token_rollup, url_rules, warc_revisits
from paperloom.llm.common import WORD
from paperloom.llm.queries import QUERIES, STATED_RULES, archive_records, op9_token_rollup, tokenizer_path


def brute_rules(rows, support, confidence, gain):
    """All token sets of labelled rows by counting, pruned as the miner does."""
    n, sets, both = len(rows), Counter(), Counter()
    for tokens, label in rows:
        for k in range(len(tokens) + 1):
            for s in combinations(sorted(tokens), k):
                sets[s] += 1
                both[s, label] += 1
    sure = {x: c / sets[x[0]] for x, c in both.items() if x[0] and c / n >= support - 1e-12 and c / sets[x[0]] >= confidence}
    base = {label: sum(y == label for _, y in rows) / n for _, label in rows}
    out = {}
    for (s, label), c in sure.items():
        known = [base[label]] if len(s) == 1 else [sure[t, label] for t in combinations(s, len(s) - 1) if (t, label) in sure]
        if not known or c >= max(known) + gain:
            out[s, label] = round(c, 9)
    return out


def test_mined_rules_and_their_matches(spark):
    rows = []
    for i in range(120):
        tokens = {f"a{i % 3}", f"b{i % 4}", f"c{i % 5}"}
        rows.append((sorted(tokens), "block" if {"a1", "b2"} <= tokens or {"c3"} <= tokens and i % 7 else "allow"))
    frame = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = url_rules.mine_rules(frame, 0.03, 0.6, 0.05)
    got = {(tuple(r.tokens), r.label): round(r.confidence, 9) for r in rules.collect()}
    assert got == brute_rules(rows, 0.03, 0.6, 0.05) and (("a1", "b2"), "block") in got
    stored = spark.createDataFrame(rules.collect(), rules.schema)
    signatures = sorted({tuple(t) for t, _ in rows})
    found = url_rules.match_rules(spark.createDataFrame([(list(s),) for s in signatures], "signature array<string>"), stored)
    verdicts = {tuple(r.signature): r.label for r in found.collect()}
    for s in signatures:
        fits = [(r.confidence, r.support, r.label) for r in stored.collect() if set(r.tokens) <= set(s)]
        assert verdicts.get(s) == (max(fits)[2] if fits else None)


def brute_classes(rows, support):
    where = {}
    for n, (tokens, _) in enumerate(rows):
        for t in tokens:
            where.setdefault(t, set()).add(n)
    names = {}
    for t in sorted(where):
        if len(where[t]) >= support * len(rows):
            names.setdefault(frozenset(where[t]), t)
    return {t: names[frozenset(s)] for t, s in where.items() if frozenset(s) in names}


def test_tokens_of_the_same_pages_are_one_item(spark):
    rows = [(["a", "b", "x"], "block"), (["a", "b", "y"], "block"), (["c", "x", "z"], "allow"), (["c", "d"], "allow"), ([], "allow")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row long, tokens array<string>, label string")
    for support in (0.0, 0.3):
        got = {r.token: r["name"] for r in url_rules.token_classes(frame, support).collect()}
        assert got == brute_classes(rows, support)


def test_a_long_url_is_mined_at_once(spark):
    urls = [(i, f"http://h{i % 3}.org/a{i % 4}/b{i % 2}") for i in range(18)] + [(18, "http://long.org/" + "/".join(f"w{i}x" for i in range(400)))]
    urls += [(50, "http://other.org/" + "/".join(["v"] * 7) + "/w7x"), (51, "http://other.org/v")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, "block" if i in (3, 18) else "allow") for i in range(19)], "page_id long, label string")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, labels, []).collect()}
    # a token of the long page's class is enough
    assert (got[18], got[50], got[51]) == ("block", "block", "allow")


def test_every_verdict_of_the_given_pages(spark, folder, table):
    """Rules by counting token sets of all labelled pages, and the best that fits each page."""
    rows = {r.page_id: r for r in table("pages").select(
        "page_id", "url", url_rules.url_tokens(F.col("url"), url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("tokens")).collect()}
    labels = {r.doc_id: "block" if r.quality == 0 or r.toxic == 1 else "allow" for r in table("labels").collect()}
    known = [(rows[i].tokens, y) for i, y in labels.items() if i in rows]
    classes = brute_classes(known, url_rules.MIN_SUPPORT)
    named = [(sorted({classes[t] for t in tokens if t in classes}), y) for tokens, y in known]
    rules = brute_rules(named, url_rules.MIN_SUPPORT, url_rules.MIN_CONFIDENCE, url_rules.MIN_GAIN)
    support = Counter()
    for tokens, y in named:
        for s, label in rules:
            support[s, label] += label == y and set(s) <= set(tokens)
    got = {r.page_id: (r.rule, r.verdict) for r in QUERIES["op1_url_rules"](spark, folder).collect()}
    assert len(got) == len(rows)
    for i, row in rows.items():
        if got[i][0] is None:
            has = {classes[t] for t in row.tokens if t in classes}
            fits = [(c, support[s, y], y) for (s, y), c in rules.items() if set(s) <= has]
            assert got[i][1] == (max(fits)[2] if fits else "allow"), row.url


def test_stated_rules_and_odd_urls(spark):
    urls = [
        (1, "HTTP://A.Example.ORG/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"),
        (2, "http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        (4, "x://com/de/", "com", "/de/", "com/de/", "block"),
        (5, "http://a.com/xx/", "a.com", "/xx/", None, "allow"),
        (6, "http://org", "org", "", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme.org/es/", "", "", None, "allow"),
        (9, "http://b.org?u=c://d.com/de/", "b.org", "", None, "allow"),
        (9, "http://b.org?u=c://d.com/de/", "b.org", "", None, "allow"),
        (None, "http:///fr/\nx", "", "/fr/\nx", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u, *_ in urls], "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "page_id long, label string")
    got = url_rules.judge_urls(pages, none, STATED_RULES).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(key((i, h, p, r, v)) for i, _, h, p, r, v in urls)
    labels = spark.createDataFrame([(1, "block"), (1, "allow"), (5, None), (None, "block")], "page_id long, label string")
    assert url_rules.judge_urls(pages, labels, STATED_RULES).count() == len(urls)
    assert url_rules.judge_urls(pages.limit(0), labels, STATED_RULES).count() == 0


def test_revisits_of_every_kind(spark):
    schema = f"record_id long, url string, ts long, type string, headers {warc_revisits.HEADERS}, status int"
    head = [("ETag", '"a"'), ("Last-Modified", "m"), ("Content-Length", "9"), ("X", "1"), ("x", "2")]
    rows = [
        (1, "http://www.A.org/p/?b=2&a=1&utm_x=3", 10, "response", head, 200),
        (2, "https://a.org:443/p?a=1&b=2#f", 100_000, "response", [("ETag", '"b"')], 200),
        (3, "http://a.org/p?a=1&b=2", 10, "revisit", [], 304),
        (4, "http://a.org/p?a=1&b=2", 11, "revisit", [("etag", 'W/"a"'), ("X", "new"), ("content-length", "0")], 304),
        (5, "http://a.org:80/p/?b=2&a=1", 99_999, "revisit", [("Last-Modified", "other")], 304),
        (6, "http://a.org/p?a=1&b=2", 900_000, "revisit", None, 304),
        (7, None, 50, "revisit", [("etag", '"a"')], 304),
        (8, "http://a.org/p?a=1&b=2", None, "revisit", [], 304),
        (4, "http://a.org/p?a=1&b=2", 11, "revisit", [("etag", 'W/"a"'), ("X", "new"), ("content-length", "0")], 304),
        (9, None, 1, "response", None, 200),
        (10, "http://a.org/p?a=1&b=2", 5, "request", None, 0),
    ]
    frame = spark.createDataFrame(rows, schema)
    got = sorted((r.record_id, r.response_id, r.status) for r in warc_revisits.resolve_revisits(frame).collect())
    assert got == [
        (3, None, "no_response"), (4, 1, "resolved"), (4, 1, "resolved"), (5, 1, "mismatch"), (6, 2, "unverified"),
        (7, None, "no_response"), (8, None, "no_response"),
    ]
    merged = {r.record_id: r.headers for r in warc_revisits.resolve_revisits(frame, stretch=7).collect()}
    assert [tuple(h) for h in merged[4]] == [("Last-Modified", "m"), ("Content-Length", "9"), ("etag", 'W/"a"'), ("X", "new")]
    assert merged[5] is None and [tuple(h) for h in merged[6]] == [("ETag", '"b"')]
    assert warc_revisits.resolve_revisits(frame.limit(0)).count() == 0


def test_responses_at_the_same_time(spark):
    schema = f"record_id long, url string, ts long, type string, headers {warc_revisits.HEADERS}"
    rows = [(1, "http://a.org/", 5, "response", [("ETag", '"x"')]), (2, "http://a.org/", 5, "response", [("ETag", '"y"')]), (3, "http://a.org/", 9, "revisit", [("ETag", '"y"')])]
    for order in (rows, rows[::-1]):
        got = warc_revisits.resolve_revisits(spark.createDataFrame(order, schema)).collect()
        assert [(r.record_id, r.response_id, r.status) for r in got] == [(3, 2, "resolved")]


def test_stretches_of_time_change_nothing(spark, table):
    records = archive_records(table("pages").withColumn("url", F.concat(F.lit("http://one.org/"), F.col("page_id") % 3)))
    answers = [sorted(map(str, warc_revisits.resolve_revisits(records, s).collect())) for s in (60, 10_000, 10**9)]
    assert answers[0] == answers[1] == answers[2]


def test_license_scan_of_odd_rows(spark):
    notice = license_scan.NOTICES[1][1]
    broken = notice.replace("source and", "source code and")
    docs = [
        (1, None, 0, None, None, "", ""), (2, "", 0, None, None, "", ""), (3, "MIT", 0, None, None, "", ""),
        (4, "The MIT License, mit-license! CC BY-NC 4.0", 3, 1, 5, "cc-by,mit", "cc-by,mit"),
        (4, "The MIT License, mit-license! CC BY-NC 4.0", 3, 1, 5, "cc-by,mit", "cc-by,mit"),
        (5, f"x {notice}. y", 0, None, None, "", "bsd"), (6, f"x {broken} y", 0, None, None, "", "bsd"),
        (7, "word " * 20000 + "cc by " * 3, 3, 20000, 20004, "cc-by", "cc-by"),
        (None, "gnu général public license apache license", 1, 4, 4, "apache", "apache"),
    ]
    frame = spark.createDataFrame([(d, t, "x") for d, t, *_ in docs], "doc_id long, text string, labels string")
    got = license_scan.license_scan(frame).collect()
    rows = [(r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got]
    assert sorted(map(str, rows)) == sorted(str((d, *rest)) for d, _, *rest in docs)
    assert all(0 <= r.score <= 1 for r in got) and {r.score for r in got if r.doc_id == 5} == {1.0}
    assert license_scan.license_scan(frame.limit(0)).count() == 0


def test_licenses_without_their_opening(spark):
    """Every passage gives its label alone, also with a word put in; a third of it gives none."""
    texts = {i: (label, body.split()) for i, label, body, _, width in license_scan.templates() if width == license_scan.LONG}
    rows = []
    for i, (_, w) in texts.items():
        rows += [(i, f"lead {' '.join(w)} trail".upper()), (1000 + i, " ".join(w[: len(w) // 3]))]
        if len(w) > 24:
            rows.append((2000 + i, " ".join([*w[:12], "inserted", *w[12:]])))
    got = {r.doc_id: r.labels for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: v for d, v in got.items() if d < 1000} == {i: label for i, (label, _) in texts.items()}
    assert {v for d, v in got.items() if 1000 <= d < 2000} <= {"", "mit"}
    assert all(v == texts[d - 2000][0] for d, v in got.items() if d >= 2000) and any(d >= 2000 for d in got)


def test_license_grams_equal_brute_force(spark, table):
    """The hits of the scan are the places where a template's words stand, found here by comparing strings."""
    docs = table("documents").limit(60).select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, license_scan.templates()[-1][2]), (-2, "a b c d"), (-3, "cc"), (-4, None)], "doc_id long, text string")
    )
    known = {}
    for _, _, text, _, width in license_scan.templates():
        parts = text.split()
        known.setdefault(width, set()).update(" ".join(parts[i : i + width]) for i in range(len(parts) - width + 1))
    got = {r.doc_id: (r.n_words, sorted((h.at, h.gram) for h in r.hits)) for r in license_scan.scanned(docs).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in docs.collect():
        w = re.findall(WORD, (r.text or "").translate(lower))
        grams = [(i, " ".join(w[i : i + k])) for k in known for i in range(len(w) - k + 1)]
        assert got[r.doc_id] == (len(w), sorted(g for g in grams if g[1] in known[len(g[1].split(" "))]))


def test_batches_count_once_in_any_order(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "en", "v", 5), ("a", "en", "v", 5), (None, "en", "v", 7), ("b", None, "v", 0)], "source string, lang string, version string, tokens long"
    )
    rollup = token_rollup.TokenRollup(spark, str(tmp_path))
    assert rollup.totals().count() == 0
    read = lambda: {(r.source, r.lang, r.docs, r.tokens) for r in rollup.totals().collect()}
    rollup.commit(1, token_rollup.deleted(rows.limit(1)))
    rollup.commit(0, token_rollup.inserted(rows))
    want = {("a", "en", 1, 5), (None, "en", 1, 7), ("b", None, 1, 0)}
    assert read() == want
    rollup.commit(1, token_rollup.deleted(rows.limit(1)))
    rollup.compact(1)
    assert read() == want
    change = rows.where("source is null")
    for _ in range(2):
        rollup.commit(2, token_rollup.revised(change, change.withColumn("tokens", F.lit(9).cast("long"))))
    rollup.commit(3, token_rollup.deleted(rows.where("source = 'b'")))
    assert read() == {("a", "en", 1, 5), (None, "en", 1, 9)}


def test_late_repeated_and_broken_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v", 5)], "source string, lang string, version string, tokens long")
    rollup = token_rollup.TokenRollup(spark, str(tmp_path))
    read = lambda: [(r.docs, r.tokens) for r in rollup.totals().collect()]
    rollup.commit(0, token_rollup.inserted(rows))
    rollup.commit(2, token_rollup.inserted(rows))
    rollup.compact(2)
    rollup.commit(1, token_rollup.inserted(rows))  # for the first time, after the snapshot
    assert read() == [(3, 15)]
    rollup.commit(2, token_rollup.inserted(rows))  # again, after the snapshot
    rollup.write_attempt(3, token_rollup.inserted(rows))  # died before it was published
    assert read() == [(3, 15)]
    rollup.compact(9)
    rollup.compact(9)
    rollup.commit(3, token_rollup.inserted(rows))
    assert read() == [(4, 20)]


def test_counts_beside_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x", 3), (2, None, 8, "y", 4)], "doc_id long, text string, c int, version string, tokens int")
    got = token_rollup.counted(df, {"w": token_rollup.word_tokens, "b": token_rollup.bpe_tokens(tokenizer_path())}).collect()
    assert sorted((r.doc_id, r.c, r.version, r.tokens > 0) for r in got) == [(1, 7, "b", True), (1, 7, "w", True), (2, 8, "b", False), (2, 8, "w", False)]


def test_rollup_of_the_corpus(spark, folder, table):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    toxic = {r.doc_id for r in table("labels").where("toxic = 1").collect()}
    want = Counter()
    for r in table("documents").collect():
        if r.doc_id not in toxic:
            text = "\n".join(dict.fromkeys((r.text or "").split("\n")))
            want[r.source, r.lang, "docs"] += 1
            want[r.source, r.lang, "tokens"] += len(plain.encode(text, add_special_tokens=False).ids)
            want[r.source, r.lang, "words"] += len(re.findall("[0-9a-zA-Z\x80-\U0010ffff]+", text))
    got = op9_token_rollup(spark, folder).where("version = 'word_bpe_49k'").collect()
    found = {(r.source, r.lang, k): r[k] for r in got for k in ("docs", "tokens")}
    found |= {(r.source, r.lang, "words"): r.tokens for r in op9_token_rollup(spark, folder).where("version = 'words_1'").collect()}
    assert found == dict(want)
