"""Chunking against a plain packer, and its properties."""

from __future__ import annotations

import random

from paperloom.operators.chunking import chunk_corpus, child_chunks, link_parents, parent_chunks


def tokens(n_words: int) -> int:
    return int(n_words * 1.3)


def packed(sections: list[str], size: int, overlap: int) -> list[tuple[str, int]]:
    """Independent statement of the packing rule, on a list of open sections."""
    done, open_sections, used = [], [], 0
    for section in sections:
        need = tokens(len(section.split()))
        if open_sections and used + need > size:
            whole = "\n\n".join(open_sections)
            done.append((whole, used))
            words = whole.split()
            open_sections = [whole if len(words) <= overlap else " ".join(words[-overlap:]), section]
            used = tokens(sum(len(s.split()) for s in open_sections))
        else:
            open_sections.append(section)
            used += need
    return done + ([("\n\n".join(open_sections), used)] if open_sections else [])


def sections_of(text: str) -> list[str]:
    return [s.strip() for s in text.split("\n\n") if s.strip()]


def random_text(rng: random.Random) -> str:
    return "\n\n".join(
        " ".join(rng.choice(["aa", "bb", "cc\n", "dd"]) for _ in range(rng.choice([0, 1, 5, 9, 40])))
        for _ in range(rng.randint(0, 30))
    )


def test_same_as_plain_packer(spark):
    rng = random.Random(7)
    texts = {i: random_text(rng) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "document_id long, text string")
    parents = parent_chunks(docs, 60, 8)
    want_parents, want_children = set(), set()
    for i, text in texts.items():
        for p, (content, used) in enumerate(packed(sections_of(text), 60, 8)):
            want_parents.add((i, p, content, used))
            for c, (part, part_used) in enumerate(packed(sections_of(content), 20, 4)):
                want_children.add((i, p, c, part, part_used))
    assert {tuple(r) for r in parents.collect()} == want_parents
    children = child_chunks(parents, 20, 4)
    assert {tuple(r) for r in children.collect()} == want_children

    one_pass = chunk_corpus(docs, parent_size=60, parent_overlap=8, child_size=20, child_overlap=4)
    linked = link_parents(parents, children)
    assert {tuple(r) for r in one_pass.select(linked.columns).collect()} == {tuple(r) for r in linked.collect()}

    # nothing is lost, every child's parent exists
    rows = one_pass.collect()
    ids = {r.chunk_id for r in rows if r.level == "parent"}
    assert all(r.parent_id in ids for r in rows if r.level == "child")
    for i, text in texts.items():
        joined = "\n\n".join(r.content for r in rows if r.document_id == i and r.level == "parent")
        assert all(s in joined for s in sections_of(text))


def test_oversized_section_stays_whole(spark):
    docs = spark.createDataFrame([(1, "w " * 500)], "document_id long, text string")
    rows = parent_chunks(docs, 100, 10).collect()
    assert [(r.chunk_index, r.token_count) for r in rows] == [(0, 650)]


def test_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "document_id long, text string")
    plan = chunk_corpus(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def paged_text(rng: random.Random, n: int) -> str:
    """Lines of words; some lines are page markers, some pages are empty, the first may have no marker."""
    lines, page = [], 1
    for _ in range(n):
        if rng.random() < 0.3:
            page += rng.choice([1, 1, 2])
            lines.append(f"[Page {page}]")
        else:
            lines.append(" ".join(rng.choice(["aa", "bb", "dd"]) for _ in range(rng.choice([1, 5, 9, 30]))))
    return "\n\n".join(lines)


def pages_by_position(text: str, starts: list[int], contents: list[str], before: int | None):
    """Pages by the word each chunk starts at in the text, counted from its words; markers are two words."""
    seen, at, page = [], [], before
    words = text.split()
    for i, word in enumerate(words):
        if word == "[Page":
            page = int(words[i + 1][:-1])
        at.append(page)
    for start, content in zip(starts, contents, strict=True):
        n = len(content.split())
        pages = [p for p in at[start : start + n] if p is not None]
        # a chunk that begins in the middle of a marker begins on its page
        seen.append((at[start] if at[start] is not None else (pages or [None])[0], sorted(set(pages))))
    return seen


def test_pages_of_chunks(spark):
    """Pages found by position: a chunk repeats at most ``overlap`` words of the one before, the rest follows on."""
    rng = random.Random(11)
    texts = {i: paged_text(rng, rng.randint(0, 60)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "document_id long, text string")
    chunks = chunk_corpus(docs, parent_size=90, parent_overlap=8, child_size=30, child_overlap=4, pages=True)
    plain = chunk_corpus(docs, parent_size=90, parent_overlap=8, child_size=30, child_overlap=4)
    rows = chunks.collect()
    assert {tuple(r) for r in chunks.select(plain.columns).collect()} == {tuple(r) for r in plain.collect()}

    def starts(contents: list[str], overlap: int) -> list[int]:
        at, found = 0, []
        for k, content in enumerate(contents):
            found.append(at)
            n = len(content.split())
            at += n - min(n, overlap) if k + 1 < len(contents) else n
        return found

    def ordered(keep):
        return sorted((r for r in rows if keep(r)), key=lambda r: r.chunk_index)

    for i, text in texts.items():
        parents = ordered(lambda r: r.document_id == i and r.level == "parent")
        contents = [r.content for r in parents]
        want = pages_by_position(text, starts(contents, 8), contents, None)
        assert [(r.page, r.pages) for r in parents] == want
        for parent in parents:
            children = ordered(lambda r: r.parent_id == parent.chunk_id)
            contents = [r.content for r in children]
            want = pages_by_position(parent.content, starts(contents, 4), contents, parent.page)
            assert [r.page for r in children] == [w[0] for w in want]


def test_text_without_markers_has_no_pages(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "[Page 99999999999] x")], "document_id long, text string")
    rows = chunk_corpus(docs, pages=True).collect()
    assert {(r.document_id, r.level, r.page, tuple(r.pages)) for r in rows} == {
        (i, level, None, ()) for i in (1, 4) for level in ("parent", "child")
    }
