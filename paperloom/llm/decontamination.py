"""Benchmark decontamination with one FM-index per shard of documents.

A shard is the documents of an Arrow batch that have about ``SHARD_CHARS`` characters together, or one document. Its alphabet is the benchmark's vocabulary: a word outside it can be in no test
phrase, so it ends the run of words it stands in, and runs shorter than the shortest phrase are left out. The remaining runs
form one sequence whose suffix array gives the Burrows-Wheeler transform; a wavelet matrix over it answers ranks. All phrases
are searched backwards together, occurrences are located by walking to the nearest sampled suffix position, and the spans of
each document are merged. A phrase never crosses documents.

The benchmark reaches the tasks in blocks of about ``BLOCK_CHARS`` characters, one pass over the documents for each, written
before the next one begins. A task therefore holds the phrases of one block, however large the benchmark is.

Null and empty texts have no words and are never hit. Benchmark rows that share an id are one item; rows without an id hit
words but are not counted as items. Repeated document rows each get their own result. An empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import give_back_memory, slices_of
from paperloom.session import stored

PHRASE_WORDS = 13
SAMPLE = 8
BLOCK_CHARS = 8_000_000
SHARD_CHARS = 4_000_000
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode().lower())


class Phrases:
    """The windows of a set of items as rows of word numbers, by length, and the items each window is of."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = PHRASE_WORDS):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text))
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(ids[i : i + size], set()).update([] if name is None else [name])
        windows = sorted(found, key=lambda w: (len(w), w))
        self.items = [sorted(found[w]) for w in windows]
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.by_length = {
            n: (np.flatnonzero(self.lengths == n), np.array([w for w in windows if len(w) == n], dtype=np.int64))
            for n in sorted(set(self.lengths.tolist()))
        }
        self.shortest = min(self.by_length, default=0)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling over those not yet apart. Zeros end runs and are apart by their place."""
    zero = symbols == 0
    rank = np.where(zero, np.cumsum(zero) - 1, symbols + zero.sum())
    order = np.argsort(rank, kind="stable")
    head = np.concatenate(([True], np.diff(rank[order]) != 0))
    places = np.arange(len(symbols))
    rank[order] = np.maximum.accumulate(np.where(head, places, 0))
    step = 1
    while True:
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not open_.size:
            return order
        at = order[open_]
        key = rank[at] * len(symbols) + rank[at + step]
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[open_] = at
        head[open_] = np.concatenate(([True], np.diff(key) != 0))
        rank[at] = np.maximum.accumulate(np.where(head[open_], open_, 0))
        step *= 2


class WaveletMatrix:
    """Bit planes of a sequence with running counts of zeros."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.planes = []
        for bit in reversed(range(max(1, int(largest).bit_length()))):
            ones = (symbols >> bit) & 1
            zeros = np.concatenate(([0], np.cumsum(1 - ones))).astype(np.int32)
            self.planes.append((bit, zeros))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``upto``."""
        start, end = np.zeros_like(upto), upto
        for bit, zeros in self.planes:
            one = ((symbol >> bit) & 1).astype(bool)
            start = np.where(one, zeros[-1] + start - zeros[start], zeros[start])
            end = np.where(one, zeros[-1] + end - zeros[end], zeros[end])
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for bit, zeros in self.planes:
            one = zeros[at + 1] == zeros[at]
            symbol |= one.astype(symbol.dtype) << bit
            at = np.where(one, zeros[-1] + at - zeros[at], zeros[at])
        return symbol


class ShardIndex:
    """FM-index of runs of word numbers, each ended by a zero."""

    def __init__(self, symbols: np.ndarray, largest: int):
        order = suffix_array(symbols)
        last = symbols[order - 1]
        self.wavelet = WaveletMatrix(last, largest)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=largest + 1))))
        self.sampled = (order % SAMPLE == 0) | (last == 0)
        self.slot = np.cumsum(self.sampled) - 1
        self.position = order[self.sampled]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the windows that occur, and the ranges of suffixes that begin with them."""
        which = np.arange(len(windows))
        low, high = self.before[windows[:, -1]], self.before[windows[:, -1] + 1]
        for column in reversed(range(windows.shape[1] - 1)):
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            symbol = windows[which, column]
            low = self.before[symbol] + self.wavelet.rank(symbol, low)
            high = self.before[symbol] + self.wavelet.rank(symbol, high)
        alive = low < high
        return which[alive], low[alive], high[alive]

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps to the left until a sampled one is met."""
        result, steps, open_ = np.zeros(len(at), dtype=np.int64), 0, np.arange(len(at))
        while open_.size:
            done = self.sampled[at]
            result[open_[done]] = self.position[self.slot[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            symbol = self.wavelet.access(at)
            at = self.before[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return result


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of the half-open spans."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate(([True], start[1:] > reach[:-1])) if start.size else np.zeros(0, dtype=bool)
    return start[first], reach[np.append(first[1:], True)] if start.size else reach


def search_shard(texts: pd.Series, phrases: Phrases) -> tuple[np.ndarray, dict[int, list], dict[int, list]]:
    """Numbers of words, and for documents that are hit the merged spans of words and the items."""
    get = phrases.vocabulary.get
    counts = np.zeros(len(texts), dtype=np.int64)
    pieces, doc_start, base = [], np.zeros(len(texts) + 1, dtype=np.int64), 0
    run_at, run_word = [], []  # where each run begins in the sequence, and its first word counted over the shard
    length = 0
    for d, text in enumerate(texts):
        found = words_of(text)
        counts[d] = len(found)
        doc_start[d] = base
        ids = np.fromiter((get(w, 0) for w in found), dtype=np.int64, count=len(found))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= phrases.shortest:
                pieces += [ids[a:b], np.zeros(1, dtype=np.int64)]
                run_at.append(length)
                run_word.append(base + a)
                length += b - a + 1
        base += len(found)
    doc_start[-1] = base
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    if not pieces or not phrases.by_length:
        return counts, spans, {}
    index = ShardIndex(np.concatenate(pieces), len(phrases.vocabulary))
    starts, ends = [], []
    run_at_, run_word_ = np.array(run_at), np.array(run_word)
    for size, (numbers, windows) in phrases.by_length.items():
        which, low, high = index.search(windows)
        if not which.size:
            continue
        many = high - low
        place = index.locate(np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        run = np.searchsorted(run_at_, place, side="right") - 1
        word = run_word_[run] + place - run_at_[run]
        starts.append(word)
        ends.append(word + size)
        doc = np.searchsorted(doc_start, word, side="right") - 1
        pairs = np.unique(doc * len(phrases.lengths) + numbers[np.repeat(which, many)])
        for d, w in zip((pairs // len(phrases.lengths)).tolist(), (pairs % len(phrases.lengths)).tolist(), strict=True):
            items.setdefault(d, set()).update(phrases.items[w])
    if starts:
        first, last = _merged(np.concatenate(starts), np.concatenate(ends))
        # spans of neighbouring documents may touch, and are cut apart here
        doc = np.searchsorted(doc_start, first, side="right") - 1
        for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True):
            while a < b:
                stop = min(b, int(doc_start[d + 1]))
                if a < stop:
                    spans.setdefault(d, []).append((a - int(doc_start[d]), stop - int(doc_start[d])))
                a, d = stop, d + 1
    return counts, spans, {d: sorted(x) for d, x in items.items()}


RESULT = "n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"


def _searched(text: Column, earlier: Column, phrases: Phrases) -> Column:
    @F.pandas_udf(RESULT)
    def search(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([judged(*(column.iloc[low:high] for column in batch)) for low, high in shards(batch[0])], ignore_index=True)
        give_back_memory()

    def shards(texts: pd.Series) -> list[tuple[int, int]]:
        sizes = np.fromiter((len(t or "") for t in texts), dtype=np.int64, count=len(texts))
        return list(slices_of(sizes, SHARD_CHARS)) or [(0, 0)]

    def judged(texts: pd.Series, old_spans: pd.Series, old_items: pd.Series) -> pd.DataFrame:
        counts, spans, items = search_shard(texts, phrases)
        out_spans, out_items, hits = [], [], []
        for d, (s, i) in enumerate(zip(old_spans, old_items, strict=True)):
            own = spans.get(d, [])
            if len(s):
                both = np.array([(x["start"], x["end"]) for x in s] + own)
                own = list(zip(*(x.tolist() for x in _merged(both[:, 0], both[:, 1])), strict=True))
            hits.append(sum(b - a for a, b in own))
            out_spans.append([{"start": a, "end": b} for a, b in own])
            out_items.append(sorted({*i, *items.get(d, [])}))
        return pd.DataFrame({"n_words": counts, "n_hit": hits, "spans": out_spans, "items": out_items})

    return search(text, earlier["spans"], earlier["items"])


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", phrase_words: int = PHRASE_WORDS, name: str = "contamination"
) -> DataFrame:
    """``docs`` with a column ``name``: words, words hit, merged spans of words to remove, and items whose phrases occur."""
    if name in docs.columns:
        raise ValueError(f"documents have a column {name} already")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    nothing = F.lit(None).cast(f"struct<{RESULT.replace(' long', ':long').replace(' array', ':array')}>")
    empty = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    out = docs.withColumn(name, nothing)
    for block in range(blocks):
        out = stored(out, "contamination") if block else out
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) if blocks > 1 else items
        phrases = Phrases([tuple(r) for r in mine.collect()], phrase_words)
        out = out.withColumn(name, _searched(F.col(text_col), F.col(name) if block else empty, phrases))
    return out


def is_contaminated(found: Column) -> Column:
    """At least one word in twenty is hit."""
    return (found["n_hit"] > 0) & (found["n_hit"] * 20 >= found["n_words"])


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hits, items and the verdict."""
    found = F.col("contamination")
    return find_contamination(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        is_contaminated(found).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    found = find_contamination(docs, benchmark, name="_contamination")
    return found.where(~is_contaminated(F.col("_contamination"))).drop("_contamination")
