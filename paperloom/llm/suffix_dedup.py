"""Removal of repeated passages by prefix-free parsing.

Every string of ``n`` bytes (200) holds a trigger: the place of the smallest of its rolling hashes over n/5 bytes, the last
one among equals. Triggers depend on content alone, so equal strings have theirs at the same place, wherever they stand. The
strings of a text that share one trigger follow each other and form a phrase, the text from the first byte of the first to
the last byte of the last, and the ordered phrases are the parse of the text. Phrases overlap such that each string of n
bytes lies in exactly one.

The dictionary holds every distinct phrase once with its number of occurrences. Corpus order, as far as repetition of n bytes
needs it, follows from three ranks, each found by grouping on all executors instead of sorting bytes: by the trigger's own
bytes (only phrases whose trigger bytes occur again are looked at further, which drops nearly all of an unrepetitive corpus),
by the whole phrase in the parse (all strings of a phrase that occurs twice are repeated, however often it occurs), and by the
suffixes of the dictionary, cut at n bytes, for phrases that share a trigger with a different phrase. The dictionary is split
by trigger into parts with a suffix array each; neighbours in it with a common prefix of n bytes that stand for two
occurrences in the parse or more cover the bytes to remove. Parts hold whole triggers of at most ``BUCKET`` phrases; the
suffixes of a more frequent one are dealt out by hash.

Phrases are told apart by 128-bit XXH3 hashes of their bytes, as are dealt-out suffixes; trigger hashes only narrow the
search. A text is known by the number of its row in a copy written once, so that repeated rows and ids are separate documents.

Null texts are empty. Texts shorter than n lose nothing. All copies of a repeated string lose it. A null id is passed on, and
an empty table gives an empty result. Other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.functions.scale import is_small
from paperloom.session import Scratch, stored

MIN_BYTES = 200
BROADCAST_ROW_NUMBERS = 1_000_000
BUCKET = 4096
PART_BYTES = 1 << 18
ROWS_AT_ONCE = 256
_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


class RollingHash:
    """Hashes of every ``width`` bytes of a text, from differences of one running sum."""

    def __init__(self, width: int):
        self.width = width
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n, width = len(data), self.width
        if len(self.up) < n:
            self.up, self.down = self._powers(_BASE, 2 * n), self._powers(pow(_BASE, -1, 1 << 64), 2 * n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data + np.uint64(1)) * self.up[:n], out=total[1:])
        hashes = (total[width:] - total[:-width]) * self.down[: n - width + 1]
        # mixed, so that their order says nothing of content
        hashes ^= hashes >> np.uint64(32)
        hashes *= _SPREAD
        hashes ^= hashes >> np.uint64(29)
        return hashes


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values, from running minima within blocks of that width, ahead and back."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def parse(data: np.ndarray, rolling: RollingHash, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a text: the trigger's hash, the start of its first string of n bytes, and how many strings it has."""
    if len(data) < n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    hashes = rolling(data)
    # upper half of the hash, then the place, counted down so that the last of equals is smallest
    keys = (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    place = (_LOW - (sliding_minimum(keys, n - rolling.width + 1) & _LOW)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(place) != 0)))
    return hashes[place[starts]].view(np.int64), starts, np.diff(np.append(starts, len(place)))


def _hashed(data: bytes, spans: zip) -> np.ndarray:
    """128-bit hashes of the spans as two columns."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in spans]), dtype="<i8").reshape(-1, 2)


def _frame(columns: dict[str, list[np.ndarray]], kinds: dict[str, type]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate(parts) if parts else np.zeros(0, dtype=kinds[c]) for c, parts in columns.items()})


def trigger_table(texts: DataFrame, n: int) -> DataFrame:
    """The trigger hash of every phrase."""

    def triggers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling = RollingHash(n // 5)
        for batch in batches:
            found = [parse(np.frombuffer(t.encode(), dtype=np.uint8), rolling, n)[0] for t in batch["text"]]
            values, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, int),) * 2
            yield pd.DataFrame({"trigger": values, "n": counts})

    return texts.select("text").mapInPandas(triggers, "trigger long, n long")


def phrase_table(texts: DataFrame, n: int) -> DataFrame:
    """One row per phrase of the parse: its trigger, the hash of its bytes, and its place."""

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling = RollingHash(n // 5)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("_row", "trigger", "p1", "p2", "at", "n")}
            for row, text in zip(batch["_row"].tolist(), batch["text"], strict=True):
                data = text.encode()
                trigger, at, many = parse(np.frombuffer(data, dtype=np.uint8), rolling, n)
                if at.size:
                    names = _hashed(data, zip(at.tolist(), (at + many - 1 + n).tolist(), strict=True))
                    for c, v in (("_row", np.full(at.size, row)), ("trigger", trigger), ("p1", names[:, 0]), ("p2", names[:, 1]), ("at", at), ("n", many)):
                        out[c].append(v)
            yield _frame(out, dict.fromkeys(out, np.int64))

    return texts.mapInPandas(phrases, "_row long, trigger long, p1 long, p2 long, at long, n long")


def phrase_bodies(texts: DataFrame, dictionary: DataFrame, n: int) -> DataFrame:
    """The dictionary's phrases with their bytes, and the number k of phrases that share their trigger."""

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, text, places in zip(batch["_row"].tolist(), batch["text"], batch["places"], strict=True):
                data = text.encode()
                out += [(p["trigger"], p["k"], p["occurs"], row, p["at"], data[p["at"] : p["at"] + p["n"] - 1 + n]) for p in places]
            yield pd.DataFrame(out, columns=["trigger", "k", "occurs", "_row", "at", "body"])

    places = dictionary.groupBy("_row").agg(F.collect_list(F.struct("trigger", "k", "at", "n", "occurs")).alias("places"))
    return _beside(texts, places).mapInPandas(bodies, "trigger long, k long, occurs long, _row long, at long, body binary")


def rank_windows(data: np.ndarray, width: int) -> np.ndarray:
    """Rank of the ``width`` bytes from each place, by doubling from seven on; bytes beyond the end count as zeros."""
    known = min(7, width)
    padded = np.append(data, np.zeros(width, dtype=data.dtype)).astype(np.int64)
    ranks = sum(padded[i : i + len(data)] << (8 * (known - 1 - i)) for i in range(known))
    ranks = np.unique(ranks, return_inverse=True)[1]
    while known < width:
        step = min(known, width - known)
        ahead = np.append(ranks[step:], np.zeros(step, dtype=np.int64))
        ranks = np.unique(ranks * len(data) + ahead, return_inverse=True)[1]
        known += step
    return ranks


def suffix_array(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their suffixes cut at ``depth`` bytes, and where a suffix has these in common with the last."""
    ranks = rank_windows(data, depth)[starts]
    order = np.argsort(ranks, kind="stable")
    in_order = ranks[order]
    return starts[order], np.concatenate(([False], in_order[1:] == in_order[:-1]))


def compare_dictionary(phrases: list[dict], n: int) -> list[tuple[int, int, int]]:
    """Spans (_row, start, end) of the strings of n bytes that phrases of one occurrence share with others.

    The dictionary's suffix array gives them: neighbours with n bytes in common stand for as many occurrences as their phrases
    have in the parse.
    """
    data = np.frombuffer(b"\0".join([*(p["body"] for p in phrases), b""]), dtype=np.uint8)
    sizes = np.array([len(p["body"]) for p in phrases])
    occurs, row, at = (np.array([p[c] for p in phrases]) for c in ("occurs", "_row", "at"))
    phrase = np.repeat(np.arange(len(phrases)), sizes + 1)
    inside = np.arange(len(data)) - (np.cumsum(sizes + 1) - sizes - 1)[phrase]
    order, same = suffix_array(data, np.flatnonzero(inside + n <= sizes[phrase]), n)
    group = np.cumsum(~same)
    times = np.bincount(group, occurs[phrase[order]])[group]
    again = np.zeros(len(data) + 1, dtype=np.int8)
    again[order] = (times > 1) & (occurs[phrase[order]] == 1)
    # the place after a phrase begins no string of n bytes, so that runs end with their phrase
    edges = np.flatnonzero(np.diff(again, prepend=0))
    first, last = edges[::2], edges[1::2] - 1
    owner = phrase[first]
    return list(zip(row[owner].tolist(), (at[owner] + inside[first]).tolist(), (at[owner] + inside[last] + n).tolist(), strict=True))


def bucket_spans(bodies: DataFrame, n: int) -> DataFrame:
    """Spans found in suffix arrays of parts of the dictionary that hold all phrases of their triggers."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def spans(part: list[dict]) -> pd.DataFrame:
            return pd.DataFrame(compare_dictionary(part, n), columns=["_row", "start", "end"])

        for batch in batches:
            part, size = [], 0
            for phrases in batch["phrases"]:
                part += list(phrases)
                size += sum(len(p["body"]) for p in phrases)
                if size >= PART_BYTES:
                    yield spans(part)
                    part, size = [], 0
            if part:
                yield spans(part)

    grouped = bodies.groupBy("trigger").agg(F.collect_list(F.struct("occurs", "_row", "at", "body")).alias("phrases"))
    return grouped.select("phrases").mapInPandas(compare, "_row long, start long, end long")


def suffix_spans(bodies: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """The same spans, one per string, by grouping the hashes of all suffixes."""

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("s1", "s2", "_row", "at", "n")}
            for row, first, body, many in zip(batch["_row"].tolist(), batch["at"].tolist(), batch["body"], batch["occurs"].tolist(), strict=True):
                i = np.arange(len(body) - n + 1)
                names = _hashed(body, zip(i.tolist(), (i + n).tolist(), strict=True))
                for c, v in (("s1", names[:, 0]), ("s2", names[:, 1]), ("_row", np.full(i.size, row)), ("at", i + first), ("n", np.full(i.size, many))):
                    out[c].append(v)
            yield _frame(out, dict.fromkeys(out, np.int64))

    found = scratch.stored(bodies.mapInPandas(suffixes, "s1 long, s2 long, _row long, at long, n long"), "suffixes")
    shared = found.groupBy("s1", "s2").agg(F.sum("n").alias("times")).where("times > 1").select("s1", "s2")
    parts = found.where("n = 1").join(scratch.stored(shared, "shared"), ["s1", "s2"])
    return parts.select("_row", F.col("at").alias("start"), (F.col("at") + n).alias("end"))


def _beside(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts with their lists; a bounded set of row numbers lets only those texts travel, a larger one is met by shuffle."""
    numbers = lists.select("_row")
    if is_small(numbers, BROADCAST_ROW_NUMBERS):
        texts = texts.join(F.broadcast(numbers), "_row", "left_semi")
    return texts.join(lists, "_row")


def repeated_spans(texts: DataFrame, n: int, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(_row, start, end): spans that cover exactly the bytes of strings of n bytes that start at two places or more."""
    again = trigger_table(texts, n).groupBy("trigger").agg(F.sum("n").alias("times")).where("times > 1").select("trigger")
    parsed = scratch.stored(phrase_table(texts, n).join(scratch.stored(again, "triggers"), "trigger"), "phrases")
    dictionary = scratch.stored(
        parsed.groupBy("trigger", "p1", "p2").agg(
            F.count(F.lit(1)).alias("occurs"), F.first("_row").alias("_row"), F.first("at").alias("at"), F.first("n").alias("n")
        ),
        "dictionary",
    )
    phrase = ["trigger", "p1", "p2"]
    repeated = scratch.stored(dictionary.where("occurs > 1").select(*phrase), "repeated")
    whole = parsed.join(repeated, phrase).select("_row", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + n).alias("end"))
    # triggers under which different phrases stand, one of them alone
    mixed = dictionary.groupBy("trigger").agg(F.count(F.lit(1)).alias("k"), F.min("occurs").alias("least")).where("k > 1 and least = 1")
    compared = dictionary.join(scratch.stored(mixed.select("trigger", "k"), "mixed"), "trigger").select("trigger", "k", "occurs", "_row", "at", "n")
    bodies = scratch.stored(phrase_bodies(texts, compared, n), "bodies", compression="zstd")
    near = bucket_spans(bodies.where(F.col("k") <= bucket), n)
    return whole.union(near).union(suffix_spans(bodies.where(F.col("k") > bucket), n, scratch))


SPANS = "array<struct<start:bigint,end:bigint>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(i, ROWS_AT_ONCE) for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
            kept, removed = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = text.encode()
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *(x for span in merged for x in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"start": a, "end": b} for a, b in merged])
            spans = pa.array(removed, batch.schema.field("spans").type)
            sizes = pa.array([len(k) + sum(s["end"] - s["start"] for s in r) for k, r in zip(kept, removed, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), sizes, spans, pa.array(kept, pa.binary())], ["row", "n_bytes", "spans", "kept"])


def deduplicated(docs: DataFrame, n: int = MIN_BYTES, bucket: int = BUCKET) -> DataFrame:
    """All columns of the documents but the text, with n_bytes, spans and kept.

    ``spans`` are the bytes removed, from ``start`` to before ``end``, in order and apart; ``kept`` are the bytes that are
    left, as binary, since a repeated string may begin or end within a character.
    """
    scratch = Scratch(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    copy = Scratch(docs.sparkSession).stored(
        docs.select(F.struct(*others).alias("row"), F.monotonically_increasing_id().alias("_row"), F.coalesce("text", F.lit("")).alias("text")),
        "texts",
        compression="zstd",
    )
    spans = repeated_spans(copy.select("_row", "text"), n, scratch, bucket)
    lists = stored(spans.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    scratch.drop()
    numbers = lists.select("_row")
    schema = StructType().add("row", copy.schema["row"].dataType).add("n_bytes", "long").add("spans", lists.schema["spans"].dataType).add("kept", "binary")
    if is_small(numbers, BROADCAST_ROW_NUMBERS):
        untouched = copy.join(F.broadcast(numbers), "_row", "left_anti").select(
            "row", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast(SPANS).alias("spans"), F.col("text").cast("binary").alias("kept")
        )
        cut = _beside(copy, lists).select("row", "text", "spans").mapInArrow(_cut, schema).union(untouched)
    else:
        cut = copy.join(lists, "_row", "left").select("row", "text", "spans").mapInArrow(_cut, schema)
    return cut.select("row.*", "n_bytes", "spans", "kept")


def without_repeats(docs: DataFrame, n: int = MIN_BYTES, bucket: int = BUCKET) -> DataFrame:
    """Figures of :func:`deduplicated`: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that are left."""
    return deduplicated(docs.select("doc_id", "text"), n, bucket).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
