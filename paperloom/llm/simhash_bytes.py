"""SimHash near-duplicates by an inverted index over byte positions, with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so at least 4 positional bytes
are shared. The index holds every distinct fingerprint under combinations of three positional bytes, chosen so that any
four positions contain one of them (20 of the 56). Each posting list is met in blocks: shared positional bytes are tallied
for every pair inside the task, pairs with the guaranteed four are verified bit by bit, and only a star per group of linked
fingerprints leaves the task, so a list of n fingerprints gives fewer than n links. Lists longer than ``BLOCK`` are cut into
blocks by hash, and every pair of blocks meets in a task of its own. Components follow from the links.

A text without words, empty or null has fingerprint zero. Equal fingerprints are joined before the index is built, so large
groups of copies count once. Null ids take part in groups but never name one, unless all ids of a group are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scale import broadcast_if_small
from paperloom.llm.common import numbered
from paperloom.llm.components import components
from paperloom.session import stored

BYTES = 8
MAX_BITS = 4
SHARED = BYTES - MAX_BITS
BLOCK = 2048
SHINGLE = 4
SEED = 42


def fingerprint_of(text: str | None) -> int:
    """Majority of the bits of XXH64 over 4-word shingles, as an unsigned integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        spans = zip((ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in spans]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def position_triples() -> list[tuple[int, ...]]:
    """Triples of byte positions such that any four positions contain one: all inside a third, or two of one and one of the next."""
    third = [p * 3 // BYTES for p in range(BYTES)]
    kept = []
    for triple in combinations(range(BYTES), 3):
        counts = [sum(third[p] == k for p in triple) for k in range(3)]
        if 3 in counts or any(counts[k] == 2 and counts[(k + 1) % 3] == 1 for k in range(3)):
            kept.append(triple)
    return kept


def index_keys(fp: Column) -> Column:
    """One key per triple: its number and the three bytes."""

    def byte(p: int) -> Column:
        return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))

    return F.array(
        *[
            F.lit(i << 24) + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c)
            for i, (a, b, c) in enumerate(position_triples())
        ]
    )


def linked(fps: np.ndarray) -> list[tuple[int, int]]:
    """Star links (member, first) over the groups of ``fps`` joined by at most MAX_BITS differing bits."""
    rest, out = np.unique(fps), []
    while rest.size > 1:
        first, rest = rest[0], rest[1:]
        front = np.array([first], dtype=np.uint64)
        while front.size and rest.size:
            differ = front[:64, None] ^ rest[None, :]
            shared = (differ.view(np.uint8).reshape(*differ.shape, BYTES) == 0).sum(axis=2)
            near = ((shared >= SHARED) & (np.bitwise_count(differ) <= MAX_BITS)).any(axis=0)
            out += [(int(x), int(first)) for x in rest[near].view(np.int64)]
            front, rest = np.concatenate((front[64:], rest[near])), rest[~near]
    return [(x, int(np.uint64(first).view(np.int64))) for x, first in out]


def _links_of(fps: Column) -> Column:
    @F.pandas_udf("array<struct<u:bigint,v:bigint>>")
    def of(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"u": u, "v": v} for u, v in linked(np.asarray(x, dtype=np.int64).view(np.uint64))] for x in lists])

    return of(fps)


def fingerprint_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that join the distinct fingerprints ``fp`` into the same components as all pairs within MAX_BITS do."""
    index = fps.select("fp", F.explode(index_keys(F.col("fp"))).alias("key"))
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = index.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block))
    part = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    met = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lists = met.groupBy("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")).agg(
        F.collect_list("fp").alias("fps")
    )
    return lists.where(F.size("fps") > 1).select(F.explode(_links_of(F.col("fps"))).alias("e")).select("e.u", "e.v")


def _with_components(rows: DataFrame, block: int) -> DataFrame:
    """Adds component (a fingerprint) and component_id to rows of (doc_id, fp, _row)."""
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    label = components(fingerprint_links(fps.select("fp"), block))
    named = stored(
        fps.join(label.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("component")),
        "labels",
    )
    first = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    by_fp = stored(named.join(first, "component").select("fp", "component", "component_id"), "members")
    return rows.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest id it is linked to."""
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    return _with_components(rows, block).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, and of several rows with that id one."""
    rows = numbered(
        docs.select(
            F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")
        ),
        "documents",
    )
    labelled = stored(_with_components(rows.select("doc_id", "fp", "_row"), block), "labelled")
    named = labelled.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stored(named.groupBy("component").agg(F.min("_row").alias("_row")), "kept")
    dropped = stored(labelled.select("_row").join(kept, "_row", "left_anti"), "dropped")
    return rows.join(broadcast_if_small(dropped), "_row", "left_anti").select("doc.*")
