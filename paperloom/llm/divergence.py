"""Divergence of the sources of a language, from bitsets of terms per source and count.

The kept terms of a language are numbered by falling frequency and dealt into stretches of ``STRETCH`` numbers. For each source
and count that occurs in a stretch, the numbers of the terms with that count are the bits of 64-bit words. Two sources are
compared word by word: the AND of two bitsets, counted, is the joint cell of two counts, multiplied by the distance ``f`` of
their shares. Cells with a count of zero are never stored; they follow by complement from the sizes of the bitsets and of the
stretch. Frequent terms have counts of their own, rare ones share few counts, so that numbering by frequency keeps the
bitsets per word few at both ends.

Sources are dealt into tiles, and a task compares two tiles in one stretch: it holds at most two tiles times a stretch of terms,
however many sources or terms there are. Terms are counted within a task before they are shuffled, so a source or language
that holds most of all rows costs no more per task.

Null text, language and source are empty strings. Texts without terms leave their group without counts, and it is compared by
zeros alone. Repeated rows count repeatedly. Equal values are ranked by the item's UTF-8. A language without kept terms gives
pairs of value 0 and no term rows; an empty table gives no rows. Other columns of the table are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scale import broadcast_if_small
from paperloom.llm.common import in_order
from paperloom.session import stored

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
WORD_BITS = 64
STRETCH = 16 * WORD_BITS
TILE = 32
HELD_TERMS = 500_000
ROWS_AT_ONCE = 256

# Bytes of terms are letters and everything beyond ASCII; A-Z are lower-cased, the rest separates.
_FOLD = bytes(b if b > 0x7F or chr(b).isalpha() else 0x20 for b in range(256)).lower()
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); each group also has a row with a null term."""

    def emit(held: dict) -> pa.RecordBatch:
        columns = [[] for _ in _COUNTED]
        for (lang, source), (counts, with_term) in held.items():
            size = len(counts) + 1
            terms = [*counts, None]
            numbers = [*counts.values(), 0], [*map(with_term.__getitem__, counts), 0]
            found = pa.repeat(lang, size), pa.repeat(source, size), pa.array(terms, pa.binary()).cast(pa.string()), *(pa.array(n, pa.int64()) for n in numbers)
            for column, part in zip(columns, found, strict=True):
                column.append(part)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], schema=_COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for whole in batches:
            for batch in (whole.slice(i, ROWS_AT_ONCE) for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
                for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    terms = text.translate(_FOLD).split()
                    counts, with_term = held.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(counts)
                    counts.update(terms)
                    with_term.update(set(terms))
                    size += len(counts)
                if size > HELD_TERMS:
                    yield emit(held)
                    held, size = {}, 0
        if held:
            yield emit(held)

    filled = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    counted = filled.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly."""
    wide = lambda c: c.cast("decimal(27,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * kept))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _segments(keys: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of the runs of equal keys."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    return list(zip(np.append(0, edges).tolist(), np.append(edges, len(keys)).tolist(), strict=True)) if len(keys) else []


def compare_tiles(rows: pd.DataFrame) -> pd.DataFrame:
    """Distances of the sources of two tiles, or of one with itself, summed over the terms of a stretch.

    ``rows`` has source, side (tile 0 or 1), zero (share of a count of 0), terms (in the stretch), and per bitset its word,
    share and bits; a row with a negative word stands for the source itself. If there is one tile, all its rows have side 0.
    """
    names = rows[rows["word"] < 0].sort_values(["side", "source"])
    index = {s: i for i, s in enumerate(names["source"])}
    zero, side = names["zero"].to_numpy(np.int64), names["side"].to_numpy()
    terms, n = int(names["terms"].iloc[0]), len(names)
    wanted = side[:, None] < side[None, :] if side[-1] else np.triu(np.ones((n, n), dtype=bool), 1)

    sets = rows[rows["word"] >= 0]
    group = sets["source"].map(index).to_numpy(np.int64)
    word = sets["word"].to_numpy(np.int64)
    order = np.lexsort((group, word))
    group, word = group[order], word[order]
    bits, share = (sets[c].to_numpy(np.int64)[order] for c in ("bits", "share"))
    bits = bits.view(np.uint64)
    size = np.bitwise_count(bits).astype(np.int64)
    both_zero = distances(zero[:, None], zero[None, :])

    # as if no two bitsets met: every term of one source against zeros of the other, the rest zeros against zeros
    value = terms * both_zero
    for g in range(n):
        own = group == g
        alone = (size[own, None] * (distances(share[own, None], zero[None, :]) - both_zero[g])).sum(axis=0)
        value[g] += alone
        value[:, g] += alone
    # then what each joint cell changes
    for start, stop in _segments(word):
        for a, b in _segments(group[start:stop]):
            a, b, g = start + a, start + b, group[start + a]
            if side[-1] and side[g]:
                break
            first = start + int(np.searchsorted(group[start:stop], np.argmax(side))) if side[-1] else b
            joint = bits[a:b, None] & bits[None, first:stop]
            i, j = np.nonzero(joint)
            if not len(i):
                continue
            count = np.bitwise_count(joint[i, j]).astype(np.int64)
            p, q, other = share[a + i], share[first + j], group[first + j]
            change = distances(p, q) - distances(p, zero[other]) - distances(zero[g], q) + both_zero[g, other]
            np.add.at(value[g], other, count * change)
    a, b = np.nonzero(wanted)
    source = names["source"].to_numpy()
    return pd.DataFrame({"a": source[a], "b": source[b], "value": value[a, b]})


def _pair_values(levels: DataFrame, groups: DataFrame, stretches: DataFrame, tile: int) -> DataFrame:
    """lang, a, b, value for each pair of sources of a language, a < b or the other way round, each pair once."""
    per_lang = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    tiled = groups.join(per_lang, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles"))
    tiled = stored(tiled.select("lang", "source", "tile", "tiles", "zero"), "tiles")
    # the sources themselves are met in every stretch, and in one that is empty, so that no pair is missed
    everywhere = stretches.unionByName(groups.select("lang").distinct().select("lang", F.lit(-1).cast("long").alias("stretch"), F.lit(0).cast("long").alias("terms")))
    nothing = F.lit(0).cast("long")
    own = tiled.join(everywhere, "lang").select("*", F.lit(-1).cast("long").alias("word"), nothing.alias("share"), nothing.alias("bits"))
    sets = levels.join(broadcast_if_small(tiled), ["lang", "source"]).withColumn("terms", nothing)
    rows = own.unionByName(sets.select(*own.columns))
    partners = F.expr("transform(sequence(0L, tiles - 1), t -> struct(least(tile, t) as low, greatest(tile, t) as high))")
    met = rows.withColumn("m", F.explode(partners)).select(
        "lang", "stretch", "m.low", "m.high", "source", (F.col("tile") != F.col("m.low")).cast("int").alias("side"), "zero", "terms", "word", "share", "bits"
    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = compare_tiles(rows)
        found.insert(0, "lang", key[0])
        return found

    parts = met.groupBy("lang", "stretch", "low", "high").applyInPandas(compare, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: every other source by distance, and the terms that a source has more of than its language."""
    counts = stored(term_counts(docs), "term-counts")
    in_lang = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = in_order(in_lang.where(F.col("docs") >= least_docs).drop("docs"), [F.col("lang"), F.col("lang_n").desc(), F.col("term")], "kept-terms", "number")
    # one row per language, and one per source and language
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    known = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "number"), "kept-counts")
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lang_total")])
    zero = F.when(F.col("kept") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(F.lit(1)).cast("long")
    groups = stored(groups.withColumn("zero", zero), "source-totals")

    shares = known.join(broadcast_if_small(groups.drop("zero")), ["lang", "source"])
    shares = shares.withColumn("share", _share(F.col("n"), F.col("total"), F.col("kept")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % WORD_BITS).cast("int"))
    stretch = F.floor(F.col("number") / STRETCH).alias("stretch")
    word = F.floor(F.col("number") / WORD_BITS).alias("word")
    levels = shares.groupBy("lang", "source", stretch, word, "n", "share").agg(F.bit_or(bit).alias("bits")).drop("n")
    stretches = kept.groupBy("lang", stretch).agg(F.count("*").alias("terms"))
    pairs = stored(_pair_values(levels, groups, stretches, tile), "source-pairs")
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = pairs.select("lang", F.explode(both).alias("p"), "value").select("lang", "p.*", F.lit("pair").alias("part"), "value")

    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = shares.withColumn("q", q).where("share > q").select(
        "lang", "source", F.col("term").alias("item"), F.lit("term").alias("part"), _distance(F.col("share"), F.col("q")).alias("value")
    )
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    best = terms.select(*columns, ranked).where(F.col("rank") <= top_terms)
    return pairs.select(*columns, ranked).unionByName(best)
