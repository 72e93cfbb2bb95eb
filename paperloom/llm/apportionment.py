"""Mixture of sources by target weights: equal blocks of words, apportioned by Sainte-Lague, then picked by a seeded order.

Each source has a weight and a target, its share of all words; a target stops at ``most_repeats`` times the words its source
has, and what is cut off is shared again by weight among the others until none is above. The mix has as many blocks of
``block_words`` words as the corpus. Sources get them by the highest quotients target / (2k + 1), where k is the number of
blocks a source already has. A source first gives whole repeats of all its words; the blocks that are left are
apportioned over its shards in the same way, and within a shard they are picked by a seeded permutation.

The documents of a source are dealt into ``shards`` by a hash of their id and follow each other in the order of that hash. The
source's words are cut into blocks along this order, whatever the bounds of documents and shards, so that all blocks but the
last are equal. Most seats are certain for any divisor that can come out; only the others, two for each source or shard,
become rows and are ranked. No block is ever a row: a document tells from its position which of its blocks are picked. A source
with most of the rows is thus many shards, and neither sources nor blocks are gathered in one place.

Null and empty texts have no words and are returned with none taken. A null source is a source of its own, after all others.
Repeated rows are documents of their own. Equal quotients go to the earlier source, or shard. No document is taken more than
``most_repeats`` times. A corpus without words has targets of 0; an empty table gives no rows. Other columns of the table are
only returned if they are named in ``keep``. The result depends on the ids, sizes and sources only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scale import broadcast_if_small
from paperloom.llm.common import in_order, numbered
from paperloom.session import stored

SIZED_WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 16
SHARDS = 1024
MOST_REPEATS = 3
SEED = 11
# Primes beyond the number of blocks of any shard.
STEPS = (2147483647, 2147483629, 2147483587)


def sized_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SIZED_WORD)), F.lit(0)).cast("long")


def _seeded(seed: int, *parts: Column) -> Column:
    """The first 32 bits of a digest of the seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 8), 16, 10).cast("long")


def capped_targets(sources: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """``sources`` (size, weight) with the target of each. The driver sees sums only, one row for each time that targets are cut."""
    cap = F.col("size") * most_repeats
    total, weight = sources.agg(F.sum("size"), F.sum("weight")).first()
    rest, free = total or 0, weight or 1
    while True:
        above = F.col("weight") * F.lit(rest) / F.lit(free) > cap
        cut, cut_weight = sources.where(above).agg(F.sum(cap), F.sum("weight")).first()
        left = ((total or 0) - (cut or 0), (weight or 1) - (cut_weight or 0))
        if left == (rest, free):
            break
        rest, free = left
    share = F.col("weight") * F.lit(rest) / F.lit(free)
    return sources.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share.cast("double")))


def _quotient(votes: str) -> Column:
    return F.col(votes).cast("double") / (F.col("_k") * 2 + 1)


def _contested(rows: DataFrame, votes: str, total: Column, count: Column, house: Column) -> DataFrame:
    """Adds _sure, the seats a row has whatever the divisor turns out to be, and a row for each seat _k that depends on it.

    With n rows and h seats the divisor lies between total / (h + n / 2) and total / (h - n / 2). Seats next to these bounds
    are ranked too, so that rounding can't decide.
    """
    seats = lambda divisor: F.floor(F.col(votes) / divisor + 0.5)
    sure = F.when(house * 2 > count, F.greatest(seats(total / (house - count / 2)) - 1, F.lit(0))).otherwise(F.lit(0)).cast("long")
    most = F.when(total > 0, seats(total / (house + count / 2)) + 1).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("_sure", sure).withColumn("_most", most)
    return rows.withColumn("_k", F.explode(F.expr("if(_most > _sure, sequence(_sure, _most - 1), array(-1L))")))


def apportion(rows: DataFrame, votes: str, house: int, order: str) -> DataFrame:
    """Adds seats: ``house`` seats by Sainte-Lague over all rows, ranked by all tasks. ``order`` names a unique column."""
    total, count = rows.agg(F.sum(votes), F.count("*")).first()
    if not total:
        return rows.withColumn("seats", F.lit(0).cast("long"))
    tried = stored(_contested(rows, votes, F.lit(float(total)), F.lit(float(count)), F.lit(float(house))), "quotients")
    certain = tried.select(order, "_sure").distinct().agg(F.sum("_sure")).first()[0]
    ranked = in_order(tried.where("_k >= 0").withColumn("_quotient", _quotient(votes)), [F.desc("_quotient"), F.col(order)], "quotient-ranks", "_rank")
    won = ranked.where(F.col("_rank") < house - certain).groupBy(order).agg(F.count("*").alias("_won"))
    known = tried.groupBy(order).agg(F.max("_sure").alias("_sure")).join(won, order, "left")
    return rows.join(known.select(order, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("seats")), order)


def apportion_within(rows: DataFrame, group: str, votes: str, house: str, order: str) -> DataFrame:
    """Adds quota: in each group, the ``house`` seats of its rows by Sainte-Lague. A group is ordered in one task."""
    whole = Window.partitionBy(group)
    summed = rows.withColumn("_total", F.sum(votes).over(whole)).withColumn("_count", F.count("*").over(whole))
    tried = _contested(summed, votes, F.col("_total"), F.col("_count"), F.col(house))
    tried = tried.withColumn("_quotient", F.when(F.col("_k") >= 0, _quotient(votes)))
    first = (F.col("_k") == F.col("_sure")) | (F.col("_k") < 0)
    certain = F.sum(F.when(first, F.col("_sure"))).over(whole)
    place = F.row_number().over(whole.orderBy(F.desc_nulls_last("_quotient"), order))
    ranked = tried.withColumn("_certain", certain).withColumn("_place", place)
    won = (F.col("_k") >= 0) & (F.col("_place") <= F.col(house) - F.col("_certain"))
    quotas = ranked.groupBy(group, order).agg((F.max("_sure") + F.count(F.when(won, 1))).alias("quota"))
    return rows.join(quotas, [group, order])


def source_table(sized: DataFrame, weights: tuple[int, ...], most_repeats: int, block_words: int) -> DataFrame:
    """One row per source: number, source, size, weight, target, seats, and the repeats and blocks that make up its seats."""
    sizes = sized.groupBy("source").agg(F.sum("_size").alias("size"))
    named = in_order(sizes, [F.col("source").isNull(), F.col("source")], "sources", "number")
    cycle = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    targets = stored(capped_targets(named.withColumn("weight", cycle), most_repeats), "targets")
    words = targets.agg(F.sum("size")).first()[0] or 0
    seated = apportion(targets, "target", (2 * words + block_words) // (2 * block_words), "number")
    budget = F.least(F.col("seats") * block_words, F.col("size") * most_repeats)
    seated = seated.withColumn("_budget", budget).withColumn("repeats", F.when(F.col("size") > 0, F.expr("_budget div size")).otherwise(F.lit(0)).cast("long"))
    blocks = F.ceil(F.col("size") / block_words)
    picked = F.least(blocks, F.floor((F.col("_budget") - F.col("repeats") * F.col("size")) / block_words + 0.5))
    return stored(seated.withColumn("blocks", picked.cast("long")).drop("_budget"), "seats")


def _shard_table(placed: DataFrame, sources: DataFrame, block_words: int, seed: int) -> DataFrame:
    """One row per shard of a source: where it begins among the source's words, its first block, its quota and its permutation."""
    cells = placed.groupBy("number", "_shard").agg(F.sum("_size").alias("_words"))
    order = Window.partitionBy("number").orderBy("_shard")
    begin = F.sum("_words").over(order) - F.col("_words")
    cells = cells.withColumn("begin", begin).withColumn("first", F.ceil(F.col("begin") / block_words))
    cells = cells.withColumn("count", F.ceil((F.col("begin") + F.col("_words")) / block_words) - F.col("first"))
    cells = stored(cells.join(broadcast_if_small(sources.select("number", "blocks")), "number"), "shards")
    quotas = apportion_within(cells, "number", "count", "blocks", "_shard")
    draw = _seeded(seed, F.col("number"), F.col("_shard"))
    step = F.element_at(F.array(*[F.lit(s).cast("long") for s in STEPS]), (draw % len(STEPS) + 1).cast("int"))
    quotas = quotas.withColumn("step", step).withColumn("shift", draw)
    last = F.when(F.col("count") > 0, _is_picked(F.col("count") - 1).cast("int"))
    # the block that reaches into a shard starts in the last shard before it in which a block starts
    return quotas.withColumn("reaching", F.coalesce(F.last(last, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _is_picked(place: Column) -> Column:
    """Whether the block at a place of its shard is among the first ``quota`` of the permutation."""
    return F.pmod(place * F.col("step") + F.col("shift"), F.greatest(F.col("count"), F.lit(1))) < F.col("quota")


def mix_sources(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    weights: tuple[int, ...] = (1, 2, 3),
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    most_repeats: int = MOST_REPEATS,
    seed: int = SEED,
    key: str = "doc_id",
) -> DataFrame:
    """The columns ``keep``, with size, source_size, target, repeats and spans (start and length in words, in order).

    The mix takes the whole document ``repeats`` times and its spans once more. ``weights`` are dealt to the sources in turn,
    in the order of their code points. ``key`` orders documents; rows of one key and size are interchangeable.
    """
    draw = _seeded(seed, F.col(key))
    sized = docs.select(
        F.struct(*keep).alias("_kept"), F.col("source"), F.col(key).cast("string").alias("_key"), sized_words(F.col("text")).alias("_size"), draw.alias("_draw")
    ).withColumn("_shard", F.floor(F.col("_draw") * shards / (1 << 32)).cast("long"))
    sized = stored(sized, "sizes")
    sources = source_table(sized, weights, most_repeats, block_words)
    about = broadcast_if_small(sources.select(F.col("source").alias("_name"), "number", F.col("size").alias("source_size"), "target", "repeats"))
    placed = sized.join(about, F.col("source").eqNullSafe(F.col("_name"))).drop("_name", "source")
    cells = _shard_table(placed, sources, block_words, seed).select("number", "_shard", "begin", "first", "count", "quota", "step", "shift", "reaching")
    inside = Window.partitionBy("number", "_shard").orderBy("_draw", "_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(cells, ["number", "_shard"])
    at = at.withColumn("_from", F.col("begin") + F.col("_inside")).withColumn("_to", F.col("_from") + F.col("_size"))
    own = F.expr(f"if(_size > 0, sequence(_from div {block_words}, (_to - 1) div {block_words}), cast(array() as array<long>))")

    def picked(block: Column) -> Column:
        return F.when(block < F.col("first"), F.col("reaching") == 1).otherwise(_is_picked(block - F.col("first")))

    def span(block: Column) -> Column:
        start, stop = F.greatest(block * block_words, F.col("_from")), F.least((block + 1) * block_words, F.col("_to"))
        return F.struct((start - F.col("_from")).alias("start"), (stop - start).alias("length"))

    spans = F.transform(F.filter(own, picked), span)
    return at.select("_kept.*", F.col("_size").alias("size"), "source_size", "target", "repeats", spans.alias("spans"))


def taken_words(mix: DataFrame) -> Column:
    """How many words a mix takes of a document, repeats counted."""
    return F.col("repeats") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The texts of the mix: doc_id, source, copy, start and text; a whole document starts at word 0 with its own spacing, spans are joined by blanks."""
    rows = numbered(docs.select("doc_id", "source", "text"), "mixed-rows")
    mix = mix_sources(rows, keep=("_row",), **options).select("_row", "repeats", "spans")
    both = rows.join(mix, "_row").where((F.col("repeats") > 0) | (F.size("spans") > 0))
    word = F.regexp_extract_all("text", F.lit(SIZED_WORD), F.lit(0))
    wholes = F.transform(F.expr("if(repeats > 0, sequence(1, repeats), cast(array() as array<long>))"), lambda n: F.struct(n.alias("copy"), F.lit(0).cast("long").alias("start"), F.col("text").alias("text")))
    both = both.withColumn("_words", F.when(F.size("spans") > 0, word).otherwise(F.array().cast("array<string>")))
    parts = F.transform(
        "spans",
        lambda s: F.struct((F.col("repeats") + 1).alias("copy"), s["start"].alias("start"), F.array_join(F.slice("_words", (s["start"] + 1).cast("int"), s["length"].cast("int")), " ").alias("text")),
    )
    return both.select("doc_id", "source", F.explode(F.concat(wholes, parts)).alias("m")).select("doc_id", "source", "m.*")
