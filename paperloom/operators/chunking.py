"""Two-level chunking of texts. Every step is a narrow expression: no shuffle and no Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import CHILD, CHILD_OVERLAP, CHILD_SIZE, PARENT, PARENT_OVERLAP, PARENT_SIZE
from paperloom.functions.fields import extract_page_numbers, starts_page
from paperloom.functions.text import let, overlap_tail, split_sections, tokens_of_words, word_count

JOINER = "\n\n"
_PACKED = "struct<done:array<struct<content:string,token_count:int>>,held:array<string>,n_words:int,tokens:int>"


def pack_sections(sections: Column, size: int, overlap: int) -> Column:
    """Greedy packing of sections into array<struct<content, token_count>>.

    A section that would exceed ``size`` closes the held ones; the next chunk then starts with their last ``overlap``
    words. A section longer than ``size`` stays whole. The fold keeps the held sections as a list and their word count
    as a number, so text is joined once per chunk and not once per section.
    """
    counted = F.transform(sections, lambda s: F.struct(s.alias("text"), word_count(s).alias("n_words")))
    start = F.struct(
        F.array().cast("array<struct<content:string,token_count:int>>").alias("done"),
        F.array().cast("array<string>").alias("held"),
        F.lit(0).alias("n_words"),
        F.lit(0).alias("tokens"),
    ).cast(_PACKED)

    def closed(acc: Column) -> Column:
        content = F.array_join(acc["held"], JOINER)
        return F.concat(acc["done"], F.array(F.struct(content.alias("content"), acc["tokens"].alias("token_count"))))

    def step(acc: Column, section: Column) -> Column:
        added = tokens_of_words(section["n_words"])
        full = (acc["tokens"] + added > size) & (F.size(acc["held"]) > 0)
        carried = F.least(acc["n_words"], F.lit(overlap)) + section["n_words"]
        restarted = F.struct(
            closed(acc).alias("done"),
            F.array(overlap_tail(F.array_join(acc["held"], JOINER), overlap), section["text"]).alias("held"),
            carried.alias("n_words"),
            tokens_of_words(carried).alias("tokens"),
        )
        extended = F.struct(
            acc["done"].alias("done"),
            F.concat(acc["held"], F.array(section["text"])).alias("held"),
            (acc["n_words"] + section["n_words"]).alias("n_words"),
            (acc["tokens"] + added).alias("tokens"),
        )
        return F.when(full, restarted).otherwise(extended)

    return F.aggregate(
        counted, start, step, lambda acc: F.when(F.size(acc["held"]) > 0, closed(acc)).otherwise(acc["done"])
    )


def parent_chunks(
    docs: DataFrame, size: int = PARENT_SIZE, overlap: int = PARENT_OVERLAP, sep: str = JOINER
) -> DataFrame:
    """docs: document_id, text -> document_id, chunk_index, content, token_count."""
    packed = pack_sections(split_sections(F.col("text"), sep), size, overlap)
    return docs.select("document_id", F.posexplode(packed).alias("chunk_index", "chunk")).select(
        "document_id", "chunk_index", "chunk.content", "chunk.token_count"
    )


def child_chunks(parents: DataFrame, size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP) -> DataFrame:
    """Children of every parent, numbered within it: document_id, parent_index, chunk_index, content, token_count."""
    packed = pack_sections(split_sections(F.col("content")), size, overlap)
    return parents.select(
        "document_id",
        F.col("chunk_index").alias("parent_index"),
        F.posexplode(packed).alias("child_index", "chunk"),
    ).select(
        "document_id", "parent_index", F.col("child_index").alias("chunk_index"), "chunk.content", "chunk.token_count"
    )


def chunk_key(document_id: Column, parent_index: Column, child_index: Column | None = None) -> Column:
    """Chunk id made of the position, so that a child knows its parent's id without a join."""
    parts = [document_id, parent_index] + ([] if child_index is None else [child_index])
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def link_parents(parents: DataFrame, children: DataFrame) -> DataFrame:
    """The chunk table of both levels, children with the id of their parent."""
    parent_key = chunk_key(F.col("document_id"), F.col("chunk_index"))
    upper = parents.select(
        parent_key.alias("chunk_id"),
        "document_id",
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(PARENT).alias("level"),
        "chunk_index",
        "content",
        "token_count",
    )
    lower = children.select(
        chunk_key(F.col("document_id"), F.col("parent_index"), F.col("chunk_index")).alias("chunk_id"),
        "document_id",
        chunk_key(F.col("document_id"), F.col("parent_index")).alias("parent_id"),
        F.lit(CHILD).alias("level"),
        "chunk_index",
        "content",
        "token_count",
    )
    return upper.unionByName(lower)


def with_pages(packed: Column, overlap: int, before: Column) -> Column:
    """Packed chunks with ``page``, on which their text begins, and ``pages``, all that it stands on, ascending.

    Pages are told by markers such as ``[Page 5]``. A chunk that does not begin with a marker goes on with the page that
    its first words stand on: the last marker before them, where words repeated from the chunk before are counted once.
    ``before`` is the page at the start of the text, null if unknown; then the first marker of the chunk counts.
    """

    def marked(chunk: Column) -> Column:
        markers = F.array_compact(extract_page_numbers(chunk["content"]))
        repeated = F.size(F.array_compact(extract_page_numbers(overlap_tail(chunk["content"], overlap))))
        # no marker, no tail to look at
        left = lambda m: F.when(F.size(m) > 0, let(F.size(m) - repeated, lambda n: F.when(n > 0, F.get(m, n - 1))))
        return let(markers, lambda m: F.struct(chunk.alias("chunk"), m.alias("markers"), left(m).alias("left")))

    start = F.struct(before.cast("int").alias("page"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, entry: Column) -> Column:
        return F.struct(
            F.coalesce(entry["left"], acc["page"]).alias("page"), F.concat(acc["at"], F.array(acc["page"])).alias("at")
        )

    def row(entry: Column, at: Column) -> Column:
        first = F.get(entry["markers"], F.lit(0))
        page = F.when(starts_page(entry["chunk"]["content"]), first).otherwise(F.coalesce(at, first))
        return F.struct(
            entry["chunk"]["content"].alias("content"),
            entry["chunk"]["token_count"].alias("token_count"),
            page.alias("page"),
            F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(page), entry["markers"])))).alias("pages"),
        )

    return let(
        F.transform(packed, marked),
        lambda entries: F.zip_with(entries, F.aggregate(entries, start, step, lambda acc: acc["at"]), row),
    )


def chunk_corpus(
    docs: DataFrame,
    sep: str = JOINER,
    parent_size: int = PARENT_SIZE,
    parent_overlap: int = PARENT_OVERLAP,
    child_size: int = CHILD_SIZE,
    child_overlap: int = CHILD_OVERLAP,
    pages: bool = False,
) -> DataFrame:
    """The same table as ``link_parents`` gives, in one pass over the corpus: each text is packed once.

    With ``pages``, the chunks of texts with page markers also have the columns of ``with_pages``.
    """
    fields = ["content", "token_count"] + (["page", "pages"] if pages else [])

    def packed(text: Column, sep: str, size: int, overlap: int, before: Column) -> Column:
        chunks = pack_sections(split_sections(text, sep), size, overlap)
        return with_pages(chunks, overlap, before) if pages else chunks

    upper = packed(F.col("text"), sep, parent_size, parent_overlap, F.lit(None))
    parents = docs.select("document_id", F.posexplode(upper).alias("chunk_index", "chunk")).select(
        "document_id", "chunk_index", *[F.col(f"chunk.{c}") for c in fields]
    )
    lower = packed(F.col("content"), JOINER, child_size, child_overlap, F.col("page") if pages else F.lit(None))
    parent_key = chunk_key(F.col("document_id"), F.col("chunk_index"))

    def row(key: Column, parent: Column, level: str, index: Column, value) -> Column:
        return F.struct(
            key.alias("chunk_id"),
            parent.alias("parent_id"),
            F.lit(level).alias("level"),
            index.alias("chunk_index"),
            *[value(c).alias(c) for c in fields],
        )

    own = row(parent_key, F.lit(None).cast("string"), PARENT, F.col("chunk_index"), F.col)
    below = F.transform(
        lower, lambda c, i: row(F.concat_ws(":", parent_key, i.cast("string")), parent_key, CHILD, i, lambda f: c[f])
    )
    return parents.select("document_id", F.inline(F.concat(F.array(own), below)))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(
        F.count_if(F.col("level") == PARENT).alias("parents"), F.count_if(F.col("level") == CHILD).alias("children")
    )
