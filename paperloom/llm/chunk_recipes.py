"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so: after a sentence end that follows one of half the letters, or at a line
end, from ``MIN_CHARS`` on. Distinct chunks get identifiers: the 64-bit hash and, where different chunks share a hash,
the number of the chunk's SHA-256 among them. A recipe is the ordered list of a text's identifiers, and texts are equal
when their recipes are. Only digests are shuffled; a text is read once and never moved.

Nulls and empty texts have the empty recipe and are equal to each other. A null id is smaller than any other. Of rows
with the same text and id exactly one stays. An empty table gives an empty result. Columns other than the id and the
text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scale import broadcast_if_small
from paperloom.llm.common import lower_ascii, numbered
from paperloom.session import stored

MIN_CHARS = 256
MAX_CHARS = 8192
CHUNK = rf"(?s).{{{MIN_CHARS},{MAX_CHARS}}}?(?:[a-m][.!?]\s|\n|\z)|.{{1,{MAX_CHARS}}}"


def chunk_digests(text: Column) -> Column:
    """Ordered digests of the chunks of a normalised text: a 64-bit hash and the SHA-256."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)),
        lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("s")),
    )


def chunk_dictionary(digests: DataFrame) -> DataFrame:
    """One row per distinct chunk: h, s and its number n among the chunks of the same 64-bit hash."""
    return digests.select("h", "s").distinct().withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("s")))


def recipes(rows: DataFrame) -> DataFrame:
    """(_row, recipe) for rows of (_row, chunks); texts without chunks are left out."""
    digests = rows.select("_row", F.posexplode("chunks").alias("pos", "c")).select("_row", "pos", "c.h", "c.s")
    dictionary = stored(chunk_dictionary(digests), "chunk-ids")
    parts = digests.join(dictionary, ["h", "s"]).groupBy("_row").agg(F.collect_list(F.struct("pos", "h", "n")).alias("parts"))
    return parts.select("_row", F.transform(F.array_sort("parts"), lambda p: F.struct(p.h, p.n)).alias("recipe"))


def grouped(rows: DataFrame) -> DataFrame:
    """Adds keep_id, group_size and kept to rows of (_row, doc_id, chunks, ...)."""
    nothing = F.array().cast("array<struct<h:bigint,n:int>>")
    lists = stored(
        rows.join(recipes(rows), "_row", "left").select(
            *[c for c in rows.columns if c != "chunks"], F.coalesce("recipe", nothing).alias("recipe")
        ),
        "recipes",
    )
    groups = lists.groupBy("recipe").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct(F.col("doc_id").alias("id"), (-F.col("_row")).alias("r"))).alias("last")
    )
    return lists.join(stored(groups, "recipe-groups"), "recipe").select(
        *[c for c in lists.columns if c != "recipe"],
        F.col("last.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == -F.col("last.r")).alias("kept"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and the SHA-256 of the normalised text."""
    text = lower_ascii(F.col(text_col))
    rows = numbered(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), chunk_digests(text).alias("chunks")), "chunks"
    )
    return grouped(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest id."""
    rows = numbered(
        docs.select(
            F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
            F.col(id_col).alias("doc_id"),
            chunk_digests(lower_ascii(F.col(text_col))).alias("chunks"),
        ),
        "documents",
    )
    dropped = stored(grouped(rows.select("_row", "doc_id", "chunks")).where(~F.col("kept")).select("_row"), "dropped")
    return rows.join(broadcast_if_small(dropped), "_row", "left_anti").select("doc.*")
