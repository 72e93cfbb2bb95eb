"""Texts of documents from their decoded elements.

Elements are gathered per page first and per document afterwards. A document with very many elements is so put
together by many tasks, and only its page texts meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import DRAWING_MIN_TEXT_PARTS, NATIVE_TEXT_CHARS_PER_PAGE
from paperloom.functions.text import strip

_NONE = "array<string>"


def _no_parts() -> Column:
    return F.array().cast(_NONE)


def items_by_page(elements: DataFrame, *columns: str) -> DataFrame:
    """document_id, page, items: the elements of the page in order."""
    return elements.groupBy("document_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("ord", *columns))).alias("items")
    )


def join_pages(pages: DataFrame, *extras: Column) -> DataFrame:
    """document_id, text from the ``parts`` of its pages, with further aggregates."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "parts")))
    return pages.groupBy("document_id").agg(
        F.array_join(F.flatten(F.transform(ordered, lambda p: p["parts"])), "\n").alias("text"), *extras
    )


def table_text(cells: Column) -> Column:
    """Cells joined by tabs, null cells empty, rows joined by line breaks."""
    return F.array_join(F.transform(cells, lambda row: F.array_join(row, "\t", "")), "\n")


def page_header(kind: str, page: Column) -> Column:
    return F.concat(F.lit(f"\n[{kind} "), page.cast("string"), F.lit("]\n"))


def assemble_pages(elements: DataFrame) -> DataFrame:
    """Text of every page under its header, followed by its tables: document_id, text, page_count."""
    texts = F.array_join(
        F.transform(
            F.filter("items", lambda e: (e["kind"] != "table") & (e["text"] != "")), lambda e: e["text"]
        ),
        "\n",
    )
    tables = F.transform(
        F.filter("items", lambda e: e["kind"] == "table"),
        lambda e: F.concat(page_header("Table on Page", F.col("page")), e["table"]),
    )
    flat = elements.withColumn("table", F.when(F.col("kind") == "table", table_text(F.col("cells"))))
    pages = items_by_page(flat, "kind", "name", "text", "table").withColumn("texts", texts)
    own = F.when(F.col("texts") != "", F.array(F.concat(page_header("Page", F.col("page")), "texts"))).otherwise(
        _no_parts()
    )
    return join_pages(pages.withColumn("parts", F.concat(own, tables)), F.max("page").alias("page_count"))


def sparse_text_flag(text: Column, page_count: Column, threshold: int = NATIVE_TEXT_CHARS_PER_PAGE) -> Column:
    """True if a page has on average fewer characters than the threshold; false without pages."""
    return F.when(page_count == 0, F.lit(False)).otherwise(F.length(text) < threshold * page_count)


def choose_text_source(native: DataFrame, recognised: DataFrame, provided: DataFrame | None = None) -> DataFrame:
    """Native text, or the recognised text where the native one is sparse.

    native: document_id, text, page_count. recognised: document_id, text. provided: document_id, page_count.
    """
    joined = native.join(recognised.select("document_id", F.col("text").alias("seen")), "document_id", "left")
    count = F.col("page_count")
    if provided is not None:
        joined = joined.join(
            provided.select("document_id", F.col("page_count").alias("given")), "document_id", "left"
        )
        count = F.coalesce(F.nullif(F.col("given"), F.lit(0)), count)
    sparse = sparse_text_flag(F.col("text"), F.col("page_count"))
    return joined.select(
        "document_id",
        F.when(sparse, F.coalesce("seen", F.lit(""))).otherwise(F.col("text")).alias("text"),
        count.alias("page_count"),
        F.when(sparse, "ocr").otherwise("native").alias("extraction_method"),
    )


def assemble_sheets(rows: DataFrame) -> DataFrame:
    """Workbooks from rows (document_id, page = sheet number, sheet_name, ord, cells).

    document_id, text, page_count = number of sheets, sheets = array<struct<page, name, rows>>.
    """
    sheets = rows.groupBy("document_id", "page", "sheet_name").agg(
        F.array_sort(F.collect_list(F.struct("ord", "cells"))).alias("items")
    )
    lines = F.transform("items", lambda e: F.array_join(e["cells"], "\t", ""))
    header = F.concat(F.lit("\n[Sheet: "), "sheet_name", F.lit("]\n"))
    parts = sheets.withColumn("parts", F.concat(F.array(header), lines))
    info = F.struct("page", F.col("sheet_name").alias("name"), F.size("items").alias("rows"))
    return join_pages(
        parts.withColumn("info", info),
        F.count(F.lit(1)).cast("int").alias("page_count"),
        F.array_sort(F.collect_list("info")).alias("sheets"),
    )


def assemble_slides(elements: DataFrame) -> DataFrame:
    """Presentations: document_id, text, page_count, slides = array<struct<number, text_blocks>>."""
    slides = items_by_page(elements, "kind", "name", "text")
    texts = F.transform(F.filter("items", lambda e: e["text"] != ""), lambda e: e["text"])
    parts = slides.withColumn("texts", texts).withColumn(
        "parts", F.concat(F.array(page_header("Slide", F.col("page"))), "texts")
    )
    info = F.struct(F.col("page").alias("number"), F.size("texts").alias("text_blocks"))
    return join_pages(
        parts.withColumn("info", info),
        F.count(F.lit(1)).cast("int").alias("page_count"),
        F.array_sort(F.collect_list("info")).alias("slides"),
    )


def assemble_paragraphs(paragraphs: DataFrame, provided: DataFrame | None = None) -> DataFrame:
    """Non-blank paragraphs (document_id, page, ord, style, text) with the list of headings."""
    pages = items_by_page(paragraphs.where(strip(F.col("text")) != ""), "style", "text")
    parts = pages.withColumn("parts", F.transform("items", lambda e: e["text"]))
    headings = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("page", "items"))),
            lambda p: F.transform(
                F.filter(p["items"], lambda e: e["style"].startswith("Heading")),
                lambda e: F.struct(e["style"].alias("level"), e["text"].alias("text")),
            ),
        )
    )
    joined = join_pages(parts, headings.alias("headings"))
    if provided is None:
        return joined.withColumn("page_count", F.lit(1))
    given = provided.select("document_id", F.nullif(F.col("page_count"), F.lit(0)).alias("page_count"))
    return joined.join(given, "document_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(1)))


def drawing_part() -> Column:
    """The text that an entity contributes: attributes carry their tag; other kinds and empty texts give null."""
    return F.when(
        F.col("text") != "",
        F.when(F.col("kind").isin("TEXT", "MTEXT"), F.col("text")).when(
            F.col("kind") == "ATTRIB", F.concat(F.lit("[ATTRIB:"), "name", F.lit("]: "), "text")
        ),
    )


def assemble_drawing_text(elements: DataFrame) -> DataFrame:
    """Drawings: document_id, text, text_parts."""
    parts = elements.withColumn("part", drawing_part()).where(F.col("part").isNotNull())
    pages = items_by_page(parts, "kind", "name", "part").withColumn("parts", F.transform("items", lambda e: e["part"]))
    return join_pages(pages, F.sum(F.size("items")).cast("int").alias("text_parts"))


def native_blocks(elements: DataFrame) -> DataFrame:
    """Text entities as blocks of full confidence with the box x, y, x + w, y + h."""
    texts = elements.where(F.col("kind").isin("TEXT", "MTEXT") & (F.col("text") != ""))
    box = F.struct(
        F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"),
        (F.col("y") + F.col("h")).alias("y2"),
    )
    return texts.select("document_id", "page", "ord", "text", F.lit(1.0).alias("confidence"), box.alias("bbox"))


def title_block(elements: DataFrame) -> DataFrame:
    """document_id, fields: map of title-block fields; of several entities for a field the last one counts."""
    tag = F.upper("name")
    key = (
        F.when(tag.contains("DRAWING") | tag.contains("TITLE"), "title")
        .when(tag.contains("NUMBER") | tag.contains("DWG"), "drawing_number")
        .when(tag.contains("REV"), "revision")
        .otherwise(F.lower("name"))
    )
    last = F.max_by("text", F.struct("page", "ord", "kind", "name", "text"))
    per_key = elements.where(F.col("kind") == "ATTRIB").groupBy("document_id", key.alias("key")).agg(last.alias("value"))
    return per_key.groupBy("document_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields")
    )


def drawing_needs_ocr(
    elements: DataFrame, recognised: DataFrame, min_parts: int = DRAWING_MIN_TEXT_PARTS
) -> DataFrame:
    """Drawings with the recognised text appended where fewer than ``min_parts`` texts were found."""
    drawn = elements.select("document_id").distinct().join(assemble_drawing_text(elements), "document_id", "left")
    seen = recognised.select("document_id", F.col("text").alias("seen"))
    short = F.coalesce("text_parts", F.lit(0)) < min_parts
    both = F.concat_ws("\n", "text", F.coalesce("seen", F.lit("")))
    return drawn.join(seen, "document_id", "left").select(
        "document_id",
        F.when(short, both).otherwise(F.col("text")).alias("text"),
        F.when(short, "dxf+ocr").otherwise("dxf").alias("extraction_method"),
    )
