"""Queries on text assembly and recognised blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.constants import OCR_CONFIDENCE
from paperloom.operators import assembly as B
from paperloom.operators import recognition as C
from paperloom.plans.admission import NOW, now, time_text
from paperloom.plans.registry import query, shared_sql
from paperloom.sources.views import Source

_NL = "chr(10)"


def elements(src: Source):
    cells = F.array(F.array("name", "text"), F.array("kind", F.lit(None).cast("string")))
    return src.elements.withColumn("cells", cells)


shared_sql("cell_texts", f"SELECT *, name || chr(9) || text || {_NL} || kind || chr(9) AS cell_text FROM elements")
shared_sql(
    "page_parts",
    f"""SELECT document_id, page, string_agg(text, {_NL} ORDER BY ord, kind, name, text) FILTER (kind <> 'table' AND text <> '') AS texts,
  string_agg({_NL} || '[Table on Page ' || page || ']' || {_NL} || cell_text, {_NL} ORDER BY ord, kind, name, text) FILTER (kind = 'table') AS tables
FROM cell_texts GROUP BY document_id, page""",
)
shared_sql(
    "native_texts",
    f"""SELECT document_id, coalesce(string_agg(part, {_NL} ORDER BY page), '') AS text, max(page) AS page_count FROM (
  SELECT document_id, page, nullif(concat_ws({_NL}, {_NL} || '[Page ' || page || ']' || {_NL} || texts, tables), '') AS part FROM page_parts) GROUP BY document_id""",
)


@query("assemble_pages", "SELECT document_id, text, page_count FROM native_texts")
def assemble_pages(src: Source):
    return B.assemble_pages(elements(src))


@query("table_text", "SELECT document_id, page, ord, cell_text FROM cell_texts")
def table_text(src: Source):
    return elements(src).select("document_id", "page", "ord", B.table_text(F.col("cells")).alias("cell_text"))


@query(
    "sparse_text_flag",
    "SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN false ELSE length(text) / (doc_id % 40) < 50 END AS needs_ocr FROM documents",
)
def sparse_text_flag(src: Source):
    return src.documents.select("doc_id", B.sparse_text_flag(F.col("text"), F.col("doc_id") % 40).alias("needs_ocr"))


shared_sql(
    "recognised_texts",
    f"""SELECT document_id, string_agg(part, {_NL} ORDER BY page) AS text FROM (
  SELECT document_id, page, {_NL} || '[Page ' || page || ']' || {_NL} || coalesce(string_agg(text, {_NL} ORDER BY ord, text, confidence, x, y) FILTER (confidence >= 0.75e0), '') AS part
  FROM ocr_blocks GROUP BY document_id, page) GROUP BY document_id""",
)


@query(
    "choose_text_source",
    """SELECT n.document_id, CASE WHEN length(n.text) / n.page_count < 50 THEN coalesce(r.text, '') ELSE n.text END AS text,
  coalesce(nullif(d.page_count, 0), n.page_count) AS page_count, CASE WHEN length(n.text) / n.page_count < 50 THEN 'ocr' ELSE 'native' END AS extraction_method
FROM native_texts n LEFT JOIN recognised_texts r ON r.document_id = n.document_id LEFT JOIN ref_documents d ON d.id = n.document_id""",
)
def choose_text_source(src: Source):
    provided = src.ref_documents.select(F.col("id").alias("document_id"), "page_count")
    return B.choose_text_source(B.assemble_pages(elements(src)), C.gated_page_text(src.ocr_blocks), provided)


@query(
    "assemble_sheets",
    f"""SELECT document_id, string_agg({_NL} || '[Sheet: S' || page || ']' || {_NL} || {_NL} || rows_text, {_NL} ORDER BY page) AS text, CAST(count(*) AS INT) AS page_count,
  string_agg('S' || page || '=' || n, ',' ORDER BY page) AS sheets FROM (
  SELECT document_id, page, count(*) AS n, string_agg(name || chr(9) || text, {_NL} ORDER BY ord, name, text) AS rows_text FROM elements GROUP BY document_id, page) GROUP BY document_id""",
)
def assemble_sheets(src: Source):
    rows = src.elements.select(
        "document_id", "page", F.concat(F.lit("S"), F.col("page").cast("string")).alias("sheet_name"), "ord",
        F.array("name", "text").alias("cells"),
    )
    listed = F.transform("sheets", lambda s: F.concat(s["name"], F.lit("="), s["rows"].cast("string")))
    return B.assemble_sheets(rows).select("document_id", "text", "page_count", F.array_join(listed, ",").alias("sheets"))


@query(
    "assemble_slides",
    f"""SELECT document_id, string_agg(concat_ws({_NL}, {_NL} || '[Slide ' || page || ']' || {_NL}, texts), {_NL} ORDER BY page) AS text, CAST(count(*) AS INT) AS page_count,
  string_agg(page || '=' || n, ',' ORDER BY page) AS slides FROM (
  SELECT document_id, page, count(*) FILTER (text <> '') AS n, string_agg(text, {_NL} ORDER BY ord, kind, name, text) FILTER (text <> '') AS texts FROM elements GROUP BY document_id, page) GROUP BY document_id""",
)
def assemble_slides(src: Source):
    listed = F.transform(
        "slides", lambda s: F.concat(s["number"].cast("string"), F.lit("="), s["text_blocks"].cast("string"))
    )
    return B.assemble_slides(src.elements).select(
        "document_id", "text", "page_count", F.array_join(listed, ",").alias("slides")
    )


@query(
    "assemble_paragraphs",
    f"""SELECT e.document_id, string_agg(text, {_NL} ORDER BY page, ord, style, text) AS text, coalesce(string_agg(style || ':' || text, ',' ORDER BY page, ord, style, text) FILTER (style LIKE 'Heading%'), '') AS headings,
  coalesce(nullif(any_value(d.page_count), 0), 1) AS page_count FROM (SELECT *, CASE name WHEN 'TITLE1' THEN 'Heading 1' WHEN 'DWG_NO' THEN 'Heading 2' ELSE 'Normal' END AS style FROM elements) e
LEFT JOIN ref_documents d ON d.id = e.document_id WHERE trim(text) <> '' GROUP BY e.document_id""",
)
def assemble_paragraphs(src: Source):
    style = F.when(F.col("name") == "TITLE1", "Heading 1").when(F.col("name") == "DWG_NO", "Heading 2").otherwise("Normal")
    provided = src.ref_documents.select(F.col("id").alias("document_id"), "page_count")
    texts = B.assemble_paragraphs(src.elements.withColumn("style", style), provided)
    listed = F.transform("headings", lambda h: F.concat_ws(":", h["level"], h["text"]))
    return texts.select("document_id", "text", F.array_join(listed, ",").alias("headings"), "page_count")


shared_sql(
    "drawing_parts",
    """SELECT *, CASE WHEN kind = 'ATTRIB' THEN '[ATTRIB:' || name || ']: ' || text ELSE text END AS part FROM elements WHERE text <> '' AND kind <> 'table'""",
)
shared_sql(
    "drawn_texts",
    f"SELECT document_id, string_agg(part, {_NL} ORDER BY page, ord, kind, name, part) AS text, CAST(count(*) AS INT) AS text_parts FROM drawing_parts GROUP BY document_id",
)


@query("assemble_drawing_text", "SELECT document_id, text, text_parts FROM drawn_texts")
def assemble_drawing_text(src: Source):
    return B.assemble_drawing_text(src.elements)


@query(
    "native_blocks",
    "SELECT document_id, page, ord, text, 1e0 AS confidence, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM elements WHERE kind IN ('TEXT', 'MTEXT') AND text <> ''",
)
def native_blocks(src: Source):
    return B.native_blocks(src.elements).select("document_id", "page", "ord", "text", "confidence", "bbox.*")


@query(
    "title_block",
    """SELECT document_id, string_agg(key || '=' || value, ';' ORDER BY key) AS fields FROM (
  SELECT document_id, CASE WHEN name LIKE '%TITLE%' THEN 'title' WHEN name LIKE '%DWG%' THEN 'drawing_number' WHEN name LIKE '%REV%' THEN 'revision' ELSE lower(name) END AS key, text AS value
  FROM elements WHERE kind = 'ATTRIB' QUALIFY row_number() OVER (PARTITION BY document_id, key ORDER BY page DESC, ord DESC, kind DESC, name DESC, text DESC) = 1) GROUP BY document_id""",
)
def title_block(src: Source):
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return B.title_block(src.elements).select("document_id", F.array_join(F.array_sort(pairs), ";").alias("fields"))


@query(
    "drawing_needs_ocr",
    f"""SELECT e.document_id, CASE WHEN coalesce(t.text_parts, 0) < 10 THEN concat_ws({_NL}, t.text, coalesce(r.text, '')) ELSE t.text END AS text,
  CASE WHEN coalesce(t.text_parts, 0) < 10 THEN 'dxf+ocr' ELSE 'dxf' END AS extraction_method
FROM (SELECT DISTINCT document_id FROM elements) e LEFT JOIN drawn_texts t ON t.document_id = e.document_id LEFT JOIN recognised_texts r ON r.document_id = e.document_id""",
)
def drawing_needs_ocr(src: Source):
    return B.drawing_needs_ocr(src.elements, C.gated_page_text(src.ocr_blocks))


@query(
    "polygon_bbox",
    "SELECT document_id, page, ord, least(x, x + w) AS x1, least(y - 1, y) AS y1, greatest(x, x + w) AS x2, greatest(y + h, y) AS y2 FROM ocr_blocks",
)
def polygon_bbox(src: Source):
    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    x, y, w, h = (F.col(c) for c in "xywh")
    corners = F.array(point(x + w, y + h), point(x, y + h), point(x, y - 1), point(x + w, y))
    return src.ocr_blocks.select("document_id", "page", "ord", C.polygon_bbox(corners).alias("b")).select(
        "document_id", "page", "ord", "b.*"
    )


def tokens(src: Source):
    return src.ocr_blocks.select(
        "document_id", "page", "ord", "text", (F.col("w") * 2).alias("conf"), F.col("x").alias("left"),
        F.col("y").alias("top"), F.col("w").alias("width"), F.col("h").alias("height"),
    )


@query(
    "normalize_ocr_tokens",
    "SELECT document_id, page, ord, trim(text) AS text, w * 2 / 100e0 AS confidence, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM ocr_blocks WHERE trim(text) <> '' AND w * 2 / 100e0 >= 0.1e0",
)
def normalize_ocr_tokens(src: Source):
    return C.normalize_ocr_tokens(tokens(src)).select("document_id", "page", "ord", "text", "confidence", "bbox.*")


shared_sql(
    "failed_pages",
    "SELECT document_id, page FROM ocr_blocks GROUP BY document_id, page HAVING max(confidence) < 0.5e0",
)


def failed_pages(src: Source):
    best = src.ocr_blocks.groupBy("document_id", "page").agg(F.max("confidence").alias("best"))
    return best.where(F.col("best") < 0.5).select("document_id", "page")


@query(
    "engine_fallback",
    """SELECT b.document_id, b.page, b.ord, CASE WHEN f.page IS NULL THEN b.text ELSE 'second ' || b.text END AS text, CASE WHEN f.page IS NULL THEN confidence ELSE 1 - confidence END AS confidence
FROM ocr_blocks b LEFT JOIN failed_pages f ON f.document_id = b.document_id AND f.page = b.page""",
)
def engine_fallback(src: Source):
    primary = src.ocr_blocks.select("document_id", "page", "ord", "text", "confidence")
    secondary = primary.withColumn("text", F.concat(F.lit("second "), "text")).withColumn(
        "confidence", 1 - F.col("confidence")
    )
    return C.engine_fallback(primary, secondary, failed_pages(src))


@query(
    "confidence_gate",
    "SELECT document_id, page, ord, text, confidence, confidence >= 0.75e0 AS passed FROM ocr_blocks",
)
def confidence_gate(src: Source):
    passing, low = C.confidence_gate(src.ocr_blocks.select("document_id", "page", "ord", "text", "confidence"))
    return passing.withColumn("passed", F.lit(True)).unionByName(low.withColumn("passed", F.lit(False)))


@query(
    "low_confidence_regions",
    f"""SELECT document_id, page, '{{"bbox":[' || x || ',' || y || ',' || (x + w) || ',' || (y + h) || ']}}' AS bbox, text, confidence, false AS reviewed, '{NOW}' AS created_at
FROM ocr_blocks WHERE confidence < 0.75e0""",
)
def low_confidence_regions(src: Source):
    x, y, w, h = (F.col(c) for c in "xywh")
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))
    _, low = C.confidence_gate(src.ocr_blocks.withColumn("bbox", box), OCR_CONFIDENCE)
    return C.low_confidence_regions(low, now()).withColumn("created_at", time_text("created_at"))


@query(
    "gated_page_text",
    f"""SELECT document_id, string_agg(part, {_NL} ORDER BY page) AS text FROM (
  SELECT document_id, page, {_NL} || '[Page ' || page || ']' || {_NL} || coalesce(string_agg(text, {_NL} ORDER BY ord, text, confidence, x, y) FILTER (confidence >= 0.75e0), '') AS part
  FROM ocr_blocks b WHERE NOT EXISTS (SELECT 1 FROM failed_pages f WHERE f.document_id = b.document_id AND f.page = b.page) GROUP BY document_id, page) GROUP BY document_id""",
)
def gated_page_text(src: Source):
    return C.gated_page_text(src.ocr_blocks, failed_pages(src))


@query(
    "confidence_stats",
    """SELECT d.id AS document_id, count(b.document_id) AS total_blocks, count(*) FILTER (confidence >= 0.75e0) AS passing_blocks, count(*) FILTER (confidence < 0.75e0) AS low_confidence_blocks,
  round(coalesce(avg(confidence), 0e0), 9) AS avg_confidence, coalesce(min(confidence), 0e0) AS min_confidence, coalesce(max(confidence), 0e0) AS max_confidence
FROM ref_documents d LEFT JOIN ocr_blocks b ON b.document_id = d.id GROUP BY d.id""",
)
def confidence_stats(src: Source):
    stats = C.confidence_stats(src.ref_documents, src.ocr_blocks)
    return stats.withColumn("avg_confidence", F.round("avg_confidence", 9))
