"""Recognised text blocks: normalising, confidence gating, and page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import OCR_CONFIDENCE, OCR_TOKEN_FLOOR
from paperloom.functions.text import strip
from paperloom.operators.assembly import items_by_page, join_pages, page_header


def polygon_bbox(polygon: Column) -> Column:
    """Bounding box of an array of points."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")
    )


def normalize_ocr_tokens(tokens: DataFrame, floor: float = OCR_TOKEN_FLOOR) -> DataFrame:
    """Tokens with a confidence of 0..100 as blocks; blank and hopeless ones are dropped."""
    box = F.struct(
        F.col("left").alias("x1"),
        F.col("top").alias("y1"),
        (F.col("left") + F.col("width")).alias("x2"),
        (F.col("top") + F.col("height")).alias("y2"),
    )
    others = [c for c in tokens.columns if c not in ("text", "conf", "left", "top", "width", "height")]
    blocks = tokens.select(
        *others, strip(F.col("text")).alias("text"), (F.col("conf") / 100.0).alias("confidence"), box.alias("bbox")
    )
    return blocks.where((F.col("text") != "") & (F.col("confidence") >= floor))


def engine_fallback(primary: DataFrame, secondary: DataFrame, failed_pages: DataFrame) -> DataFrame:
    """Blocks of the first engine, and of the second one for the pages on which the first failed."""
    failed = failed_pages.select("document_id", "page").distinct()
    keys = ["document_id", "page"]
    return primary.join(failed, keys, "left_anti").unionByName(secondary.join(failed, keys, "left_semi"))


def passes(threshold: float = OCR_CONFIDENCE) -> Column:
    return F.col("confidence") >= threshold


def confidence_gate(blocks: DataFrame, threshold: float = OCR_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    return blocks.where(passes(threshold)), blocks.where(~passes(threshold))


def low_confidence_regions(low: DataFrame, now: Column) -> DataFrame:
    """Rows of the review queue."""
    return low.select(
        "document_id",
        "page",
        F.to_json(F.struct(F.array("bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2").alias("bbox"))).alias("bbox"),
        "text",
        "confidence",
        F.lit(False).alias("reviewed"),
        now.alias("created_at"),
    )


def gated_page_text(
    blocks: DataFrame, failed_pages: DataFrame | None = None, threshold: float = OCR_CONFIDENCE
) -> DataFrame:
    """document_id, text: the passing texts of each page under its header. A page without any keeps its header."""
    if failed_pages is not None:
        blocks = blocks.join(failed_pages.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti")
    pages = items_by_page(blocks, "text", "confidence", "x", "y")
    passing = F.transform(F.filter("items", lambda b: b["confidence"] >= threshold), lambda b: b["text"])
    part = F.concat(page_header("Page", F.col("page")), F.array_join(passing, "\n"))
    return join_pages(pages.withColumn("parts", F.array(part)))


def confidence_stats(documents: DataFrame, blocks: DataFrame, threshold: float = OCR_CONFIDENCE) -> DataFrame:
    """Block counts and confidences per document; zeros for a document without blocks."""
    stats = blocks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_blocks"),
        F.count_if(passes(threshold)).alias("passing_blocks"),
        F.count_if(~passes(threshold)).alias("low_confidence_blocks"),
        F.avg("confidence").alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
    )
    names = stats.columns[1:]
    joined = documents.select(F.col("id").alias("document_id")).join(stats, "document_id", "left")
    zeros = {n: (0 if n.endswith("_blocks") else 0.0) for n in names}
    return joined.na.fill(zeros)
