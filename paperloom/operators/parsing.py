"""Deterministic parsing of texts into fields and child tables: one narrow projection per corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fields as X


def parse_documents(docs: DataFrame, strict: bool = False) -> DataFrame:
    """docs: document_id, text and optionally the known page_count.

    Adds six scalar fields, five lists, the signature block, text_length and fields_extracted.
    """
    text = F.col("text")
    given = F.col("page_count") if "page_count" in docs.columns else None
    parsed = docs.select(
        "document_id",
        X.extract_document_number(text).alias("document_number"),
        X.extract_title(text).alias("title"),
        X.extract_revision(text, strict).alias("revision"),
        X.extract_issue_status(text).alias("issue_status"),
        X.extract_contract_number(text, strict).alias("contract_number"),
        X.extract_page_count(text, given).alias("page_count"),
        X.extract_revision_history(text).alias("revision_history"),
        X.extract_comments(text).alias("comments"),
        X.extract_legend_symbols(text).alias("legend_symbols"),
        X.extract_equipment_ratings(text).alias("equipment_ratings"),
        X.extract_drawing_index(text).alias("drawing_index"),
        X.extract_signature_block(text, strict).alias("signature_block"),
        F.length(text).alias("text_length"),
    )
    return parsed.withColumn("fields_extracted", X.count_extracted_fields())


def explode_children(parsed: DataFrame) -> dict[str, DataFrame]:
    """The five child tables; entries are numbered from 1 within their document."""

    def rows(column: str) -> DataFrame:
        exploded = parsed.select("document_id", F.posexplode(column).alias("pos", "e"))
        return exploded.select("document_id", (F.col("pos") + 1).alias("seq"), "e.*" if column != "comments" else "e")

    comments = rows("comments").select("document_id", "seq", "e.client_comment", "e.contractor_response")
    return {
        "revision_history": rows("revision_history").drop("raw"),
        "comments_response": comments,
        "legend_symbols": rows("legend_symbols"),
        "equipment_ratings": rows("equipment_ratings"),
        "drawing_index": rows("drawing_index"),
    }
