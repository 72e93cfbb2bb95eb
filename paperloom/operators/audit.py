"""Uniform audit rows of the processing steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEEP = {"ignoreNullFields": "false"}


def _event(
    df: DataFrame,
    now: Column,
    event_type: str,
    metadata: list,
    entity_type: str = "document",
    confidence: Column | None = None,
) -> DataFrame:
    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    return df.select(
        now.alias("timestamp"),
        F.lit(event_type).alias("event_type"),
        F.lit(entity_type).alias("entity_type"),
        column("entity_id", "long").cast("long").alias("entity_id"),
        column("file_hash", "string").alias("file_hash"),
        column("model_version", "string").alias("model_version"),
        (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence_score"),
        F.to_json(F.struct(*metadata), _KEEP).alias("metadata"),
    )


def ocr_events(pages: DataFrame, now: Column) -> DataFrame:
    """pages: entity_id, file_hash, model_version, avg_confidence, page, block_count, low_confidence_count."""
    return _event(
        pages, now, "ocr", ["page", "block_count", "low_confidence_count"], confidence=F.col("avg_confidence")
    )


def parse_events(parsed: DataFrame, now: Column) -> DataFrame:
    """parsed: entity_id, file_hash, model_version, parser_type, success, extracted_fields (array)."""
    fields = F.coalesce("extracted_fields", F.array().cast("array<string>")).alias("extracted_fields")
    return _event(parsed, now, "parse", ["parser_type", "success", fields])


def validation_events(validated: DataFrame, now: Column) -> DataFrame:
    """validated: entity_id, file_hash, model_version, passed, rules_evaluated, rules_failed, rejection_note."""
    return _event(validated, now, "validate", ["passed", "rules_evaluated", "rules_failed", "rejection_note"])


def qa_events(log: DataFrame, now: Column) -> DataFrame:
    """log: the columns of the question log. The model is part of the metadata here."""
    metadata = [
        "query_text", "answer", "confidence_level", "cited_document_ids", "retrieved_chunk_ids", "model_version",
    ]
    events = _event(log, now, "qa", metadata, entity_type="query")
    return events.withColumn("model_version", F.lit(None).cast("string"))


def audit_events(ocr: DataFrame, parsed: DataFrame, validated: DataFrame, answered: DataFrame, now: Column) -> DataFrame:
    """All four kinds of events in one table."""
    return (
        ocr_events(ocr, now)
        .unionByName(parse_events(parsed, now))
        .unionByName(validation_events(validated, now))
        .unionByName(qa_events(answered, now))
    )
