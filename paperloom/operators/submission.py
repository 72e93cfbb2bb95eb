"""Submission of approved documents to an external controller: payloads, references and the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import APPROVED
from paperloom.functions.fields import LIST_FIELDS, SCALAR_FIELDS


def submittable(documents: DataFrame, discipline: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Approved documents with ``submission_discipline``, and the others with the reason of refusal."""
    given = F.coalesce(F.nullif(F.lit(discipline or ""), F.lit("")), F.col("discipline"))
    approved = F.col("status") == APPROVED
    reason = F.concat(
        F.lit("Document must be approved before submission. Current status: "), F.col("status")
    )
    return (
        documents.where(approved).withColumn("submission_discipline", given),
        documents.where(~approved).withColumn("reason", reason),
    )


def _absent_if_empty(column: str) -> Column:
    return F.when(F.size(column) > 0, F.col(column))


def submission_payloads(ready: DataFrame, now: Column, model_version: str, form: str = "full") -> DataFrame:
    """document_id, payload as JSON. Scalars that are empty or zero and lists without entries are left out.

    The short form carries the identifying columns only.
    """
    if form == "short":
        fields = F.struct(
            F.col("id").alias("document_id"), "file_hash", "document_number",
            F.col("submission_discipline").alias("discipline"), now.alias("submitted_at"),
        )
        return ready.select(
            F.col("id").alias("document_id"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("payload")
        )
    extension = F.regexp_extract("original_path", r"(\.[^./]+)$", 1)
    present = [c for c in SCALAR_FIELDS if c in ready.columns]
    lists = [c for c in LIST_FIELDS if c in ready.columns]
    scalars = [
        F.nullif(F.col(c), F.lit(0) if c == "page_count" else F.lit("")).alias(c) for c in present
    ]
    metadata = F.struct(
        F.col("id").alias("document_id"),
        F.col("file_hash").alias("file_hash"),
        extension.alias("file_extension"),
        F.col("submission_discipline").alias("discipline"),
        F.lit(model_version).alias("model_version"),
        now.alias("submission_timestamp"),
        *scalars,
        *[_absent_if_empty(c).alias(c) for c in lists],
    )
    payload = F.struct(
        F.lit("engineering_document").alias("submission_type"),
        F.col("submission_discipline").alias("discipline"),
        metadata.alias("metadata"),
        F.struct(F.col("file_hash").alias("hash"), extension.alias("extension")).alias("file_info"),
    )
    return ready.select(F.col("id").alias("document_id"), F.to_json(payload).alias("payload"))


def confirmation_ref(responses: DataFrame, mock: bool = False) -> DataFrame:
    """document_id, ref, status from the controller's JSON answers.

    The first of confirmation_ref, reference and id that is neither empty nor zero counts. Without one the submission
    failed or, in the ``mock`` form for an unavailable controller, gets a stand-in reference and stays pending.
    """
    parts = F.from_json("response", "confirmation_ref string, reference string, id string")

    def filled(name: str) -> Column:
        value = parts[name]
        return F.when(~value.isin("", "0", "false", "[]", "{}"), value)

    found = responses.select("document_id", F.coalesce(*[filled(n) for n in ("confirmation_ref", "reference", "id")]).alias("found"))
    missing = F.col("found").isNull()
    stand_in = F.concat(F.lit("MOCK-"), F.col("document_id").cast("string")) if mock else F.lit(None).cast("string")
    return found.select(
        "document_id",
        F.coalesce("found", stand_in).alias("ref"),
        F.when(missing, F.lit("pending" if mock else "failed")).otherwise("submitted").alias("status"),
    )


def submission_log(ready: DataFrame, refs: DataFrame, now: Column, model_version: str) -> DataFrame:
    """Log rows of the documents that the controller acknowledged."""
    acknowledged = refs.where(F.col("ref").isNotNull()).select(F.col("document_id").alias("id"), "ref")
    return ready.join(acknowledged, "id").select(
        F.col("id").alias("document_id"),
        F.col("submission_discipline").alias("discipline"),
        F.lit("pass").alias("status"),
        "file_hash",
        F.col("ref").alias("confirmation_ref"),
        F.lit(model_version).alias("model_version"),
        now.alias("submitted_at"),
    )
