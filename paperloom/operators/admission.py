"""Idempotent admission of files and upkeep of the document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.constants import APPROVED, CHECKING, DISCIPLINES, DOCUMENT_LIMITS, FILE_TYPES, REJECTED
from paperloom.functions.scale import broadcast_if_small
from paperloom.functions.text import extension
from paperloom.session import stored
from paperloom.sources.files import supported_list

# Copies of one content that a task of a shuffled join can well take.
HEAVY_COPIES = 100_000


def rejection_of_upload(path: Column, discipline: Column) -> Column:
    """Null for an acceptable upload, otherwise the reason; the suffix is looked at first."""
    ext = extension(path)
    return F.when(
        ~ext.isin(sorted(FILE_TYPES)),
        F.concat(F.lit("Unsupported file format: "), ext, F.lit(f". Supported: {supported_list()}")),
    ).when(
        (discipline != "") & ~discipline.isin(DISCIPLINES),
        F.concat(F.lit("Invalid discipline: "), discipline, F.lit(f". Must be one of: {', '.join(DISCIPLINES)}")),
    )


def admit_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted uploads, and refused ones with their reason."""
    judged = uploads.withColumn("reason", rejection_of_upload(F.col("path"), F.col("discipline")))
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def _at_first(incoming: DataFrame, firsts: DataFrame, order_col: str) -> DataFrame:
    """The row of every hash at its ``first_arrival``; of different rows at one arrival, the least."""
    keys = firsts.select(F.col("file_hash").alias("_hash"), F.col("first_arrival").alias("_first"))
    # dealt by hash and arrival, so that the copies of a hash are spread; equal rows are combined before the shuffle
    at = incoming.join(keys, F.col("file_hash").eqNullSafe(F.col("_hash")) & F.col(order_col).eqNullSafe(F.col("_first")))
    rows = at.select(*incoming.columns).distinct()
    place = F.row_number().over(Window.partitionBy("file_hash").orderBy(*[c for c in incoming.columns if c != "file_hash"]))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def _per_hash(incoming: DataFrame, order_col: str) -> DataFrame:
    return incoming.groupBy("file_hash").agg(F.min(order_col).alias("first_arrival"), F.count(F.lit(1)).alias("copies"))


def first_arrivals(incoming: DataFrame, order_col: str = "arrival") -> DataFrame:
    """The earliest row of every hash, found by numbers; the other columns are fetched afterwards."""
    return _at_first(incoming, _per_hash(incoming, order_col), order_col)


def dedup_by_hash(
    incoming: DataFrame, existing: DataFrame, order_col: str = "arrival", heavy_copies: int = HEAVY_COPIES
) -> tuple[DataFrame, DataFrame]:
    """New rows (first of every unknown hash), and repeats with the id and status they resolve to.

    ``existing`` has file_hash, id, status. A repeat inside ``incoming`` resolves to the arrival number of the first row.
    What a hash resolves to is worked out once per hash, with its number of copies. Hashes of more than ``heavy_copies`` copies, of
    which there can be only so many, are sent to all tasks, where their copies are; the others meet them in a shuffle.
    """
    known = existing.select("file_hash", F.col("id").alias("known_id"), F.col("status").alias("known_status"))
    target = _per_hash(incoming, order_col).join(known, "file_hash", "left").select(
        "file_hash",
        "first_arrival",
        "copies",
        F.coalesce("known_id", "first_arrival").alias("id"),
        F.coalesce("known_status", F.lit(CHECKING)).alias("status"),
        F.col("known_id").isNotNull().alias("stored"),
    )
    target = stored(target, "hash-targets")
    new = _at_first(incoming, target.where("not stored"), order_col)
    heavy = target.where(F.col("copies") > heavy_copies).drop("copies")
    if heavy.isEmpty():
        met = incoming.join(target.drop("copies"), "file_hash")
    else:
        heavy = broadcast_if_small(heavy)
        rest = incoming.join(heavy.select("file_hash"), "file_hash", "left_anti")
        met = incoming.join(heavy, "file_hash").unionByName(rest.join(target.drop("copies"), "file_hash"))
    repeats = met.where(F.col("stored") | (F.col(order_col) != F.col("first_arrival"))).drop("first_arrival", "stored")
    return new, repeats


def new_document_records(accepted: DataFrame, upload_dir: str, now: Column) -> DataFrame:
    """Rows of the document table. Path and job id follow from the content hash, so that a re-run agrees."""
    return accepted.select(
        "file_hash",
        F.concat(F.lit(upload_dir + "/"), F.col("file_hash"), extension(F.col("path"))).alias("original_path"),
        F.lit(CHECKING).alias("status"),
        F.substring(F.sha2(F.concat(F.lit("job:"), F.col("file_hash")), 256), 1, 32).alias("job_id"),
        "discipline",
        now.alias("created_at"),
        now.alias("updated_at"),
    )


UPDATED_FIELDS = ["document_number", "title", "revision", "issue_status", "contract_number", "page_count"]


def upsert_documents(documents: DataFrame, results: DataFrame, now: Column, model_version: str) -> DataFrame:
    """Documents with the outcome of processing written in.

    ``results`` has id, success and any of the scalar fields, at most one row per id. A field that was not found keeps
    its old value; success approves the document and failure rejects it.
    """
    fields = [c for c in UPDATED_FIELDS if c in results.columns]
    update = results.select("id", "success", *[F.col(c).alias(f"new_{c}") for c in fields])
    touched = F.col("success").isNotNull()
    joined = documents.join(update, "id", "left")
    changed = {c: F.coalesce(f"new_{c}", c) for c in fields}
    changed["status"] = (
        F.when(F.col("success"), APPROVED).when(touched, REJECTED).otherwise(F.col("status"))
    )
    columns = [changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns if
               c not in ("model_version", "updated_at")]
    old_version = F.col("model_version") if "model_version" in documents.columns else F.lit(None).cast("string")
    old_time = F.col("updated_at") if "updated_at" in documents.columns else F.col("created_at")
    return joined.select(
        *columns,
        F.when(touched, F.lit(model_version)).otherwise(old_version).alias("model_version"),
        F.when(touched, now).otherwise(old_time).alias("updated_at"),
    )


def upload_outcomes(uploads: DataFrame, existing: DataFrame, order_col: str = "arrival") -> DataFrame:
    """Every upload with its outcome: failed, already_exists or successful."""
    accepted, refused = admit_uploads(uploads)
    new, repeats = dedup_by_hash(accepted, existing, order_col)
    return (
        refused.select(order_col, F.lit("failed").alias("outcome"))
        .unionByName(repeats.select(order_col, F.lit("already_exists").alias("outcome")))
        .unionByName(new.select(order_col, F.lit("successful").alias("outcome")))
    )


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(F.col("outcome") == name).alias(name)
            for name in ("successful", "already_exists", "failed")
        ],
    )


def count_outcomes(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """The same summary without the outcome of each upload: counted per hash before the hashes meet the known ones."""
    refused = F.count_if(rejection_of_upload(F.col("path"), F.col("discipline")).isNotNull())
    per_hash = uploads.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"), refused.alias("refused"))
    known = existing.select("file_hash", F.lit(True).alias("known")).distinct()
    new = F.count_if((F.col("n") > F.col("refused")) & F.col("known").isNull())
    sums = per_hash.join(known, "file_hash", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), new.alias("successful"), F.coalesce(F.sum("refused"), F.lit(0)).alias("failed")
    )
    already = F.col("total") - F.col("failed") - F.col("successful")
    return sums.select("total", "successful", already.alias("already_exists"), "failed")


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given documents and their dependent rows. The document table is ``documents``."""
    gone = ids.select(F.col("id").alias("gone_id")).distinct()
    return {
        name: df.join(gone, F.col("id" if name == "documents" else "document_id") == F.col("gone_id"), "left_anti")
        for name, df in tables.items()
    }


def audit_constraints(
    unique: list[tuple[str, DataFrame, list[str]]], references: list[tuple[str, DataFrame, str, DataFrame, str]]
) -> DataFrame:
    """Violations as check, table_name, key, violations.

    ``unique``: (table, frame, key columns). ``references``: (table, child frame, column, parent frame, column).
    """
    found: DataFrame | None = None
    for table, df, keys in unique:
        key = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
        part = (
            df.where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda ok: ok))
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("violations"))
            .where(F.col("violations") > 1)
            .select(F.lit("unique").alias("check"), F.lit(table).alias("table_name"), key.alias("key"), "violations")
        )
        found = part if found is None else found.unionByName(part)
    for table, child, column, parent, parent_column in references:
        # counted per key before the join, so that a hot missing parent is one row
        keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(
            F.count(F.lit(1)).alias("violations")
        )
        part = keys.join(parent.select(F.col(parent_column).alias("k")), "k", "left_anti").select(
            F.lit("reference").alias("check"),
            F.lit(table).alias("table_name"),
            F.col("k").cast("string").alias("key"),
            "violations",
        )
        found = part if found is None else found.unionByName(part)
    return found


def audit_lengths(df: DataFrame, limits: dict[str, tuple[int | None, bool]] = DOCUMENT_LIMITS) -> DataFrame:
    """Per column: values longer than declared, and nulls where none may be. One pass over the table.

    A limit of None bounds no length. ``CHUNK_LIMITS`` are those of the chunk table.
    """
    aggregates = []
    for column, (limit, required) in limits.items():
        long = F.lit(False) if limit is None else F.length(column) > limit
        aggregates.append(F.count_if(long).alias(f"{column}__long"))
        nulls = F.count_if(F.col(column).isNull()) if required else F.count_if(F.lit(False))
        aggregates.append(nulls.alias(f"{column}__null"))
    rows = F.array(
        *[
            F.struct(
                F.lit(column).alias("column_name"),
                F.col(f"{column}__long").alias("too_long"),
                F.col(f"{column}__null").alias("nulls"),
            )
            for column in limits
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows))
