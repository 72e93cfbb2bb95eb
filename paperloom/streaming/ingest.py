"""Continuous admission of documents and continuous validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.admission import first_arrivals, new_document_records
from paperloom.operators.validation import validate_documents
from paperloom.session import stored
from paperloom.streaming.known import HashIndex, is_complete
from paperloom.streaming.runs import for_each_batch
from paperloom.streaming.verdicts import VerdictTable


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A batch that is run again after its folder was complete leaves it, otherwise replaces it, so that each batch counts once."""
    folder = f"{path}/batch_id={batch_id}"
    if not is_complete(df.sparkSession, folder):
        df.write.mode("overwrite").parquet(folder)


def ingest_stream(
    files: DataFrame,
    existing: Callable[[], DataFrame],
    upload_dir: str,
    path: str,
    checkpoint: str,
    available_now: bool = True,
    index: str | None = None,
    compact_every: int = 100,
):
    """Admit each new content once.

    files: stream of file_hash, arrival, path, discipline. Of the files of a batch with one hash the first arrival
    is admitted. Hashes seen before are found in the hash column of ``existing()``, read again for every batch, and in an index of
    those admitted by this stream (in the folder ``index``, next to the checkpoint unless given). Of the index, and of an
    ``existing()`` that is laid out by a column ``prefix`` in the same way, a batch reads the prefixes of its own hashes only.
    """
    root = index or f"{checkpoint.rstrip('/')}-hashes"

    def admit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = HashIndex(spark, root)
        folder = f"{path}/batch_id={batch_id}"
        if not is_complete(spark, folder):
            new = stored(first_arrivals(batch), "arrivals")
            stored_hashes = existing()
            if "prefix" in stored_hashes.columns:
                stored_hashes = stored_hashes.where(F.col("prefix").isin([r[0] for r in new.select(known.prefix("file_hash")).distinct().collect()]))
            for seen in (stored_hashes.select("file_hash"), known.known(new, batch_id)):
                new = new.join(seen, "file_hash", "left_anti")
            now = F.current_timestamp().cast("timestamp_ntz")
            _write_batch(new_document_records(new, upload_dir, now), path, batch_id)
        # the index follows the written batch, whatever happened in between
        known.append(batch_id, spark.read.schema("file_hash string").parquet(folder))
        if batch_id and batch_id % compact_every == 0:
            known.compact(batch_id)

    return for_each_batch(files, admit, checkpoint, available_now)


def continuous_validation(
    documents: DataFrame,
    read_rules: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = True,
):
    """Validate documents as they arrive; the rules are read again for every batch."""

    def judge(batch: DataFrame, batch_id: int) -> None:
        _write_batch(validate_documents(batch, read_rules()), path, batch_id)

    return for_each_batch(documents, judge, checkpoint, available_now)


def maintained_validation(
    documents: DataFrame,
    read_rules: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = True,
):
    """As ``continuous_validation``, but changed rules also reach the documents judged before: a ``VerdictTable`` at ``path``."""

    def judge(batch: DataFrame, batch_id: int) -> None:
        VerdictTable(batch.sparkSession, path).commit(batch_id, batch, read_rules())

    return for_each_batch(documents, judge, checkpoint, available_now)
