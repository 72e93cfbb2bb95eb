"""Token counts kept as additive totals by source, language and tokenizer version.

A change is a signed count: an insert adds a document's tokens, a delete takes them away, and a revision takes the old count
away and adds the new one. A batch of changes is summed per group and appended under its number and the name of the attempt; then
a row that publishes the attempt is appended. Of several published attempts at a batch one counts, so a batch that is delivered
or retried twice counts once, and an attempt that dies half-way counts as nothing and harms no other. Totals are the sum of the
published attempts. ``compact`` sums them up in a snapshot together with the set of batches it holds; batches outside that set count
beside it, whatever their number and whenever they come.

Null sources, languages and versions are groups of their own. Null and empty texts have no tokens but count as documents.
Repeated rows count repeatedly. Groups whose documents are all gone are left out of the totals. No batches give no totals.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.scale import broadcast_if_small
from paperloom.llm.common import WORD, lower_ascii
from paperloom.llm.tokens import by_size, definition_of, shared_tokenizer
from paperloom.session import stored

GROUP = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, docs long, tokens long"


def bpe_tokens(path: str):
    """Counter of the ids of a tokenizer file."""
    definition = definition_of(path)

    def count(text: Column) -> Column:
        @F.pandas_udf("long")
        def of(texts: pd.Series) -> pd.Series:
            tokenizer = shared_tokenizer(definition)
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
            parts = [tokenizer.encode_batch(part.column("text"))[1] for part in by_size(batch, "text")]
            return pd.Series(np.concatenate([np.zeros(0, dtype=np.int64), *parts]))

        return of(text)

    return count


def word_tokens(text: Column) -> Column:
    return F.regexp_count(lower_ascii(text), F.lit(WORD)).cast("long")


def counted(docs: DataFrame, counters: dict) -> DataFrame:
    """One row per document and version with its tokens; the text is counted and left behind, as are columns named version or tokens."""
    kept = [c for c in docs.columns if c not in ("text", "version", "tokens")]
    each = F.array(*[F.struct(F.lit(v).alias("version"), count(F.col("text")).alias("tokens")) for v, count in sorted(counters.items())])
    return docs.select(*kept, F.explode(each).alias("_counted")).select(*kept, "_counted.version", "_counted.tokens")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(*GROUP, F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).alias("tokens"))


def inserted(rows: DataFrame) -> DataFrame:
    return signed(rows, 1)


def deleted(rows: DataFrame) -> DataFrame:
    return signed(rows, -1)


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    return deleted(before).unionByName(inserted(after))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class TokenRollup:
    """Totals in a folder that all executors share. Batches are numbered and committed in any order."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Write an attempt at the batch and publish it; the batch counts once, however often it is committed."""
        attempt = self.write_attempt(batch, changes)
        self._append(self.spark.createDataFrame([(batch, attempt)], "batch long, attempt string"), "published")

    def write_attempt(self, batch: int, changes: DataFrame) -> str:
        """Write the sums of a batch, which count once the attempt is published."""
        attempt = uuid.uuid4().hex
        sums = _summed(changes).select("*", F.lit(batch).cast("long").alias("batch"), F.lit(attempt).alias("attempt"))
        sums.write.mode("append").partitionBy("batch", "attempt").parquet(f"{self.folder}/changes")
        return attempt

    def _append(self, df: DataFrame, part: str) -> None:
        df.coalesce(1).write.mode("append").parquet(f"{self.folder}/{part}")

    def _read(self, part: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")

    def _snapshot(self) -> tuple[DataFrame, DataFrame]:
        """Sums of the published snapshot that holds the most batches, and those batches."""
        held = self._read("snapshot_batches", "batch long, snapshot string")
        done = self._read("published_snapshots", "snapshot string, batches long")
        best = done.agg(F.max(F.struct("batches", "snapshot")).alias("s")).first().s
        name = best.snapshot if best else ""
        sums = self._read("snapshots", f"{SCHEMA}, snapshot string")
        return sums.where(F.col("snapshot") == name).drop("snapshot"), held.where(F.col("snapshot") == name).select("batch")

    def _later(self, held: DataFrame) -> DataFrame:
        """One published attempt of each batch outside the snapshot."""
        one = self._read("published", "batch long, attempt string").groupBy("batch").agg(F.min("attempt").alias("attempt"))
        return one.join(held, "batch", "left_anti")

    def _changes(self, attempts: DataFrame) -> DataFrame:
        changes = self._read("changes", f"{SCHEMA}, batch long, attempt string")
        return changes.join(broadcast_if_small(attempts), ["batch", "attempt"], "left_semi").drop("batch", "attempt")

    def totals(self) -> DataFrame:
        sums, held = self._snapshot()
        return _summed(sums.unionByName(self._changes(self._later(held)))).where("docs <> 0 or tokens <> 0")

    def compact(self, upto: int) -> None:
        """Snapshot of the last one and of the published batches up to ``upto``."""
        sums, held = self._snapshot()
        added = stored(self._later(held).where(F.col("batch") <= upto), "compacted-batches")
        name = uuid.uuid4().hex
        named = lambda df: df.withColumn("snapshot", F.lit(name))
        named(_summed(sums.unionByName(self._changes(added)))).write.mode("append").partitionBy("snapshot").parquet(f"{self.folder}/snapshots")
        batches = stored(held.unionByName(added.select("batch")), "snapshot-batches")
        named(batches).write.mode("append").partitionBy("snapshot").parquet(f"{self.folder}/snapshot_batches")
        self._append(named(batches.agg(F.count("*").alias("batches"))).select("snapshot", "batches"), "published_snapshots")
