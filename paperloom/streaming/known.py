"""An index of the content hashes that a stream has seen, of which a micro-batch reads the parts its own hashes can be in.

Hashes are laid out by their first digits. Every batch appends a folder of its own; ``compact`` writes the batches up to one
together as a base. A reader takes the latest complete base, the later batches, and of both only the folders of the prefixes
that are asked for, so that what a micro-batch reads follows its own size and not what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a folder was written to its end."""
    return exists(spark, f"{folder}/_SUCCESS")


class HashIndex:
    """Hashes by batch. Batches are numbered upwards; a batch that is appended again replaces itself."""

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits

    def prefix(self, file_hash: Column | str) -> Column:
        return F.substring(file_hash, 1, self.digits)

    def _numbers(self, part: str) -> list[int]:
        """Numbers of the complete folders of a part, in order. One folder per batch since the last compaction, or per base."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(n.split("=")[1]) for n in names if "=" in n and is_complete(self.spark, f"{self.path}/{part}/{n}"))

    def _parts(self, before: int) -> tuple[list[int], list[int]]:
        """The latest base, if any, and the batches after it, all of them before a batch."""
        base = [n for n in self._numbers("base") if n < before][-1:]
        return base, [n for n in self._numbers("batches") if n < before and n > max(base, default=-1)]

    def _read(self, before: int) -> DataFrame:
        found = self.spark.createDataFrame([], "file_hash string, prefix string")
        for part, key, numbers in zip(("base", "batches"), ("upto", "batch_id"), self._parts(before), strict=True):
            if numbers:
                rows = self.spark.read.schema(f"file_hash string, {key} long, prefix string").parquet(f"{self.path}/{part}")
                found = found.unionByName(rows.where(F.col(key).isin(numbers)).drop(key))
        return found

    def known(self, hashes: DataFrame, before: int) -> DataFrame:
        """Hashes of earlier batches that share a prefix with one of ``hashes``: file_hash."""
        wanted = [r[0] for r in hashes.select(self.prefix("file_hash")).distinct().collect()]  # at most 16 to the power of digits
        return self._read(before).where(F.col("prefix").isin(wanted)).select("file_hash")

    def append(self, batch_id: int, hashes: DataFrame) -> None:
        self._write(hashes.select("file_hash"), f"batches/batch_id={batch_id}")

    def _write(self, hashes: DataFrame, part: str) -> None:
        keyed = hashes.where("file_hash is not null").distinct().withColumn("prefix", self.prefix("file_hash"))
        keyed.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/{part}")

    def compact(self, upto: int) -> None:
        """Write what is known up to a batch as one base. Streams may go on; the folders it replaces are kept for readers under way."""
        if upto not in self._numbers("base"):
            self._write(self._read(upto + 1).select("file_hash"), f"base/upto={upto}")

    def remove_compacted(self) -> None:
        """Delete the folders that the latest base replaces, once no reader uses them any more."""
        bases = self._numbers("base")
        for part, number in [("base/upto", n) for n in bases[:-1]] + [("batches/batch_id", n) for n in self._numbers("batches") if bases and n <= bases[-1]]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}={number}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
