"""Column helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A word is a run of digits, lower-case ASCII letters and any characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def slices_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes come to about ``most`` together, or that are one row."""
    edge = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
    for low, high in zip(np.append(0, edge).tolist(), np.append(edge, len(sizes)).tolist(), strict=True):
        if high > low:
            yield low, high


def give_back_memory() -> None:
    """At the end of a task: what a worker process has freed goes back to the system, since it is kept for tasks of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def numbered(df: DataFrame, purpose: str, name: str = "_row") -> DataFrame:
    """``df`` written once with a number for each row, so that every later read of a row sees the same number."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), purpose)


def in_order(df: DataFrame, order: list[Column], purpose: str, name: str) -> DataFrame:
    """``df`` with the place of each row in the given order, from 0 on, which must leave no ties that matter.

    Rows are sorted by ranges and counted per range; one row per range is then summed up, so no task sees all rows.
    """
    sort = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits of the id count the rows of a partition
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = stored(sort.withColumn("_range", F.spark_partition_id()).withColumn("_inside", inside), purpose)
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")
