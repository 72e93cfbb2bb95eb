"""Sets of document numbers as bitmaps, small enough to be sent to where vectors and postings are.

A bitmap is a table of (bucket, bits), 32,768 numbers a row in 4 kB, so a corpus of 100 million documents is 12 MB. Whether a row's
document is in the set is looked up by its bucket and tested by its bit; the rows that are tested are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scale import is_small

# 4096 rows are 16 MB.
MAX_BUCKETS = 4096


def bitmap_of(rows: DataFrame, number: str, *keys: str) -> DataFrame:
    """(keys, bucket, bits) of the numbers of all rows; null numbers are in no set."""
    known = rows.where(F.col(number).isNotNull())
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(number))
    return known.groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket")).agg(bits.alias("bits"))


def common(*bitmaps: DataFrame) -> DataFrame:
    """Numbers that are in all sets."""
    rows = bitmaps[0].select("bucket", "bits")
    for other in bitmaps[1:]:
        rows = rows.unionByName(other.select("bucket", "bits"))
    met = rows.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return met.where(F.col("n") == len(bitmaps)).drop("n")


def has_bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def in_bitmap(rows: DataFrame, number: str, bitmap: DataFrame, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Rows whose number is in the set. Beyond ``max_buckets`` rows the bitmap meets them in a shuffle."""
    found = bitmap.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    found = F.broadcast(found) if is_small(bitmap, max_buckets) else found
    met = rows.join(found, F.bitmap_bucket_number(number) == F.col("_bucket"))
    return met.where(has_bit(F.col("_bits"), F.bitmap_bit_position(number))).select(*rows.columns)
