"""Guards for plans whose cost depends on the size of one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def is_small(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; stops reading as soon as it has seen more."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a count; otherwise the side is left to a shuffled join with AQE skew handling."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column behind a one-row generator, which filters and projections on it do not repeat."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def salt_of(*keys: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")


def replicate(df: DataFrame, salts: int, name: str = "salt") -> DataFrame:
    """One copy of every row per salt, for the smaller side of a salted join."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def spread(df: DataFrame, key: str) -> DataFrame:
    """More partitions for a small input that is about to be worked on hard; a large one is returned as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df
