"""Parquet persistence of the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION_COLUMNS = {"documents": ["discipline"]}


def write_tables(tables: dict[str, DataFrame], root: str, mode: str = "errorifexists") -> None:
    """Write each table below ``root``; documents are laid out by discipline.

    Rows are not shuffled by discipline first: every task writes its own file per discipline, so that a dominant
    discipline is still written by all tasks.
    """
    for name, df in tables.items():
        columns = [c for c in PARTITION_COLUMNS.get(name, []) if c in df.columns]
        writer = df.write.mode(mode)
        if columns:
            writer = writer.partitionBy(*columns)
        writer.parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def rewrite_partitions(df: DataFrame, path: str, columns: list[str]) -> None:
    """Replace only the partitions that occur in ``df``; the rest of the table stays. ``df`` must not read ``path``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(path)
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: its name and number of rows."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
              for name, df in tables.items()]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result
