"""Listings laid out by ranges of their order, so that a page reads the ranges it lies in and no others.

Rows are cut into ranges of about equal size over (time, id), newest first; rows of one time are cut by their id. Next to them lie
the counts per range and combination of filter values, from which the place of a page and the total follow without the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_RANGE = "listing_range"


class Listing:
    """A listing at ``path``, newest first and by id among rows of one time; rows without a time come last.

    ``schema`` is that of the rows. ``filters`` are columns of few values that pages can be restricted by; for the rows of one
    document or job the plain listings of ``reports`` are there.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, newest: str, id_col: str, filters: tuple[str, ...] = ()
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.newest, self.id_col, self.filters = newest, id_col, filters

    def _order(self):
        return F.col(self.newest).desc_nulls_last(), F.col(self.id_col).asc_nulls_first()

    def write(self, rows: DataFrame, ranges: int) -> None:
        """Lay out ``rows``. ``ranges`` bounds what a page has to read (two ranges of 1/ranges each, if it is not longer than one)
        and the rows of counts the driver sees for a page."""
        # cut points come from Spark's sample of the keys; every row is placed by them
        ranged = rows.select(self.schema.names).repartitionByRange(ranges, *self._order()).withColumn(_RANGE, F.spark_partition_id())
        ranged.write.partitionBy(_RANGE).parquet(f"{self.path}/rows")
        counts = self._rows().groupBy(_RANGE, *self.filters).agg(F.count(F.lit(1)).alias("n"))
        counts.coalesce(1).write.parquet(f"{self.path}/counts")

    def _rows(self) -> DataFrame:
        laid_out = StructType([*self.schema.fields, StructField(_RANGE, IntegerType())])
        return self.spark.read.schema(laid_out).parquet(f"{self.path}/rows")

    def page(self, limit: int, offset: int = 0, **equals) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of those whose filter columns have the given values (None: any), with ``total``."""
        if limit < 1 or offset < 0:
            raise ValueError("limit starts at 1 and offset at 0")
        unknown = set(equals) - set(self.filters)
        if unknown:
            raise ValueError(f"not laid out for filters by {sorted(unknown)}")
        wanted = [F.col(c) == v for c, v in equals.items() if v is not None]
        counts = self.spark.read.parquet(f"{self.path}/counts")
        for condition in wanted:
            counts = counts.where(condition)
        # at most one row per range
        per_range = counts.groupBy(_RANGE).agg(F.sum("n").alias("n")).orderBy(_RANGE).collect()
        reached, skipped, parts = 0, 0, []
        for row in per_range:
            if reached + row.n <= offset:
                skipped += row.n
            elif reached < offset + limit:
                parts.append(row[_RANGE])
            reached += row.n
        found = self._rows().where(F.col(_RANGE).isin(parts))
        for condition in wanted:
            found = found.where(condition)
        ordered = found.orderBy(*self._order()).offset(offset - skipped).limit(limit)
        return ordered.drop(_RANGE).withColumn("total", F.lit(reached).cast("long"))
