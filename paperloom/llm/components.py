"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node and a join. The minima are combined before the shuffle and written, so that both sides of
the join are dealt out anew and AQE can split a node with a large part of all links. Each round is written to the shared
folder, so lineage stays short and a lost executor costs tasks of one round. Nothing but one checksum per round reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each larger neighbour of a node to the smallest of its neighbourhood."""
    both = _both_ways(edges)
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them; edges point from larger to smaller."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has a link, apart from the smallest of its component, with that smallest node."""
    edges = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = _checksum(edges)
    while True:
        edges = stored(_small_star(stored(_large_star(edges), "stars")), "stars")
        now = _checksum(edges)
        if now == before:
            return edges
        before = now
