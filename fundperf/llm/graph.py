"""Connected components by alternating large and small stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) that isn't its component's smallest node.

    Each round hangs a node's larger neighbours, then its smaller ones, below its smallest neighbour, until
    nothing changes. Rounds are written tables; only a count and a checksum reach the driver. Minima are
    aggregated before the shuffle, written, and joined back as tables, so Spark can split a hub's rows.
    """
    stars = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(lowest, "u")
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        stars = cut(small)
        state = tuple(
            stars.agg(
                F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
            ).first()
        )
        if state == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
