"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.session import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """``node BIGINT, component BIGINT`` (the smallest node reachable) for edges ``a, b``.

    Every round groups neighbours by a minimum, which combines before the shuffle, and writes
    the new edges; no node's neighbours are ever gathered.  The number of rounds grows with
    the logarithm of the longest path.
    """
    edges = durable(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        edges = durable(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        # Done when the edges stay the same: every node then points at its component's least.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = now
