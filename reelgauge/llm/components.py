"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.common import Tables


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """node, root (the smallest node reachable) of every node of ``links`` (a, b).

    Each round is a few joins on one node, over links that are written in between; the
    number of rounds grows with the logarithm of a component's size.  Nothing is gathered.
    """
    edges = tables.keep(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.keep(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tables.keep(moved.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(edges.select(F.col("v"), F.col("v")).distinct())
