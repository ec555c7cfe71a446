"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, save


def components(links: DataFrame) -> DataFrame:
    """node, component (its least reachable node) for the nodes of ``links`` (a, b).

    Each round hangs every larger neighbour under a node's least neighbour, then
    every smaller one, until nothing moves; rounds grow with the logarithm of the
    longest path. Links stay distributed; each round's are written out, and deleted
    once the next one's are there.
    """
    edges = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = save(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        before, edges = edges, save(small, "small-star")
        discard(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # every edge now leads from a node to its component
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.saved_at = edges.saved_at
    return out
