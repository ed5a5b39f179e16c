"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each link with the least neighbour of u, or u itself. A minimum combines before the shuffle, and the join can be split, so a node of any degree is no hot spot."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (columns a and b): component is the least node reachable. Nodes without links are not returned. Each round is written to the shared folder; rounds end when one changes nothing, which takes about the logarithm of the largest component's size."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)  # every link of `large` leads downwards
        down = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, edges = edges, materialize(down.where("u <> v").distinct())
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:  # neither step changes a thing: every node hangs on its least
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
