"""Connected components of a table of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, component): the smallest node that each node reaches.

    Alternating large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014): a node's larger, then its
    smaller neighbours are hung on its smallest one, until nothing changes;
    rounds grow with the logarithm of the path lengths.  No task sees a node's
    whole neighbourhood: only its minimum is aggregated, then joined.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        # large star: every larger neighbour of n goes to n's smallest
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u != v").distinct(), "edges")
        # small star: n and its smaller neighbours go to the smallest of them
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u != v").distinct(), "edges")
        # every node hangs on one root: no node is on both sides
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(state)
