"""Connected components of a table of edges, by rounds of joins that halve the distance to the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelwatch.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node of the component) for every node in ``edges`` (columns ``a`` and ``b``).

    Alternates large stars (every neighbour that is larger goes to a node's smallest neighbour) and small stars (every
    neighbour that is not larger does); the number of rounds is logarithmic. Every round is written, so nothing depends on
    an executor that may be lost. A node with very many neighbours costs one row per neighbour in one partial aggregate;
    the smallest neighbour is joined back instead of gathering neighbours.
    """
    links = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("low"))
        # Large star: b > node moves to the smallest of node and its neighbours.
        large = (
            links.join(lowest, links["a"] == lowest["node"]).select(F.col("low").alias("a"), "b").distinct()
        )
        large = materialise(large.where("a <> b"), "large-star")
        # Small star: here every edge points from the smaller node, so the neighbours of b that are not larger are its a's.
        smallest = large.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"))
        joined = large.join(smallest, large["b"] == smallest["node"])
        small = joined.select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        links = materialise(small, "small-star")
        ends = links.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("centres"), F.countDistinct("b").alias("leaves")).first()
        nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().count()
        # Stars: every leaf has one centre, and no centre is a leaf.
        if ends["n"] == ends["leaves"] and nodes == ends["centres"] + ends["leaves"]:
            break
    roots = links.select(F.col("a").alias("node")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots.select("node", F.col("node").alias("component")))
