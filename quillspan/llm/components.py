"""Connected components of links between ids, as Spark joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); root is the smallest id that a node reaches.

    Each round hangs a node's other smaller neighbours below its smallest one; when every node
    has one smaller neighbour left, pointers are doubled. Counts only reach the driver.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    while True:
        low = stored(links.groupBy("a").agg(F.min("b").alias("p"), F.count("*").alias("n")), "lowest")
        if low.where("n > 1").isEmpty():
            break
        both = links.join(low, "a")
        moved = both.select(F.when(F.col("b") == F.col("p"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("p").alias("b"))
        links = stored(moved.distinct(), "links")
    tree = ends(links).select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())


def ends(tree: DataFrame) -> DataFrame:
    """(a, b) of a forest of pointers with b at the end of a's chain: each round doubles the pointers' reach."""
    while True:
        up = tree.select(F.col("a").alias("b"), F.col("b").alias("up"))
        if tree.join(up, "b", "left_semi").isEmpty():
            return tree
        tree = stored(tree.join(up, "b", "left").select("a", F.coalesce("up", "b").alias("b")), "links")
