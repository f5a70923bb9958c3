"""Connected components of a link table, by alternating large and small stars.

Each round hooks every node to the smallest node it knows, written to the
shared folder; links, nodes and labels never leave Spark. The rounds grow with
the logarithm of the longest path, not with the size of a component, and a
hub's links meet its label through a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tiercast.sources.storage import write_through


def _settled(links: DataFrame) -> bool:
    """True if every node on the left has one link, to a node that is on no left side."""
    lows = links.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    if not lows.where(F.col("low") != F.col("high")).isEmpty():
        return False
    return links.join(lows.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); component is its smallest node.

    Direction, order and repeats of links do not matter; links with a null or
    to itself say nothing. No links give no rows.
    """
    now = write_through(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = write_through(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where(F.col("b") != F.col("low")).select(
            F.col("b").alias("a"), F.col("low").alias("b"))
        now = write_through(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "links")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
