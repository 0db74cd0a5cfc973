"""Connected components of links between documents, on Spark tables of (node, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm import common


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, label): the smallest node that can be reached, for every node with a link.

    Alternating large-star and small-star steps, until only stars are left: each neighbour moves to the smallest node around.
    A node's smallest neighbour is a plain minimum (combined before the shuffle), so no neighbourhood is ever gathered.
    """
    edges = common.stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not stars_only(edges):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that Spark can split the edges of a node with many
        least = common.stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = common.stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        joined = large.join(common.stored(large.groupBy("a").agg(F.min("b").alias("m"))), "a")
        edges = common.stored(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def stars_only(edges: DataFrame) -> bool:
    """Whether every node either has one edge to a smaller node or is the smaller end of all of its edges."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()
