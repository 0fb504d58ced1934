"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import drop_shuffles
from passagework.session import discard, materialize


def smallest_reachable(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each end of an edge can reach.

    Alternating rounds: every node links its larger neighbours to the smallest node
    around it (large star), then its smaller ones likewise (small star). Links
    only move to smaller nodes, and after a number of rounds that grows with the
    logarithm of the longest path all links of a component point at its smallest
    node: when each larger end has one link and is nobody's smaller end, no round follows. Aggregates are partial, so a node with very many links is no single task's
    work; each round is a written table, which a lost executor cannot take back.
    An empty table gives an empty table.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links"
    )
    while not _pointed(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.filter("u <> v"), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = large.join(least, "u")
        small = pointed.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, now = now, materialize(small.filter("u <> v").distinct(), "small-star")
        discard(before, large)
        drop_shuffles(now.sparkSession)
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _pointed(links: DataFrame) -> bool:
    """Whether all links (u, v) point at nodes that point at no other, one from each node."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out")).union(links.select("v", F.lit(0)))
    each = ends.groupBy("node").agg(F.sum("out").alias("links"), F.min("out").alias("inner"))
    return each.filter("links > 1 OR (links > 0 AND inner = 0)").isEmpty()
