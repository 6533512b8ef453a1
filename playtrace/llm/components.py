"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm.common import settle


def _hung(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (a, b): the larger (or else smaller) neighbours of each node hang on its least neighbour."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        near = edges.select("a", "b").union(edges.select("b", "a"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    both = near.join(least, "a")  # not windowed: a node with a third of all links is split like any skewed key
    hung = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if not small else both.where("b != m").select(
        F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return hung.where("a != b").distinct()


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root) for each node that has a link, its least node as root.

    Every pair of steps is written to the shared folder; the number of pairs grows with the logarithm of the longest
    path. Links of a node to itself and repeated links are ignored; no links give no rows.
    """
    edges = settle(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most):
        edges = settle(_hung(_hung(edges, small=False), small=True), "stars")
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = seen
    raise RuntimeError(f"components did not settle in {most} rounds")
