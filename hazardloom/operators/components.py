"""Connected components by alternating stars, for duplicate groups of the core package.

Large-star links every larger neighbour of a vertex to the smallest of its neighbourhood, small-star every
smaller one; the edges converge to one star per component in a logarithmic number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.operators.skew import join_hot
from hazardloom.storage import Workspace


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """``edges``: (a, b) directed; each vertex a sends its chosen neighbours to the smallest vertex it knows."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    keep = "b > a" if larger else "b <= a"
    return join_hot(edges.filter(keep), least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def components(links: DataFrame, space: Workspace, max_rounds: int = 50) -> DataFrame:
    """(id, root) of every vertex of ``links`` (u, v); root is the smallest id. Loops and repeats change nothing."""
    edges = space.cut(links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a != b").distinct(), "edges")
    for _ in range(max_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = space.cut(_star(both, True), "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_hot(down, least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(least.select("a", F.col("m").alias("b"))).distinct()
        nxt = space.cut(small, "edges")
        same = nxt.exceptAll(edges).isEmpty() and edges.exceptAll(nxt).isEmpty()
        space.drop(large, edges)
        edges = nxt
        if same:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"no end after {max_rounds} rounds")
