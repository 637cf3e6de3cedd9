"""Problem 7: consolidating pairwise matches into groups by seed-tree pruning.

Each round every vertex names the minimum of its neighbourhood (itself included) to all of it. A vertex that
nobody names leaves the graph: it hangs below the smallest name it was told, in a propagation forest. The
others are joined to that smallest name and go on. What ends without edges is a seed, the smallest id of its
group; seed identifiers then flow down the forest, last round first. Rounds are logarithmic in practice,
every table is written to shared storage, and no table of a round is larger than twice the edges before it.

Defined cases: ids are compared lower-case without surrounding white space; null, blank and missing-like ids
(``null``, ``none``, ``nan``, ``unknown``, ``n/a``) and pairs of one id link nothing; repeated and reversed
pairs count once; an empty input gives no rows; columns beside the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.operators.skew import join_hot
from hazardloom.storage import Workspace

MISSING = ("", "null", "none", "nan", "unknown", "n/a")  # fixed values
MAX_ROUNDS = 60


def clean_id(c: str | Column) -> Column:
    """Lower case without surrounding white space, null where missing."""
    v = F.lower(F.regexp_replace(F.col(c).cast("string") if isinstance(c, str) else c, r"^[\s\u00A0\u3000]+|[\s\u00A0\u3000]+$", ""))
    return F.when(v.isin(*MISSING), None).otherwise(v)


def clean_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct undirected links (u < v)."""
    x, y = clean_id(a), clean_id(b)
    return pairs.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"), x.alias("x"), y.alias("y")).filter("x is not null and y is not null and u != v").select("u", "v").distinct()


def connected_groups(links: DataFrame, space: Workspace, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, root) of every vertex of ``links`` (u, v; each undirected link once), root the smallest id of its group."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows, most = {"rows": F.count(F.lit(1))}, {"most": F.max("n")}  # seen while a table is written
    edges = space.cut(both, "edges", **rows)
    first, forest = edges, []
    for _ in range(max_rounds):
        if not space.seen_of(edges, "rows"):
            break
        # the smallest name in the closed neighbourhood of each vertex, told to the whole neighbourhood
        least = space.cut(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least", **most)
        told = join_hot(edges, least, "u", "n", most=space.seen_of(least, "most")).select(F.col("v").alias("a"), F.col("m").alias("t")).union(least.select(F.col("u").alias("a"), F.col("m").alias("t")))
        told = space.cut(told.distinct(), "told")
        heads = space.cut(told.groupBy("a").agg(F.min("t").alias("h"), F.count("*").alias("n"), F.max((F.col("a") == F.col("t")).cast("int")).alias("named")), "heads", **most)
        forest.append(space.cut(heads.filter("named = 0").select(F.col("a").alias("child"), F.col("h").alias("parent")), "forest"))
        linked = join_hot(told, heads.select("a", "h", "n"), "a", "n", most=space.seen_of(heads, "most")).filter("t != h").select(F.least("t", "h").alias("p"), F.greatest("t", "h").alias("q")).distinct()
        nxt = space.cut(linked.select(F.col("p").alias("u"), F.col("q").alias("v")).union(linked.select(F.col("q").alias("u"), F.col("p").alias("v"))), "edges", **rows)
        space.drop(least, told, heads, edges if edges is not first else None)
        edges = nxt
    else:
        if space.seen_of(edges, "rows"):
            raise RuntimeError(f"no end after {max_rounds} rounds")
    # seeds flow down: a parent without a label of its own is a seed
    labels = None
    for tree in reversed(forest):
        if labels is None:
            new = tree.select(F.col("child").alias("id"), F.col("parent").alias("root"))
        else:
            below = tree.groupBy("parent").agg(F.count("*").alias("n"))
            known = space.cut(below.join(labels, below["parent"] == labels["id"]).select("parent", "root", "n"), "known", **most)
            new = join_hot(tree, known, "parent", "n", "left", most=space.seen_of(known, "most")).select(F.col("child").alias("id"), F.coalesce("root", "parent").alias("root"))
            new = labels.union(new)
        old, labels = labels, space.cut(new, "labels")
        space.drop(old)
    if labels is None:
        return first.select(F.col("u").alias("id"), F.col("v").alias("root")).limit(0)
    return labels.union(labels.select(F.col("root").alias("id"), "root").distinct())
