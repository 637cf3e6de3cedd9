"""Problem 6: splits that keep related records together.

Records tied by group or text hash are bundled by Borůvka contraction: every component takes its smallest
outgoing edge in one total order, the chosen edges (persisted with their original ends: a spanning forest) are
contracted by pointer jumping, until no edge is left. The roots are then stratified by size band and share of
positives, and dealt systematically: the k-th bundle of a stratum takes the split where the k-th point of a
golden-ratio sequence falls, so each stratum follows the proportions however small it is.

Defined cases: group and hash are compared lower-case without surrounding white space; missing values tie
nothing; a record id that comes twice is one record, tied by the keys of all its rows; null ids are left out;
an empty input gives no rows; columns beside those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardloom.llm.components import clean_id
from hazardloom.operators.skew import join_hot
from hazardloom.storage import Workspace

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Bundles of a stratum that are dealt in one task.
DEAL_ROWS = 50_000
_GOLDEN = 0.6180339887498949


def tie_edges(records: DataFrame, record_id: str, keys: list[str], space: Workspace) -> DataFrame:
    """(u, v): every record with the smallest record of each of its keys; a star per key, not all its pairs."""
    out = None
    for k in keys:
        tied = space.cut(records.select(F.col(record_id).cast("string").alias("id"), clean_id(k).alias("key")).filter("id is not null and key is not null").distinct(), "tied")
        least = tied.groupBy("key").agg(F.min("id").alias("u"), F.count("*").alias("n")).filter("n > 1")
        star = join_hot(tied, least, "key", "n").filter("id != u").select("u", F.col("id").alias("v"))
        out = star if out is None else out.union(star)
    return space.cut(out.distinct(), "edges")


def spanning_forest(edges: DataFrame, space: Workspace, max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """((id, root) of every vertex, (u, v) edges of the forest); root is the smallest id of the tree."""
    rows_of = {"rows": F.count(F.lit(1))}
    e = space.cut(edges.select("u", "v", F.struct("u", "v").alias("w")), "round", **rows_of)
    labels = space.cut(edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct().select("id", F.col("id").alias("root")), "labels")
    forest: list[DataFrame] = []
    for _ in range(max_rounds):
        if not space.seen_of(e, "rows"):
            break
        ends = e.select(F.col("u").alias("a"), F.col("v").alias("b"), "w").union(e.select(F.col("v").alias("a"), F.col("u").alias("b"), "w"))
        best = space.cut(ends.groupBy("a").agg(F.min(F.struct("w", "b")).alias("s")).select("a", F.col("s.b").alias("b"), F.col("s.w").alias("w")), "best")
        forest.append(space.cut(best.select("w.u", "w.v").distinct(), "forest"))
        back = best.select(F.col("a").alias("b"), F.col("b").alias("back"))
        # two components that chose one another are a cycle of two: the smaller one is the root
        parent = best.join(back, "b", "left").select("a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("p"))
        parent = space.cut(parent, "parent")
        while True:  # all leaves of a star have one parent: its row is joined with salts where it is hot
            next_up = parent.select(F.col("a").alias("p"), F.col("p").alias("q")).join(parent.groupBy("p").agg(F.count("*").alias("n")), "p")
            up = space.cut(next_up, "up", most=F.max("n"), moved=F.count_if(F.col("p") != F.col("q")))
            if not space.seen_of(up, "moved"):
                break
            jumped = join_hot(parent, up, "p", "n", most=space.seen_of(up, "most")).select("a", F.col("q").alias("p"))
            before, parent = parent, space.cut(jumped, "parent")
            space.drop(before, up)
        # rows of each vertex as left end, right end and label, so that hot ones are salted
        rows = e.select(F.col("u").alias("a"), F.lit(1).alias("nu"), F.lit(0).alias("nv"), F.lit(0).alias("nr"))
        rows = rows.union(e.select("v", F.lit(0), F.lit(1), F.lit(0))).union(labels.select("root", F.lit(0), F.lit(0), F.lit(1)))
        to = space.cut(parent.join(rows.groupBy("a").agg(*(F.sum(c).alias(c) for c in ("nu", "nv", "nr"))), "a"), "to", **{c: F.max(c) for c in ("nu", "nv", "nr")})
        u = to.select(F.col("a").alias("u"), F.col("p").alias("ru"), F.col("nu").alias("n"))
        v = to.select(F.col("a").alias("v"), F.col("p").alias("rv"), F.col("nv").alias("n"))
        ends = join_hot(join_hot(e, u, "u", "n", most=space.seen_of(to, "nu")), v, "v", "n", most=space.seen_of(to, "nv"))
        moved = ends.filter("ru != rv").groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min("w").alias("w"))
        nxt = space.cut(moved, "round", **rows_of)
        roots = to.select(F.col("a").alias("root"), "p", F.col("nr").alias("n"))
        new = space.cut(join_hot(labels, roots, "root", "n", "left", most=space.seen_of(to, "nr")).select("id", F.coalesce("p", "root").alias("root")), "labels")
        space.drop(e, best, labels, parent, to)
        e, labels = nxt, new
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    trees = labels.groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    named = join_hot(labels, trees, "root", "n").select("id", F.col("least").alias("root"))
    all_edges = forest[0] if forest else edges.select("u", "v").limit(0)
    for f in forest[1:]:
        all_edges = all_edges.union(f)
    return named, all_edges


def bundles(records: DataFrame, record_id: str, keys: list[str], space: Workspace) -> DataFrame:
    """(id, root) of each record tied to another one."""
    return spanning_forest(tie_edges(records, record_id, keys, space), space)[0]


def assign(records: DataFrame, record_id: str, label: str, roots: DataFrame, proportions: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """(record_id, bundle_root, label, split) of every record id; records without ties are bundles of one."""
    shares = proportions or PROPORTIONS
    ids = records.select(F.col(record_id).cast("string").alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null").groupBy("id").agg(F.max("label").alias("label"))
    placed = ids.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sized = placed.groupBy("root").agg(F.count("*").alias("n"), F.avg(F.coalesce("label", F.lit(0))).alias("positive"))
    sized = sized.withColumn("stratum", F.concat_ws("/", F.floor(F.log2("n")).cast("string"), F.round(F.col("positive") * 4).cast("string")))
    # a stratum may be unbounded (singletons): it is dealt in hashed parts, each following the proportions
    strata = sized.groupBy("stratum").agg(F.ceil(F.count("*") / F.lit(DEAL_ROWS)).cast("int").alias("parts"))
    dealt = sized.join(strata, "stratum").withColumn("part", F.pmod(F.xxhash64("root", F.lit(seed)), F.col("parts")))
    k = F.row_number().over(W.partitionBy("stratum", "part").orderBy(F.xxhash64(F.lit(seed + 1), "root"), "root"))
    point = F.pmod(k * F.lit(_GOLDEN) + F.pmod(F.xxhash64("stratum", "part"), F.lit(1000)) / 1000.0, F.lit(1.0))
    bound, split = 0.0, None
    total = sum(shares.values())
    for name, share in list(shares.items())[:-1]:
        bound += share / total
        split = F.when(point < bound, F.lit(name)) if split is None else split.when(point < bound, F.lit(name))
    last = list(shares)[-1]
    chosen = dealt.select("root", (split.otherwise(F.lit(last)) if split is not None else F.lit(last)).alias("split"), "n")
    return join_hot(placed, chosen, "root", "n").select(F.col("id").alias("record_id"), F.col("root").alias("bundle_root"), "label", "split")
