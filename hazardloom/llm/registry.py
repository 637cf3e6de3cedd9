"""Queries of problems 4 to 10, over their whole tables, and their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.llm import components, consensus, leaks, mixing, personal, sentences, splits
from hazardloom.storage import Workspace, table, utc


def _texts(spark: SparkSession, d: str) -> DataFrame:
    utc(spark)
    return personal.union_texts((table(spark, d, "reports"), "reports", "id", "raw_text"), (table(spark, d, "analyst_decisions"), "analyst_decisions", "id", "analyst_comment"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every place of personal information in reports and comments."""
    return personal.places(_texts(spark, d))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders."""
    return personal.redacted(_texts(spark, d))


def _consensus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    utc(spark)
    labels = consensus.latest_labels(table(spark, d, "analyst_decisions"), "report_id", "analyst_id", "analyst_label", "reviewed_at", "id")
    return (labels, *consensus.discover(labels, Workspace(spark, "p5")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The consensus of every report with at least three labelling analysts."""
    truth = _consensus(spark, d)[1]
    return truth.filter("n_labels >= 3").select(F.col("item").alias("report_id"), F.when(F.col("truth") > 0.5, "SIF").otherwise("NON_SIF").alias("consensus_label"))


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per labelled report: votes, share of analysts that agree with the consensus, and its posterior."""
    truth = _consensus(spark, d)[1]
    agree = F.when(F.col("truth") > 0.5, F.col("n_positive")).otherwise(F.col("n_labels") - F.col("n_positive"))
    pairs = F.when(F.col("n_labels") > 1, (F.col("n_positive") * (F.col("n_positive") - 1) + (F.col("n_labels") - F.col("n_positive")) * (F.col("n_labels") - F.col("n_positive") - 1)) / (F.col("n_labels") * (F.col("n_labels") - 1)))
    return truth.select(F.col("item").alias("report_id"), "n_labels", "n_positive", F.round("truth", 6).alias("posterior"), F.round(agree / F.col("n_labels"), 6).alias("agreement"), F.round(pairs, 6).alias("pairwise_agreement"))


def p5_analysts(spark: SparkSession, d: str) -> DataFrame:
    """The reliability of every analyst."""
    return consensus.reliability(_consensus(spark, d)[2]).withColumnRenamed("annotator", "analyst_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that must share a split."""
    utc(spark)
    return splits.bundles(table(spark, d, "incident_records"), "id", ["group_id", "text_hash"], Workspace(spark, "p6")).select(F.col("id").alias("record_id"), F.col("root").alias("bundle_root"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its split."""
    utc(spark)
    records = table(spark, d, "incident_records")
    space = Workspace(spark, "p6")
    roots = space.cut(splits.bundles(records, "id", ["group_id", "text_hash"], space), "roots")
    return splits.assign(records, "id", "label", roots)


def p6_forest(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the spanning forest that hold the bundles together."""
    space = Workspace(spark, "p6")
    edges = splits.tie_edges(table(spark, d, "incident_records"), "id", ["group_id", "text_hash"], space)
    return splits.spanning_forest(edges, space)[1]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every report that is linked to another one."""
    utc(spark)
    links = components.clean_pairs(table(spark, d, "duplicate_pairs"), "report_id_a", "report_id_b")
    return components.connected_groups(links, Workspace(spark, "p7")).select(F.col("id").alias("report_id"), F.col("root").alias("group_root"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold parts of evaluation passages, with the items."""
    utc(spark)
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each test item leaked into."""
    items = table(spark, d, "eval_items").select("item_id", "suite", "lang", "split_name")
    return items.join(p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs")), "item_id", "left").na.fill(0, ["n_docs"])


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    utc(spark)
    return mixing.mix(table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "mix_targets"), Workspace(spark, "p9"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence and heading of every document."""
    utc(spark)
    return sentences.sentences(table(spark, d, "documents"), Workspace(spark, "p10"))


QUERIES = {
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p5_found": p5_found,
    "p5_agreement": p5_agreement,
    "p5_analysts": p5_analysts,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p6_forest": p6_forest,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}

_WHITE = r"^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$"


def _clean(c: str) -> str:
    return f"lower(regexp_replace({c}, '{_WHITE}', '', 'g'))"


_MISSING = "('', 'null', 'none', 'nan', 'unknown', 'n/a')"
#: Reachability carries ever smaller ids over the links; the smallest that arrives is the root.
_REACH = "w(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id WHERE w.root < e.b)"

SQL: dict[str, str] = {
    "p6_found": f"""WITH RECURSIVE k AS (SELECT id, 'g' || {_clean("group_id")} AS key FROM incident_records WHERE {_clean("group_id")} NOT IN {_MISSING} UNION SELECT id, 'h' || {_clean("text_hash")} FROM incident_records WHERE {_clean("text_hash")} NOT IN {_MISSING}),
      s AS (SELECT id, min(id) OVER (PARTITION BY key) AS hub FROM k), e AS (SELECT id AS a, hub AS b FROM s WHERE id <> hub UNION SELECT hub, id FROM s WHERE id <> hub), {_REACH} SELECT id AS record_id, min(root) AS bundle_root FROM w GROUP BY 1""",
    "p7_found": f"""WITH RECURSIVE p AS (SELECT {_clean("report_id_a")} AS a, {_clean("report_id_b")} AS b FROM duplicate_pairs WHERE {_clean("report_id_a")} NOT IN {_MISSING} AND {_clean("report_id_b")} NOT IN {_MISSING}),
      e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b), {_REACH} SELECT id AS report_id, min(root) AS group_root FROM w GROUP BY 1""",
}
