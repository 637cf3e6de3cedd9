"""Canonical views over the base tables, as DataFrames and as the same CTEs in SQL, and the query registry.

``reports``: one row per id, the latest delivery. ``classifications``: the model's last statement on a report, as
snapshotted with its decisions. ``reviews``: distinct decisions that carry a label. ``triples``: activity, asset
and department of a report as its pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardloom.storage import table, utc

CTES = {
    "r": """r AS (SELECT * EXCLUDE (reported_at, ingested_at, resolved_at), reported_at AT TIME ZONE 'UTC' AS reported_at, ingested_at AT TIME ZONE 'UTC' AS ingested_at, resolved_at AT TIME ZONE 'UTC' AS resolved_at
      FROM reports QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)""",
    "d": "d AS (SELECT DISTINCT * EXCLUDE (reviewed_at), reviewed_at AT TIME ZONE 'UTC' AS reviewed_at FROM analyst_decisions)",
    "c": """c AS (SELECT report_id, ai_sif_probability_at_time AS sif_probability, ai_sif_label_at_time AS sif_label FROM d
      WHERE ai_sif_probability_at_time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY reviewed_at DESC, id DESC) = 1)""",
    "v": "v AS (SELECT id, report_id, analyst_id, analyst_label AS final_label, ai_sif_label_at_time AS ai_label, ai_sif_probability_at_time AS ai_probability, review_action, reviewed_at FROM d WHERE analyst_label IS NOT NULL AND ai_sif_label_at_time IS NOT NULL)",
    "t": "t AS (SELECT id AS report_id, lower(trim(job_type)) AS activity, lower(trim(equipment_type)) AS location_asset, coalesce(lower(trim(department)), 'not identified') AS barrier_failure, site_id, reported_at FROM r WHERE job_type IS NOT NULL AND equipment_type IS NOT NULL)",
}
_NEEDS = {"c": ("d",), "v": ("d",), "t": ("r",)}


def ctes(*names: str) -> str:
    """WITH clause for the named views and what they need."""
    order: list[str] = []

    def take(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            take(m)
        if n not in order:
            order.append(n)

    for n in names:
        take(n)
    return "WITH " + ", ".join(CTES[n] for n in order) + " "


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Latest delivery per id. A ranked window, not an aggregate of whole rows: unread columns (the text above all) stay out of the shuffle."""
    newest = F.row_number().over(W.partitionBy("id").orderBy(F.desc("ingested_at")))
    return table(spark, d, "reports").withColumn("__k", newest).filter("__k = 1").drop("__k")


def reports_of(spark: SparkSession, d: str, *values: Column | str) -> DataFrame:
    """id and some values of the latest delivery per id, for values made from texts: they are made first, so only
    they, not the texts, go into the shuffle; the few repeated deliveries cost their computation twice."""
    values = [F.col(v) if isinstance(v, str) else v for v in values]
    made = table(spark, d, "reports").select("id", "ingested_at", F.struct(*values).alias("v"))
    return made.groupBy("id").agg(F.max_by("v", "ingested_at").alias("v")).select("id", "v.*")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Each decision once: repeats are exact, so the id is enough and unread columns are pruned."""
    return table(spark, d, "analyst_decisions").dropDuplicates(["id"])


def classifications(spark: SparkSession, d: str) -> DataFrame:
    said = decisions(spark, d).filter("ai_sif_probability_at_time is not null")
    last = said.groupBy("report_id").agg(F.max_by(F.struct("ai_sif_probability_at_time", "ai_sif_label_at_time"), F.struct("reviewed_at", "id")).alias("s"))
    return last.select("report_id", F.col("s.ai_sif_probability_at_time").alias("sif_probability"), F.col("s.ai_sif_label_at_time").alias("sif_label"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).filter("analyst_label is not null and ai_sif_label_at_time is not null").select("id", "report_id", "analyst_id", F.col("analyst_label").alias("final_label"), F.col("ai_sif_label_at_time").alias("ai_label"), F.col("ai_sif_probability_at_time").alias("ai_probability"), "review_action", "reviewed_at")


def triples(spark: SparkSession, d: str) -> DataFrame:
    low = lambda c: F.lower(F.trim(c))
    return reports(spark, d).filter("job_type is not null and equipment_type is not null").select(F.col("id").alias("report_id"), low("job_type").alias("activity"), low("equipment_type").alias("location_asset"), F.coalesce(low("department"), F.lit("not identified")).alias("barrier_failure"), "site_id", "reported_at")


class Registry:
    """Queries of one module with their SQL checks."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def wrap(f: Callable) -> Callable:
            def run(spark: SparkSession, d: str) -> DataFrame:
                utc(spark)
                return f(spark, d)

            run.__doc__ = f.__doc__
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return f

        return wrap
