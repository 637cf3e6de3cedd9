"""Evaluation corpora and ingestion jobs over the base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardloom.functions import fixed_values as V
from hazardloom.functions import text as X
from hazardloom.plans import ingestion
from hazardloom.plans.texts import _named, norm_sql
from hazardloom.plans.views import Registry
from hazardloom.sources import jobs
from hazardloom.storage import Workspace, table

REG = Registry()
GOLD = ("HUMAN_VALIDATED", "SENIOR_REVIEW")
#: Candidates of a category: the queue's size is its feature.
QUEUE = 15
CATEGORIES = ("paraphrase", "indirect", "ambiguous", "unseen_terminology", "difficult_non_sif")
_SEVERE = r"\b(fatal|killed|amputat)"
_MISSING = "('', 'null', 'none', 'nan', 'unknown', 'n/a')"


@REG.add("c09_evaluation_records", f"WITH x AS (SELECT DISTINCT id, coalesce(lower(CASE WHEN lower(trim(group_id)) IN {_MISSING} THEN NULL ELSE trim(group_id) END), id) AS group_id, {norm_sql('raw_text')} AS norm_text, label FROM incident_records WHERE label IS NOT NULL AND lower(data_type) <> 'synthetic') SELECT *, substring(sha256(norm_text), 1, 16) AS text_hash FROM x WHERE norm_text <> ''")
def _(spark, d):
    """Labelled records that aren't synthetic, normalised, hashed and grouped."""
    return jobs.evaluation_records(table(spark, d, "incident_records"))


@REG.add("s18_job_summary", "WITH x AS (SELECT DISTINCT id, raw_text, site_id, reported_at FROM reports) SELECT 'nightly-run' AS run_id, count(*) AS n_rows, count(*) FILTER (length(trim(raw_text)) >= 10) AS n_reports, count(*) FILTER (length(trim(raw_text)) < 10) AS n_errors, 'COMPLETED' AS status FROM x")
def _(spark, d):
    """The reports as one upload: sites and dates resolved row by row, every row a report or an error."""
    t = table(spark, d, "reports")
    rows = t.select(F.xxhash64("id", "raw_text").alias("row_no"), "id", "raw_text", "site_id", F.lit(None).cast("string").alias("site_name"), F.date_format("reported_at", "yyyy-MM-dd HH:mm:ss").alias("reported_at"), "report_type").distinct()
    return jobs.process(rows, table(spark, d, "sites"), "nightly-run", "2025-01-01 00:00:00")[2]


_FLAGS = f"""WITH x AS (SELECT id, min(raw_text) AS t, min(label_source) AS source, bool_or(label) AS y, min(norm_text) AS nt FROM incident_records GROUP BY id),
  h AS (SELECT nt FROM x WHERE nt <> '' GROUP BY nt HAVING count(*) > 1),
  w AS (SELECT id, source, unnest(list_distinct(list_filter(string_split({norm_sql('t')}, ' '), lambda k: k <> ''))) AS w FROM x),
  voc AS (SELECT DISTINCT w FROM w WHERE source = 'IMPORTED'),
  o AS (SELECT id, count(voc.w) / count(*) AS known FROM w LEFT JOIN voc USING (w) GROUP BY 1),
  f AS (SELECT x.id, nt IN (SELECT nt FROM h) AS e1, {_named(V.INDIRECT_CUES, c='t')} AND NOT {_named(_SEVERE, c='t')} AS e2,
    NOT {_named(V.DIRECT_CUES, c='t')} AND NOT {_named(V.INDIRECT_CUES, c='t')} AND NOT {_named(V.ROUTINE_CUES, c='t')} AS e3,
    coalesce(known, 1) < 0.35 AND {_named(V.UNSEEN_TERMS, c='t')} AS e4,
    (NOT y AND {_named(V.DIRECT_CUES, c='t')}) OR (source IN ('UNKNOWN', 'SYNTHETIC') AND {_named(V.ROUTINE_CUES, c='t')} AND NOT {_named(V.DIRECT_CUES, c='t')} AND NOT {_named(V.INDIRECT_CUES, c='t')}) AS e5
    FROM x LEFT JOIN o USING (id) WHERE source NOT IN ('HUMAN_VALIDATED', 'SENIOR_REVIEW') AND length(trim(t)) >= 20)"""
_CASCADE = ", ".join(f"s{k} AS (SELECT id, '{c}' AS category FROM f WHERE e{k}" + "".join(f" AND id NOT IN (SELECT id FROM s{j})" for j in range(1, k)) + f" ORDER BY id LIMIT {QUEUE})" for k, c in enumerate(CATEGORIES, 1))


@REG.add("t12_challenge_queue", f"{_FLAGS}, {_CASCADE} " + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, 6)))
def _(spark, d):
    """Difficult records to be labelled, none of them gold: each category takes the first that no category before it took.

    A record that finds its category full falls through to the next, which is the same as choosing category by
    category; only the chosen (at most 15 a category) are held against the rest.
    """
    space = Workspace(spark, "t12")
    x = table(spark, d, "incident_records").groupBy("id").agg(F.min("raw_text").alias("t"), F.min("label_source").alias("source"), F.bool_or("label").alias("y"), F.min("norm_text").alias("nt"))
    x = space.cut(x, "records")
    t = F.col("t")
    shared = x.filter("nt != ''").groupBy(F.sha2("nt", 256).alias("h")).agg(F.count("*").alias("k")).filter("k > 1").select("h", F.lit(True).alias("shared"))
    words = x.select("id", "source", F.explode(X.tokens(X.normalise(t))).alias("w"))
    vocabulary = words.filter("source = 'IMPORTED'").select("w").distinct().withColumn("in", F.lit(1))
    rare = words.join(x.filter(X.named(t, V.UNSEEN_TERMS)).select("id"), "id", "left_semi")
    known = rare.join(vocabulary, "w", "left").groupBy("id").agg((F.count("in") / F.count("*")).alias("known"))
    direct, indirect, routine = (X.named(t, p) for p in (V.DIRECT_CUES, V.INDIRECT_CUES, V.ROUTINE_CUES))
    fits = (
        F.coalesce("shared", F.lit(False)), indirect & ~X.named(t, _SEVERE), ~direct & ~indirect & ~routine, (F.coalesce("known", F.lit(1.0)) < 0.35) & X.named(t, V.UNSEEN_TERMS),
        (~F.col("y") & direct) | (F.col("source").isin("UNKNOWN", "SYNTHETIC") & routine & ~direct & ~indirect),
    )
    open_ = x.filter(~F.col("source").isin(*GOLD) & (F.length(F.trim(t)) >= 20)).withColumn("h", F.sha2("nt", 256))
    flags = space.cut(open_.join(shared, "h", "left").join(known, "id", "left").select("id", *(c.alias(n) for c, n in zip(fits, CATEGORIES))), "flags")
    chosen = None
    for name in CATEGORIES:
        rest = flags.filter(F.col(name))
        rest = rest if chosen is None else rest.join(F.broadcast(chosen.select("id")), "id", "left_anti")
        taken = space.cut(rest.select("id").orderBy("id").limit(QUEUE).withColumn("category", F.lit(name)), name)
        chosen = taken if chosen is None else space.cut(chosen.union(taken), "chosen")
    return chosen


@REG.add("t14_evaluation_corpus")
def _(spark, d):
    """Every labelled record with hash, duplicate group, split and queue category: the corpus in one table."""
    q = REG.queries
    records = table(spark, d, "incident_records").select("id", "label", "label_source", X.text_hash(F.col("norm_text")).alias("text_hash")).distinct()
    groups = ingestion.QUERIES["t13_duplicate_groups"](spark, d)
    queue = q["t12_challenge_queue"](spark, d)
    return records.join(groups, "id", "left").join(queue, "id", "left").withColumn("group_root", F.coalesce("group_root", "id")).withColumn("is_gold", F.col("label_source").isin(*GOLD))


QUERIES, SQL = REG.queries, REG.sql
