"""Ingestion jobs: payloads, resolution of sites and dates with errors row by row, synthetic records, evaluation
records, and artefacts with a manifest.

Rows of a job: row_no, id, raw_text, site_id, site_name, reported_at, report_type and further text columns. A null or
blank value is missing. Nothing is dropped silently: every row is a report or an error with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.functions import pipeline as P
from hazardloom.functions import text as X
from hazardloom.operators.time_normal import parse_times
from hazardloom.sources.adapters import iso_date
from hazardloom.sources.batch import MAX_ROWS

UPLOAD = ("id", "raw_text", "site_id", "site_name", "reported_at", "report_type", "department", "shift", "equipment_type", "job_type")
SHORTEST_TEXT = 10
#: Keys whose values never leave the engine in a log or trace.
BODY_KEYS = ("raw_text", "text", "processed_text", "narrative", "description", "comment", "body", "content", "payload", "prompt")


def payload_rows(spark: SparkSession, payload: list[dict]) -> DataFrame:
    """Rows of a JSON payload, numbered from 1 in its order; other keys are ignored. An empty or oversized payload is an error."""
    if not isinstance(payload, list) or not payload or not all(isinstance(r, dict) for r in payload):
        raise ValueError("a payload is a list of one or more objects")
    if len(payload) > MAX_ROWS:
        raise ValueError(f"{len(payload)} rows are more than the {MAX_ROWS} allowed")
    text = lambda v: None if v is None else str(v)
    rows = [(k + 1, *(text(r.get(c)) for c in UPLOAD)) for k, r in enumerate(payload)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("row_no", T.LongType()), *(T.StructField(c, T.StringType()) for c in UPLOAD)]))


def export_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export (a JSON list in one file, or JSON lines), numbered by their hash order, which no run changes."""
    df = spark.read.option("multiLine", not path.endswith(".jsonl")).json(path)
    have = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in UPLOAD]
    if "source_report_id" in df.columns:
        have[0] = F.coalesce(F.col("source_report_id").cast("string"), have[0]).alias("id")
    rows = df.select(*have)
    return rows.withColumn("row_no", F.xxhash64(*UPLOAD)).select("row_no", *UPLOAD)


def _blank(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(c)), F.lit("")).isin(*X.MISSING)


def process(rows: DataFrame, sites: DataFrame, run_id: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reports, errors (row_no, error), summary (run_id, n_rows, n_reports, n_errors, status)).

    Sites resolve by id, else by name without case and surrounding white space, else to the first one; an upload
    without any site is an error on each row. A missing date is ``now``; one that can't be read is an error, as is a
    missing or short text. A missing id is INGEST-<run>-<row>. The run failed only if nothing came through.
    """
    known = sites.select(F.col("id").alias("by_id"))
    names = sites.select(F.lower(F.trim("name")).alias("key"), F.col("id").alias("by_name")).groupBy("key").agg(F.min("by_name").alias("by_name"))
    first = sites.agg(F.min("id").alias("default_site"))
    r = rows.join(known, F.col("site_id") == F.col("by_id"), "left").join(names, F.lower(F.trim("site_name")) == F.col("key"), "left").crossJoin(F.broadcast(first))  # one row
    site = F.coalesce("by_id", "by_name", "default_site")
    r = parse_times(r.withColumn("resolved_site", site), "reported_at", F.lit(True))
    told = F.coalesce(F.timestamp_seconds("t_unix"), F.timestamp_seconds("t_local"), F.col("t_day").cast("timestamp"), F.to_timestamp(iso_date(F.col("reported_at"))))
    at = F.when(_blank("reported_at"), F.lit(now).cast("timestamp")).otherwise(told)
    error = (
        F.when(_blank("raw_text"), "missing text").when(F.length(F.trim("raw_text")) < SHORTEST_TEXT, "text too short").when(F.col("resolved_site").isNull(), "no valid site")
        .when(~_blank("reported_at") & told.isNull(), "unreadable date")
    )
    ident = F.when(_blank("id"), F.concat(F.lit(f"INGEST-{run_id[:8]}-"), F.lpad(F.col("row_no").cast("string"), 4, "0"))).otherwise(F.trim("id"))
    kept = [c for c in rows.columns if c not in ("row_no", "id", "site_id", "site_name", "reported_at")]
    judged = r.select("row_no", ident.alias("id"), F.col("resolved_site").alias("site_id"), at.alias("reported_at"), *kept, error.alias("error"))
    n = judged.agg(F.count("*").alias("n_rows"), F.count_if(F.col("error").isNull()).alias("n_reports"), F.count("error").alias("n_errors"))
    status = F.when((F.col("n_reports") == 0) & (F.col("n_rows") > 0), "FAILED").otherwise("COMPLETED")
    return judged.filter("error is null").drop("error", "row_no"), judged.filter("error is not null").select("row_no", "error"), n.select(F.lit(run_id).alias("run_id"), "*", status.alias("status"))


def synthetic(rows: DataFrame) -> DataFrame:
    """Synthetic records: marked as such whatever they say, ids with the prefix ``SYN-``, without an id or with a short text left out."""
    ident = F.trim("id")
    r = rows.filter(~_blank("id") & (F.length(X.clean_text(F.coalesce("raw_text", F.lit("")))) >= SHORTEST_TEXT))
    return r.withColumn("id", F.when(ident.startswith("SYN-"), ident).otherwise(F.concat(F.lit("SYN-"), ident))).withColumn("data_type", F.lit("synthetic")).withColumn("raw_text", X.clean_text(F.col("raw_text")))


def evaluation_records(records: DataFrame) -> DataFrame:
    """(id, group_id, norm_text, text_hash, label) of labelled records that aren't synthetic; a record without a group is its own."""
    kept = records.filter("label is not null and lower(coalesce(data_type, '')) != 'synthetic'")
    norm = X.normalise(F.coalesce("raw_text", F.lit("")))
    group = F.coalesce(F.lower(X.optional(F.col("group_id"))), F.col("id"))
    return kept.select("id", group.alias("group_id"), norm.alias("norm_text"), "label").distinct().filter("norm_text != ''").withColumn("text_hash", X.text_hash(F.col("norm_text")))


def observable(payload: Column) -> Column:
    """A map of texts as it may be logged: body-like keys left out, plain personal data in the others replaced."""
    open_ = F.map_filter(payload, lambda k, v: ~F.lower(k).isin(*BODY_KEYS))
    return F.transform_values(open_, lambda k, v: P.redacted(v)[0])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of all files below an artefact's folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = path.split(":", 1)[-1].rstrip("/")
    name = F.expr(f"substring(p, length('/{base.strip('/')}/') + 1)")
    return files.select(root.alias("p"), "length", F.sha2("content", 256).alias("sha256")).select(name.alias("file"), "length", "sha256")


def changed_files(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(file, problem) of an artefact that differs from its manifest: missing, added or altered files; empty where it is whole."""
    now = manifest(spark, path).select("file", F.col("sha256").alias("now"))
    both = known.select("file", F.col("sha256").alias("then")).join(now, "file", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "added").when(F.col("now") != F.col("then"), "altered")
    return both.select("file", problem.alias("problem")).filter("problem is not null")
