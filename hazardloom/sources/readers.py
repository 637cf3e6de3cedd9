"""File scans: csv with a sniffed delimiter, JSON in its usual wrappings, JSON lines, and header aliases."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.functions.text import MISSING
from hazardloom.sources.delimited import delimiter_of

#: Names under which uploads bring the canonical fields.
HEADER_ALIASES = {
    "raw_text": ["raw_text", "description", "incident_description", "event_description", "narrative", "text", "incident_details", "details", "summary"],
    "source_report_id": ["source_report_id", "report_id", "id", "incident_id", "event_id", "reference_no", "ref_no"],
    "site_name": ["site_name", "site", "location", "facility", "plant", "asset_location"],
    "site_id": ["site_id"],
    "report_type": ["report_type", "type", "event_type", "incident_type", "classification", "category"],
    "department": ["department", "dept", "section", "area", "division"],
    "shift": ["shift", "shift_time", "work_shift"],
    "equipment_type": ["equipment_type", "equipment", "asset", "machinery", "system"],
    "job_type": ["job_type", "activity", "task", "operation", "work_type"],
    "reported_at": ["reported_at", "date", "incident_date", "event_date", "timestamp", "date_time", "occurrence_date"],
}
WRAPPINGS = ("records", "data", "reports", "case_studies")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """From the first line alone; the file itself is never read on the driver."""
    first = spark.read.text(path).limit(1).collect()
    return delimiter_of(first[0][0] if first else "")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All fields as strings; quoted fields may hold delimiters and line breaks."""
    return spark.read.csv(path, header=True, sep=sniff_delimiter(spark, path), multiLine=True, escape='"', enforceSchema=False)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, an object that wraps one, or a single object."""
    df = spark.read.json(path, multiLine=True)
    for w in WRAPPINGS:
        if w in df.columns and isinstance(df.schema[w].dataType, T.ArrayType):
            return df.select(F.explode(w).alias("x")).select("x.*")
    return df


def canonical_key(name: str) -> str:
    return re.sub(r"\W+", "_", name.strip().lower()).strip("_")


def with_header_aliases(df: DataFrame) -> DataFrame:
    """The canonical fields of an upload: the first non-blank alias wins.

    Without any text field, the first string column with at least four words in a row serves as the text.
    Columns whose names clash after normalisation are read in their order.
    """
    by_key: dict[str, list[str]] = {}
    for c in df.columns:
        by_key.setdefault(canonical_key(c), []).append(c)
    value = lambda c: F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.trim(F.col(f"`{c}`").cast("string")))
    out = {}
    for field, names in HEADER_ALIASES.items():
        found = [value(c) for n in names for c in by_key.get(n, [])]
        out[field] = F.coalesce(*found) if found else F.lit(None).cast("string")
    if not any(by_key.get(n) for n in HEADER_ALIASES["raw_text"]):
        wordy = [F.when(F.size(F.split(value(c), r"\s+")) >= 4, value(c)) for c, t in df.dtypes if t == "string"]
        out["raw_text"] = F.coalesce(*wordy) if wordy else out["raw_text"]
    return df.select(*(c.alias(f) for f, c in out.items()))


def upload_issues(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``issues`` to uploaded rows (row_no, source_report_id, raw_text, site_name, reported_at), checked against ``known`` (source_report_id)."""
    blank = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("")).isin(*MISSING)
    first = rows.groupBy("source_report_id").agg(F.min("row_no").alias("first_no"))
    seen = known.select("source_report_id").distinct().withColumn("stored", F.lit(True))
    j = rows.join(first, "source_report_id", "left").join(seen, "source_report_id", "left")
    issue = lambda cond, text: F.when(cond, F.lit(text))
    issues = F.array_compact(F.array(issue(blank("raw_text"), "missing_text"), issue(~blank("raw_text") & (F.length(F.trim("raw_text")) < 10), "short_text"), issue(blank("site_name"), "missing_site"), issue(blank("reported_at"), "missing_date"), issue(F.coalesce("stored", F.lit(False)) | (F.col("row_no") > F.col("first_no")), "duplicate_id")))
    return j.select("row_no", "source_report_id", issues.alias("issues"))
