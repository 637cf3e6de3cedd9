"""Batch ingestion of files: read, map headers to the source's layout, normalise, split off rejects, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.sources import adapters, readers

#: Limits of an upload.
MAX_BYTES, MAX_ROWS = 10 * 1024 * 1024, 5_000
#: Columns that each adapter reads; the first is the record's number.
LAYOUTS = {
    "phmsa": ("report_number", "local_datetime", "operator_name", "location_city_name", "location_state_abbreviation", "commodity_released_type", "system_type", "system_part_involved", "cause", "subcause", "ignite_ind", "explode_ind", "num_fatalities", "num_injuries", "narrative"),
    "cer": ("incident_number", "incident_date", "company", "pipeline_name", "province", "substance", "activity_at_time", "what_happened", "primary_cause", "adverse_effects", "significant", "fatalities", "serious_injuries"),
    "oisd": ("incident_no", "date_of_occurrence", "organization", "installation_unit", "state_region", "sector", "activity_underway", "description_of_incident", "hazard_type", "barrier_failure", "consequence", "fatalities", "injuries", "sif_potential"),
}


def check_upload(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> None:
    """Raises where a file is of another kind or larger than an upload may be."""
    if not path.lower().endswith((".csv", ".json", ".jsonl")):
        raise ValueError("only csv, json and jsonl files can be read")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    if size > max_bytes:
        raise ValueError(f"{size} bytes are more than the {max_bytes} allowed")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    kind = path.lower().rsplit(".", 1)[-1]
    return readers.read_csv(spark, path) if kind == "csv" else spark.read.json(path) if kind == "jsonl" else readers.read_json(spark, path)


def laid_out(df: DataFrame, source: str) -> DataFrame:
    """The source's columns as text, found whatever the case and marks of the headers; absent ones are null."""
    found: dict[str, list[str]] = {}
    for c in df.columns:
        found.setdefault(readers.canonical_key(c), []).append(c)
    pick = lambda c: F.coalesce(*(F.col(f"`{x}`").cast("string") for x in found[c])) if c in found else F.lit(None).cast("string")
    return df.select(*(pick(c).alias(c) for c in LAYOUTS[source]))


def ingest(spark: SparkSession, source: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted canonical incidents, rejected rows with the reason)."""
    if source not in LAYOUTS:
        raise ValueError(f"unknown source {source!r}; known are {', '.join(sorted(LAYOUTS))}")
    rows = laid_out(read_any(spark, path), source)
    number = F.coalesce(F.trim(LAYOUTS[source][0]), F.lit(""))
    return adapters.ADAPTERS[source](rows.filter(number != "")), rows.filter(number == "").withColumn("reason", F.lit("missing_record_number"))


def run(spark: SparkSession, inputs: dict[str, str], out: str) -> DataFrame:
    """Ingests several sources into one Parquet table below ``out`` and returns the quality report, written beside it."""
    accepted = reduce(DataFrame.unionByName, (ingest(spark, s, p)[0] for s, p in inputs.items()))
    accepted.write.mode("overwrite").partitionBy("source").parquet(f"{out}/incidents")
    stored = spark.read.parquet(f"{out}/incidents")
    adapters.quality(stored, ["source"]).write.mode("overwrite").json(f"{out}/quality")
    return spark.read.json(f"{out}/quality")
