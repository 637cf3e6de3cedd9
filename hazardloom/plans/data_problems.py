"""Queries of problems 1 to 3, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.operators import raw_rows, schema_drift, time_normal
from hazardloom.storage import Workspace, table, utc

#: source -> (table, record number, time, area)
TIMED = {
    "phmsa": ("phmsa_incidents", "report_number", "local_datetime", "location_state_abbreviation"),
    "cer": ("cer_incidents", "incident_number", "incident_date", "province"),
    "oisd": ("oisd_incidents", "incident_no", "date_of_occurrence", "state_region"),
}


def _raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    utc(spark)
    return table(spark, d, "raw_records"), table(spark, d, "raw_files")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a file against the one before it in its feed."""
    return schema_drift.changes(*_raw(spark, d)).select("file_id", "change_kind", "field_name", "old_field_name").distinct()


def p1_table(source: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """The consistent typed table of one source, with the casts that failed."""
        records, files = _raw(spark, d)
        return schema_drift.consistent_table(records, files, source, Workspace(spark, "p1"))

    return query


def p2_times(spark: SparkSession, d: str) -> DataFrame:
    utc(spark)
    parts = [table(spark, d, t).select(F.lit(source).alias("source"), F.col(no).cast("string").alias("record_no"), F.col(value).cast("string").alias("value"), F.col(area).cast("string").alias("area")) for source, (t, no, value, area) in TIMED.items()]
    return time_normal.normalise(parts[0].union(parts[1]).union(parts[2]), table(spark, d, "local_zones"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The normal form of the time of each record with a readable one."""
    return time_normal.one_per_record(p2_times(spark, d))


def p2_status(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each source were read in which way."""
    return p2_times(spark, d).groupBy("source", "status").agg(F.count("*").alias("n_values"), F.countDistinct("record_no").alias("n_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the phmsa and osha csv files that can't be loaded, with the first reason."""
    return raw_rows.failing_rows(*_raw(spark, d)).select("file_id", "line_no", "reason")


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    """The records that load, as field maps."""
    return raw_rows.sound_rows(*_raw(spark, d))


QUERIES = {
    "p1_found": p1_found,
    "p1_table_phmsa": p1_table("phmsa"),
    "p1_table_oisd": p1_table("oisd"),
    "p1_table_export": p1_table("export"),
    "p2_found": p2_found,
    "p2_times": p2_times,
    "p2_status": p2_status,
    "p3_found": p3_found,
    "p3_rows": p3_rows,
}

#: A field of a record, quoted or bare, for the delimiter d of its file.
_FIELD = """('(?:"[^"]*(?:""[^"]*)*"|[^"' || d || ']*)')"""
_PLAIN = """CASE WHEN starts_with(v, '"') THEN replace(substring(v, 2, length(v) - 2), '""', '"') ELSE v END"""
_FIELDS = """list_transform(regexp_extract_all({t} || d, '(' || field || ')[' || d || ']', 1), lambda v: """ + _PLAIN + ")"
SQL: dict[str, str] = {
    "p3_found": rf"""WITH f AS (SELECT DISTINCT file_id FROM raw_files WHERE lower(trim(file_format)) = 'csv' AND lower(trim(source)) IN ('phmsa', 'osha')),
      h AS (SELECT file_id, min(line_text) AS header FROM raw_records JOIN f USING (file_id) WHERE line_no = 0 GROUP BY 1),
      b AS (SELECT *, regexp_replace(header, '"[^"]*"', '', 'g') AS bare FROM h),
      c AS (SELECT *, [length(bare) - length(replace(bare, x, '')) FOR x IN [',', ';', '|', chr(9)]] AS n FROM b),
      d AS (SELECT file_id, header, [',', ';', '|', chr(9)][list_position(n, list_max(n))] AS d FROM c),
      e AS (SELECT *, {_FIELD} AS field FROM d),
      k AS (SELECT *, {_FIELDS.format(t='header')} AS names FROM e),
      x AS (SELECT DISTINCT file_id, line_no, coalesce(line_text, '') AS t, d, field, names FROM raw_records JOIN k USING (file_id) WHERE line_no <> 0),
      y AS (SELECT *, regexp_full_match(t, field || '(?:[' || d || ']' || field || ')*') AS closed FROM x),
      z AS (SELECT *, CASE WHEN closed THEN {_FIELDS.format(t='t')} END AS vals FROM y),
      u AS (SELECT file_id, line_no, unnest(list_transform(names, lambda w: upper(trim(w)))) AS name, unnest(vals) AS v FROM z WHERE closed AND len(vals) = len(names)),
      w AS (SELECT DISTINCT file_id, line_no FROM u WHERE CASE
        WHEN name IN ('NUM_FATALITIES', 'NUM_INJURIES', 'HOSPITALIZED', 'AMPUTATION') THEN NOT (lower(trim(v)) IN ('', 'null', 'none', 'nan', 'unknown', 'n/a') OR regexp_full_match(v, '\s*[0-9]+(\.0+)?\s*'))
        WHEN name = 'UNINTENTIONAL_RELEASE_BBLS' THEN NOT regexp_full_match(v, '\s*\+?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')
        WHEN name = 'LOCAL_DATETIME' THEN NOT (regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AND try_strptime(v, '%Y-%m-%d %H:%M:%S') IS NOT NULL)
        WHEN name = 'INCIDENT DATE' THEN NOT (regexp_full_match(v, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') AND try_strptime(v, '%m/%d/%Y') IS NOT NULL)
        WHEN name IN ('NARRATIVE', 'FINAL NARRATIVE') THEN length(regexp_replace(v, '^\s+|\s+$', '', 'g')) < 10 ELSE false END)
      SELECT DISTINCT z.file_id, z.line_no::BIGINT AS line_no, CASE WHEN NOT closed THEN 'quoting' WHEN len(vals) <> len(names) THEN 'column_count' ELSE 'invalid_value' END AS reason
      FROM z LEFT JOIN w ON w.file_id = z.file_id AND w.line_no = z.line_no WHERE NOT closed OR len(vals) <> len(names) OR w.file_id IS NOT NULL""",
}
