"""Problem 3: rows that fail to parse, set apart with the reason while the valid rows load.

Every record is parsed under the header of its file. Records of one file are joined with their header by
(file, block of 100,000 lines), so a file that holds a third of all rows spreads over many tasks; the header
itself comes from one map-side combined aggregate. Results are distinct: a record that is delivered twice
gives one row. A null line is an empty record; records without file_id or line_no have no place to be
reported at and are left out; an empty input gives no rows; columns beside those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.sources import delimited

#: Lines of a file that are parsed together at most, whatever the size of the file.
BLOCK_LINES = 100_000


def with_headers(records: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, line_no, source, file_format, header, line_text of every record that is not a csv header."""
    rec = records.select(F.col("file_id").cast("long"), F.col("line_no").cast("long"), "line_text").filter("file_id is not null and line_no is not null")
    meta = files.select(F.col("file_id").cast("long"), F.lower(F.trim("source")).alias("source"), F.lower(F.trim("file_format")).alias("file_format")).filter("file_id is not null").dropDuplicates(["file_id"])
    heads = rec.groupBy("file_id").agg(F.max("line_no").alias("last"), F.min(F.when(F.col("line_no") == 0, F.col("line_text"))).alias("header"))
    blocks = heads.join(meta, "file_id").select("file_id", "source", "file_format", F.coalesce("header", F.lit("")).alias("header"), F.explode(F.sequence(F.lit(0), (F.greatest("last", F.lit(0)) / BLOCK_LINES).cast("long"))).alias("block"))
    return (
        rec.withColumn("block", (F.col("line_no") / BLOCK_LINES).cast("long"))
        .join(blocks, ["file_id", "block"])
        .filter("not (file_format = 'csv' and line_no = 0)")
        .select("file_id", "line_no", "source", "file_format", "header", "line_text")
    )


def csv_records(records: DataFrame, files: DataFrame, sources: tuple[str, ...] = ("phmsa", "osha")) -> DataFrame:
    wanted = files.filter((F.lower(F.trim("file_format")) == "csv") & F.lower(F.trim("source")).isin(*sources))
    return with_headers(records.join(wanted.select("file_id").distinct(), "file_id", "left_semi"), wanted)


def _label(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, delimited.Parsed, np.ndarray, np.ndarray]]:
    """For each header of a batch: row positions, parsed records, reason and failing field of each record."""
    for header, part in pdf.groupby("header", sort=False):
        parsed = delimited.parse_lines(header, part["line_text"].tolist())
        reason, field = parsed.reason.copy(), np.full(len(part), None, dtype=object)
        for name, bad in delimited.failing_cells(parsed.names, parsed.columns).items():
            rows = parsed.at[bad]
            rows = rows[reason[rows] != "invalid_value"] if len(rows) else rows
            reason[rows] = "invalid_value"
            field[rows] = name
        yield part.index.to_numpy(), parsed, reason, field


def failing_rows(records: DataFrame, files: DataFrame, sources: tuple[str, ...] = ("phmsa", "osha")) -> DataFrame:
    """(file_id, line_no, reason, failing_field, line_text) of each record that can't be loaded; the failing field only for ``invalid_value``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            pdf["reason"], pdf["failing_field"] = None, None
            reason, field = pdf["reason"].to_numpy(dtype=object), pdf["failing_field"].to_numpy(dtype=object)
            for at, _, why, name in _label(pdf):
                reason[at], field[at] = why, name
            out = pdf.assign(reason=reason, failing_field=field)
            yield out.loc[out["reason"].notna(), ["file_id", "line_no", "reason", "failing_field", "line_text"]]

    return csv_records(records, files, sources).mapInPandas(run, "file_id long, line_no long, reason string, failing_field string, line_text string").distinct()


def sound_rows(records: DataFrame, files: DataFrame, sources: tuple[str, ...] = ("phmsa", "osha")) -> DataFrame:
    """(file_id, line_no, source, fields map<string,string>) of each record that loads; missing values are null, others trimmed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            rows, maps = [], []
            for at, parsed, why, _ in _label(pdf):
                good = np.flatnonzero([why[k] is None for k in parsed.at])
                values = [[None if m else v.strip() for v, m in zip(c.to_pylist(), delimited.missing_mask(c).to_pylist())] for c in parsed.columns]
                rows.extend(at[parsed.at[good]])
                maps.extend({n: v[k] for n, v in zip(parsed.names, values)} for k in good)
            out = pdf.loc[rows, ["file_id", "line_no", "source"]].copy()
            out["fields"] = pd.Series(maps, index=out.index, dtype=object)
            yield out

    return csv_records(records, files, sources).mapInPandas(run, "file_id long, line_no long, source string, fields map<string,string>")
