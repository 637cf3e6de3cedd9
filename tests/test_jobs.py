"""Ingestion jobs: every row is a report or an error."""

import json

import pytest
from pyspark.sql import functions as F

from hazardloom.sources import jobs

SITES = [("s1", "North Dock"), ("s2", "Tank Farm")]


def test_payloads(spark):
    for bad in ([], {}, [1], [{"id": 1}] * (jobs.MAX_ROWS + 1)):
        with pytest.raises(ValueError):
            jobs.payload_rows(spark, bad)
    rows = jobs.payload_rows(spark, [{"id": 7, "raw_text": "the valve was open", "more": [1]}]).collect()
    assert rows[0]["row_no"] == 1 and rows[0]["id"] == "7" and rows[0]["site_id"] is None


def test_every_row_is_a_report_or_an_error(spark):
    sites = spark.createDataFrame(SITES, "id string, name string")
    text = "the valve was open"
    rows = jobs.payload_rows(spark, [
        {"id": "a", "raw_text": text, "site_id": "s2", "reported_at": "2024-07-01 10:00:00"}, {"raw_text": text, "site_name": " north dock ", "site_id": "nowhere"}, {"id": " ", "raw_text": text, "reported_at": "1 July 2024"},
        {"id": "b", "raw_text": "short"}, {"id": "c", "raw_text": "n/a"}, {"id": "d", "raw_text": text, "reported_at": "the day before"},
    ])
    reports, errors, summary = jobs.process(rows, sites, "run-12345678", "2025-01-01 00:00:00")
    got = {r["id"]: (r["site_id"], str(r["reported_at"])) for r in reports.collect()}
    assert got == {"a": ("s2", "2024-07-01 10:00:00"), "INGEST-run-1234-0002": ("s1", "2025-01-01 00:00:00"), "INGEST-run-1234-0003": ("s1", "2024-07-01 00:00:00")}
    assert {r["row_no"]: r["error"] for r in errors.collect()} == {4: "text too short", 5: "missing text", 6: "unreadable date"}
    assert tuple(summary.first())[1:] == (6, 3, 3, "COMPLETED")
    _, errors, summary = jobs.process(rows, sites.limit(0), "run-1", "2025-01-01 00:00:00")
    assert summary.first()["status"] == "FAILED" and errors.count() == 6


def test_exports_and_synthetic_records(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text(json.dumps([{"source_report_id": "E1", "raw_text": "the  valve was\nopen", "site_name": "x"}, {"source_report_id": "SYN-2", "raw_text": "too short"[:5]}, {"source_report_id": None, "raw_text": "the valve was open"}]))
    rows = jobs.export_rows(spark, str(path))
    assert rows.count() == 3
    got = jobs.synthetic(rows).collect()
    assert [(r["id"], r["raw_text"], r["data_type"]) for r in got] == [("SYN-E1", "the valve was open", "synthetic")]


def test_evaluation_records(spark):
    df = spark.createDataFrame([("a", " G1 ", "The valve!", True, "real", "x"), ("a", " G1 ", "The valve!", True, "real", "x"), ("b", "n/a", "The pump", False, "real", "x"), ("c", None, "x y", True, "Synthetic", "x"), ("d", None, "x", None, "real", "x"), ("e", None, None, True, None, "x")], "id string, group_id string, raw_text string, label boolean, data_type string, text_hash string")
    got = {r["id"]: (r["group_id"], r["norm_text"]) for r in jobs.evaluation_records(df).collect()}
    assert got == {"a": ("g1", "the valve"), "b": ("b", "the pump")}


def test_observable_maps(spark):
    df = spark.createDataFrame([({"user": "mail a.b@example.org", "Raw_Text": "secret", "n": None},), (None,)], "m map<string,string>")
    rows = [r["o"] for r in df.select(jobs.observable(F.col("m")).alias("o")).collect()]
    assert rows == [{"user": "mail [EMAIL]", "n": None}, None]


def test_artefacts(spark, tmp_path):
    folder = tmp_path / "model"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.bin").write_bytes(b"one")
    (folder / "sub" / "b.bin").write_bytes(b"two")
    known = spark.createDataFrame(jobs.manifest(spark, str(folder)).collect())
    assert sorted(r["file"] for r in known.collect()) == ["a.bin", "sub/b.bin"]
    assert jobs.changed_files(spark, str(folder), known).count() == 0
    (folder / "a.bin").write_bytes(b"1")
    (folder / "sub" / "b.bin").unlink()
    (folder / "c.bin").write_bytes(b"x")
    assert {r["file"]: r["problem"] for r in jobs.changed_files(spark, str(folder), known).collect()} == {"a.bin": "altered", "sub/b.bin": "missing", "c.bin": "added"}
