"""Problems 1 to 3 on small inputs: stated cases, edge cases and brute force."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from hazardloom.operators import raw_rows, schema_drift, time_normal
from hazardloom.sources import delimited
from hazardloom.storage import Workspace

RECORDS = "file_id long, line_no int, line_text string, source string"
FILES = "file_id long, source string, feed_id string, file_seq int, file_format string, delivered_at string, record_count int"


def reason(header, line):
    p = delimited.parse_lines(header, [line])
    if p.reason[0]:
        return p.reason[0]
    bad = [n for n, m in delimited.failing_cells(p.names, p.columns).items() if m[0]]
    return "invalid_value" if bad else None


@pytest.mark.parametrize(
    "line, want",
    [
        ('1,"a ""b"", c",2', None), ('1,"a\nb",2', None), ("1,a\nb,2", None), ('1,"ab', "quoting"), ('1,"a"b,2', "quoting"), ('1,a"b,2', "quoting"), ("1,2", "column_count"), ("", "column_count"), (None, "column_count"),
        ("1,x,2,3", "column_count"), ("1,x, 2 ", None), ("1,x,2.0", None), ("1,x,n/a", None), ("1,x,-1", "invalid_value"), ("1,x,1.5", "invalid_value"), ("1,x,1O", "invalid_value"), ('1,"",', None),
    ],
)
def test_reasons(line, want):
    assert reason("id,note,NUM_INJURIES", line) == want


@pytest.mark.parametrize("value, ok", [("2024-02-29 10:00:00", True), ("2023-02-29 10:00:00", False), ("2024-01-01 24:00:00", False), ("2024-1-01 10:00:00", False), ("", False), ("9024-01-01 10:00:00", True)])
def test_local_datetime(value, ok):
    assert (reason("a;LOCAL_DATETIME", f"x;{value}") is None) == ok


def test_parser_agrees_with_csv_module():
    import csv
    import io

    rng = random.Random(3)
    header = "a|b|c"
    rows = [["".join(rng.choice('ab |"\n') for _ in range(rng.randrange(6))) for _ in range(3)] for _ in range(200)]
    lines = []
    for r in rows:
        f = io.StringIO()
        csv.writer(f, delimiter="|", quoting=csv.QUOTE_ALL, lineterminator="").writerow(r)
        lines.append(f.getvalue())
    p = delimited.parse_lines(header, lines)
    assert not any(p.reason) and [list(x) for x in zip(*(c.to_pylist() for c in p.columns))] == rows


def test_failing_rows_in_spark(spark):
    files = spark.createDataFrame([(1, "phmsa", "f", 1, "csv", "", 3), (2, "osha", "g", 1, "csv", "", 1), (3, "phmsa", "f", 2, "jsonl", "", 1)], FILES)
    rec = [(1, 0, "REPORT;NUM_FATALITIES", "x"), (1, 1, "a;1", "x"), (1, 2, "b;two", "x"), (1, 2, "b;two", "x"), (1, 250_000, "c", "x"), (1, 3, None, "x"), (2, 0, "ID,Final Narrative", "x"), (2, 1, '1,"short"', "x"), (3, 0, "{}", "x"), (None, 1, "x", "x")]
    got = raw_rows.failing_rows(spark.createDataFrame(rec, RECORDS), files).select("file_id", "line_no", "reason").collect()
    assert sorted(map(tuple, got)) == [(1, 2, "invalid_value"), (1, 3, "column_count"), (1, 250_000, "column_count"), (2, 1, "invalid_value")]
    empty = raw_rows.failing_rows(spark.createDataFrame([], RECORDS), spark.createDataFrame([], FILES))
    assert empty.count() == 0
    assert raw_rows.sound_rows(spark.createDataFrame(rec, RECORDS), files).count() == 1


def test_schema_changes(spark):
    files = spark.createDataFrame([(k, "export", "f", k, "jsonl", "", 3) for k in (1, 2, 3, 4)] + [(9, "osha", "f", 5, "csv", "", 1)], FILES)
    one = ['{"Incident No": "A-%d", "site": "north dock", "n": %d, "x": null}' % (i, i) for i in range(6)]
    two = ['{"IncidentNo": "A-%d", "n": %d.5, "x": "unknown", "mood": true}' % (i, i) for i in range(6)]
    three = ['{"IncidentNo": "A-%d", "n": %d, "x": [1], "mood": "yes"}' % (i, i) for i in range(6)]
    rec = [(k, i, line, "x") for k, lines in ((1, one), (2, two), (3, three), (4, [])) for i, line in enumerate(lines)]
    got = schema_drift.changes(spark.createDataFrame(rec, RECORDS), files).select("file_id", "change_kind", "field_name", "old_field_name").distinct().collect()
    assert sorted(map(tuple, got)) == sorted([(2, "renamed", "IncidentNo", "Incident No"), (2, "removed", "site", ""), (2, "added", "mood", ""), (2, "retyped", "n", ""), (3, "retyped", "n", ""), (3, "retyped", "mood", "")])
    t = schema_drift.consistent_table(spark.createDataFrame(rec, RECORDS), files, "export", Workspace(spark, "t"))
    assert t.count() == 18 and "cast_failures" in t.columns
    few = schema_drift.consistent_table(spark.createDataFrame(rec, RECORDS), files, "export", Workspace(spark, "t"), most=2)
    assert few.columns[2:] == ["incident_no", "n", "cast_failures", "collisions", "other_fields"] or len(few.columns) == 7
    assert {k for r in few.collect() for k in r["other_fields"]} >= {"x", "mood"} - set(few.columns)
    assert schema_drift.changes(spark.createDataFrame([], RECORDS), files).count() == 0


def test_inner_paths_and_whole_values(spark):
    """A field inside an object is compared where both files have the object; long values that differ late are told apart."""
    files = spark.createDataFrame([(k, "oisd", "f", k, "jsonl", "", 3) for k in (1, 2, 3)], FILES)
    opening = "the same opening of more than a dozen words that every one of these two long texts has before it "
    one = ['{"site": {"name": "dock", "old": 1}, "q1": "%salpha beta gamma delta epsilon zeta eta theta iota kappa", "q2": "%sone two three four five six seven eight nine ten", "late": "x"}' % (opening, opening)] * 3
    two = ['{"site": {"name": "dock"}, "z2": "%salpha beta gamma delta epsilon zeta eta theta iota kappa", "z1": "%sone two three four five six seven eight nine ten", "late": {"a": 1}}' % (opening, opening)] * 3
    rec = [(k, i, line, "x") for k, lines in ((1, one), (2, two), (3, ["[1]", "{", None])) for i, line in enumerate(lines)]
    got = schema_drift.changes(spark.createDataFrame(rec, RECORDS), files).select("file_id", "change_kind", "field_name", "old_field_name").collect()
    assert sorted(map(tuple, got)) == sorted([(2, "removed", "site->old", ""), (2, "renamed", "z2", "q1"), (2, "renamed", "z1", "q2"), (2, "retyped", "late", "")])


def test_no_merge_of_fields_that_stand_together(spark):
    """Renames a -> b in one feed never merge a and b where a file has both; two values under one name are reported."""
    files = spark.createDataFrame([(1, "export", "f", 1, "jsonl", "", 1), (2, "export", "f", 2, "jsonl", "", 1), (3, "export", "g", 1, "jsonl", "", 1)], FILES)
    rec = [(1, 0, '{"Site Name": "dock"}', "x"), (2, 0, '{"site_name": "dock"}', "x"), (3, 0, '{"Site Name": "dock", "site_name": "yard"}', "x")]
    df = spark.createDataFrame(rec, RECORDS)
    space = Workspace(spark, "t")
    packed = schema_drift.file_fields(df, files, ("export",), space)
    names = schema_drift.aliases(schema_drift.changes_between(packed, files, ("export",)), packed, files, "export")
    assert names == {"Site Name": "Site Name", "site_name": "site_name"}
    merged = {r["file_id"]: r for r in schema_drift.consistent_rows(df, files, "export", {"site_name": "Site Name", "Site Name": "Site Name"}).collect()}
    assert merged[3]["fields"] == {"Site Name": "dock"} and merged[3]["collisions"] == {"site_name": "yard"} and merged[2]["fields"] == {"Site Name": "dock"} and merged[2]["collisions"] == {}


def test_name_similarity():
    assert schema_drift.name_similarity("Report Number", "report_number") == 1.0
    assert schema_drift.name_similarity("department", "dept") > 0.3
    assert schema_drift.name_similarity("EXPLODE_IND", "IGNITED") == 0.0


ZONES = "source string, area string, zone_name string"


def normalised(spark, rows):
    df = spark.createDataFrame(rows, "source string, record_no string, value string, area string")
    zones = spark.createDataFrame([("phmsa", "TX", "America/Chicago"), ("cer", "Newfoundland", "America/St_Johns"), ("oisd", "Assam", "Asia/Kolkata")], ZONES)
    return {(r["record_no"]): r["normal_time"] for r in time_normal.one_per_record(time_normal.normalise(df, zones)).collect()}


def test_notations(spark):
    cases = {
        "2024-07-01 12:00:00": "2024-07-01T17:00:00Z", "07/01/2024 12:00 PM": "2024-07-01T17:00:00Z", "1 July 2024": "2024-07-01", "20240701": "2024-07-01", "1719853200": "2024-07-01T17:00:00Z", "1719853200999": "2024-07-01T17:00:00Z",
        "2024-07-01T12:00:00.999-05:00": "2024-07-01T17:00:00Z", "01-Jul-24 12:00": "2024-07-01T17:00:00Z", "1200 hrs, 1 July 2024": "2024-07-01T17:00:00Z", "Mon, 01 Jul 2024 12:00:00 -0500": "2024-07-01T17:00:00Z", "Jul 1, 2024 12:00 PM CDT": "2024-07-01T17:00:00Z",
        " 20240701T170000Z ": "2024-07-01T17:00:00Z", "2024-07-01 12:00:00 America/Chicago": "2024-07-01T17:00:00Z", "2024-11-03 01:30:00": "2024-11-03T06:30:00Z", "2024-03-10 02:30:00": "2024-03-10T08:30:00Z",
        "2023-02-30": None, "13/45/2024": None, "yesterday": None, "": None, "N/A": None, "2024-07-01 25:00:00": None,
    }
    rows = [("phmsa", str(k), v, " tx ") for k, v in enumerate(cases)] + [("phmsa", "x", "2024-07-01 12:00:00", None), ("phmsa", "y", "2024-07-01", None), ("cer", "z", "le 3 février 2024 à 7 h 05", "Newfoundland"), ("oisd", "w", "02/03/2024", None), ("phmsa", "n", None, "TX")]
    got = normalised(spark, rows)
    assert {k: got.get(str(k)) for k in range(len(cases))} == dict(enumerate(cases.values()))
    assert "x" not in got and got["y"] == "2024-07-01" and got["z"] == "2024-02-03T10:35:00Z" and got["w"] == "2024-03-02" and "n" not in got
    assert normalised(spark, []) == {}


def test_any_year_and_any_number_of_tails(spark):
    zone = ZoneInfo("America/Chicago")
    years = [1201, 1799, 1800, 1801, 1850, 1883, 1899, 1900, 2099, 2100, 2101, 2250, 2400, 3004, 9998]
    times = [datetime(y, m, d, 1, 30) for y in years for m, d in ((1, 1), (2, 28), (3, 10), (7, 1), (11, 6), (12, 31))]
    # zoneinfo's own rule for far years; local mean time has seconds
    want = {f"y{k}": t.replace(tzinfo=zone).astimezone(timezone.utc).strftime("%m-%dT%H:%M:%SZ") for k, t in enumerate(times)}
    rows = [("phmsa", f"y{k}", f"{t:%m-%d %H:%M:%S}", "TX") for k, t in enumerate(times)]
    rows = [(a, no, f"{t.year:04d}-{v}", c) for (a, no, v, c), t in zip(rows, times)]
    rows += [("phmsa", f"t{k}", f"2024-07-01 12:00:00 Area{k}/Place{k}", None) for k in range(1200)] + [("phmsa", "z", "2024-07-01 12:00:00 Europe/Berlin", None)]
    got = normalised(spark, rows)
    assert got["z"] == "2024-07-01T10:00:00Z" and not any(k.startswith("t") for k in got)
    assert {k: v.split("-", 1)[1] for k, v in got.items() if k != "z"} == want


def test_local_times_by_brute_force(spark):
    rng = random.Random(5)
    zone, rows, want = ZoneInfo("America/St_Johns"), [], {}
    for k in range(300):
        day = rng.choice([datetime(2021, 3, 14), datetime(2021, 11, 7), datetime(2021, 6, 1)])
        t = day + timedelta(minutes=rng.randrange(240))
        rows.append(("cer", str(k), t.strftime("%Y-%m-%d %H:%M:%S"), "newfoundland"))
        # fold 0 is the earlier of two instants and the offset before a jump
        want[str(k)] = t.replace(tzinfo=zone, fold=0).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    assert normalised(spark, rows) == want


@pytest.mark.parametrize("header", ['a,"b,c', "a,b\rc,d", 'a,"b"x,c'])
def test_an_unreadable_header_is_no_field(header):
    import pandas as pd

    from hazardloom.operators import schema_drift

    pdf = pd.DataFrame({"file_id": [1, 2], "file_format": "csv", "header": [header, "a,b"], "line_text": ["1,2,3", "1,2"]})
    with pytest.warns(UserWarning, match="files .1.: their header"):
        cells = schema_drift.batch_cells(pdf)
    assert cells.shown == [] and sorted(cells.path) == ["a", "b"] and set(cells.row) == {1}
