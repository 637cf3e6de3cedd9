"""Readers, header aliases, components and the set join."""

import json
import random

from hazardloom.operators.components import components
from hazardloom.operators.set_join import jaccard_pairs
from hazardloom.sources import readers
from hazardloom.storage import Workspace


def test_csv_delimiters_and_json_wrappings(spark, tmp_path):
    for k, sep in enumerate(",;|\t"):
        p = tmp_path / f"{k}.csv"
        p.write_text(sep.join(["a", "b"]) + "\n" + sep.join(["1", f'"x{sep}y ""z""\nw"']) + "\n")
        assert [tuple(r) for r in readers.read_csv(spark, str(p)).collect()] == [("1", f'x{sep}y "z"\nw')]
    rows = [{"a": 1}, {"a": 2}]
    for k, doc in enumerate((rows, {"records": rows}, {"data": rows}, {"case_studies": rows})):
        p = tmp_path / f"{k}.json"
        p.write_text(json.dumps(doc))
        assert sorted(r["a"] for r in readers.read_json(spark, str(p)).collect()) == [1, 2]


def test_header_aliases(spark):
    df = spark.createDataFrame([(" ", "the narrative of it", "x1", "Plant A")], "raw_text string, Description string, `Incident ID` string, Facility string")
    r = readers.with_header_aliases(df).first()
    assert (r["raw_text"], r["source_report_id"], r["site_name"], r["department"]) == ("the narrative of it", "x1", "Plant A", None)
    other = readers.with_header_aliases(spark.createDataFrame([("7", "one two three four")], "n string, remark string")).first()
    assert other["raw_text"] == "one two three four"


def test_upload_issues(spark):
    rows = spark.createDataFrame([(1, "a", "long enough text", "s", "2024"), (2, "a", "short", None, "n/a"), (3, "b", None, "s", "2024")], "row_no int, source_report_id string, raw_text string, site_name string, reported_at string")
    known = spark.createDataFrame([("b",)], "source_report_id string")
    got = {r["row_no"]: r["issues"] for r in readers.upload_issues(rows, known).collect()}
    assert got == {1: [], 2: ["short_text", "missing_site", "missing_date", "duplicate_id"], 3: ["missing_text", "duplicate_id"]}


def test_components_by_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}
    df = spark.createDataFrame(links, "u long, v long")
    assert {r["id"]: r["root"] for r in components(df, Workspace(spark, "t")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long"), Workspace(spark, "t")).count() == 0


def test_set_join_by_brute_force(spark):
    rng = random.Random(2)
    sets = [(k, sorted({rng.randrange(14) for _ in range(rng.randrange(1, 12))})) for k in range(90)]
    rows = [(k, [str(x) for x in s]) for k, s in sets]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) >= 0.7 * len(set(x) | set(y)) - 1e-12}
    got = {(r["a"], r["b"]) for r in jaccard_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), 0.7, Workspace(spark, "t")).collect()}
    assert got == want


def test_join_hot_splits_and_keeps_rows(spark, monkeypatch):
    from hazardloom.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    big = spark.createDataFrame([("a", i) for i in range(95)] + [("b", 200), ("c", 300)], "k string, v int")
    small = spark.createDataFrame([("a", "A", 95), ("b", "B", 1)], "k string, x string, n long")
    for stored in (False, True):
        got = sorted((r["k"], r["v"], r["x"]) for r in skew.join_hot(big, small, "k", "n", parts=20, stored=stored).collect())
        assert got == [("a", i, "A") for i in range(95)] + [("b", 200, "B")]
        assert skew.join_hot(big, small, "k", "n", "left", parts=20, stored=stored).count() == 97


def test_batch_ingestion(spark, tmp_path):
    import pytest

    from hazardloom.sources import batch

    (tmp_path / "p.csv").write_text("REPORT_NUMBER;LOCAL_DATETIME;NARRATIVE;NUM_FATALITIES;IGNITE_IND\n1;2024-02-03 10:00:00;a long narrative;1;YES\n;2024-02-03;no number here;0;NO\n2;13/45/2024;short;n/a;no\n")
    (tmp_path / "o.json").write_text(json.dumps({"reports": [{"Incident No": "7", "Installation / Unit": "CDU 2", "SIF Potential": "No", "Fatalities": 0}]}))
    good, bad = batch.ingest(spark, "phmsa", str(tmp_path / "p.csv"))
    rows = {r["report_id"]: r for r in good.collect()}
    assert set(rows) == {"PHMSA-1", "PHMSA-2"} and bad.count() == 1
    assert rows["PHMSA-1"]["incident_date"] == "2024-02-03" and rows["PHMSA-1"]["sif_potential"] is True and rows["PHMSA-1"]["consequence"] == "Fire, Loss of Containment"
    assert rows["PHMSA-2"]["incident_date"] is None and rows["PHMSA-2"]["sif_potential"] is None and rows["PHMSA-2"]["description"].startswith("PHMSA reported")
    report = batch.run(spark, {"phmsa": str(tmp_path / "p.csv"), "oisd": str(tmp_path / "o.json")}, str(tmp_path / "out"))
    assert {r["source"]: r["n"] for r in report.collect()} == {"PHMSA": 2, "OISD": 1}
    with pytest.raises(ValueError):
        batch.ingest(spark, "other", "x.csv")
    with pytest.raises(ValueError):
        batch.check_upload(spark, str(tmp_path / "p.csv"), max_bytes=10)
    batch.check_upload(spark, str(tmp_path / "p.csv"))


def _split_table(spark, path, rows):
    spark.createDataFrame(rows, "id string, group_id string, raw_text string, norm_text string, text_hash string, label boolean").write.parquet(f"{path}/incident_records.parquet")
    return str(path)


def test_leak_free_split_keeps_ties_together(spark, tmp_path):
    from hazardloom.plans import ingestion

    words = lambda k, n=8: [f"w{k}x{i}" for i in range(n)]
    rows = []
    for k in range(40):
        base, y = " ".join(words(k, 14)), k % 2 == 0
        rows += [(f"a{k:02}", f"Grp-{k}", base, base, f"AB{k:02}", y), (f"b{k:02}", f" grp-{k} ", f"other {k}", f"other {k}", None, y)]
        rows += [(f"c{k:02}", "N/A", f"third {k}", f"third {k}", f" ab{k:02}", False), (f"d{k:02}", None, base + " more", base + " more", None, False)]
    rows += [("e1", None, "", "", "", True), ("e2", "", "", "", None, False)]
    d = _split_table(spark, tmp_path / "t", rows)
    got = {r["id"]: r for r in ingestion.QUERIES["t15_leak_free_split"](spark, d).collect()}
    assert set(got) == {r[0] for r in rows}
    for k in range(40):
        tied = [got[f"{c}{k:02}"] for c in "abcd"]
        assert len({r["split"] for r in tied}) == 1 and {r["group_root"] for r in tied} == {f"a{k:02}"} and {r["positive"] for r in tied} == {int(k % 2 == 0)}
    assert got["e1"]["group_root"] == "e1" and got["e2"]["group_root"] == "e2"
    for y in (0, 1):
        groups = {r["group_root"]: r["split"] for r in got.values() if r["positive"] == y}
        assert sorted(list(groups.values()).count(s) for s in ("train", "validation", "test")) == [3, 3, 15]
    assert {r["status"] for r in got.values()} == {"VALIDATED"}
    assert ingestion.QUERIES["u05_split_leaks"](spark, d).count() == 0

    space = Workspace(spark, "t")
    x = space.cut(ingestion._tied_records(spark, d), "x")
    near = ingestion._near_links(x, space)
    for one, other in (("a00", "b00"), ("a01", "c01"), ("a02", "d02")):  # group id, hash, near pair
        ids = [(r[0], "test" if r[0] == one else "train") for r in rows if r[0] in (one, other)]
        assert ingestion._leaks(x, near, spark.createDataFrame(ids, "id string, split string")).count() == 2


def test_small_tables_are_not_split(spark, tmp_path):
    from hazardloom.plans import ingestion

    d = _split_table(spark, tmp_path / "t", [(f"i{k}", None, f"text {k}", f"text {k}", None, k < 3) for k in range(30)])
    got = ingestion.QUERIES["t15_leak_free_split"](spark, d).collect()
    assert len(got) == 30 and {(r["split"], r["status"]) for r in got} == {("train", "INSUFFICIENT_VALIDATION_DATA")}


def test_osha_rules(spark):
    from hazardloom.sources import adapters

    base = {"ID": "1", "NAICS": "213112", "Employer": "Acme", "City": "X", "State": "TX", "EventTitle": "Caught in machinery", "SourceTitle": "winch", "NatureTitle": "Burns", "PartTitle": "Hand", "Hospitalized": "1", "Amputation": "1", "Final Narrative": "A high voltage line was touched."}
    short = base | {"ID": "2", "NAICS": "999", "Employer": "Rig Crew", "EventTitle": "", "Hospitalized": "0", "Final Narrative": "short", "NatureTitle": None}
    none = base | {"ID": "3", "Hospitalized": "0", "Amputation": "0"}
    got = {r["report_id"]: r for r in adapters.osha(spark.createDataFrame([(x,) for x in (base, short, none)], "fields map<string,string>")).collect()}
    a, b, c = (got[f"OSHA-{k}"] for k in "123")
    assert (a["sector"], a["injury_severity"], a["consequence"], a["lsr"], a["energy"]) == ("Upstream - Drilling and Well Services", "HOSPITALIZED", "Burns", "Line of Fire", "Electrical Energy")
    assert a["barrier_failure"] == "Deficiency in barrier during Caught in machinery" and a["activity"] == "Caught in machinery involving winch" and json.loads(a["metadata"])["part_of_body"] == "Hand"
    assert (b["sector"], b["injury_severity"], b["consequence"], b["barrier_failure"], b["lsr"]) == ("Oil and Gas Operations", "AMPUTATION", "Severe Occupational Injury", None, None)
    assert b["description"] == "OSHA severe injury reported at Rig Crew. Event: winch." and (c["injury_severity"], c["sif_potential"]) == (None, None)
