"""The text pipeline: golden narratives and edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from hazardloom.functions import pipeline as P
from hazardloom.functions.negation import suppress

SCENARIOS = {
    "LSR04": "Crew worked on live electrical panel without energy isolation. Lock-out tag-out not applied.",
    "LSR09": "Worker fell from incomplete scaffold platform. No harness worn while working at height.",
    "LSR07": "Dropped object near miss during crane lift. Rigging damaged, sling snapped with suspended load.",
    "LSR03": "Driver speeding on convoy journey, no seat belt worn. Near collision with vehicle at gate.",
    "LSR02": "Confined space entry into storage tank without gas test. Attendant missing and toxic atmosphere.",
    "LSR06": "Worker standing under load in the line of fire when hydraulic pressure hose whipped.",
    "LSR05": "Hot work welding near hydrocarbon line without permit. Fire watch missing.",
    "LSR01": "Electrician bypassed safety interlock on rotating equipment and defeated guard with jumper.",
    "LSR08": "Work carried out without permit to work. PTW expired and JSA not done before entry.",
}
QUIET = ["No worker exposed", "No lift was performed", "No energy release occurred", "Isolation was verified before work", "PTW was valid and confirmed", "Forklift moving pipe bundles at night.", "", None]
HOUSEKEEPING = "Routine housekeeping completed in warehouse. Swept floor, organized cardboard boxes, and replenished printer paper in the site office. No high-energy operations underway."


def run(spark, texts, *columns):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return P.with_signals(df.withColumn("p", P.preprocessed(F.col("t"))), "p.processed").select("k", "p", *columns).orderBy("k").collect()


def test_rules_and_quiet_narratives(spark):
    p = F.col("p.processed")
    rows = run(spark, [*SCENARIOS.values(), *QUIET, HOUSEKEEPING], P.rule_tags(p).alias("tags"), P.guard(p, F.col("p.script"), F.lit(0.9)).alias("status"))
    for rule, row in zip(SCENARIOS, rows):
        found = {t["rule_id"]: t["confidence"] for t in row["tags"]}
        assert found.get(rule, 0) >= 0.5, (rule, found)
        order = [(-t["confidence"], t["rule_id"]) for t in row["tags"]]
        assert order == sorted(order)
    quiet = rows[len(SCENARIOS) :]
    assert [r["tags"] for r in quiet] == [[]] * len(quiet)
    assert [r["status"] for r in quiet[: len(QUIET)]] == ["NO_ASSERTED_SAFETY_SIGNAL"] * len(QUIET)


def test_guards_in_order(spark):
    texts = ["यह एक परीक्षण है।", "Mail a.b@example.org about the hose.", "The hose burst."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("p", P.preprocessed(F.col("t")))
    seen = df.select("k", P.guard(F.col("p.processed"), F.col("p.script"), F.lit(0.9)).alias("a"), P.guard(F.col("t"), F.col("p.script"), F.lit(0.9)).alias("b"), P.guard(F.col("p.processed"), F.col("p.script"), F.lit(None)).alias("c"), "p").orderBy("k").collect()
    assert [r["a"] for r in seen] == ["LANGUAGE_UNSUPPORTED", "UNCALIBRATED_FALLBACK", "UNCALIBRATED_FALLBACK"]
    assert seen[1]["b"] == "PII_REDACTION_REQUIRED" and seen[2]["c"] == "NO_MODEL_LOADED"
    assert seen[0]["p"]["script"] == "devanagari" and seen[0]["p"]["method"] == "unsupported_language" and seen[1]["p"]["redacted"] == "Mail [EMAIL] about the hose." and seen[1]["p"]["n_personal"] == 1


def test_negation_goldens():
    assert suppress("No worker was exposed to H2S during the inspection.")[0] == ""
    text, gone, _ = suppress("The lift was not performed, but workers were near a live electrical panel.")
    assert "live electrical panel" in text and gone == ["The lift was not performed"]
    kept = "No gas test was performed before confined space entry."
    assert suppress(kept)[0] == kept


def test_features_and_phrases(spark):
    text = "Crane CRANE near the wellhead; guard removed, valve not isolated. Pressure rose, pressure held."
    f = run(spark, [text], P.features(F.col("p.processed")).alias("f"), P.phrases(P.features(F.col("p.processed"))["spans"]).alias("x"))[0]
    assert f["f"]["energy_types"] == ["pressure", "mechanical"] and f["f"]["barrier_failures"] == ["not isolated", "guard removed"]
    assert [s.lower() for s in f["f"]["spans"]] == ["pressure", "wellhead", "crane", "not isolated", "guard removed"] and f["f"]["spans"][2] == "Crane"
    assert [(x["phrase"], x["weight"]) for x in f["x"]][0] == ("not isolated", 0.92) and len(f["x"]) == 5


def test_precursors(spark):
    texts = ["Technician dismantled the pressurized line at the wellhead without confirming isolation.", "They opened the line. It was quiet.", "Nothing to tell.", "", None]
    equipment = F.when(F.col("k") == 1, "rig floor hoist").when(F.col("k") == 2, "General")
    rows = [r["x"] for r in run(spark, texts, P.precursor(F.col("p.processed"), equipment).alias("x"))]
    a = rows[0]
    assert (a["activity"], a["location"], a["barrier_failure"], a["hazard_exposure"], a["rule_id"], a["confidence"]) == ("Line dismantling / piping break", "wellhead", "Isolation not verified", "Stored / pressurized energy", "LSR04", 0.92)
    assert a["evidence"] == "without confirming isolation" and a["barrier_confidence"] == 0.98
    assert rows[1]["activity_confidence"] == 0.86 and rows[1]["location"] == "rig floor" and rows[1]["confidence"] == 0.85
    assert rows[2]["location"] is None and rows[2]["confidence"] == 0.4 and rows[2]["evidence"] == "Nothing to tell."
    assert rows[3]["confidence"] == 0.0 and rows[4]["confidence"] == 0.0 and rows[4]["activity"] is None


def test_catalogue_as_parameter(spark, tmp_path):
    rules = [{"id": f"R{k}", "name": f"rule {k}", "keywords": [f"word{k}"], "phrases": [f"two words{k}"], "energies": ["pressure"]} for k in range(9)]
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rules))
    catalogue = P.load_catalogue(str(path))
    tags = run(spark, ["two words3 under pressure"], P.rule_tags(F.col("p.processed"), catalogue).alias("t"))[0]["t"]
    assert [(t["rule_id"], t["source"], t["confidence"]) for t in tags] == [("R3", "rule", 0.77)]
    for bad in (rules[:8], [*rules[:8], rules[0]], [*rules[:8], {"id": "R8", "name": "rule 8"}]):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            P.load_catalogue(str(path))


def test_each_pattern_is_written_once(spark):
    """The optimizer copies what is read from inside a struct; no pattern of features or concepts may multiply that way."""
    import __spark_entry__

    df = __spark_entry__.queries()["t01_text_pipeline"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 70
