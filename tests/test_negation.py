"""Negated hazards are taken out of a text; missing controls and other clauses stay."""

import pytest

from hazardloom.functions.negation import suppressed
from hazardloom.plans import registry

CASES = [
    ("Housekeeping done. No worker was exposed to H2S, area was clean.", "Housekeeping done. area was clean.", ["No worker was exposed to H2S"], "regex_fallback"),
    ("No leak was found but the crane struck the rack", "the crane struck the rack", ["No leak was found"], "regex_fallback"),
    ("There was no permit and the worker entered the tank.", "There was no permit and the worker entered the tank.", [], "regex_fallback"),
    ("Welding went on with no fire watch.", "Welding went on with no fire watch.", [], "regex_fallback"),
    ("Worker without a harness at risk of falling", "Worker without a harness at risk of falling", [], "regex_fallback"),
    ("Nothing was released; HOWEVER nobody, not even the lead, had a fire", "Nothing was released; nobody, not even the lead, had a fire", [], "regex_fallback"),
    ("Not seen by anyone of the whole crew on the long day shift was the leak", "Not seen by anyone of the whole crew on the long day shift was the leak", [], "regex_fallback"),
    ("The pump leaked.", "The pump leaked.", [], "none"), ("Valve not isolated.", "Valve not isolated.", [], "none"), ("", "", [], "none"), (None, None, [], "none"),
]


def test_suppression(spark):
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, t string").select("k", suppressed("t").alias("s")).select("k", "s.*").collect()
    assert [(r["text"], r["negated_phrases"], r["method"]) for r in sorted(rows, key=lambda r: r["k"])] == [c[1:] for c in CASES]


def test_query_gives_every_report(spark):
    d = "/root/testdata/sf0.001"
    got = registry.queries()["x12_suppressed_text"](spark, d)
    assert got.columns == ["id", "text", "negated_phrases", "method"]
    assert got.count() == registry.queries()["x01_clean_text"](spark, d).count()
