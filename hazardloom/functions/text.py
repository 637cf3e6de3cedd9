"""Text functions as column expressions: everything here stays inside generated JVM code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardloom.functions import fixed_values as V

MISSING = ("", "null", "none", "nan", "unknown", "n/a")  # fixed values
#: Misspelt words and what they stand for.
SPELLING = {"sefty": "safety", "saftey": "safety", "harnes": "harness", "scaffld": "scaffold", "scafolding": "scaffolding", "isolaton": "isolation", "electrial": "electrical", "presure": "pressure", "leakeage": "leakage", "permitt": "permit"}
#: Abbreviations of the trade.
ABBREVIATIONS = {
    "PTW": "Permit to Work", "LOTO": "Lock-Out Tag-Out", "H2S": "Hydrogen Sulfide", "PPE": "Personal Protective Equipment", "JSA": "Job Safety Analysis", "TBT": "Toolbox Talk", "SIMOPS": "Simultaneous Operations",
    "BOP": "Blowout Preventer", "ESD": "Emergency Shutdown", "SCBA": "Self-Contained Breathing Apparatus", "CSE": "Confined Space Entry", "WAH": "Working at Height", "MEWP": "Mobile Elevating Work Platform",
    "NDT": "Non-Destructive Testing", "MOC": "Management of Change", "SWL": "Safe Working Load", "WHP": "Wellhead Pressure", "ESP": "Electrical Submersible Pump", "HSSE": "Health Safety Security Environment", "RCA": "Root Cause Analysis",
}
#: Rule catalogue: keywords of the nine life-saving rules.
RULES = {
    "LSR01": ("Bypassing Safety Controls", "bypass|interlock|defeated|override|muted|inhibited"), "LSR02": ("Confined Space", "confined space|vessel entry|oxygen deficiency|gas test|sump pit|tank entry"),
    "LSR03": ("Driving", "vehicle|truck|driver|seat belt|collision|journey"), "LSR04": ("Energy Isolation", "isolation|isolated|stored energy|zero energy|lock-out|trapped pressure|residual pressure"),
    "LSR05": ("Hot Work", "hot work|welding|grinding|flammable|ignition|hot surface"), "LSR06": ("Line of Fire", "line of fire|under the load|struck by|pinch point|moving machinery|hose"),
    "LSR07": ("Safe Mechanical Lifting", "crane|sling|lift plan|suspended load|rigger|load cell"), "LSR08": ("Work Authorization", "permit|toolbox talk|authori[sz]ation|checklist|signed the sheet"),
    "LSR09": ("Working at Height", "at height|harness|scaffold|ladder|fall from|open grating"),
}


def bounded(words: str) -> str:
    return f"(^|[^a-z0-9])({words})($|[^a-z0-9])"


def clean_text(c: Column) -> Column:
    """Trimmed, with line breaks, tabs and runs of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\r\n\t]+", " "), r"\s{2,}", " "))


def optional(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin(*MISSING), None).otherwise(F.trim(c))


def normalise(c: Column) -> Column:
    """Lower case, marks as spaces, one space between words; letters of all scripts stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def text_hash(norm: Column) -> Column:
    return F.when(norm == "", "").otherwise(F.substring(F.sha2(norm, 256), 1, 16))


def tokens(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, " "), lambda x: x != ""))


def expand_abbreviations(c: Column) -> Column:
    """Longest first, whatever the case, bounded by what isn't a letter or digit."""
    for key in sorted(ABBREVIATIONS, key=lambda k: (-len(k), k)):
        c = F.regexp_replace(c, f"(?i)(?<![A-Za-z0-9]){key}(?![A-Za-z0-9])", ABBREVIATIONS[key])
    return c


def correct_spelling(c: Column) -> Column:
    """Each misspelling in upper case, capitalised and otherwise, keeping that case."""
    for wrong, right in SPELLING.items():
        for a, b in ((wrong.upper(), right.upper()), (wrong.capitalize(), right.capitalize()), (f"(?i){wrong}", right)):
            c = F.regexp_replace(c, rf"(?<![\p{{L}}\p{{N}}_]){a}(?![\p{{L}}\p{{N}}_])", b)
    return c


def hits(c: Column, words: str) -> Column:
    """Whether a bounded word occurs. The pattern only runs where the plain word is contained, which a scan finds fast."""
    low, found = F.lower(c), None
    for w in words.split("|"):
        one = low.rlike(bounded(w)) if re.search(r"[^a-z0-9 \-]", w) else low.contains(w) & low.rlike(bounded(w))
        found = one if found is None else found | one
    return found


def named(c: Column, *patterns: str) -> Column:
    """Whether one of the patterns matches, whatever the case: one alternation a list."""
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def energy_types(c: Column) -> Column:
    return F.filter(F.array(*(F.when(named(c, *p), F.lit(k)) for k, p in V.ENERGY_PATTERNS.items())), lambda x: x.isNotNull())


def weak_votes(c: Column) -> dict[str, Column]:
    """Seven labelling functions: 1 serious, -1 routine, 0 no opinion."""
    energy = [p for patterns in V.ENERGY_PATTERNS.values() for p in patterns]
    high = [p for k in V.HIGH_ENERGY for p in V.ENERGY_PATTERNS[k]]
    failed = named(c, *V.BARRIER_FAILURE_PATTERNS)
    vote = lambda cond, v=1: F.when(cond, v).otherwise(0)
    return {
        "lf_high_energy": vote(named(c, *high)), "lf_proximity_to_energy": vote(named(c, *energy) & named(c, *V.PROXIMITY_PATTERNS)), "lf_barrier_failure_with_energy": vote(named(c, *energy) & failed),
        "lf_height_or_dropped_object": vote(named(c, V.HEIGHT)), "lf_confined_or_h2s": vote(named(c, V.CONFINED)), "lf_lifting_line_of_fire": vote(named(c, V.LIFTING)),
        "lf_routine_low_energy": vote(named(c, V.ROUTINE_NOISE) & ~named(c, *energy) & ~failed, -1),
    }


def vote_label(votes: list[Column]) -> tuple[Column, Column, Column]:
    """(positive votes, label, confidence)."""
    pos = reduce(lambda a, b: a + b, (F.when(v == 1, 1).otherwise(0) for v in votes))
    neg = reduce(lambda a, b: a + b, (F.when(v == -1, 1).otherwise(0) for v in votes))
    label = F.when(pos > neg, 1).when(neg > pos, -1).otherwise(0)
    sure = F.when((pos == 0) & (neg == 0), 0.35).when(pos > neg, F.least(F.lit(0.95), 0.5 + 0.1 * pos)).when(neg > pos, F.least(F.lit(0.9), 0.55 + 0.1 * neg)).otherwise(0.5)
    return pos, label, sure


def rule_tags(c: Column) -> Column:
    """Array of (rule_id, hits, confidence) of the rules with at least one keyword: .62 + .07 a hit, .22 more at most."""
    def one(rule: str, words: str) -> Column:
        n = reduce(lambda a, b: a + b, (F.when(hits(c, w), 1).otherwise(0) for w in words.split("|")))
        return F.when(n > 0, F.struct(F.lit(rule).alias("rule_id"), n.alias("hits"), F.round(0.62 + F.least(F.lit(0.22), 0.07 * n), 4).alias("confidence")))

    return F.filter(F.array(*(one(r, w) for r, (_, w) in RULES.items())), lambda x: x.isNotNull())


def script_counts(c: Column) -> dict[str, Column]:
    return {"devanagari": F.regexp_count(c, F.lit("[ऀ-ॿ]")), "bengali": F.regexp_count(c, F.lit("[ঀ-৿]")), "latin": F.regexp_count(c, F.lit("[A-Za-z]"))}


def initial_sentences(c: Column) -> Column:
    """Plain split after sentence marks and at line breaks, without blanks."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\n"), r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
