"""The text pipeline as column expressions: preprocessing, features, guards, rule tags and precursors.

Everything but the suppression of negated hazards (``negation``) stays in generated JVM code. A null narrative gives
null texts, empty arrays, no tags and the status of an empty text.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions import fixed_values as V
from hazardloom.functions import text as X
from hazardloom.functions.negation import suppressed

_OR = lambda a, b: a | b
_ADD = lambda a, b: a + b


def matches(c: Column, *patterns: str) -> Column:
    return F.coalesce(c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def _head(pattern: str) -> str:
    """The plain words that every match of a pattern begins with, in lower case."""
    m = re.match(r"\\b([A-Za-z0-9 -]+)(?=([?*+{|]?))", pattern)
    plain_alternation = "|" in re.sub(r"\([^()]*\)", "", pattern)
    return "" if m is None or plain_alternation else (m[1][:-1] if m[2] else m[1]).lower()


def found(c: Column, pattern: str) -> Column:
    """All matches of one pattern, as they stand in the text. It only runs where its first words are contained, which a scan finds fast."""
    all_ = F.coalesce(F.regexp_extract_all(c, F.lit(f"(?i){pattern}"), F.lit(0)), F.array().cast("array<string>"))
    return F.when(F.lower(c).contains(_head(pattern)), all_).otherwise(F.array().cast("array<string>"))


def found_all(c: Column, patterns: list[str]) -> Column:
    return F.concat(*(found(c, p) for p in patterns))


def distinct_spans(spans: Column) -> Column:
    """Each span once, whatever its case, as first seen."""
    low = F.transform(spans, F.lower)
    return F.filter(spans, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def features(c: Column) -> Column:
    """Struct (energy_types, proximity_hits, barrier_failures, spans)."""
    by_type = {k: found_all(c, p) for k, p in V.ENERGY_PATTERNS.items()}
    types = F.filter(F.array(*(F.when(F.size(x) > 0, F.lit(k)) for k, x in by_type.items())), lambda x: x.isNotNull())
    near, failed = found_all(c, V.PROXIMITY_PATTERNS), found_all(c, V.BARRIER_FAILURE_PATTERNS)
    spans = distinct_spans(F.concat(*by_type.values(), near, failed))
    return F.struct(types.alias("energy_types"), near.alias("proximity_hits"), failed.alias("barrier_failures"), spans.alias("spans"))


def phrases(spans: Column) -> Column:
    """The weightiest spans of a narrative, (phrase, weight), in the order of the text within a weight."""
    critical = lambda x: reduce(_OR, (F.lower(x).contains(k) for k in V.CRITICAL_PHRASES))
    heavy, light = F.filter(spans, critical), F.filter(spans, lambda x: ~critical(x))
    weighed = lambda a, w: F.transform(a, lambda x: F.struct(x.alias("phrase"), F.lit(w).alias("weight")))
    return F.slice(F.concat(weighed(heavy, V.CRITICAL_WEIGHT), weighed(light, V.PHRASE_WEIGHT)), 1, V.MOST_PHRASES)


def redacted(c: Column) -> tuple[Column, Column]:
    """(text with the plain patterns of personal data replaced, number of replacements). Names are the business of the llm operator."""
    n = F.lit(0)
    for pattern, token in V.PERSONAL_PATTERNS:
        n = n + F.regexp_count(c, F.lit(f"(?i){pattern}"))
        c = F.regexp_replace(c, f"(?i){pattern}", token)
    return c, F.coalesce(n, F.lit(0))


def unsupported_script(c: Column) -> Column:
    """``devanagari`` or ``bengali`` where such signs outnumber Latin letters, else null."""
    n = X.script_counts(c)
    return F.when(n["devanagari"] + n["bengali"] > n["latin"], F.when(n["devanagari"] >= n["bengali"], "devanagari").otherwise("bengali"))


def preprocessed(c: Column) -> Column:
    """Struct (redacted, processed, n_personal, script, negated, method): redact, spell, expand, suppress; a script that isn't supported ends it after the first."""
    plain, n = redacted(c)
    return _preprocessed(plain, n, unsupported_script(c))


def with_preprocessed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the struct ``p`` of ``preprocessed``. Each step is a column of its own: inside one struct the
    optimizer would write every step again wherever a field of it is read."""
    c = F.col(text)
    df = df.withColumns({"__c": c, "__n": F.lit(0), "__script": unsupported_script(c)})
    for pattern, token in V.PERSONAL_PATTERNS:
        df = df.withColumns({"__n": F.col("__n") + F.regexp_count("__c", F.lit(f"(?i){pattern}")), "__c": F.regexp_replace("__c", f"(?i){pattern}", token)})
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    holds = lambda c, words: reduce(_OR, (low(c).contains(w.lower()) for w in words))
    read = F.col("__script").isNull()
    df = df.withColumn("__spelt", F.when(read, F.when(holds(F.col("__c"), X.SPELLING), X.correct_spelling(F.col("__c"))).otherwise(F.col("__c"))))
    df = df.withColumn("__spelt", F.when(holds(F.col("__spelt"), X.ABBREVIATIONS), X.expand_abbreviations(F.col("__spelt"))).otherwise(F.col("__spelt")))
    df = df.withColumn("__clean", suppressed(F.col("__spelt")))
    fields = _preprocessed(F.col("__c"), F.coalesce("__n", F.lit(0)), F.col("__script"), F.col("__clean"), parts=True)
    df = df.withColumns({f"__{k}": v for k, v in fields.items()})
    return df.withColumn("p", F.struct(*(F.col(f"__{k}").alias(k) for k in fields))).drop("__c", "__n", "__spelt", "__clean", *(f"__{k}" for k in fields))


def _preprocessed(plain: Column, n: Column, script: Column, clean: Column | None = None, parts: bool = False) -> Column | dict[str, Column]:
    clean = clean if clean is not None else suppressed(F.when(script.isNull(), X.expand_abbreviations(X.correct_spelling(plain))))
    no_phrases = F.array().cast("array<string>")
    fields = {
        "redacted": plain, "processed": F.when(script.isNull(), clean["text"]).otherwise(plain), "n_personal": n.cast("long"), "script": script,
        "negated": F.when(script.isNull(), F.coalesce(clean["negated_phrases"], no_phrases)).otherwise(no_phrases), "method": F.when(script.isNull(), clean["method"]).otherwise("unsupported_language"),
    }
    return fields if parts else F.struct(*(v.alias(k) for k, v in fields.items()))


def guard(processed: Column, script: Column, probability: Column) -> Column:
    """What stands before a prediction, in order; null probabilities are a model that isn't loaded."""
    personal = matches(processed, *(p for p, _ in V.PERSONAL_PATTERNS))
    nothing = (F.trim(F.coalesce(processed, F.lit(""))) == "") | matches(processed, V.CONFIRMED_CONTROL) | matches(processed, V.SPARSE_MATERIAL)
    return (
        F.when(script.isNotNull(), "LANGUAGE_UNSUPPORTED").when(personal, "PII_REDACTION_REQUIRED").when(probability.isNull(), "NO_MODEL_LOADED")
        .when(nothing, "NO_ASSERTED_SAFETY_SIGNAL").otherwise("UNCALIBRATED_FALLBACK")
    )


def concept_pattern(concept: str) -> str:
    """A concept with its inflections where it ends in a stem."""
    return rf"\b{concept}" + (r"\w*\b" if concept[-1] in "setdr" and " " not in concept else r"\b")


def concept_sentences(c: Column) -> Column:
    """Sentences of more than five signs, the whole text where there are none."""
    low = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    parts = F.filter(F.transform(F.split(low, r"[.!?;\n]+"), F.trim), lambda x: F.length(x) > 5)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(low))


def concept_score(sentences: Column, rule: str) -> Column:
    """Best score of a rule's concepts over sentences: two groups at least, all three where there are three, else 0."""
    profile = V.CONCEPT_PROFILES[rule]

    # the hits of each group are made once a sentence; a pattern only runs where its plain words are contained
    named = lambda s, w: F.when(s.contains(w) & s.rlike(concept_pattern(w)), 1).otherwise(0)
    counts = F.transform(sentences, lambda s: F.array(*(reduce(_ADD, (named(s, w) for w in group)) for group in profile)))

    def one(n: Column) -> Column:
        groups = [F.get(n, F.lit(k)) for k in range(len(profile))]
        covered = reduce(_ADD, (F.when(g > 0, 1).otherwise(0) for g in groups))
        score = 0.54 + 0.12 * (covered / F.lit(len(profile))) + F.least(F.lit(0.12), 0.02 * reduce(_ADD, groups))
        return F.when(covered >= (3 if len(profile) == 3 else 2), F.round(score, 3)).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(counts, one)), F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """One rule of a catalogue: what names it and which signals of a narrative support it."""

    id: str
    name: str
    phrases: tuple[str, ...]
    keywords: tuple[str, ...]
    energies: tuple[str, ...] = ()
    barriers: tuple[str, ...] = ()
    exposures: tuple[str, ...] = ()


_SIGNALS = {
    "LSR01": (("electrical", "pressure", "mechanical"), ("bypass", "interlock defeated", "guard removed"), ()), "LSR02": (("chemical",), ("no gas test", "missing attendant"), ()),
    "LSR03": (("kinetic",), (), ("path of travel",)), "LSR04": (("electrical", "pressure"), ("not isolated", "lock-out tag-out not", "loto not"), ()), "LSR05": (("thermal", "chemical"), ("no gas test", "missing fire watch"), ()),
    "LSR06": (("kinetic", "pressure", "gravity"), (), ("line of fire", "under the load", "standing under", "within the drop zone")), "LSR07": (("mechanical", "gravity"), ("missing tag line",), ("under the load", "no exclusion zone")),
    "LSR08": ((), ("no permit", "without permit", "permit expired", "without authorization"), ()), "LSR09": (("gravity",), ("missing harness",), ()),
}


def own_catalogue() -> list[Rule]:
    """The catalogue of this package: several words are a phrase, one is a keyword."""
    out = []
    for rule, (name, words) in X.RULES.items():
        plain = [w for w in words.replace("[sz]", "z").split("|")]
        out.append(Rule(rule, name, tuple(w for w in plain if " " in w or "-" in w), tuple(w for w in plain if " " not in w and "-" not in w), *_SIGNALS[rule]))
    return out


def load_catalogue(path: str, size: int = 9) -> list[Rule]:
    """A catalogue from a JSON list of objects; exactly ``size`` rules with different ids and names, each with something to match."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)
    rules = [Rule(r["id"], r["name"], *(tuple(r.get(k, ())) for k in ("phrases", "keywords", "energies", "barriers", "exposures"))) for r in rows]
    if len(rules) != size or len({r.id for r in rules}) != size or len({r.name for r in rules}) != size:
        raise ValueError(f"a catalogue has {size} rules with different ids and names")
    if any(not r.phrases and not r.keywords for r in rules):
        raise ValueError("a rule without phrases and keywords")
    return rules


def _touches(found_texts: Column, named: tuple[str, ...]) -> Column:
    """Whether one of the found texts holds, or is held by, one of the named."""
    if not named:
        return F.lit(False)
    return F.exists(found_texts, lambda x: reduce(_OR, (F.lower(x).contains(n.lower()) | F.lit(n.lower()).contains(F.lower(x)) for n in named)))


def _rule_tag(low: Column, f: Column, scores: Column, rule: Rule) -> Column:
    hit = {p: low.contains(p.lower()) for p in rule.phrases}
    count = lambda conditions: reduce(_ADD, (F.when(c, 1).otherwise(0) for c in conditions), F.lit(0))
    n_phrases = count(hit.values())
    words = []
    for w in rule.keywords:
        spoken = [hit[p] for p in rule.phrases if w.lower() in p.lower()]  # a word of a phrase that is there counts with it
        named = low.contains(w.lower()) & low.rlike(rf"\b{re.escape(w.lower())}\b")
        words.append(named & ~reduce(_OR, spoken) if spoken else named)
    n_words = count(words)
    energy = F.arrays_overlap(f["energy_types"], F.array(*map(F.lit, rule.energies))) if rule.energies else F.lit(False)
    barrier, exposure = _touches(f["barrier_failures"], rule.barriers), _touches(f["proximity_hits"], rule.exposures)
    crossed = energy & (barrier | exposure)
    alike = scores[rule.id] if rule.id in V.CONCEPT_PROFILES else F.lit(0.0)
    told = alike >= V.CONCEPT_MATCH
    by_phrase = 0.65 + F.least(F.lit(0.20), 0.06 * n_phrases)
    base = (
        F.when(n_phrases > 0, F.when(told, F.least(F.lit(0.95), by_phrase + 0.10)).otherwise(by_phrase))
        .when(told & (n_words > 0), 0.58 + F.least(F.lit(0.25), (alike - 0.45) * 1.5)).when(told, 0.54 + F.least(F.lit(0.30), (alike - 0.48) * 1.6))
        .when(n_words > 0, F.when((alike < V.CONCEPT_CONFIRMS) & ~crossed, 0.0).otherwise(0.48 + F.least(F.lit(0.16), 0.05 * n_words))).when(crossed, 0.58).otherwise(0.0)
    )
    source = F.when(n_phrases > 0, F.when(told, "hybrid").otherwise("rule")).when(told, F.when(n_words > 0, "hybrid").otherwise("semantic")).when(n_words > 0, "rule").otherwise("model")
    boost = F.when(energy, 0.06).otherwise(0.0) + F.when(barrier, 0.06).otherwise(0.0) + F.when(exposure, 0.05).otherwise(0.0)
    sure = F.when((base > 0) & (source != "semantic"), F.least(F.lit(0.98), base + boost)).otherwise(base)
    return F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.name).alias("rule_name"), F.round(sure, 3).alias("confidence"), source.alias("source"), n_phrases.alias("n_phrases"), n_words.alias("n_keywords"))


def with_signals(df: DataFrame, processed: str) -> DataFrame:
    """``df`` with ``low``, ``f`` (features), ``sentences`` and ``scores`` (of concepts by rule) of a column, made once for all rules."""
    df = df.withColumn("__text", F.col(processed))
    c = F.col("__text")
    by_type = {k: found_all(c, p) for k, p in V.ENERGY_PATTERNS.items()}
    made = {f"__e_{k}": v for k, v in by_type.items()} | {"__near": found_all(c, V.PROXIMITY_PATTERNS), "__failed": found_all(c, V.BARRIER_FAILURE_PATTERNS)}
    df = df.withColumns(made | {"low": F.lower(c), "sentences": concept_sentences(c)})
    types = F.filter(F.array(*(F.when(F.size(f"__e_{k}") > 0, F.lit(k)) for k in by_type)), lambda x: x.isNotNull())
    scores = {f"__s_{r}": concept_score(F.col("sentences"), r) for r in V.CONCEPT_PROFILES}
    df = df.withColumns({"__types": types, "__spans": F.concat(*map(F.col, made))} | scores).withColumn("__spans", distinct_spans(F.col("__spans")))
    f = F.struct(F.col("__types").alias("energy_types"), F.col("__near").alias("proximity_hits"), F.col("__failed").alias("barrier_failures"), F.col("__spans").alias("spans"))
    return df.withColumns({"f": f, "scores": F.struct(*(F.col(k).alias(k[4:]) for k in scores))}).drop("__text", "__types", "__spans", *made, *scores)


def rule_tags(processed: Column, catalogue: list[Rule] | None = None, threshold: float = 0.5) -> Column:
    """Tags of a narrative by falling confidence, then rule, over the columns of ``with_signals``. A control stated to be in place, or a bare movement of material, has none."""
    low, f, scores = F.col("low"), F.col("f"), F.col("scores")
    tags = F.filter(F.array(*(_rule_tag(low, f, scores, r) for r in catalogue or own_catalogue())), lambda t: t["confidence"] >= threshold)
    quiet = (F.size(f["energy_types"]) + F.size(f["proximity_hits"]) + F.size(f["barrier_failures"])) == 0
    none = matches(processed, V.CONFIRMED_CONTROL) | F.coalesce(low.contains("forklift") & low.contains("pipe bundle") & quiet, F.lit(False))
    order = F.array_sort(tags, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).when(a["rule_id"] < b["rule_id"], -1).otherwise(1))
    return F.filter(order, lambda t: ~(none | processed.isNull()))


def _first(c: Column, patterns: list[str]) -> Column:
    """The text of the first pattern that matches, null where none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, f"(?i){p}", 0), F.lit("")) for p in patterns)) if patterns else F.lit(None).cast("string")


def _members(c: Column, taxonomy: list[tuple]) -> Column:
    """Matching members of a taxonomy in its order: (name, rule, clause, method)."""
    out = []
    for name, rule, patterns, alike in taxonomy:
        plain, near = _first(c, patterns), _first(c, alike)
        clause = F.coalesce(plain, near)
        method = F.when(plain.isNotNull(), "rule").otherwise("semantic_pattern")
        out.append(F.when(clause.isNotNull(), F.struct(F.lit(name).alias("name"), F.lit(rule).cast("string").alias("rule"), clause.alias("clause"), method.alias("method"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def location(c: Column, equipment: Column) -> Column:
    """A place that the text or the equipment names, never an invented one."""
    named = F.when(~F.lower(F.trim(equipment)).isin(*V.NO_EQUIPMENT) & (F.trim(equipment) != ""), equipment)
    of = lambda t: F.coalesce(*(F.when(matches(t, *p), F.lit(name)) for name, p in V.LOCATIONS))
    return F.coalesce(of(c), of(named))


def precursor(c: Column, equipment: Column) -> Column:
    """Struct of activity, location, failed barrier and hazard with rule, evidence and confidence: the first member of each taxonomy counts, the others are secondary."""
    return _precursor(c, *(_members(c, t) for t in (V.ACTIVITIES, V.BARRIERS, V.HAZARDS)), location(c, equipment))


def with_precursor(df: DataFrame, text: str, equipment: str) -> DataFrame:
    """``df`` with the struct ``precursor``, whose members and place are made once."""
    df = df.withColumn("__text", F.col(text))
    c = F.col("__text")
    made = {f"__{k}": _members(c, t) for k, t in (("acts", V.ACTIVITIES), ("bars", V.BARRIERS), ("hazards", V.HAZARDS))} | {"__place": location(c, F.col(equipment))}
    return df.withColumns(made).withColumn("precursor", _precursor(c, *map(F.col, made))).drop("__text", *made)


def _precursor(c: Column, acts: Column, bars: Column, hazards: Column, place: Column) -> Column:
    act, bar, hazard = (F.get(x, F.lit(0)) for x in (acts, bars, hazards))
    sure = lambda x: F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in V.METHOD_CONFIDENCE.items() for v in kv)), x["method"]), F.lit(0.0))
    n = reduce(_ADD, (F.when(x.isNotNull(), 1).otherwise(0) for x in (act, place, bar, hazard)))
    rest = lambda x: F.transform(F.slice(x, 2, 100), lambda m: m["name"])
    empty = F.trim(F.coalesce(c, F.lit(""))) == ""
    confidence = F.when(empty, 0.0).otherwise(F.element_at(F.create_map(*(F.lit(v) for kv in V.DIMENSION_CONFIDENCE.items() for v in kv)), n))
    return F.struct(
        act["name"].alias("activity"), place.alias("location"), bar["name"].alias("barrier_failure"), hazard["name"].alias("hazard_exposure"), F.coalesce(bar["rule"], act["rule"], hazard["rule"]).alias("rule_id"),
        F.coalesce(bar["clause"], hazard["clause"], act["clause"], F.when(~empty, F.substring(c, 1, 120))).alias("evidence"), confidence.alias("confidence"), rest(acts).alias("secondary_activities"), rest(bars).alias("secondary_barriers"),
        sure(act).alias("activity_confidence"), sure(bar).alias("barrier_confidence"), sure(hazard).alias("hazard_confidence"),
    )
