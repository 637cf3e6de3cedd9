"""Queries of the text pipeline over whole narratives, with their SQL checks where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardloom.functions import fixed_values as V
from hazardloom.functions import pipeline as P
from hazardloom.functions import text as X
from hazardloom.plans.dashboard import BANDS
from hazardloom.plans.texts import _EQUIPMENT, R, _place_sql, _q
from hazardloom.plans.views import Registry, classifications, reports_of
from hazardloom.storage import spread, table

REG = Registry()


def _redacted_sql(c: str) -> tuple[str, str]:
    n = []
    for pattern, token in V.PERSONAL_PATTERNS:
        p = _q(f"(?i){pattern}")
        n.append(f"len(regexp_extract_all({c}, {p}))")
        c = f"regexp_replace({c}, {p}, {_q(token)}, 'g')"
    return c, " + ".join(n)


_TEXT, _N = _redacted_sql("raw_text")


@REG.add("x08_redacted", R + f"SELECT id, {_TEXT} AS redacted, {_N} AS n_personal FROM r")
def _(spark, d):
    """Narratives with the plain patterns of personal data replaced."""
    text, n = P.redacted(F.col("raw_text"))
    return reports_of(spark, d, text.alias("redacted"), n.cast("long").alias("n_personal"))


@REG.add("x10_personal_guard", R + f"SELECT id, {_N} > 0 AS holds_personal FROM r")
def _(spark, d):
    """Whether a narrative must not reach a model as it stands."""
    return reports_of(spark, d, (P.redacted(F.col("raw_text"))[1] > 0).alias("holds_personal"))


@REG.add("x13_preprocessed")
def _(spark, d):
    """Redacted, spelt, expanded, negations suppressed; a script that isn't supported ends it early."""
    r = spread(reports_of(spark, d, "raw_text"))
    r = P.with_preprocessed(r, "raw_text")
    return r.select("id", "p.processed", "p.n_personal", "p.script", "p.negated", "p.method")


_SPANS = "list_concat(" + ", ".join(f"regexp_extract_all(raw_text, {_q('(?i)' + p)})" for patterns in (*V.ENERGY_PATTERNS.values(), V.PROXIMITY_PATTERNS, V.BARRIER_FAILURE_PATTERNS) for p in patterns) + ")"
_COUNT = lambda patterns: " + ".join(f"len(regexp_extract_all(raw_text, {_q('(?i)' + p)}))" for p in patterns)


@REG.add("x14_found_spans", R + f", s AS (SELECT id, {_SPANS} AS spans, {_COUNT(V.PROXIMITY_PATTERNS)} AS n_proximity, {_COUNT(V.BARRIER_FAILURE_PATTERNS)} AS n_barrier FROM r) SELECT id, array_to_string(list_filter(spans, lambda x, i: list_position(list_transform(spans, lambda y: lower(y)), lower(x)) = i), '|') AS spans, n_proximity, n_barrier FROM s")
def _(spark, d):
    """All spans of all patterns, each once as first seen, and how many signals of exposure and of failed barriers there are."""
    f = reports_of(spark, d, P.features(F.col("raw_text")).alias("f"))
    return f.select("id", F.array_join("f.spans", "|").alias("spans"), F.size("f.proximity_hits").cast("long").alias("n_proximity"), F.size("f.barrier_failures").cast("long").alias("n_barrier"))


def _clause_sql(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(raw_text, {_q('(?i)' + p)}, 0), '')" for p in patterns) + ", NULL)"


def _members_sql(taxonomy: list[tuple]) -> str:
    rows = ", ".join(f"CASE WHEN {_clause_sql([*plain, *near])} IS NOT NULL THEN {{'name': {_q(name)}, 'rule': {_q(rule) if rule else 'NULL::VARCHAR'}, 'clause': {_clause_sql([*plain, *near])}}} END" for name, rule, plain, near in taxonomy)
    return f"list_filter([{rows}], lambda x: x IS NOT NULL)"


_PRE = f"pre AS (SELECT id, raw_text, {_members_sql(V.ACTIVITIES)} AS a, {_members_sql(V.BARRIERS)} AS b, {_members_sql(V.HAZARDS)} AS h, coalesce({_place_sql('raw_text')}, {_place_sql('(' + _EQUIPMENT + ')')}) AS place FROM r)"
_DIMS = "(a[1] IS NOT NULL)::INT + (b[1] IS NOT NULL)::INT + (h[1] IS NOT NULL)::INT + (place IS NOT NULL)::INT"


@REG.add("x19_precursors", R + f", {_PRE} SELECT id, a[1].name AS activity, place AS location, b[1].name AS barrier_failure, h[1].name AS hazard_exposure, coalesce(b[1].rule, a[1].rule, h[1].rule) AS rule_id, coalesce(b[1].clause, h[1].clause, a[1].clause, substring(raw_text, 1, 120)) AS evidence, CASE {_DIMS} WHEN 0 THEN 0.4 WHEN 1 THEN 0.7 WHEN 2 THEN 0.85 ELSE 0.92 END::DOUBLE AS confidence, greatest(len(a) - 1, 0) AS n_other_activities FROM pre")
def _(spark, d):
    """Activity, place, failed barrier and hazard of every narrative, with rule, evidence and confidence."""
    p = reports_of(spark, d, P.precursor(F.col("raw_text"), F.col("equipment_type")).alias("p"))
    return p.select("id", "p.activity", "p.location", "p.barrier_failure", "p.hazard_exposure", "p.rule_id", "p.evidence", "p.confidence", F.size("p.secondary_activities").cast("long").alias("n_other_activities"))


_CONCEPTS = ", ".join(f"('{rule}', {g}, {len(groups)}, {_q(P.concept_pattern(w))})" for rule, groups in V.CONCEPT_PROFILES.items() for g, group in enumerate(groups) for w in group)


@REG.add("t06_concept_scores", R + rf", c(rule_id, grp, n_groups, pattern) AS (VALUES {_CONCEPTS}), low AS (SELECT id, trim(regexp_replace(lower(raw_text), '\s+', ' ', 'g')) AS t FROM r), p AS (SELECT id, t, list_filter(list_transform(regexp_split_to_array(t, '[.!?;\n]+'), lambda x: trim(x)), lambda x: length(x) > 5) AS s FROM low), e AS (SELECT id, unnest(CASE WHEN len(s) > 0 THEN list_transform(range(len(s)), lambda i: {{'n': i, 's': s[i + 1]}}) ELSE [{{'n': 0, 's': t}}] END) AS u FROM p), m AS (SELECT id, u.n AS n, rule_id, max(n_groups) AS n_groups, count(*) AS hits, count(DISTINCT grp) AS covered FROM e JOIN c ON regexp_matches(u.s, pattern) GROUP BY 1, 2, 3), k AS (SELECT id, rule_id, max(CASE WHEN covered >= CASE WHEN n_groups = 3 THEN 3 ELSE 2 END THEN round(0.54::DOUBLE + 0.12::DOUBLE * (covered / n_groups) + least(0.12::DOUBLE, 0.02::DOUBLE * hits), 3) ELSE 0 END) AS score FROM m GROUP BY 1, 2) SELECT id, rule_id, score::DOUBLE AS score FROM k WHERE score > 0")
def _(spark, d):
    """Rules whose concepts meet in one sentence, with the best score."""
    scores = F.array(*(F.struct(F.lit(r).alias("rule_id"), P.concept_score(F.col("s"), r).alias("score")) for r in V.CONCEPT_PROFILES))
    s = reports_of(spark, d, P.concept_sentences(F.col("raw_text")).alias("s"))
    return s.select("id", F.explode(F.filter(scores, lambda x: x["score"] > 0)).alias("x")).select("id", "x.*")


def _processed(spark, d):
    return P.with_preprocessed(spread(reports_of(spark, d, "raw_text", "equipment_type")), "raw_text").select("id", "equipment_type", "p")


@REG.add("t04_full_rule_tags")
def _(spark, d):
    """Tags of the processed narratives from phrases, keywords, concepts and cross signals."""
    read = P.with_signals(_processed(spark, d).filter("p.script is null"), "p.processed")
    return read.select("id", F.explode(P.rule_tags(F.col("p.processed"))).alias("t")).select("id", "t.*")


def _classified(spark, d):
    """One struct a report; the probability is the model's last statement on it (``classifications``)."""
    p = _processed(spark, d).join(classifications(spark, d).select(F.col("report_id").alias("id"), "sif_probability"), "id", "left")
    status = P.guard(F.col("p.processed"), F.col("p.script"), F.col("sif_probability"))
    score = F.when(F.col("status") == "UNCALIBRATED_FALLBACK", F.least(F.greatest(F.col("sif_probability"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    band = F.when(F.col("status") == "LANGUAGE_UNSUPPORTED", "LANGUAGE_UNSUPPORTED_NEEDS_REVIEW").when(F.col("score") >= BANDS[0], "SIF_LIKELY").when(F.col("score") >= BANDS[1], "UNCERTAIN").otherwise("NON_SIF")
    votes = X.weak_votes(F.col("p.processed"))
    pos, label, sure = X.vote_label([F.col(k) for k in votes])
    read = F.col("p.script").isNull()
    told = P.with_signals(p.withColumns({"status": status} | votes).withColumn("score", F.round(score, 4)), "p.processed")
    return told.select(
        "id", "p", "equipment_type", "low", "f", "scores", "status", "score", band.alias("state"), F.when(read, label).alias("weak_label"), F.when(read, F.round(sure, 4)).alias("weak_confidence"),
        F.when(read, P.phrases(F.col("f.spans"))).alias("phrases"),
    )


@REG.add("t03_guarded_predictions")
def _(spark, d):
    """Probability and status of each report behind the guards: script, personal data, missing model, nothing asserted."""
    return _classified(spark, d).select("id", "status", "score", "state")


@REG.add("t02_classified")
def _(spark, d):
    """Status, probability, band, weak label and weightiest phrases of each report."""
    return _classified(spark, d).select("id", "status", "score", "state", F.col("state").isin("UNCERTAIN", "LANGUAGE_UNSUPPORTED_NEEDS_REVIEW").alias("needs_review"), "weak_label", "weak_confidence", "phrases")


@REG.add("t01_text_pipeline")
def _(spark, d):
    """Everything the pipeline says of a narrative in one row: texts, classification, tags and precursor."""
    c = P.with_precursor(_classified(spark, d), "p.processed", "equipment_type")
    read = F.col("p.script").isNull()
    return c.select("id", F.col("p.redacted").alias("redacted"), F.col("p.processed").alias("processed"), "status", "score", "state", "weak_label", "phrases", F.when(read, P.rule_tags(F.col("p.processed"))).alias("tags"), F.when(read, F.col("precursor")).alias("precursor"))


_CAP = 200


@REG.add("m01_log_norm", R + f"SELECT site_id, count(*) AS n, round(least(1.0, greatest(0.0, ln(1 + count(*)) / ln(1 + {_CAP}))), 6)::DOUBLE AS log_norm FROM r WHERE site_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    """Reports of a site on a logarithmic scale from 0 to 1, 1 from the cap on."""
    n = F.col("n")
    scaled = F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log1p(n) / F.log1p(F.lit(float(_CAP))))))
    return reports_of(spark, d, "site_id").filter("site_id is not null").groupBy("site_id").agg(F.count("*").alias("n")).withColumn("log_norm", F.round(scaled, 6))


@REG.add("x27_area_labels", "SELECT DISTINCT department, array_to_string(list_transform(string_split(lower(department), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS label FROM reports WHERE trim(coalesce(department, '')) <> ''")
def _(spark, d):
    """Departments in title case."""
    return table(spark, d, "reports").select("department").filter("trim(coalesce(department, '')) != ''").distinct().withColumn("label", F.initcap("department"))


QUERIES, SQL = REG.queries, REG.sql
