"""Text queries over whole narratives, each with the same pattern in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardloom.functions import fixed_values as V
from hazardloom.functions import pipeline as P
from hazardloom.functions import text as X
from hazardloom.functions.negation import suppressed
from hazardloom.plans.views import Registry, ctes, reports, reports_of
from hazardloom.storage import spread, table

REG = Registry()
R = ctes("r")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hit(words: str, c: str = "raw_text") -> str:
    return f"regexp_matches(lower({c}), {_q(X.bounded(words))})"


NORM = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def norm_sql(c: str) -> str:
    return NORM.replace("{c}", c)


@REG.add("x01_clean_text", R + r"SELECT id, trim(regexp_replace(regexp_replace(raw_text, '[\r\n\t]+', ' ', 'g'), '\s{2,}', ' ', 'g')) AS cleaned FROM r")
def _(spark, d):
    return reports_of(spark, d, X.clean_text(F.col("raw_text")).alias("cleaned"))


@REG.add("x02_null_tokens", "SELECT CASE WHEN lower(trim(group_id)) IN ('', 'null', 'none', 'nan', 'unknown', 'n/a') THEN NULL ELSE trim(group_id) END AS group_id, count(*) AS n FROM incident_records GROUP BY 1")
def _(spark, d):
    return table(spark, d, "incident_records").groupBy(X.optional(F.col("group_id")).alias("group_id")).agg(F.count("*").alias("n"))


@REG.add("x03_normalise", R + f"SELECT id, {norm_sql('raw_text')} AS norm FROM r")
def _(spark, d):
    return reports_of(spark, d, X.normalise(F.col("raw_text")).alias("norm"))


@REG.add("x04_text_hash", R + f"SELECT id, substring(sha256({norm_sql('raw_text')}), 1, 16) AS text_hash FROM r")
def _(spark, d):
    return reports_of(spark, d, X.text_hash(X.normalise(F.col("raw_text"))).alias("text_hash"))


@REG.add("x05_token_set", R + f"SELECT id, len(list_distinct(list_filter(string_split({norm_sql('raw_text')}, ' '), lambda x: x <> ''))) AS n_tokens FROM r")
def _(spark, d):
    return reports_of(spark, d, F.size(X.tokens(X.normalise(F.col("raw_text")))).cast("long").alias("n_tokens"))


def _spelling_sql(c: str) -> str:
    b = r"(^|[^\p{L}\p{N}_])"
    e = r"($|[^\p{L}\p{N}_])"
    for wrong, right in X.SPELLING.items():
        for a, w, flag in ((wrong.upper(), right.upper(), "g"), (wrong.capitalize(), right.capitalize(), "g"), (wrong, right, "gi")):
            c = f"regexp_replace({c}, {_q(f'{b}{a}{e}')}, {_q(chr(92) + '1' + w + chr(92) + '2')}, '{flag}')"
    return c


@REG.add("x06_correct_spelling", R + f"SELECT id, {_spelling_sql(_q('Sefty first: ') + ' || raw_text || ' + _q(' PRESURE isolaton'))} AS corrected FROM r")
def _(spark, d):
    text = F.concat(F.lit("Sefty first: "), F.col("raw_text"), F.lit(" PRESURE isolaton"))
    return reports_of(spark, d, X.correct_spelling(text).alias("corrected"))


def _abbreviation_sql(c: str) -> str:
    for key in sorted(X.ABBREVIATIONS, key=lambda k: (-len(k), k)):
        for _ in range(2):  # neighbours share their bound
            c = f"regexp_replace({c}, '(^|[^A-Za-z0-9]){key}($|[^A-Za-z0-9])', '\\1{X.ABBREVIATIONS[key]}\\2', 'gi')"
    return c


@REG.add("x07_expand_abbreviations", R + f"SELECT id, {_abbreviation_sql(_q('PTW and JSA: ') + ' || raw_text')} AS expanded FROM r")
def _(spark, d):
    return reports_of(spark, d, X.expand_abbreviations(F.concat(F.lit("PTW and JSA: "), F.col("raw_text"))).alias("expanded"))


@REG.add("x08_contact_counts", R + r"SELECT id, len(regexp_extract_all(raw_text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n_mail, len(regexp_extract_all(raw_text, '[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}')) AS n_phone FROM r")
def _(spark, d):
    n = lambda p: F.regexp_count("raw_text", F.lit(p)).cast("long")
    return reports_of(spark, d, n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("n_mail"), n(r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}").alias("n_phone"))


@REG.add("x11_script", "SELECT doc_id, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS devanagari, len(regexp_extract_all(text, '[ঀ-৿]')) AS bengali, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, CASE WHEN len(regexp_extract_all(text, '[ऀ-ॿ]')) + len(regexp_extract_all(text, '[ঀ-৿]')) > len(regexp_extract_all(text, '[A-Za-z]')) THEN CASE WHEN len(regexp_extract_all(text, '[ऀ-ॿ]')) >= len(regexp_extract_all(text, '[ঀ-৿]')) THEN 'devanagari' ELSE 'bengali' END ELSE 'other' END AS unsupported FROM documents")
def _(spark, d):
    n = {k: c.cast("long") for k, c in X.script_counts(F.col("text")).items()}
    a, b, c = n["devanagari"], n["bengali"], n["latin"]
    return table(spark, d, "documents").select("doc_id", *(v.alias(k) for k, v in n.items()), F.when(a + b > c, F.when(a >= b, "devanagari").otherwise("bengali")).otherwise("other").alias("unsupported"))


_HAZARD, _NEGATOR = "leak|release|fire|explosion|contact|exposure|fall|injur|hurt", "no|not|never|without|nobody|nor"


@REG.add("x12_negated_hazards", R + f"SELECT id, len(list_filter(regexp_split_to_array(lower(raw_text), '[.;,!?\\n]+'), lambda x: regexp_matches(x, '(^|[^a-z])({_NEGATOR})[^a-z].{{0,48}}({_HAZARD})'))) AS n_negated FROM r")
def _(spark, d):
    """Clauses in which a negation stands within 48 characters before a hazard."""
    clauses = F.split(F.lower("raw_text"), r"[.;,!?\n]+")
    return reports_of(spark, d, F.size(F.filter(clauses, lambda x: x.rlike(f"(^|[^a-z])({_NEGATOR})[^a-z].{{0,48}}({_HAZARD})"))).cast("long").alias("n_negated"))


@REG.add("x12_suppressed_text")
def _(spark, d):
    """Narratives without negated hazard clauses, with those clauses and the method; x12_negated_hazards only counts, on marks alone."""
    return spread(reports_of(spark, d, "raw_text")).select("id", suppressed(F.col("raw_text")).alias("s")).select("id", "s.*")


def _named(*patterns: str, c: str = "raw_text") -> str:
    return f"regexp_matches({c}, {_q('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


@REG.add("x15_features", R + "SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_named(*p)} THEN '{k}' END" for k, p in V.ENERGY_PATTERNS.items()) + f"], lambda x: x IS NOT NULL), ',') AS energy_types, {_named(*V.PROXIMITY_PATTERNS)} AS proximity, {_named(*V.BARRIER_FAILURE_PATTERNS)} AS barrier_failure FROM r")
def _(spark, d):
    t = F.col("raw_text")
    return reports_of(spark, d, X.energy_types(t).alias("e"), X.named(t, *V.PROXIMITY_PATTERNS).alias("proximity"), X.named(t, *V.BARRIER_FAILURE_PATTERNS).alias("barrier_failure")).select("id", F.array_join("e", ",").alias("energy_types"), "proximity", "barrier_failure")


def _votes_sql() -> str:
    energy = _named(*(p for patterns in V.ENERGY_PATTERNS.values() for p in patterns))
    high, failed = _named(*(p for k in V.HIGH_ENERGY for p in V.ENERGY_PATTERNS[k])), _named(*V.BARRIER_FAILURE_PATTERNS)
    pos = [high, f"({energy} AND {_named(*V.PROXIMITY_PATTERNS)})", f"({energy} AND {failed})", _named(V.HEIGHT), _named(V.CONFINED), _named(V.LIFTING)]
    neg = f"({_named(V.ROUTINE_NOISE)} AND NOT {energy} AND NOT {failed})"
    return f"SELECT id, {' + '.join(f'CAST({p} AS INT)' for p in pos)} AS pos, CAST({neg} AS INT) AS neg FROM r"


@REG.add("a33_weak_labels", R + ", x AS (" + _votes_sql() + ") SELECT id, pos AS positive_votes, CASE WHEN pos > neg THEN 1 WHEN neg > pos THEN -1 ELSE 0 END AS weak_label, round(CASE WHEN pos = 0 AND neg = 0 THEN 0.35 WHEN pos > neg THEN least(0.95, 0.5 + 0.1 * pos) WHEN neg > pos THEN least(0.9, 0.55 + 0.1 * neg) ELSE 0.5 END, 4)::DOUBLE AS confidence FROM x")
def _(spark, d):
    pos, label, sure = X.vote_label(list(X.weak_votes(F.col("raw_text")).values()))
    return reports_of(spark, d, pos.alias("positive_votes"), label.alias("weak_label"), F.round(sure, 4).alias("confidence"))


_RULE_ROWS = ", ".join(f"('{r}', {_q(n)})" for r, (n, _) in X.RULES.items())
_TAGS = "tags AS (" + " UNION ALL ".join(f"SELECT id, '{r}' AS rule_id, " + " + ".join(f"CAST({_hit(w)} AS INT)" for w in words.split("|")) + " AS hits FROM r" for r, (_, words) in X.RULES.items()) + ")"


def _tags(spark, d):
    return reports_of(spark, d, X.rule_tags(F.col("raw_text")).alias("tags")).select("id", F.explode("tags").alias("t")).select("id", "t.*")


@REG.add("t05_rule_tags", R + f", {_TAGS} SELECT id, rule_id, hits, round(0.62 + least(0.22, 0.07 * hits), 4)::DOUBLE AS confidence FROM tags WHERE hits > 0")
def _(spark, d):
    """Keyword rules on every narrative: nine counts per row in one projection instead of a cross join with the catalogue."""
    return _tags(spark, d)


@REG.add("a04_rule_distribution", R + f", {_TAGS}, rules(rule_id, rule_name) AS (VALUES {_RULE_ROWS}) SELECT rules.rule_id, rule_name, count(DISTINCT CASE WHEN hits > 0 THEN id END) AS report_count FROM rules LEFT JOIN tags USING (rule_id) GROUP BY 1, 2")
def _(spark, d):
    """Reports per rule, all nine rules present."""
    rules = spark.createDataFrame([(r, n) for r, (n, _) in X.RULES.items()], "rule_id string, rule_name string")
    n = _tags(spark, d).groupBy("rule_id").agg(F.countDistinct("id").alias("n"))
    return rules.join(n, "rule_id", "left").select("rule_id", "rule_name", F.coalesce("n", F.lit(0)).alias("report_count"))


@REG.add("w12_tag_order", R + f", {_TAGS} SELECT id, string_agg(rule_id, ',' ORDER BY -(0.62 + least(0.22, 0.07 * hits)), rule_id) AS tags FROM tags WHERE hits > 0 GROUP BY id")
def _(spark, d):
    """Tags of a report by falling confidence, then id, ordered inside the row."""
    order = F.sort_array(F.transform(X.rule_tags(F.col("raw_text")), lambda t: F.struct((-t["confidence"]).alias("c"), t["rule_id"].alias("r"))))
    return reports_of(spark, d, F.array_join(F.transform(order, lambda t: t["r"]), ",").alias("tags")).filter("tags != ''")


#: The source labels' spellings of the rules.
_ALIAS = {"energy isolation": "LSR04", "line of fire": "LSR06", "confined space": "LSR02", "confined space entry": "LSR02", "hot work": "LSR05", "mechanical lifting": "LSR07", "safe mechanical lifting": "LSR07", "working at height": "LSR09", "work authorisation": "LSR08", "work authorization": "LSR08", "bypassing safety controls": "LSR01", "driving": "LSR03"}
_ALIAS_ROWS = ", ".join(f"('{a}', '{r}')" for a, r in _ALIAS.items())


@REG.add("a28_rule_metrics", "WITH o AS (SELECT DISTINCT incident_no AS id, lower(trim(life_saving_rule_violated)) AS label, description_of_incident || ' ' || hazard_type || ' ' || barrier_failure AS raw_text FROM oisd_incidents WHERE life_saving_rule_violated IS NOT NULL), al(label, truth) AS (VALUES " + _ALIAS_ROWS + "), r AS (SELECT o.id, truth, raw_text FROM o JOIN al USING (label)), " + _TAGS.replace("SELECT id,", "SELECT id, truth,") + """, k AS (SELECT rule_id, count(*) FILTER (hits > 0 AND truth = rule_id) AS tp, count(*) FILTER (hits > 0 AND truth <> rule_id) AS fp, count(*) FILTER (hits = 0 AND truth = rule_id) AS fn, count(*) FILTER (hits = 0 AND truth <> rule_id) AS tn FROM tags GROUP BY 1)
  SELECT rule_id, tp, fp, fn, tn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 4) END AS recall FROM k""")
def _(spark, d):
    """Tagger against the label of the source, per rule; labels by an explicit alias table."""
    o = table(spark, d, "oisd_incidents").filter("life_saving_rule_violated is not null").select(F.col("incident_no").alias("id"), F.lower(F.trim("life_saving_rule_violated")).alias("label"), F.concat_ws(" ", "description_of_incident", "hazard_type", "barrier_failure").alias("raw_text")).distinct()
    truth = F.element_at(F.create_map(*(F.lit(x) for p in _ALIAS.items() for x in p)), F.col("label"))
    ids = F.transform(X.rule_tags(F.col("raw_text")), lambda t: t["rule_id"])
    rows = o.select(truth.alias("truth"), ids.alias("found")).filter("truth is not null").select("truth", "found", F.explode(F.array(*(F.lit(r) for r in X.RULES))).alias("rule_id"))
    hit, true = F.array_contains("found", F.col("rule_id")), F.col("truth") == F.col("rule_id")
    k = rows.groupBy("rule_id").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 4))
    return k.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


_EQUIPMENT = "CASE WHEN lower(trim(equipment_type)) NOT IN ('general', 'unspecified', 'none', 'n/a', 'unknown') AND trim(equipment_type) <> '' THEN equipment_type END"


def _place_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {_named(*p, c=c)} THEN '{name}'" for name, p in V.LOCATIONS) + " END"


@REG.add("x18_location", R + f"SELECT id, coalesce({_place_sql('raw_text')}, {_place_sql('(' + _EQUIPMENT + ')')}) AS location_asset FROM r")
def _(spark, d):
    """A place that the text or the equipment names, never an invented one."""
    return reports_of(spark, d, P.location(F.col("raw_text"), F.col("equipment_type")).alias("location_asset"))


@REG.add("x20_evidence", R + r"SELECT id, trim(regexp_extract(lower(raw_text), '[^.]*(?:pressure|suspended load|line of fire|flammable)[^.]*\.?')) AS evidence FROM r")
def _(spark, d):
    """The stretch between full stops around the first hazard."""
    return reports_of(spark, d, F.trim(F.regexp_extract(F.lower("raw_text"), r"[^.]*(?:pressure|suspended load|line of fire|flammable)[^.]*\.?", 0)).alias("evidence"))


@REG.add("x21_sentence_split", R + r"SELECT id, len(list_filter(regexp_split_to_array(regexp_replace(raw_text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x) <> '')) AS n_sentences FROM r")
def _(spark, d):
    return reports_of(spark, d, F.size(X.initial_sentences(F.col("raw_text"))).cast("long").alias("n_sentences"))


_CRITICAL = {"interlock": 1.0, "isolation": 0.95, "relief": 0.9, "permit": 0.8, "gas test": 0.8, "guard": 0.7, "alarm": 0.6, "checklist": 0.4}


@REG.add("x24_keyword_score", R + "SELECT id, CASE WHEN trim(raw_text) = '' THEN 0.0 ELSE coalesce(greatest(" + ", ".join(f"CASE WHEN contains(lower(raw_text), '{k}') THEN {v} END" for k, v in _CRITICAL.items()) + "), 0.5) END::DOUBLE AS score FROM r")
def _(spark, d):
    """Highest score of the keywords contained, .5 where none is, 0 without text."""
    best = F.greatest(*(F.when(F.lower("raw_text").contains(k), F.lit(v)) for k, v in _CRITICAL.items()))
    return reports_of(spark, d, F.when(F.trim("raw_text") == "", 0.0).otherwise(F.coalesce(best, F.lit(0.5))).alias("score"))


@REG.add("x26_group_keys", "SELECT lower(trim(group_id)) AS gid, 'psc-' || substring(sha256(string_agg(DISTINCT id, '|' ORDER BY id)), 1, 16) AS group_key FROM incident_records WHERE lower(trim(group_id)) NOT IN ('', 'null', 'none', 'nan', 'unknown', 'n/a') GROUP BY 1")
def _(spark, d):
    """Stable key of a group's sorted members; the exact-group key needs the whole list, which is bounded by its group."""
    g = table(spark, d, "incident_records").select("id", F.lower(X.optional(F.col("group_id"))).alias("gid")).filter("gid is not null").distinct()
    return g.groupBy("gid").agg(F.concat(F.lit("psc-"), F.substring(F.sha2(F.array_join(F.sort_array(F.collect_set("id")), "|"), 256), 1, 16)).alias("group_key"))


@REG.add("u04_group_jaccard", "WITH k AS (SELECT department, list_distinct(flatten(list(string_split(norm_text, ' ')))) AS w FROM incident_records WHERE department IS NOT NULL GROUP BY 1), x AS (SELECT a.department AS a, b.department AS b, len(list_intersect(a.w, b.w)) AS both_, len(a.w) AS na, len(b.w) AS nb FROM k a JOIN k b ON a.department < b.department) SELECT a, b, both_ AS n_common, round(both_ / (na + nb - both_), 6) AS jaccard FROM x")
def _(spark, d):
    """Vocabulary overlap of departments: distinct (department, word) pairs joined on the word, never whole sets in one row."""
    w = table(spark, d, "incident_records").filter("department is not null").select("department", F.explode(F.split("norm_text", " ")).alias("w")).distinct()
    n = w.groupBy("department").agg(F.count("*").alias("n"))
    common = w.select(F.col("department").alias("a"), "w").join(w.select(F.col("department").alias("b"), "w"), "w").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n_common"))
    na, nb = n.select(F.col("department").alias("a"), F.col("n").alias("na")), n.select(F.col("department").alias("b"), F.col("n").alias("nb"))
    return common.join(na, "a").join(nb, "b").select("a", "b", "n_common", F.round(F.col("n_common") / (F.col("na") + F.col("nb") - F.col("n_common")), 6).alias("jaccard"))


QUERIES, SQL = REG.queries, REG.sql
