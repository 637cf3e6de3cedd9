"""Source, data-quality, duplicate and split queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardloom.functions import text as X
from hazardloom.operators import raw_rows
from hazardloom.operators.components import components
from hazardloom.operators.set_join import jaccard_pairs
from hazardloom.operators.skew import join_hot
from hazardloom.plans.views import Registry, ctes, reports
from hazardloom.sources import adapters, readers
from hazardloom.storage import Workspace, checkpoint_root, table

REG = Registry()
MISS = "('', 'null', 'none', 'nan', 'unknown', 'n/a')"
_T = r"coalesce(trim(regexp_replace(regexp_replace({c}, '[\r\n\t]+', ' ', 'g'), '\s{{2,}}', ' ', 'g')), '')"


def _t(c: str) -> str:
    return _T.format(c=c)


def _opt(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) IN {MISS} THEN NULL ELSE trim({x}) END"


def _date(c: str) -> str:
    v = f"trim({c})"
    mon = lambda p, k: f"CAST((position(upper(regexp_extract({v}, '{p}', {k})) IN '{adapters.MONTHS}') + 2) // 3 AS VARCHAR)"
    g = lambda p, k: f"regexp_extract({v}, '{p}', {k})"
    iso, us, slash, dash = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ].*)?$", r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: .*)?$", r"^(\d{4})/(\d{2})/(\d{2})$", r"^(\d{2})-(\d{2})-(\d{4})$"
    named, short, long = r"^(\d{2})-([A-Za-z]{3})-(\d{4})$", r"^(\d{2})-([A-Za-z]{3})-(\d{2})$", r"^([A-Za-z]{3}) (\d{1,2}), (\d{4})$"
    one = lambda p, y, m, d: f"CASE WHEN regexp_matches({v}, '{p}') THEN TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) END"
    parts = [one(iso, g(iso, 1), g(iso, 2), g(iso, 3)), one(us, g(us, 3), g(us, 1), g(us, 2)), one(us, g(us, 3), g(us, 2), g(us, 1)), one(slash, g(slash, 1), g(slash, 2), g(slash, 3)), one(dash, g(dash, 3), g(dash, 2), g(dash, 1)), one(named, g(named, 3), mon(named, 2), g(named, 1)), one(short, "'20' || " + g(short, 3), mon(short, 2), g(short, 1)), one(long, g(long, 3), mon(long, 1), g(long, 2))]
    return f"strftime(coalesce({', '.join(parts)}), '%Y-%m-%d')"


def _join(parts: list[str], sep: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x <> ''), '{sep}')"


_SEV = "CASE WHEN fatalities > 0 THEN 'FATALITY' WHEN injuries > 0 THEN 'HOSPITALIZED' END AS injury_severity"
_flag = lambda c: f"upper({_t(c)}) IN ('YES', 'Y', '1', 'TRUE')"
_place = _join([_t("location_city_name"), _t("location_state_abbreviation")], ", ")
_both = f"upper({_t('commodity_released_type')} || {_t('system_type')})"
PHMSA_SQL = f"""SELECT DISTINCT 'PHMSA-' || trim(report_number) AS report_id, 'PHMSA' AS source, {_date('local_datetime')} AS incident_date, 'USA' AS country, nullif(trim({_t('operator_name')} || CASE WHEN {_place} <> '' THEN ' (' || {_place} || ')' ELSE '' END), '') AS site,
  CASE WHEN {_both} LIKE '%GAS%' THEN 'Pipeline Transportation - Natural Gas' WHEN {_both} LIKE '%LIQUID%' OR upper({_t('commodity_released_type')}) LIKE '%CRUDE%' THEN 'Pipeline Transportation - Hazardous Liquids' WHEN {_t('commodity_released_type')} <> '' THEN 'Pipeline Transportation - ' || {_t('commodity_released_type')} ELSE 'Pipeline Transportation' END AS sector,
  'Pipeline Transmission & Distribution' AS activity, CASE WHEN length({_t('narrative')}) >= 10 THEN {_t('narrative')} ELSE {_join(["'PHMSA reported pipeline accident involving ' || CASE WHEN " + _t('operator_name') + " <> '' THEN " + _t('operator_name') + " ELSE 'operator' END || '.'", "CASE WHEN " + _t('system_part_involved') + " <> '' THEN 'Component involved: ' || " + _t('system_part_involved') + " || '.' ELSE '' END", "CASE WHEN " + _t('cause') + " <> '' THEN 'Cause documented: ' || " + _t('cause') + " || '.' ELSE '' END"], ' ')} END AS description,
  coalesce({_opt(_t('commodity_released_type'))}, 'Pressurized Hydrocarbon') AS hazard, {_opt(_join([_t('cause'), _t('subcause')], ' - '))} AS barrier_failure, CASE WHEN {_flag('explode_ind')} THEN 'Explosion, ' ELSE '' END || CASE WHEN {_flag('ignite_ind')} THEN 'Fire, ' ELSE '' END || 'Loss of Containment' AS consequence,
  num_fatalities AS fatalities, num_injuries AS injuries, CASE WHEN num_fatalities > 0 THEN 'FATALITY' WHEN num_injuries > 0 THEN 'HOSPITALIZED' END AS injury_severity, CASE WHEN num_fatalities > 0 OR num_injuries > 0 OR {_flag('explode_ind')} THEN true WHEN num_fatalities = 0 AND num_injuries = 0 AND NOT {_flag('ignite_ind')} AND NOT {_flag('explode_ind')} THEN false END AS sif_potential, 'real' AS data_type FROM phmsa_incidents WHERE trim(report_number) <> ''"""
_csite = _join([_t("company"), _t("pipeline_name"), _t("province")], " - ")
CER_SQL = f"""SELECT DISTINCT 'CER-' || trim(incident_number) AS report_id, 'CER' AS source, {_date('incident_date')} AS incident_date, 'Canada' AS country, nullif({_csite}, '') AS site, CASE WHEN {_t('substance')} <> '' THEN 'Pipeline Transportation - ' || {_t('substance')} ELSE 'Pipeline Transportation' END AS sector, coalesce({_opt(_t('activity_at_time'))}, 'Pipeline Operations & Maintenance') AS activity, {_t('what_happened')} AS description,
  coalesce({_opt(_t('substance'))}, 'Pressurized Pipeline Fluid') AS hazard, {_opt(_t('primary_cause'))} AS barrier_failure, CASE WHEN {_t('adverse_effects')} <> '' THEN {_t('adverse_effects')} ELSE 'Loss of Containment' END AS consequence, fatalities, serious_injuries AS injuries, CASE WHEN fatalities > 0 THEN 'FATALITY' WHEN serious_injuries > 0 THEN 'HOSPITALIZED' END AS injury_severity,
  CASE WHEN fatalities > 0 OR serious_injuries > 0 OR lower({_t('significant')}) IN ('yes', 'true', '1') THEN true WHEN fatalities = 0 AND serious_injuries = 0 THEN false END AS sif_potential, 'real' AS data_type FROM cer_incidents WHERE trim(incident_number) <> ''"""
_osite = _join([_t("installation_unit"), _t("organization"), _t("state_region")], " - ")
_owords = f"upper({_t('organization')} || ' ' || {_t('installation_unit')})"
OISD_SQL = f"""SELECT DISTINCT 'OISD-' || trim(incident_no) AS report_id, 'OISD' AS source, {_date('date_of_occurrence')} AS incident_date, 'India' AS country, nullif({_osite}, '') AS site, CASE WHEN {_t('sector')} <> '' THEN {_t('sector')} WHEN {_owords} LIKE '%REFINERY%' OR {_owords} LIKE '%CDU%' OR {_owords} LIKE '%PETROCHEM%' THEN 'Downstream - Refining & Petrochemicals' WHEN {_owords} LIKE '%PIPELINE%' OR {_owords} LIKE '%PUMPING%' THEN 'Midstream - Cross-Country Pipelines' ELSE 'Upstream - Exploration & Production' END AS sector,
  {_opt(_t('activity_underway'))} AS activity, {_t('description_of_incident')} AS description, coalesce({_opt(_t('hazard_type'))}, 'Pressurized Hydrocarbon') AS hazard, {_opt(_t('barrier_failure'))} AS barrier_failure, CASE WHEN {_t('consequence')} <> '' THEN {_t('consequence')} ELSE 'Loss of Containment / Flash Fire' END AS consequence, fatalities, injuries, {_SEV},
  CASE WHEN sif_potential IS NOT NULL THEN lower(trim(sif_potential)) IN ('yes', 'true', '1', 'high') WHEN fatalities > 0 OR injuries > 0 THEN true WHEN fatalities = 0 AND injuries = 0 THEN false END AS sif_potential, 'real' AS data_type FROM oisd_incidents WHERE trim(incident_no) <> ''"""
UNION_SQL = f"u AS ({PHMSA_SQL} UNION ALL {CER_SQL} UNION ALL {OISD_SQL})"


def incidents(spark, d) -> DataFrame:
    return reduce(DataFrame.unionByName, (f(table(spark, d, f"{s}_incidents")) for s, f in adapters.ADAPTERS.items()))


for _s, _sql in (("phmsa", PHMSA_SQL), ("cer", CER_SQL), ("oisd", OISD_SQL)):

    def _adapt(spark, d, s=_s):
        return adapters.ADAPTERS[s](table(spark, d, f"{s}_incidents"))

    REG.add(f"s_{_s}_normalised", _sql)(_adapt)


def _rule_sql(words: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({words}, '{k}')" for k in keys.split("|")) + f" THEN '{rule}'" for keys, rule in rules) + f" ELSE {otherwise} END"


def _say_sql(before: str, c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN '{before}' || {c} || '.' ELSE '' END"


def _told_sql(c: str, *parts: str) -> str:
    return f"CASE WHEN length({_t(c)}) >= 10 THEN {_t(c)} ELSE {_join(list(parts), ' ')} END"


_or = lambda a, b: f"CASE WHEN {_t(a)} <> '' THEN {_t(a)} ELSE {b} END"
_PTOLD = PHMSA_SQL.split("'Pipeline Transmission & Distribution' AS activity, ")[1].split(" AS description")[0]
_PWORDS = f"upper({_t('cause')} || ' ' || {_t('subcause')} || ' ' || {_PTOLD})"
_PLSR = _rule_sql(_PWORDS, [("CORROSION|MATERIAL FAILURE", "Asset Integrity / Work Authorisation"), ("EXCAVATION|THIRD PARTY|DIGGING", "Excavation / Line of Fire"), ("ISOLATION|VALVE", "Energy Isolation")], f"CASE WHEN {_flag('ignite_ind')} OR {_flag('explode_ind')} OR contains({_PWORDS}, 'HOT WORK') THEN 'Hot Work' END")
_PMORE = f", {_PLSR} AS lsr, 'Pressure & Chemical Hydrocarbon' AS energy, json_object('system_part', system_part_involved, 'release_volume', CAST(unintentional_release_bbls AS VARCHAR), 'commodity_type', {_t('commodity_released_type')}, 'fire_ignition', {_flag('ignite_ind')}, 'explosion', {_flag('explode_ind')})::VARCHAR AS metadata FROM phmsa_incidents"
_CTOLD = _told_sql("what_happened", f"'CER recorded pipeline incident involving ' || {_or('company', chr(39) + 'operator' + chr(39))} || ' on ' || {_or('pipeline_name', chr(39) + 'pipeline' + chr(39))} || '.'", _say_sql("Primary cause: ", _t("primary_cause")), _say_sql("Substance involved: ", _t("substance")), _say_sql("Effects observed: ", _t("adverse_effects")))
_CLSR = _rule_sql(f"upper({_t('primary_cause')} || ' ' || {_CTOLD})", [("CORROSION|CRACKING|DEFECT", "Asset Integrity / Work Authorisation"), ("EXTERNAL INTERFERENCE|EXCAVATION", "Excavation / Line of Fire"), ("INCORRECT OPERATION|VALVE|ISOLATION", "Energy Isolation"), ("FIRE|EXPLOSION", "Hot Work")], "NULL")
_CMORE = f", {_CLSR} AS lsr, 'Pressure & Stored Chemical Energy' AS energy, json_object('pipeline_name', {_t('pipeline_name')}, 'province', {_t('province')}, 'substance', {_t('substance')}, 'significant_flag', lower({_t('significant')}) IN ('yes', 'true', '1'), 'approximate_volume_released', approximate_volume_released)::VARCHAR AS metadata FROM cer_incidents"
_OTOLD = _told_sql("description_of_incident", f"'OISD safety case record at ' || {_or('installation_unit', _or('organization', chr(39) + 'oil & gas installation' + chr(39)))} || '.'", _say_sql("Activity underway: ", f"coalesce({_opt(_t('activity_underway'))}, '')"), _say_sql("Hazard encountered: ", _t("hazard_type")), _say_sql("Barrier deficiency: ", _t("barrier_failure")))
_ORULE = _or("life_saving_rule_violated", _t("oisd_standard"))
_OLSR = _rule_sql(f"upper({_ORULE} || ' ' || {_OTOLD} || ' ' || coalesce({_opt(_t('barrier_failure'))}, ''))", [("ISOLATION|LOTO|ENERGY", "Energy Isolation"), ("HOT WORK|PERMIT|PTW|OISD-STD-105", "Hot Work / Work Authorisation"), ("LINE OF FIRE|HOSE|PRESSURE", "Line of Fire"), ("CONFINED SPACE|CSE", "Confined Space Entry"), ("LIFTING|CRANE|SUSPENDED", "Mechanical Lifting"), ("BYPASS|INTERLOCK", "Bypassing Safety Controls")], f"nullif({_ORULE}, '')")
_OMORE = f", {_OLSR} AS lsr, coalesce({_opt(_t('energy_source'))}, 'Hydrocarbon Chemical & Pressure Energy') AS energy, json_object('organization', {_t('organization')}, 'unit', {_t('installation_unit')}, 'oisd_standard', oisd_standard)::VARCHAR AS metadata FROM oisd_incidents"
_FULL = {
    "phmsa": PHMSA_SQL.replace(" FROM phmsa_incidents", _PMORE),
    "cer": CER_SQL.replace(f"{_t('what_happened')} AS description", f"{_CTOLD} AS description").replace(" FROM cer_incidents", _CMORE),
    "oisd": OISD_SQL.replace(f"{_t('description_of_incident')} AS description", f"{_OTOLD} AS description").replace(" FROM oisd_incidents", _OMORE),
}
for _s, _sql in _FULL.items():

    def _adapt_full(spark, d, s=_s):
        return adapters.ADAPTERS[s](table(spark, d, f"{s}_incidents"), full=True)

    REG.add(f"s_{_s}_full", _sql)(_adapt_full)


@REG.add("s10_osha_normalised")
def _(spark, d):
    """Oil and gas records of the OSHA csv files: parsed, filtered by domain, normalised."""
    return adapters.osha(raw_rows.sound_rows(table(spark, d, "raw_records"), table(spark, d, "raw_files"), ("osha",)))


@REG.add("u01_all_sources", f"WITH {UNION_SQL} SELECT source, sif_potential, count(*) AS n, count(DISTINCT report_id) AS n_reports, sum(fatalities)::BIGINT AS fatalities FROM u GROUP BY 1, 2")
def _(spark, d):
    return incidents(spark, d).groupBy("source", "sif_potential").agg(F.count("*").alias("n"), F.countDistinct("report_id").alias("n_reports"), F.sum("fatalities").alias("fatalities"))


@REG.add("a17_data_quality", f"WITH {UNION_SQL}, q AS (SELECT source, count(*) AS n, count(*) FILTER (coalesce(length(description), 0) < 10) AS missing_text, count(*) FILTER (incident_date IS NULL) AS missing_date, count(*) - count(DISTINCT report_id) AS repeats, round(avg(((site IS NOT NULL)::INT + (sector IS NOT NULL)::INT + (activity IS NOT NULL)::INT) / 3.0), 4) AS context_share, count(sif_potential) AS labelled FROM u GROUP BY 1) SELECT *, round(least(greatest(40 * (1 - missing_text / n) + 20 * (1 - missing_date / n) + 20 * context_share + 20 - 10 * repeats / n, 0.0), 100.0), 1) AS score FROM q")
def _(spark, d):
    return adapters.quality(incidents(spark, d), ["source"])


@REG.add("d01_dates", f"SELECT 'cer' AS source, incident_date AS value, {_date('incident_date')} AS iso FROM cer_incidents WHERE incident_date IS NOT NULL UNION SELECT 'oisd', date_of_occurrence, {_date('date_of_occurrence')} FROM oisd_incidents WHERE date_of_occurrence IS NOT NULL")
def _(spark, d):
    """The reference's own date reading (calendar date, month first), beside the fuller one of problem 2."""
    one = lambda s, t, c: table(spark, d, t).filter(F.col(c).isNotNull()).select(F.lit(s).alias("source"), F.col(c).alias("value"), adapters.iso_date(F.col(c)).alias("iso"))
    return one("cer", "cer_incidents", "incident_date").union(one("oisd", "oisd_incidents", "date_of_occurrence")).distinct()


@REG.add("s02_csv_round_trip", "SELECT trim(report_number) AS report_number, operator_name, narrative FROM phmsa_incidents")
def _(spark, d):
    """Written as bar-delimited csv and read back with a sniffed delimiter."""
    path = f"{Workspace(spark, 's02').base}/csv"
    table(spark, d, "phmsa_incidents").select("report_number", "operator_name", "narrative").write.mode("overwrite").csv(path, header=True, sep="|", escape='"', quoteAll=True)
    return readers.read_csv(spark, path).select(F.trim("report_number").alias("report_number"), "operator_name", "narrative")


@REG.add("s19_jsonl_round_trip", f"WITH {UNION_SQL} SELECT report_id, source, incident_date, description FROM u")
def _(spark, d):
    path = f"{Workspace(spark, 's19').base}/jsonl"
    incidents(spark, d).select("report_id", "source", "incident_date", "description").write.mode("overwrite").json(path)
    return spark.read.schema("report_id string, source string, incident_date string, description string").json(path)


@REG.add("s26_application_rows", f"WITH {UNION_SQL} SELECT report_id AS source_report_id, coalesce(site, 'Unknown site') AS site_name, CASE WHEN fatalities > 0 OR injury_severity IS NOT NULL THEN 'incident' ELSE 'near_miss' END AS report_type, description AS raw_text, incident_date AS reported_at FROM u")
def _(spark, d):
    kind = F.when((F.col("fatalities") > 0) | F.col("injury_severity").isNotNull(), "incident").otherwise("near_miss")
    return incidents(spark, d).select(F.col("report_id").alias("source_report_id"), F.coalesce("site", F.lit("Unknown site")).alias("site_name"), kind.alias("report_type"), F.col("description").alias("raw_text"), F.col("incident_date").alias("reported_at"))


@REG.add("f16_upload_validation", "WITH x AS (SELECT row_number() OVER (ORDER BY id, ingested_at) AS row_no, id, raw_text, site_id, reported_at FROM reports), f AS (SELECT id, min(row_no) AS first_no FROM x GROUP BY 1), y AS (SELECT x.*, f.first_no FROM x JOIN f USING (id)) SELECT count(*) AS n, count(*) FILTER (row_no > first_no OR id IN (SELECT report_id FROM analyst_decisions)) AS duplicate_id, count(*) FILTER (length(trim(raw_text)) < 10) AS short_text, count(*) FILTER (site_id IS NULL) AS missing_site FROM y")
def _(spark, d):
    """Issues of uploaded rows: text, site, date and ids that came before, in the upload or among those already reviewed."""
    rows = table(spark, d, "reports").select(F.struct("id", "ingested_at").alias("row_no"), F.col("id").alias("source_report_id"), "raw_text", F.col("site_id").alias("site_name"), F.col("reported_at").cast("string").alias("reported_at"))
    known = table(spark, d, "analyst_decisions").select(F.col("report_id").alias("source_report_id"))
    got = readers.upload_issues(rows, known)
    has = lambda x: F.count_if(F.array_contains("issues", x)).alias(x)
    return got.agg(F.count("*").alias("n"), has("duplicate_id"), has("short_text"), has("missing_site"))


@REG.add("a18_upload_quality", "SELECT count(*) AS n, round(40 * avg((length(trim(raw_text)) >= 10)::INT) + 20 * avg((site_id IS NOT NULL)::INT) + 15 * avg((reported_at IS NOT NULL)::INT) + 15 * avg(((department IS NOT NULL)::INT + (shift IS NOT NULL)::INT + (equipment_type IS NOT NULL)::INT + (job_type IS NOT NULL)::INT) / 4.0) + 10 - 10 * (count(*) - count(DISTINCT id)) / count(*), 1) AS score FROM reports")
def _(spark, d):
    yes = lambda c: F.col(c).isNotNull().cast("int")
    n = F.count("*")
    score = 40 * F.avg((F.length(F.trim("raw_text")) >= 10).cast("int")) + 20 * F.avg(yes("site_id")) + 15 * F.avg(yes("reported_at")) + 15 * F.avg((yes("department") + yes("shift") + yes("equipment_type") + yes("job_type")) / 4.0) + 10 - 10 * (n - F.countDistinct("id")) / n
    return table(spark, d, "reports").agg(n.alias("n"), F.round(score, 1).alias("score"))


@REG.add("f13_gold_records", "SELECT label_source, count(*) AS n FROM (SELECT DISTINCT id, label_source, data_type FROM incident_records) WHERE upper(label_source) IN ('HUMAN_VALIDATED', 'IMPORTED', 'EXPERT') AND lower(data_type) NOT IN ('synthetic', 'demo') GROUP BY 1")
def _(spark, d):
    gold = table(spark, d, "incident_records").select("id", "label_source", "data_type").distinct().filter(F.upper("label_source").isin("HUMAN_VALIDATED", "IMPORTED", "EXPERT") & ~F.lower("data_type").isin("synthetic", "demo"))
    return gold.groupBy("label_source").agg(F.count("*").alias("n"))


@REG.add("a19_validation_stats", "WITH x AS (SELECT DISTINCT id, label_source, data_type, label, norm_text FROM incident_records) SELECT count(*) AS n, count(DISTINCT id) AS n_ids, count(*) FILTER (label) AS n_positive, count(*) FILTER (lower(data_type) = 'synthetic') AS n_synthetic, count(DISTINCT norm_text) AS n_texts, count(*) - count(DISTINCT norm_text) AS n_copies FROM x")
def _(spark, d):
    x = table(spark, d, "incident_records").select("id", "label_source", "data_type", "label", "norm_text").distinct()
    return x.agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.count_if("label").alias("n_positive"), F.count_if(F.lower("data_type") == "synthetic").alias("n_synthetic"), F.countDistinct("norm_text").alias("n_texts"), (F.count("*") - F.countDistinct("norm_text")).alias("n_copies"))


@REG.add("j11_exact_duplicates", "WITH x AS (SELECT DISTINCT id, substring(sha256(norm_text), 1, 16) AS h FROM incident_records WHERE norm_text <> '') SELECT id, min(id) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) - 1 AS n_links FROM x QUALIFY count(*) OVER (PARTITION BY h) > 1")
def _(spark, d):
    """One row per record with copies: its class and the number of links, never all pairs of a class."""
    x = table(spark, d, "incident_records").filter("norm_text != ''").select("id", X.text_hash(F.col("norm_text")).alias("h")).distinct()
    k = x.groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("k")).filter("k > 1")
    return x.join(k, "h").select("id", "class_id", (F.col("k") - 1).alias("n_links"))


def _text_sets(spark, d) -> DataFrame:
    """One set per text, told apart by the hash of the whole text; a text that many records share is one row before the shuffle."""
    t = table(spark, d, "incident_records").filter("norm_text != ''").select("id", F.sha2("norm_text", 256).alias("h"), X.tokens(F.col("norm_text")).alias("tokens"))
    return t.groupBy("h").agg(F.min("id").alias("id"), F.any_value("tokens").alias("tokens")).select("id", "tokens")


_NEAR_SQL = "WITH t AS (SELECT min(id) AS id, list_distinct(list_filter(string_split(norm_text, ' '), lambda x: x <> '')) AS w FROM incident_records WHERE norm_text <> '' GROUP BY norm_text), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS na, len(b.w) AS nb FROM t a JOIN t b ON a.id < b.id AND len(a.w) >= 6 AND len(b.w) >= 6 AND len(a.w) >= 0.85 * len(b.w) AND len(b.w) >= 0.85 * len(a.w))"


@REG.add("j10_near_duplicates", _NEAR_SQL + " SELECT a, b, round(c / (na + nb - c), 6) AS similarity FROM p WHERE c / (na + nb - c) >= 0.85")
def _(spark, d):
    """Pairs of different texts with token Jaccard of .85 and more, each text by its smallest record; copies are classes of j11."""
    return jaccard_pairs(_text_sets(spark, d), 0.85, Workspace(spark, "j10"), least_tokens=6).withColumn("similarity", F.round("similarity", 6))


_GROUPS = ", n AS (SELECT a, b FROM p WHERE c / (na + nb - c) >= 0.85), x AS (SELECT DISTINCT id, norm_text FROM incident_records WHERE norm_text <> ''), m AS (SELECT id AS a, min(id) OVER (PARTITION BY norm_text) AS b FROM x), e AS (SELECT a, b FROM n UNION SELECT b, a FROM n UNION SELECT a, b FROM m WHERE a <> b UNION SELECT b, a FROM m WHERE a <> b), w(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id WHERE w.root < e.b)"


@REG.add("t13_duplicate_groups", _NEAR_SQL.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + _GROUPS + " SELECT id, min(root) AS group_root FROM w GROUP BY 1")
def _(spark, d):
    """(id, group_root) over exact copies and near pairs: connected components of both."""
    space = Workspace(spark, "t13")
    near = jaccard_pairs(_text_sets(spark, d), 0.85, space, least_tokens=6).select(F.col("a").alias("u"), F.col("b").alias("v"))
    x = table(spark, d, "incident_records").filter("norm_text != ''").select("id", F.sha2("norm_text", 256).alias("h")).distinct()
    least = space.cut(x.groupBy("h").agg(F.min("id").alias("u"), F.count("*").alias("n")).filter("n > 1"), "least")
    exact = join_hot(x, least, "h", "n", stored=True).filter("id != u").select("u", F.col("id").alias("v"))
    return components(near.union(exact), space).select("id", F.col("root").alias("group_root"))


def _tied_records(spark, d) -> DataFrame:
    """(id, norm_text, text, positive, group_id, text_hash) per distinct row: keys lower-case and null where missing, ``text`` null where empty."""
    key = lambda c: F.lower(X.optional(F.regexp_replace(c, r"^[\s\u00a0\u3000]+|[\s\u00a0\u3000]+$", "")))
    norm = F.coalesce("norm_text", F.lit(""))
    text = F.when(norm != "", norm).otherwise(X.normalise(F.coalesce("raw_text", F.lit(""))))
    positive = F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("positive")
    return table(spark, d, "incident_records").select("id", "norm_text", F.when(text != "", text).alias("text"), positive, key("group_id").alias("group_id"), key("text_hash").alias("text_hash")).distinct()


def _near_links(x: DataFrame, space: Workspace) -> DataFrame:
    """(u, v) of near pairs, each text by its smallest record."""
    sets = space.cut(x.filter("text is not null").groupBy("text").agg(F.min("id").alias("id")).select("id", "text").withColumn("tokens", X.tokens(F.col("text"))).select("id", "tokens"), "sets")
    return space.cut(jaccard_pairs(sets, 0.85, space, least_tokens=6).select(F.col("a").alias("u"), F.col("b").alias("v")), "near")


def _star_links(x: DataFrame, key: str, space: Workspace) -> DataFrame:
    """(u, v) of records with one key: a star on the smallest record, never all pairs."""
    tied = space.cut(x.filter(F.col(key).isNotNull()).select("id", F.col(key).alias("key")).distinct(), key)
    least = tied.groupBy("key").agg(F.min("id").alias("u"), F.count("*").alias("n")).filter("n > 1")
    return join_hot(tied, least, "key", "n").filter("id != u").select("u", F.col("id").alias("v"))


#: Groups of a stratum are ranked inside this many hash ranges.
_RANGES = 4096
_SHARE = 0.15
_LEAST_RECORDS, _LEAST_CLASS = 20, 4


def _dealt(groups: DataFrame) -> DataFrame:
    """``groups``: (root, positive). 70/15/15 of each stratum in the order of a seeded hash: validation and test take
    floor(.15 n), at least one group each, as far as train keeps one. Ranks run inside hash ranges, after the counts of those before."""
    g = groups.withColumn("h", F.xxhash64("root", F.lit(42))).withColumn("range", F.pmod("h", F.lit(_RANGES)))
    sizes = g.groupBy("positive", "range").agg(F.count("*").alias("k"))
    by = W.partitionBy("positive")
    sizes = sizes.select("positive", "range", (F.sum("k").over(by.orderBy("range")) - F.col("k")).alias("before"), F.sum("k").over(by).alias("n"))  # at most 2 x 4096 rows
    rank = F.col("before") + F.row_number().over(W.partitionBy("positive", "range").orderBy("h", "root"))
    part = F.greatest(F.lit(1), F.floor(F.col("n") * _SHARE))
    train = F.greatest(F.lit(1), F.col("n") - 2 * part)
    split = F.when(F.col("rank") <= F.col("train"), "train").when(F.col("rank") <= F.col("train") + F.col("part"), "validation").otherwise("test")
    return g.join(sizes, ["positive", "range"]).select("root", "positive", rank.alias("rank"), train.alias("train"), part.alias("part")).select("root", "positive", split.alias("split"))


def _split(x: DataFrame, near: DataFrame, space: Workspace) -> DataFrame:
    """(id, group_root, positive, split, status) of every record of ``x``."""
    links = space.cut(reduce(DataFrame.union, (_star_links(x, k, space) for k in ("text", "group_id", "text_hash")), near).distinct(), "links")
    roots = components(links, space).select("id", "root")
    own = x.groupBy("id").agg(F.max("positive").alias("y"))
    own = space.cut(own.join(roots, "id", "left").select("id", "y", F.coalesce("root", "id").alias("root")), "own")
    n, yes = own.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    enough = n >= _LEAST_RECORDS and min(yes, n - yes) >= _LEAST_CLASS
    groups = own.groupBy("root").agg(F.max("y").alias("positive"), F.count("*").alias("rows"))
    dealt = _dealt(groups) if enough else groups.select("root", "positive", F.lit("train").alias("split"))
    status = "VALIDATED" if enough else "INSUFFICIENT_VALIDATION_DATA"
    done = join_hot(own.select("id", "root"), dealt.join(groups.select("root", "rows"), "root"), "root", "rows")
    return done.select("id", F.col("root").alias("group_root"), "positive", "split", F.lit(status).alias("status"))


def _leaks(x: DataFrame, near: DataFrame, split: DataFrame) -> DataFrame:
    """(norm_text) of records whose group id, text hash, text or near pair stands in two splits of ``split`` (id, split)."""
    s = x.join(split.select("id", "split"), "id").select("id", "norm_text", "text", "group_id", "text_hash", "split")

    def parted(key: str) -> DataFrame:
        bad = s.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo != hi").select(key)
        return s.join(bad, key, "left_semi").select("norm_text")

    of = split.select("id", "split")
    ends = near.join(of.toDF("u", "su"), "u").join(of.toDF("v", "sv"), "v").filter("su != sv")
    ends = s.join(ends.select(F.explode(F.array("u", "v")).alias("id")), "id", "left_semi").select("norm_text")
    return reduce(DataFrame.union, (parted(k) for k in ("id", "text", "group_id", "text_hash")), ends).distinct()


@REG.add("t15_leak_free_split")
def _(spark, d):
    """70/15/15 over connected components of group id, text hash, copies and near pairs, stratified by whether any record of the
    component is positive. Every record gets a split; too few records or records of a class: all train, and the status says so."""
    space = Workspace(spark, "t15")
    x = space.cut(_tied_records(spark, d), "records")
    return _split(x, _near_links(x, space), space)


@REG.add("u05_split_leaks", "SELECT CAST(NULL AS VARCHAR) AS norm_text WHERE false")
def _(spark, d):
    """Texts of records whose group id, text hash, text or near pair stands in two splits: none."""
    space = Workspace(spark, "u05")
    x = space.cut(_tied_records(spark, d), "records")
    near = _near_links(x, space)
    return _leaks(x, near, space.cut(_split(x, near, space), "split"))


@REG.add("m05_centroid_similarity", "WITH v AS (SELECT row_number() OVER () AS rid, e.* FROM embeddings e), x AS (SELECT v.*, unnest(embedding) AS val, generate_subscripts(embedding, 1) AS pos FROM v), c AS (SELECT label, pos, avg(val) AS m FROM x GROUP BY 1, 2), s AS (SELECT x.vec_id, x.label, sum(x.val * c.m) / (sqrt(sum(x.val * x.val)) * sqrt(sum(c.m * c.m))) AS cosine FROM x JOIN c USING (label, pos) GROUP BY x.rid, x.vec_id, x.label) SELECT label, count(*) AS n, round(avg(cosine), 4) AS mean_cosine FROM s GROUP BY 1")
def _(spark, d):
    """Mean cosine of vectors to the centroid of their label: centroids by position, similarity inside the row."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    c = e.select("label", F.posexplode("e").alias("pos", "val")).groupBy("label", "pos").agg(F.avg("val").alias("m"))
    c = c.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))  # 64 numbers a label
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cos = dot("e", "c") / (F.sqrt(dot("e", "e")) * F.sqrt(dot("c", "c")))
    return e.join(c, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(cos), 4).alias("mean_cosine"))


QUERIES, SQL = REG.queries, REG.sql
