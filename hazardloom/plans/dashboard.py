"""Dashboard queries: density, distribution, trend, KPIs, lists and filters, all at report grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardloom.plans.views import Registry, classifications, ctes, decisions, reports, reports_of, reviews, triples
from hazardloom.storage import table

REG = Registry()
BANDS = (0.55, 0.35)
SCOPE = ("site-001", "site-002", "site-003", "site-011", "site-017")
IN_SCOPE = "('site-001', 'site-002', 'site-003', 'site-011', 'site-017')"


def share(a: Column, b: Column, digits: int) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, digits))


def scoped(df: DataFrame, scope: tuple[str, ...] | None) -> DataFrame:
    """Row-level site scope: None sees all, an empty scope nothing."""
    return df if scope is None else df.filter(F.col("site_id").isin(*scope)) if scope else df.filter(F.lit(False))


def filtered(spark, d, df: DataFrame, start=None, end=None, site=None, department=None, min_confidence=None) -> DataFrame:
    """The dashboard's filter set: inclusive dates on the day, and semi-joins on child tables, which never multiply rows."""
    if start or end:
        df = df.filter(F.to_date("reported_at").between(F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date")))
    if site:
        df = df.filter(F.col("site_id") == site)
    if department:
        df = df.filter(F.col("department") == department)
    if min_confidence is not None:
        sure = classifications(spark, d).filter(F.col("sif_probability") >= min_confidence)
        df = df.join(sure.select(F.col("report_id").alias("id")), "id", "left_semi")
    return df


def _density(df: DataFrame, key: str) -> DataFrame:
    n = F.countDistinct("id")
    s = F.count_if("sif_label")
    return df.groupBy(key).agg(s.alias("sif_count"), n.alias("report_count"), share(s, n, 3).alias("sif_rate"))


def _classified(spark, d) -> DataFrame:
    return reports(spark, d).join(classifications(spark, d).withColumnRenamed("report_id", "id"), "id")


@REG.add("a01_sif_density_site", ctes("r", "c") + "SELECT s.name AS site_name, count(*) FILTER (c.sif_label) AS sif_count, count(DISTINCT r.id) AS report_count, round(count(*) FILTER (c.sif_label) / count(DISTINCT r.id), 3) AS sif_rate FROM r JOIN c ON c.report_id = r.id JOIN sites s ON s.id = r.site_id GROUP BY s.name")
def _(spark, d):
    """Share of serious-potential reports by site."""
    sites = table(spark, d, "sites").select(F.col("id").alias("site_id"), F.col("name").alias("site_name"))
    return _density(_classified(spark, d).select("id", "site_id", "sif_label").join(sites, "site_id"), "site_name")


@REG.add("a02_sif_density_department", ctes("r", "c") + "SELECT coalesce(r.department, 'Unspecified') AS department, count(*) FILTER (c.sif_label) AS sif_count, count(DISTINCT r.id) AS report_count, round(count(*) FILTER (c.sif_label) / count(DISTINCT r.id), 3) AS sif_rate FROM r JOIN c ON c.report_id = r.id GROUP BY 1")
def _(spark, d):
    return _density(_classified(spark, d).withColumn("department", F.coalesce("department", F.lit("Unspecified"))), "department")


@REG.add("a03_sif_density_activity", ctes("r", "c", "t") + "SELECT activity, count(*) FILTER (sif_label) AS sif_count, count(DISTINCT id) AS report_count, round(count(*) FILTER (sif_label) / count(DISTINCT id), 3) AS sif_rate FROM (SELECT DISTINCT t.report_id AS id, t.activity, c.sif_label FROM t JOIN c USING (report_id)) GROUP BY activity")
def _(spark, d):
    """Distinct (report, activity, label) first, then the aggregate."""
    return _density(triples(spark, d).join(classifications(spark, d), "report_id").select(F.col("report_id").alias("id"), "activity", "sif_label").distinct(), "activity")


for _unit in ("day", "week", "month"):

    def _trend(spark, d, unit=_unit):
        n, s = F.count("*"), F.count_if("sif_label")
        period = F.date_format(F.date_trunc(unit, "reported_at"), "yyyy-MM-dd")
        return _classified(spark, d).filter("reported_at is not null").groupBy(period.alias("period")).agg(s.alias("sif_count"), n.alias("report_count"), share(s, n, 3).alias("sif_rate"))

    REG.add(f"a05_trend_{_unit}", ctes("r", "c") + f"SELECT strftime(date_trunc('{_unit}', r.reported_at), '%Y-%m-%d') AS period, count(*) FILTER (c.sif_label) AS sif_count, count(*) AS report_count, round(count(*) FILTER (c.sif_label) / count(*), 3) AS sif_rate FROM r JOIN c ON c.report_id = r.id WHERE r.reported_at IS NOT NULL GROUP BY 1")(_trend)


@REG.add("d02_week_of_year", ctes("r") + "SELECT strftime(reported_at, '%Y-%W') AS week, count(*) AS n FROM r WHERE reported_at IS NOT NULL GROUP BY 1")
def _(spark, d):
    """Year and Monday week of the year (00 to 53), the bucket of the lighter database dialect."""
    monday0 = F.pmod(F.dayofweek("reported_at") + 5, F.lit(7))
    week = F.floor((F.dayofyear("reported_at") + 6 - monday0) / 7)
    return reports(spark, d).filter("reported_at is not null").groupBy(F.format_string("%04d-%02d", F.year("reported_at"), week.cast("int")).alias("week")).agg(F.count("*").alias("n"))


@REG.add("a06_kpis", ctes("r", "c", "t") + """, j AS (SELECT r.*, c.sif_label, c.sif_probability FROM r LEFT JOIN c ON c.report_id = r.id),
  top AS (SELECT s.name, round(count(*) FILTER (sif_label) / count(*), 3) AS rate FROM j JOIN sites s ON s.id = j.site_id WHERE sif_label IS NOT NULL GROUP BY s.name ORDER BY rate DESC, s.name LIMIT 1),
  pat AS (SELECT t.activity || ' | ' || t.location_asset AS p, count(DISTINCT CASE WHEN c.sif_label THEN report_id END) AS k, count(DISTINCT report_id) AS n FROM t JOIN c USING (report_id) GROUP BY 1 ORDER BY k DESC, n DESC, p LIMIT 1)
  SELECT count(*) AS total_reports, count(*) FILTER (sif_label) AS sif_reports, round(count(*) FILTER (sif_label) / count(*), 3) AS sif_rate, round(avg(sif_probability), 3) AS avg_probability, count(*) FILTER (lifecycle_status IN ('HSE_REVIEW', 'AI_ANALYZED')) AS queue_size, (SELECT name FROM top) AS top_risk_site, (SELECT p FROM pat) AS top_pattern FROM j""")
def _(spark, d):
    """Headline figures in one pass, and the two leaders by ordered aggregates without a sort."""
    j = reports(spark, d).join(classifications(spark, d).withColumnRenamed("report_id", "id"), "id", "left")
    n, s = F.count("*"), F.count_if("sif_label")
    head = j.agg(n.alias("total_reports"), s.alias("sif_reports"), share(s, n, 3).alias("sif_rate"), F.round(F.avg("sif_probability"), 3).alias("avg_probability"), F.count_if(F.col("lifecycle_status").isin("HSE_REVIEW", "AI_ANALYZED")).alias("queue_size"))
    sites = table(spark, d, "sites").select(F.col("id").alias("site_id"), "name")
    top = j.filter("sif_label is not null").join(sites, "site_id").groupBy("name").agg(share(s, n, 3).alias("rate")).agg(F.min_by("name", F.struct(-F.col("rate"), "name")).alias("top_risk_site"))
    pattern = F.concat_ws(" | ", "activity", "location_asset").alias("p")
    pat = triples(spark, d).join(classifications(spark, d), "report_id").groupBy(pattern).agg(F.countDistinct(F.when(F.col("sif_label"), F.col("report_id"))).alias("k"), F.countDistinct("report_id").alias("n")).agg(F.min_by("p", F.struct(-F.col("k"), -F.col("n"), "p")).alias("top_pattern"))
    return head.crossJoin(top).crossJoin(pat)  # three single rows


@REG.add("a07_status_counts", ctes("r") + "SELECT lifecycle_status, count(*) AS n, count(*) FILTER (resolved_at IS NOT NULL) AS n_resolved FROM r GROUP BY 1")
def _(spark, d):
    return reports(spark, d).groupBy("lifecycle_status").agg(F.count("*").alias("n"), F.count("resolved_at").alias("n_resolved"))


@REG.add("a08_agreement_analytics", ctes("v") + "SELECT count(*) AS n_reviews, count(*) FILTER (final_label = ai_label) AS n_agree, round(count(*) FILTER (final_label = ai_label) / count(*), 4) AS agreement_rate, count(*) FILTER (review_action = 'CONFIRM') AS n_confirm, count(*) FILTER (review_action = 'OVERRIDE') AS n_override, count(*) FILTER (ai_label AND NOT final_label) AS false_positives, count(*) FILTER (NOT ai_label AND final_label) AS false_negatives FROM v")
def _(spark, d):
    agree = F.count_if(F.col("final_label") == F.col("ai_label"))
    return reviews(spark, d).agg(F.count("*").alias("n_reviews"), agree.alias("n_agree"), share(agree, F.count("*"), 4).alias("agreement_rate"), F.count_if(F.col("review_action") == "CONFIRM").alias("n_confirm"), F.count_if(F.col("review_action") == "OVERRIDE").alias("n_override"), F.count_if(F.col("ai_label") & ~F.col("final_label")).alias("false_positives"), F.count_if(~F.col("ai_label") & F.col("final_label")).alias("false_negatives"))


@REG.add("a08_override_reasons", ctes("d") + "SELECT trim(analyst_comment) AS reason, count(*) AS n FROM d WHERE review_action = 'OVERRIDE' AND trim(coalesce(analyst_comment, '')) <> '' GROUP BY 1")
def _(spark, d):
    reason = F.trim("analyst_comment")
    return decisions(spark, d).filter((F.col("review_action") == "OVERRIDE") & (F.coalesce(reason, F.lit("")) != "")).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@REG.add("a15_triage_progress", ctes("r", "d", "c") + """SELECT count(*) FILTER (c.sif_probability >= 0.55) AS remaining_likely, count(*) FILTER (c.sif_probability >= 0.35 AND c.sif_probability < 0.55) AS remaining_uncertain, count(*) FILTER (c.sif_probability < 0.35) AS remaining_other,
  (SELECT count(DISTINCT report_id) FROM d) AS reviewed, (SELECT count(DISTINCT report_id) FROM d WHERE analyst_label) AS confirmed, (SELECT count(DISTINCT report_id) FROM d WHERE review_action = 'OVERRIDE') AS overridden FROM r JOIN c ON c.report_id = r.id WHERE r.final_sif_label IS NULL""")
def _(spark, d):
    p = F.col("sif_probability")
    left = _classified(spark, d).filter("final_sif_label is null").agg(F.count_if(p >= BANDS[0]).alias("remaining_likely"), F.count_if((p >= BANDS[1]) & (p < BANDS[0])).alias("remaining_uncertain"), F.count_if(p < BANDS[1]).alias("remaining_other"))
    one = lambda cond: F.countDistinct(F.when(cond, F.col("report_id")))
    seen = decisions(spark, d).agg(F.countDistinct("report_id").alias("reviewed"), one(F.col("analyst_label")).alias("confirmed"), one(F.col("review_action") == "OVERRIDE").alias("overridden"))
    return left.crossJoin(seen)  # two single rows


@REG.add("a16_pattern_metrics", ctes("r", "c", "t") + "SELECT activity, location_asset, count(DISTINCT report_id) AS report_count, count(DISTINCT CASE WHEN sif_label THEN report_id END) AS sif_count, count(DISTINCT site_id) AS site_count, round(max(sif_probability), 4) AS max_probability, round(count(DISTINCT CASE WHEN sif_label THEN report_id END) / count(DISTINCT report_id), 4) AS sif_rate FROM t LEFT JOIN c USING (report_id) GROUP BY 1, 2 HAVING count(DISTINCT report_id) >= 2")
def _(spark, d):
    """Patterns with at least two reports: the exact-triple clusters and their report metrics, in one grouped join."""
    n, s = F.countDistinct("report_id"), F.countDistinct(F.when(F.col("sif_label"), F.col("report_id")))
    return triples(spark, d).join(classifications(spark, d), "report_id", "left").groupBy("activity", "location_asset").agg(n.alias("report_count"), s.alias("sif_count"), F.countDistinct("site_id").alias("site_count"), F.round(F.max("sif_probability"), 4).alias("max_probability"), F.round(s / n, 4).alias("sif_rate")).filter("report_count >= 2")


@REG.add("f01_site_scope", ctes("r") + f"SELECT site_id, count(*) AS n FROM r WHERE site_id IN {IN_SCOPE} GROUP BY 1")
def _(spark, d):
    return scoped(reports(spark, d), SCOPE).groupBy("site_id").agg(F.count("*").alias("n"))


@REG.add("f01_empty_scope", ctes("r") + "SELECT id, site_id FROM r WHERE false")
def _(spark, d):
    return scoped(reports(spark, d), ()).select("id", "site_id")


@REG.add("f02_filters", ctes("r", "c") + "SELECT r.id, r.site_id, strftime(r.reported_at, '%Y-%m-%d') AS day FROM r WHERE CAST(r.reported_at AS DATE) BETWEEN DATE '2021-01-01' AND DATE '2022-06-30' AND r.department = 'Maintenance' AND EXISTS (SELECT 1 FROM c WHERE c.report_id = r.id AND c.sif_probability >= 0.5)")
def _(spark, d):
    return filtered(spark, d, reports(spark, d), "2021-01-01", "2022-06-30", department="Maintenance", min_confidence=0.5).select("id", "site_id", F.date_format("reported_at", "yyyy-MM-dd").alias("day"))


@REG.add("f03_status_groups", ctes("r") + """SELECT CASE WHEN lifecycle_status IN ('SUBMITTED', 'AI_ANALYZED', 'HSE_REVIEW', 'REOPENED') THEN 'PENDING_REVIEW' WHEN lifecycle_status IN ('CONFIRMED', 'OVERRIDDEN') THEN 'REVIEWED' WHEN lifecycle_status IN ('ACTION_ASSIGNED', 'IN_PROGRESS') THEN 'OPEN_ACTIONS' ELSE lifecycle_status END AS status_group, report_type, count(*) AS n FROM r GROUP BY 1, 2""")
def _(spark, d):
    s = F.col("lifecycle_status")
    group = F.when(s.isin("SUBMITTED", "AI_ANALYZED", "HSE_REVIEW", "REOPENED"), "PENDING_REVIEW").when(s.isin("CONFIRMED", "OVERRIDDEN"), "REVIEWED").when(s.isin("ACTION_ASSIGNED", "IN_PROGRESS"), "OPEN_ACTIONS").otherwise(s)
    return reports(spark, d).groupBy(group.alias("status_group"), "report_type").agg(F.count("*").alias("n"))


@REG.add("f04_decision_log", ctes("d") + "SELECT id, analyst_id, review_action, strftime(reviewed_at, '%Y-%m-%d %H:%M:%S') AS at FROM d WHERE review_action = 'OVERRIDE' AND reviewed_at >= TIMESTAMP '2023-01-01' AND reviewed_at < TIMESTAMP '2024-01-01' ORDER BY reviewed_at DESC, id DESC LIMIT 500")
def _(spark, d):
    """The log by action and date range, newest 500."""
    at = F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss").alias("at")
    return decisions(spark, d).filter("review_action = 'OVERRIDE' and reviewed_at >= timestamp'2023-01-01' and reviewed_at < timestamp'2024-01-01'").orderBy(F.desc("reviewed_at"), F.desc("id")).limit(500).select("id", "analyst_id", "review_action", at)


@REG.add("f06_visible_patterns", ctes("r", "t") + f"SELECT DISTINCT activity, location_asset FROM t WHERE EXISTS (SELECT 1 FROM r WHERE r.id = t.report_id AND r.site_id IN {IN_SCOPE})")
def _(spark, d):
    mine = scoped(reports(spark, d), SCOPE).select(F.col("id").alias("report_id"))
    return triples(spark, d).join(mine, "report_id", "left_semi").select("activity", "location_asset").distinct()


@REG.add("f07_report_summary", ctes("r", "t", "d") + """, l AS (SELECT report_id, review_action FROM d QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY reviewed_at DESC, id DESC) = 1)
  SELECT r.id, CASE WHEN length(raw_text) > 180 THEN substring(raw_text, 1, 180) || '…' ELSE raw_text END AS excerpt, t.activity || ' | ' || t.location_asset || ' | ' || t.barrier_failure AS pattern, coalesce(l.review_action, 'NONE') AS last_action, coalesce(r.validated_label, r.human_label) AS label FROM r LEFT JOIN t ON t.report_id = r.id LEFT JOIN l ON l.report_id = r.id""")
def _(spark, d):
    excerpt = F.when(F.length("raw_text") > 180, F.concat(F.substring("raw_text", 1, 180), F.lit("…"))).otherwise(F.col("raw_text"))
    last = decisions(spark, d).groupBy(F.col("report_id").alias("id")).agg(F.max_by("review_action", F.struct("reviewed_at", "id")).alias("review_action"))
    pattern = triples(spark, d).select(F.col("report_id").alias("id"), F.concat_ws(" | ", "activity", "location_asset", "barrier_failure").alias("pattern"))
    made = reports_of(spark, d, excerpt.alias("excerpt"), "validated_label", "human_label")
    return made.join(pattern, "id", "left").join(last, "id", "left").select("id", "excerpt", "pattern", F.coalesce("review_action", F.lit("NONE")).alias("last_action"), F.coalesce("validated_label", "human_label").alias("label"))


@REG.add("f08_report_detail", ctes("r", "d") + "SELECT r.id, count(d.id) AS n_decisions, coalesce(string_agg(d.review_action || ':' || d.analyst_id, ',' ORDER BY d.reviewed_at, d.id), '') AS history FROM r LEFT JOIN d ON d.report_id = r.id GROUP BY r.id")
def _(spark, d):
    """Children are packed per report first, then joined: the parent never multiplies."""
    packed = decisions(spark, d).groupBy(F.col("report_id").alias("id")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("reviewed_at", F.col("id").alias("k"), F.concat("review_action", F.lit(":"), "analyst_id").alias("x")))).alias("all"))
    return reports(spark, d).select("id").join(packed, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_decisions"), F.coalesce(F.array_join(F.transform("all", lambda s: s["x"]), ","), F.lit("")).alias("history"))


@REG.add("f11_decision_bands", ctes("c") + "SELECT CASE WHEN sif_probability >= 0.55 THEN 'SIF_LIKELY' WHEN sif_probability >= 0.35 THEN 'UNCERTAIN' ELSE 'NON_SIF' END AS state, count(*) AS n, round(min(sif_probability), 4) AS low, round(max(sif_probability), 4) AS high FROM c GROUP BY 1")
def _(spark, d):
    p = F.least(F.greatest(F.col("sif_probability"), F.lit(0.0)), F.lit(1.0))
    state = F.when(p >= BANDS[0], "SIF_LIKELY").when(p >= BANDS[1], "UNCERTAIN").otherwise("NON_SIF")
    return classifications(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.round(F.min(p), 4).alias("low"), F.round(F.max(p), 4).alias("high"))


@REG.add("f20_department_options", "SELECT DISTINCT department FROM reports WHERE trim(coalesce(department, '')) <> ''")
def _(spark, d):
    return table(spark, d, "reports").select("department").filter("trim(coalesce(department, '')) != ''").distinct()


@REG.add("f21_sites_in_scope", f"SELECT id, name, region FROM sites WHERE id IN {IN_SCOPE}")
def _(spark, d):
    return table(spark, d, "sites").filter(F.col("id").isin(*SCOPE)).select("id", "name", "region").orderBy("name")


@REG.add("j03_review_sites", ctes("r", "v") + "SELECT coalesce(s.name, 'Unknown') AS site_name, count(*) AS n_reviews FROM v JOIN r ON r.id = v.report_id LEFT JOIN sites s ON s.id = r.site_id GROUP BY 1")
def _(spark, d):
    sites = table(spark, d, "sites").select(F.col("id").alias("site_id"), "name")
    rep = reports(spark, d).select(F.col("id").alias("report_id"), "site_id")
    return reviews(spark, d).select("report_id").join(rep, "report_id").join(sites, "site_id", "left").groupBy(F.coalesce("name", F.lit("Unknown")).alias("site_name")).agg(F.count("*").alias("n_reviews"))


@REG.add("j06_reviewed_reports", ctes("r", "d") + "SELECT report_type, count(*) AS n FROM r WHERE id IN (SELECT report_id FROM d WHERE analyst_label) GROUP BY 1")
def _(spark, d):
    yes = decisions(spark, d).filter("analyst_label").select(F.col("report_id").alias("id"))
    return reports(spark, d).select("id", "report_type").join(yes, "id", "left_semi").groupBy("report_type").agg(F.count("*").alias("n"))


@REG.add("j13_site_resolution", ctes("r") + "SELECT coalesce(a.id, b.id, 'site-001') AS resolved_site, count(*) AS n FROM (SELECT id, site_id, lower(trim(department)) AS key FROM r) x LEFT JOIN sites a ON a.id = x.site_id LEFT JOIN sites b ON lower(trim(b.name)) = x.key GROUP BY 1")
def _(spark, d):
    """By id, else by normalised name, else the default."""
    sites = table(spark, d, "sites")
    a, b = sites.select(F.col("id").alias("a_id")), sites.select(F.col("id").alias("b_id"), F.lower(F.trim("name")).alias("b_key"))
    x = reports(spark, d).select("site_id", F.lower(F.trim("department")).alias("key"))
    return x.join(a, F.col("site_id") == F.col("a_id"), "left").join(b, F.col("key") == F.col("b_key"), "left").groupBy(F.coalesce("a_id", "b_id", F.lit("site-001")).alias("resolved_site")).agg(F.count("*").alias("n"))


@REG.add("j15_unreviewed", ctes("r", "d") + "SELECT site_id, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.report_id = r.id) GROUP BY 1")
def _(spark, d):
    seen = decisions(spark, d).select(F.col("report_id").alias("id"))
    return reports(spark, d).select("id", "site_id").join(seen, "id", "left_anti").groupBy("site_id").agg(F.count("*").alias("n"))


@REG.add("l01_page", ctes("r") + "SELECT id, strftime(reported_at, '%Y-%m-%d %H:%M:%S') AS reported FROM r ORDER BY reported_at DESC, id LIMIT 25 OFFSET 50")
def _(spark, d):
    """The third page of 25: the page is the feature."""
    return reports(spark, d).orderBy(F.desc("reported_at"), "id").offset(50).limit(25).select("id", F.date_format("reported_at", "yyyy-MM-dd HH:mm:ss").alias("reported"))


@REG.add("l02_pattern_ranking", ctes("r", "t") + "SELECT activity, location_asset, n, rank() OVER (ORDER BY n DESC) AS place FROM (SELECT activity, location_asset, count(*) AS n FROM t GROUP BY 1, 2)")
def _(spark, d):
    """Rank by size. The ranks come from the distinct sizes, so no window runs over all patterns in one task."""
    sized = triples(spark, d).groupBy("activity", "location_asset").agg(F.count("*").alias("n"))
    sizes = sized.groupBy("n").agg(F.count("*").alias("k"))
    place = 1 + F.coalesce(F.sum("k").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sized.join(sizes.select("n", place.alias("place")), "n").select("activity", "location_asset", "n", "place")


@REG.add("l09_triage_order", ctes("r", "c") + "SELECT r.id, r.final_priority, round(c.sif_probability, 4) AS probability FROM r JOIN c ON c.report_id = r.id WHERE r.final_priority IS NOT NULL ORDER BY CASE r.final_priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, c.sif_probability DESC, r.id LIMIT 100")
def _(spark, d):
    p = F.col("final_priority")
    order = F.when(p == "CRITICAL", 0).when(p == "HIGH", 1).when(p == "MEDIUM", 2).otherwise(3)
    return _classified(spark, d).filter("final_priority is not null").orderBy(order, F.desc("sif_probability"), "id").limit(100).select("id", "final_priority", F.round("sif_probability", 4).alias("probability"))


QUERIES, SQL = REG.queries, REG.sql
