"""Model monitoring, evaluation metrics, rater agreement and window idioms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardloom.plans.dashboard import share
from hazardloom.plans.views import Registry, classifications, ctes, decisions, reports, reviews, triples
from hazardloom.storage import table

REG = Registry()
AS_OF = "2025-06-01"

#: Evaluation rows: the true label of a report and the model's probability.
EV = ctes("r", "c") + ", e AS (SELECT r.id, r.site_id, r.department, r.report_type, r.final_sif_label AS y, c.sif_probability AS p FROM r JOIN c ON c.report_id = r.id WHERE r.final_sif_label IS NOT NULL)"


def evaluation(spark, d) -> DataFrame:
    c = classifications(spark, d).select(F.col("report_id").alias("id"), F.col("sif_probability").alias("p"))
    return reports(spark, d).filter("final_sif_label is not null").select("id", "site_id", "department", "report_type", F.col("final_sif_label").alias("y")).join(c, "id")


def _cells(y: Column, hat: Column) -> dict[str, Column]:
    return {"tp": F.count_if(hat & y), "fp": F.count_if(hat & ~y), "fn": F.count_if(~hat & y), "tn": F.count_if(~hat & ~y)}


def kappa(n: Column, a: Column, b: Column, c: Column, dd: Column) -> Column:
    """Cohen's kappa from the four cells; 1 where chance agreement is complete."""
    po = (a + dd) / n
    pe = ((a + b) * (a + c) + (c + dd) * (b + dd)) / (n * n)
    return F.when(n == 0, None).when(pe >= 1, 1.0).otherwise(F.round((po - pe) / (1 - pe), 4))


def _kappa_sql(n: str, a: str, b: str, c: str, d: str) -> str:
    pe = f"((({a} + {b}) * ({a} + {c}) + ({c} + {d}) * ({b} + {d})) / ({n} * {n}))"
    return f"CASE WHEN {n} = 0 THEN NULL WHEN {pe} >= 1 THEN 1.0 ELSE round((({a} + {d}) / {n} - {pe}) / (1 - {pe}), 4) END"


@REG.add("a10_model_health", ctes("v") + ", x AS (SELECT count(*) AS n, count(*) FILTER (ai_label AND final_label) AS tp, count(*) FILTER (ai_label AND NOT final_label) AS fp, count(*) FILTER (NOT ai_label AND final_label) AS fn, count(*) FILTER (NOT ai_label AND NOT final_label) AS tn FROM v) SELECT n, tp, fp, fn, tn, round((tp + tn) / n, 4) AS agreement, CASE WHEN fp + tn = 0 THEN 0.0 ELSE round(fp / (fp + tn), 4) END AS fpr, CASE WHEN fn + tp = 0 THEN 0.0 ELSE round(fn / (fn + tp), 4) END AS fnr, " + _kappa_sql("n", "tp", "fp", "fn", "tn") + " AS kappa, n < 10 AS insufficient FROM x")
def _(spark, d):
    """Confusion matrix, rates and kappa of model against analysts, in one aggregate."""
    x = reviews(spark, d).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in _cells(F.col("final_label"), F.col("ai_label")).items()))
    n, tp, fp, fn, tn = (F.col(c) for c in ("n", "tp", "fp", "fn", "tn"))
    return x.select("n", "tp", "fp", "fn", "tn", F.round((tp + tn) / n, 4).alias("agreement"), share(fp, fp + tn, 4).alias("fpr"), share(fn, fn + tp, 4).alias("fnr"), kappa(n, tp, fp, fn, tn).alias("kappa"), (n < 10).alias("insufficient"))


@REG.add("a11_errors_by_site", ctes("r", "v") + "SELECT coalesce(s.name, 'Unknown') AS site_name, count(*) FILTER (ai_label AND NOT final_label) AS fp, count(*) FILTER (NOT ai_label AND final_label) AS fn FROM v JOIN r ON r.id = v.report_id LEFT JOIN sites s ON s.id = r.site_id WHERE ai_label <> final_label GROUP BY 1")
def _(spark, d):
    wrong = reviews(spark, d).filter("ai_label != final_label").join(reports(spark, d).select(F.col("id").alias("report_id"), "site_id"), "report_id")
    sites = table(spark, d, "sites").select(F.col("id").alias("site_id"), "name")
    return wrong.join(sites, "site_id", "left").groupBy(F.coalesce("name", F.lit("Unknown")).alias("site_name")).agg(F.count_if("ai_label").alias("fp"), F.count_if("final_label").alias("fn"))


@REG.add("a11_latest_errors", ctes("r", "v") + "SELECT * FROM (SELECT v.id, CASE WHEN ai_label THEN 'fp' ELSE 'fn' END AS kind, substring(r.raw_text, 1, 200) AS excerpt FROM v JOIN r ON r.id = v.report_id WHERE ai_label <> final_label QUALIFY row_number() OVER (PARTITION BY ai_label ORDER BY v.reviewed_at DESC, v.id DESC) <= 50)")
def _(spark, d):
    """The newest 50 errors of each kind: two ordered limits, which never sort a whole kind in one task."""
    wrong = reviews(spark, d).filter("ai_label != final_label")
    newest = [wrong.filter(F.col("ai_label") == is_fp).orderBy(F.desc("reviewed_at"), F.desc("id")).limit(50).withColumn("kind", F.lit("fp" if is_fp else "fn")) for is_fp in (True, False)]
    texts = reports(spark, d).select(F.col("id").alias("report_id"), F.substring("raw_text", 1, 200).alias("excerpt"))
    return newest[0].union(newest[1]).select("id", "report_id", "kind").join(texts, "report_id").select("id", "kind", "excerpt")


_F1 = "round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 4)"


@REG.add("a12_version_drift", ctes("v") + f", m AS (SELECT strftime(reviewed_at, '%Y-%m') AS run, count(*) FILTER (ai_label AND final_label) AS tp, count(*) FILTER (ai_label AND NOT final_label) AS fp, count(*) FILTER (NOT ai_label AND final_label) AS fn FROM v GROUP BY 1), f AS (SELECT run, {_F1} AS f1 FROM m) SELECT run, f1, lag(f1) OVER (ORDER BY run) AS previous_f1, coalesce(f1 < lag(f1) OVER (ORDER BY run), false) AS regression FROM f")
def _(spark, d):
    """Monthly runs and whether f1 fell; the window is over the handful of runs."""
    runs = reviews(spark, d).groupBy(F.date_format("reviewed_at", "yyyy-MM").alias("run")).agg(*(c.alias(k) for k, c in _cells(F.col("final_label"), F.col("ai_label")).items()))
    f1 = F.round(F.try_divide(2.0 * F.col("tp"), F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))), 4)
    before = F.lag("f1").over(W.orderBy("run"))
    return runs.select("run", f1.alias("f1")).select("run", "f1", before.alias("previous_f1"), F.coalesce(F.col("f1") < before, F.lit(False)).alias("regression"))


@REG.add("a13_resolution", ctes("r") + "SELECT strftime(resolved_at, '%Y-%m') AS month, count(*) AS n_resolved, round(avg(epoch(resolved_at - reported_at) / 86400.0), 1) AS mean_days FROM r WHERE lifecycle_status = 'RESOLVED' AND resolved_at IS NOT NULL AND reported_at IS NOT NULL GROUP BY 1")
def _(spark, d):
    days = (F.unix_seconds("resolved_at") - F.unix_seconds("reported_at")) / 86400.0
    return reports(spark, d).filter("lifecycle_status = 'RESOLVED' and resolved_at is not null and reported_at is not null").groupBy(F.date_format("resolved_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_resolved"), F.round(F.avg(days), 1).alias("mean_days"))


@REG.add("a13_half_split", ctes("r", "c") + ", x AS (SELECT c.sif_label, row_number() OVER (ORDER BY r.reported_at, r.id) AS k, count(*) OVER () AS n FROM r JOIN c ON c.report_id = r.id) SELECT CASE WHEN k <= n // 2 THEN 'first' ELSE 'second' END AS half, count(*) AS n_reports, round(count(*) FILTER (sif_label) / count(*), 4) AS sif_rate FROM x GROUP BY 1")
def _(spark, d):
    """Share of serious reports in the earlier and the later half.

    The middle row is found by counting days, then by ranking within the one day that holds it: no global sort.
    """
    j = reports(spark, d).join(classifications(spark, d).withColumnRenamed("report_id", "id"), "id").select("id", "reported_at", "sif_label").withColumn("day", F.to_date("reported_at"))
    days = j.groupBy("day").agg(F.count("*").alias("k"))
    w = W.orderBy("day")
    days = days.withColumn("through", F.sum("k").over(w)).withColumn("half", F.floor(F.sum("k").over(W.partitionBy()) / 2))
    placed = j.join(days, "day").withColumn("start", F.col("through") - F.col("k"))
    split = placed.filter("start < half and through > half").withColumn("first", F.row_number().over(W.partitionBy("day").orderBy("reported_at", "id")) + F.col("start") <= F.col("half"))
    whole = placed.filter("not (start < half and through > half)").withColumn("first", F.col("through") <= F.col("half"))
    both = split.select("first", "sif_label").union(whole.select("first", "sif_label"))
    return both.groupBy(F.when(F.col("first"), "first").otherwise("second").alias("half")).agg(F.count("*").alias("n_reports"), F.round(F.count_if("sif_label") / F.count("*"), 4).alias("sif_rate"))


@REG.add("a14_agreement_trend", ctes("v") + "SELECT strftime(reviewed_at, '%Y-%m') AS month, count(*) AS total, round(count(*) FILTER (ai_label = final_label) / count(*), 4) AS agree_rate, round(count(*) FILTER (ai_label AND NOT final_label) / count(*), 4) AS fp_rate, round(count(*) FILTER (NOT ai_label AND final_label) / count(*), 4) AS fn_rate FROM v GROUP BY 1")
def _(spark, d):
    n, cells = F.count("*"), _cells(F.col("final_label"), F.col("ai_label"))
    return reviews(spark, d).groupBy(F.date_format("reviewed_at", "yyyy-MM").alias("month")).agg(n.alias("total"), F.round((cells["tp"] + cells["tn"]) / n, 4).alias("agree_rate"), F.round(cells["fp"] / n, 4).alias("fp_rate"), F.round(cells["fn"] / n, 4).alias("fn_rate"))


_METRICS_SQL = "count(*) AS n, tp, fp, fn, tn"


def _metrics(df: DataFrame, keys: list[str], threshold: Column, digits: int = 4) -> DataFrame:
    cells = df.groupBy(*keys).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in _cells(F.col("y"), F.col("p") >= threshold).items()))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(*keys, "n", "tp", "fp", "fn", "tn", F.round((tp + tn) / F.col("n"), digits).alias("accuracy"), share(tp, tp + fp, digits).alias("precision"), share(tp, tp + fn, digits).alias("recall"), share(2 * tp, 2 * tp + fp + fn, digits).alias("f1"), share(tn, tn + fp, digits).alias("specificity"))


def _metrics_sql(keys: str, source: str, threshold: str, digits: int = 4) -> str:
    group = f"{keys}, " if keys else ""
    r = lambda a, b, name: f"CASE WHEN {b} = 0 THEN 0.0 ELSE round({a} / ({b}), {digits}) END AS {name}"
    return f", x AS (SELECT {group}count(*) AS n, count(*) FILTER (p >= {threshold} AND y) AS tp, count(*) FILTER (p >= {threshold} AND NOT y) AS fp, count(*) FILTER (p < {threshold} AND y) AS fn, count(*) FILTER (p < {threshold} AND NOT y) AS tn FROM {source} {'GROUP BY ' + keys if keys else ''}) SELECT {group}n, tp, fp, fn, tn, round((tp + tn) / n, {digits}) AS accuracy, {r('tp', 'tp + fp', 'precision')}, {r('tp', 'tp + fn', 'recall')}, {r('2 * tp', '2 * tp + fp + fn', 'f1')}, {r('tn', 'tn + fp', 'specificity')} FROM x"


@REG.add("a20_evaluation_metrics", EV + _metrics_sql("", "e", "0.5"))
def _(spark, d):
    return _metrics(evaluation(spark, d), [], F.lit(0.5))


@REG.add("a21_metrics_by_threshold", EV + ", th AS (SELECT (10 + 5 * i) / 100.0 AS threshold FROM range(17) t(i)), et AS (SELECT CAST(threshold AS DOUBLE) AS threshold, y, p FROM e, th)" + _metrics_sql("threshold", "et", "threshold", 3))
def _(spark, d):
    """All thresholds from .10 to .90: every row meets a constant array of 17, no join."""
    grid = F.array(*(F.lit((10 + 5 * i) / 100.0) for i in range(17)))
    return _metrics(evaluation(spark, d).withColumn("threshold", F.explode(grid)), ["threshold"], F.col("threshold"), 3)


@REG.add("a22_brier_logloss", EV + " SELECT count(*) AS n, round(avg((p - y::INT) * (p - y::INT)), 4) AS brier, round(avg(-(y::INT * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - y::INT) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)))), 4) AS log_loss FROM e")
def _(spark, d):
    y, p = F.col("y").cast("int"), F.col("p")
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return evaluation(spark, d).agg(F.count("*").alias("n"), F.round(F.avg((p - y) * (p - y)), 4).alias("brier"), F.round(F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))), 4).alias("log_loss"))


_BINS = ", b AS (SELECT least(floor(p * 5), 4)::INT AS bin, count(*) AS n, avg(p) AS confidence, avg(y::INT) AS observed FROM e GROUP BY 1)"


def _bins(spark, d) -> DataFrame:
    return evaluation(spark, d).groupBy(F.least(F.floor(F.col("p") * 5), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg(F.col("y").cast("int")).alias("observed"))


@REG.add("a23_calibration_error", EV + _BINS + " SELECT round(sum(n * abs(observed - confidence)) / sum(n), 4) AS ece FROM b")
def _(spark, d):
    return _bins(spark, d).agg(F.round(F.sum(F.col("n") * F.abs(F.col("observed") - F.col("confidence"))) / F.sum("n"), 4).alias("ece"))


@REG.add("a25_calibration_curve", EV + _BINS + " SELECT bin, n, round(confidence, 4) AS confidence, round(observed, 4) AS observed FROM b")
def _(spark, d):
    return _bins(spark, d).select("bin", "n", F.round("confidence", 4).alias("confidence"), F.round("observed", 4).alias("observed"))


@REG.add("a26_auc", EV + """, g AS (SELECT p, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM e GROUP BY p), k AS (SELECT p, pos, neg, sum(neg) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) - neg AS below, sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(pos + neg) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS taken FROM g)
  SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / taken) / sum(pos), 6) AS pr_auc FROM k""")
def _(spark, d):
    """Rank form over distinct scores: running sums within a thousandth of the scale, which carry on from the sums of
    the thousandths before; only those (at most 1,001 rows) are ordered in one task."""
    g = evaluation(spark, d).groupBy("p").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    g = g.withColumn("bin", F.floor(F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)) * 1000).cast("int"))
    bins = g.groupBy("bin").agg(F.sum("pos").alias("bin_pos"), F.sum("neg").alias("bin_neg"))
    before, after = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    bins = bins.select("bin", zero(F.sum("bin_neg").over(before)).alias("neg_below"), zero(F.sum("bin_pos").over(after)).alias("pos_above"), zero(F.sum(F.col("bin_pos") + F.col("bin_neg")).over(after)).alias("above"))
    up = W.partitionBy("bin").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("bin").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    k = g.join(F.broadcast(bins), "bin").select(
        "pos", "neg", (F.col("neg_below") + F.sum("neg").over(up) - F.col("neg")).alias("below"), (F.col("pos_above") + F.sum("pos").over(down)).alias("tp"), (F.col("above") + F.sum(F.col("pos") + F.col("neg")).over(down)).alias("taken")
    )
    roc = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg"))
    return k.agg(F.round(roc, 6).alias("roc_auc"), F.round(F.sum(F.col("pos") * F.col("tp") / F.col("taken")) / F.sum("pos"), 6).alias("pr_auc"))


@REG.add("a27_segment_evaluation", EV + ", s AS (SELECT 'site_id' AS dimension, site_id AS segment, y, p FROM e UNION ALL SELECT 'department', department, y, p FROM e UNION ALL SELECT 'report_type', report_type, y, p FROM e), q AS (SELECT * FROM s WHERE segment IS NOT NULL)" + _metrics_sql("dimension, segment", "q", "0.5"))
def _(spark, d):
    e = evaluation(spark, d).unpivot(["y", "p"], ["site_id", "department", "report_type"], "dimension", "segment")
    return _metrics(e.filter("segment is not null"), ["dimension", "segment"], F.lit(0.5))


@REG.add("a29_kappa_pairs", ctes("d") + ", l AS (SELECT report_id, analyst_id, analyst_label FROM d WHERE analyst_label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report_id, analyst_id ORDER BY reviewed_at DESC, id DESC) = 1), x AS (SELECT a.analyst_id AS rater_a, b.analyst_id AS rater_b, count(*) AS n, count(*) FILTER (a.analyst_label AND b.analyst_label) AS yy, count(*) FILTER (a.analyst_label AND NOT b.analyst_label) AS yn, count(*) FILTER (NOT a.analyst_label AND b.analyst_label) AS ny, count(*) FILTER (NOT a.analyst_label AND NOT b.analyst_label) AS nn FROM l a JOIN l b ON a.report_id = b.report_id AND a.analyst_id < b.analyst_id GROUP BY 1, 2) SELECT rater_a, rater_b, n, " + _kappa_sql("n", "yy", "yn", "ny", "nn") + " AS kappa FROM x WHERE n >= 5")
def _(spark, d):
    """Agreement of every two raters with five common reports; raters of one report are few, so pairs stay within it."""
    last = decisions(spark, d).filter("analyst_label is not null").groupBy("report_id", "analyst_id").agg(F.max_by("analyst_label", F.struct("reviewed_at", "id")).alias("x"))
    a, b = last.select("report_id", F.col("analyst_id").alias("rater_a"), F.col("x").alias("xa")), last.select("report_id", F.col("analyst_id").alias("rater_b"), F.col("x").alias("xb"))
    both = a.join(b, "report_id").filter("rater_a < rater_b").groupBy("rater_a", "rater_b").agg(F.count("*").alias("n"), *(c.alias(k) for k, c in {"yy": F.count_if(F.expr("xa and xb")), "yn": F.count_if(F.expr("xa and not xb")), "ny": F.count_if(F.expr("not xa and xb")), "nn": F.count_if(F.expr("not xa and not xb"))}.items()))
    return both.filter("n >= 5").select("rater_a", "rater_b", "n", kappa(F.col("n"), F.col("yy"), F.col("yn"), F.col("ny"), F.col("nn")).alias("kappa"))


@REG.add("a30_first_two_reviewers", ctes("d") + """, f AS (SELECT report_id, analyst_id, min(reviewed_at) AS first_at, arg_max(analyst_label, (reviewed_at, id)) AS x FROM d WHERE analyst_label IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY first_at, analyst_id) AS n FROM f), p AS (SELECT report_id, max(CASE WHEN n = 1 THEN x::INT END) AS a, max(CASE WHEN n = 2 THEN x::INT END) AS b FROM k WHERE n <= 2 GROUP BY 1 HAVING count(*) = 2)
  SELECT count(*) AS n_reports, count(*) FILTER (a = b) AS n_agree, round(count(*) FILTER (a = b) / count(*), 4) AS agreement FROM p""")
def _(spark, d):
    first = decisions(spark, d).filter("analyst_label is not null").groupBy("report_id", "analyst_id").agg(F.min("reviewed_at").alias("first_at"), F.max_by("analyst_label", F.struct("reviewed_at", "id")).alias("x"))
    k = first.withColumn("n", F.row_number().over(W.partitionBy("report_id").orderBy("first_at", "analyst_id"))).filter("n <= 2")
    p = k.groupBy("report_id").agg(F.max(F.when(F.col("n") == 1, F.col("x"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("x"))).alias("b")).filter("b is not null")
    same = F.count_if(F.col("a") == F.col("b"))
    return p.agg(F.count("*").alias("n_reports"), same.alias("n_agree"), F.round(same / F.count("*"), 4).alias("agreement"))


@REG.add("a31_mode_by_site", ctes("r") + "SELECT site_id, shift AS mode_shift, n FROM (SELECT site_id, lower(trim(shift)) AS shift, count(*) AS n FROM r WHERE shift IS NOT NULL AND site_id IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY n DESC, shift) = 1")
def _(spark, d):
    """Most frequent value, ties to the smaller one: two map-side combined aggregates."""
    n = reports(spark, d).filter("shift is not null and site_id is not null").groupBy("site_id", F.lower(F.trim("shift")).alias("shift")).agg(F.count("*").alias("n"))
    best = n.groupBy("site_id").agg(F.min_by(F.struct("shift", "n"), F.struct(-F.col("n"), "shift")).alias("s"))
    return best.select("site_id", F.col("s.shift").alias("mode_shift"), F.col("s.n").alias("n"))


@REG.add("a32_activity_histogram", ctes("t") + "SELECT activity, count(*) AS n FROM t GROUP BY 1")
def _(spark, d):
    return triples(spark, d).groupBy("activity").agg(F.count("*").alias("n"))


@REG.add("w01_latest_decision", ctes("d") + "SELECT report_id, id, review_action FROM d QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY reviewed_at DESC, id DESC) = 1")
def _(spark, d):
    """Latest per key as an aggregate, which combines before the shuffle; a window would sort every key whole."""
    last = decisions(spark, d).groupBy("report_id").agg(F.max_by(F.struct("id", "review_action"), F.struct("reviewed_at", "id")).alias("s"))
    return last.select("report_id", "s.id", "s.review_action")


@REG.add("w03_latest_per_reviewer", ctes("d") + "SELECT report_id, analyst_id, analyst_label FROM d WHERE analyst_label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report_id, analyst_id ORDER BY reviewed_at DESC, id DESC) = 1")
def _(spark, d):
    return decisions(spark, d).filter("analyst_label is not null").groupBy("report_id", "analyst_id").agg(F.max_by("analyst_label", F.struct("reviewed_at", "id")).alias("analyst_label"))


@REG.add("w04_next_version", ctes("r", "d") + "SELECT r.id, count(d.id) + 1 AS next_version FROM r LEFT JOIN d ON d.report_id = r.id GROUP BY 1")
def _(spark, d):
    seen = decisions(spark, d).groupBy(F.col("report_id").alias("id")).agg(F.count("*").alias("v"))
    return reports(spark, d).select("id").join(seen, "id", "left").select("id", (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


@REG.add("w08_duplicate_deliveries", "SELECT id, count(*) - 1 AS n_repeats FROM reports GROUP BY id HAVING count(*) > 1")
def _(spark, d):
    return table(spark, d, "reports").groupBy("id").agg((F.count("*") - 1).alias("n_repeats")).filter("n_repeats > 0")


@REG.add("w10_pattern_trend", ctes("t") + f", k AS (SELECT activity, location_asset, count(*) FILTER (reported_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND reported_at <= TIMESTAMP '{AS_OF}') AS recent, count(*) FILTER (reported_at > TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND reported_at <= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS older FROM t GROUP BY 1, 2) SELECT activity, location_asset, recent, older, CASE WHEN recent > older + 1 THEN 'growing' WHEN recent + 1 < older THEN 'shrinking' ELSE 'stable' END AS trend FROM k")
def _(spark, d):
    """Last 30 days against the 30 before, relative to a given date."""
    at, ts = F.lit(AS_OF).cast("timestamp"), F.col("reported_at")
    day30, day60 = at - F.expr("interval 30 days"), at - F.expr("interval 60 days")
    k = triples(spark, d).groupBy("activity", "location_asset").agg(F.count_if((ts > day30) & (ts <= at)).alias("recent"), F.count_if((ts > day60) & (ts <= day30)).alias("older"))
    return k.withColumn("trend", F.when(F.col("recent") > F.col("older") + 1, "growing").when(F.col("recent") + 1 < F.col("older"), "shrinking").otherwise("stable"))


@REG.add("w11_top3_per_site", ctes("t") + "SELECT site_id, activity, location_asset, n, place FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, activity, location_asset) AS place FROM (SELECT site_id, activity, location_asset, count(*) AS n FROM t WHERE site_id IS NOT NULL GROUP BY 1, 2, 3)) WHERE place <= 3")
def _(spark, d):
    """Three largest patterns of each site, ranked after aggregation."""
    n = triples(spark, d).filter("site_id is not null").groupBy("site_id", "activity", "location_asset").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("site_id").orderBy(F.desc("n"), "activity", "location_asset"))).filter("place <= 3")


@REG.add("l07_timeline", ctes("r", "d") + "SELECT report_id, kind, strftime(ev, '%Y-%m-%d %H:%M:%S') AS happened FROM (SELECT id AS report_id, 'reported' AS kind, reported_at AS ev FROM r UNION ALL SELECT id, 'ingested', ingested_at FROM r UNION ALL SELECT id, 'resolved', resolved_at FROM r WHERE resolved_at IS NOT NULL UNION ALL SELECT report_id, lower(review_action), reviewed_at FROM d)")
def _(spark, d):
    """Union of the event kinds of all reports."""
    r = reports(spark, d)
    one = lambda df, key, kind, at: df.select(F.col(key).alias("report_id"), kind.alias("kind"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("happened"))
    return one(r, "id", F.lit("reported"), "reported_at").union(one(r, "id", F.lit("ingested"), "ingested_at")).union(one(r.filter("resolved_at is not null"), "id", F.lit("resolved"), "resolved_at")).union(one(decisions(spark, d), "report_id", F.lower("review_action"), "reviewed_at"))


@REG.add("t18_best_threshold", EV + ", th AS (SELECT (10 + 5 * i) / 100.0 AS threshold FROM range(17) t(i)), et AS (SELECT CAST(threshold AS DOUBLE) AS threshold, y, p FROM e, th), q AS (" + _metrics_sql("threshold", "et", "threshold", 3).replace(", x AS", "WITH x AS", 1) + ") SELECT threshold, f1, recall, precision FROM q ORDER BY (recall >= 0.85) DESC, CASE WHEN recall >= 0.85 THEN f1 ELSE recall END DESC, recall DESC, precision DESC, abs(threshold - 0.45), threshold LIMIT 1")
def _(spark, d):
    """Threshold with recall of .85 and the best f1, else the best recall; among 17 rows."""
    grid = F.array(*(F.lit((10 + 5 * i) / 100.0) for i in range(17)))
    q = _metrics(evaluation(spark, d).withColumn("threshold", F.explode(grid)), ["threshold"], F.col("threshold"), 3)
    good = F.col("recall") >= 0.85
    order = F.struct((~good).alias("a"), (-F.when(good, F.col("f1")).otherwise(F.col("recall"))).alias("b"), (-F.col("recall")).alias("c"), (-F.col("precision")).alias("e"), F.abs(F.col("threshold") - 0.45).alias("f"), F.col("threshold").alias("g"))
    return q.agg(F.min_by(F.struct("threshold", "f1", "recall", "precision"), order).alias("s")).select("s.*")


QUERIES, SQL = REG.queries, REG.sql
