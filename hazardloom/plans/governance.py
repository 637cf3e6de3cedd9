"""Label governance, evaluation corpora, projections and the remaining listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardloom.functions import fixed_values as V
from hazardloom.functions import text as X
from hazardloom.plans import ingestion, texts
from hazardloom.plans.monitoring import EV, _metrics, _metrics_sql, evaluation
from hazardloom.plans.views import Registry, classifications, ctes, decisions, reports, reports_of, triples
from hazardloom.storage import Workspace, table

REG = Registry()
R = ctes("r")
_RULES = ", ".join(f"('{r}', '{n}')" for r, (n, _) in X.RULES.items())


def _rule_names():
    return F.create_map(*(F.lit(x) for r, (n, _) in X.RULES.items() for x in (r, n)))


@REG.add("t33_rule_catalogue", f"SELECT * FROM (VALUES {_RULES}) t(rule_id, rule_name)")
def _(spark, d):
    return spark.createDataFrame([(r, n) for r, (n, _) in X.RULES.items()], "rule_id string, rule_name string")


@REG.add("f09_tag_projection", R + f", {texts._TAGS}, rules(rule_id, rule_name) AS (VALUES {_RULES}) SELECT id, rule_id || ' ' || rule_name AS tag, hits FROM tags JOIN rules USING (rule_id) WHERE hits > 0")
def _(spark, d):
    """Tags with their rule names, looked up in a literal map instead of a join."""
    return texts._tags(spark, d).select("id", F.concat_ws(" ", "rule_id", F.element_at(_rule_names(), F.col("rule_id"))).alias("tag"), "hits")


@REG.add("f10_classification", ctes("c") + "SELECT report_id, round(sif_probability, 4) AS probability, sif_label, sif_probability >= 0.35 AND sif_probability < 0.55 AS needs_review FROM c")
def _(spark, d):
    p = F.col("sif_probability")
    return classifications(spark, d).select("report_id", F.round(p, 4).alias("probability"), "sif_label", ((p >= 0.35) & (p < 0.55)).alias("needs_review"))


@REG.add("f14_contamination", "SELECT id FROM incident_records WHERE lower(data_type) IN ('synthetic', 'demo') AND upper(label_source) = 'HUMAN_VALIDATED'")
def _(spark, d):
    """Synthetic rows that claim a human label: the rows an assertion would name."""
    return table(spark, d, "incident_records").filter(F.lower("data_type").isin("synthetic", "demo") & (F.upper("label_source") == "HUMAN_VALIDATED")).select("id")


_GATE = "CASE WHEN n < 10 OR tp + fn = 0 OR fp + tn = 0 THEN 'skipped' WHEN recall >= 0.70 AND precision >= 0.50 THEN 'passed' ELSE 'failed' END"


@REG.add("f15_segment_gates", EV + ", s AS (SELECT site_id AS segment, y, p FROM e WHERE site_id IS NOT NULL), m AS (" + _metrics_sql("segment", "s", "0.5").replace(", x AS", "WITH x AS", 1) + f") SELECT segment, n, {_GATE} AS gate FROM m")
def _(spark, d):
    m = _metrics(evaluation(spark, d).filter("site_id is not null").withColumnRenamed("site_id", "segment"), ["segment"], F.lit(0.5))
    return m.select("segment", "n", F.expr(_GATE).alias("gate"))


@REG.add("a24_log_loss", EV + " SELECT CASE WHEN min(y::INT) = max(y::INT) THEN NULL ELSE round(avg(-(y::INT * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - y::INT) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)))), 4) END AS log_loss FROM e")
def _(spark, d):
    y = F.col("y").cast("int")
    q = F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6))
    return evaluation(spark, d).agg(F.when(F.min(y) != F.max(y), F.round(F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))), 4)).alias("log_loss"))


@REG.add("a34_fold_balance", "WITH x AS (SELECT DISTINCT id, label FROM incident_records), k AS (SELECT id, label, ('0x' || substring(sha256(id), 1, 8))::BIGINT % 5 AS fold FROM x) SELECT fold, count(*) AS n, count(*) FILTER (label) AS n_positive FROM k GROUP BY 1")
def _(spark, d):
    """Five folds by a stable hash of the id: the same in every engine and at every size, without a global rank."""
    x = table(spark, d, "incident_records").select("id", "label").distinct()
    fold = F.pmod(F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("long"), F.lit(5)).alias("fold")
    return x.groupBy(fold).agg(F.count("*").alias("n"), F.count_if("label").alias("n_positive"))


@REG.add("a35_worst_errors", EV + " SELECT id, y, round(p, 4) AS p FROM e WHERE (p >= 0.5) <> y ORDER BY abs(p - y::INT) DESC, id LIMIT 50")
def _(spark, d):
    wrong = evaluation(spark, d).filter((F.col("p") >= 0.5) != F.col("y"))
    return wrong.orderBy(F.desc(F.abs(F.col("p") - F.col("y").cast("int"))), "id").limit(50).select("id", "y", F.round("p", 4).alias("p"))


@REG.add("a38_predictor_comparison", EV.replace("r.report_type, r.final_sif_label", "r.report_type, r.raw_text, r.final_sif_label") + ", b AS (SELECT report_type, y, 'model' AS predictor, p FROM e UNION ALL SELECT report_type, y, 'rules', CASE WHEN " + " OR ".join(texts._hit(w) for _, w in X.RULES.values()) + " THEN 1.0 ELSE 0.0 END FROM e)" + _metrics_sql("report_type, predictor", "b", "0.5"))
def _(spark, d):
    """Keyword rules against the model, per report type, from one pass with both predictions in a row."""
    said = F.when(F.size(X.rule_tags(F.col("raw_text"))) > 0, 1.0).otherwise(0.0)
    e = evaluation(spark, d).join(reports(spark, d).select("id", said.alias("rules")), "id").withColumnRenamed("p", "model")
    return _metrics(e.unpivot(["report_type", "y"], ["model", "rules"], "predictor", "p"), ["report_type", "predictor"], F.lit(0.5))


@REG.add("l05_last_decisions", ctes("d") + "SELECT id, analyst_id FROM d ORDER BY reviewed_at DESC, id DESC LIMIT 50")
def _(spark, d):
    return decisions(spark, d).orderBy(F.desc("reviewed_at"), F.desc("id")).limit(50).select("id", "analyst_id")


@REG.add("l08_preview", R + "SELECT id, substring(raw_text, 1, 200) AS excerpt FROM r ORDER BY id LIMIT 25")
def _(spark, d):
    return reports(spark, d).orderBy("id").limit(25).select("id", F.substring("raw_text", 1, 200).alias("excerpt"))


@REG.add("t24_consensus_state", ctes("d") + """, l AS (SELECT report_id, analyst_id, analyst_label AS x FROM d WHERE analyst_label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report_id, analyst_id ORDER BY reviewed_at DESC, id DESC) = 1)
  SELECT report_id, count(*) AS n_reviewers, CASE WHEN count(*) < 2 THEN 'PENDING' WHEN count(DISTINCT x) = 1 THEN 'VALIDATED' ELSE 'DISAGREEMENT' END AS state FROM l GROUP BY 1""")
def _(spark, d):
    """State of a report's labels from the latest label of each reviewer."""
    last = decisions(spark, d).filter("analyst_label is not null").groupBy("report_id", "analyst_id").agg(F.max_by("analyst_label", F.struct("reviewed_at", "id")).alias("x"))
    k = last.groupBy("report_id").agg(F.count("*").alias("n_reviewers"), F.countDistinct("x").alias("k"))
    return k.select("report_id", "n_reviewers", F.when(F.col("n_reviewers") < 2, "PENDING").when(F.col("k") == 1, "VALIDATED").otherwise("DISAGREEMENT").alias("state"))


@REG.add("t25_label_history", ctes("d") + "SELECT report_id, string_agg(CASE WHEN analyst_label THEN 'Y' ELSE 'N' END, '' ORDER BY reviewed_at, id) AS history, count(DISTINCT analyst_id) AS n_reviewers FROM d WHERE analyst_label IS NOT NULL GROUP BY 1")
def _(spark, d):
    x = F.when(F.col("analyst_label"), "Y").otherwise("N")
    k = decisions(spark, d).filter("analyst_label is not null").groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("reviewed_at", "id", x.alias("x")))).alias("h"), F.countDistinct("analyst_id").alias("n_reviewers"))
    return k.select("report_id", F.array_join(F.transform("h", lambda s: s["x"]), "").alias("history"), "n_reviewers")


_SOURCES = {"HUMAN_VALIDATED": "GOLD", "EXPERT": "GOLD", "IMPORTED": "SOURCE_TAXONOMY", "HEURISTIC": "WEAK", "SYNTHETIC": "DEMO"}


@REG.add("t30_label_source_map", "SELECT CASE upper(trim(label_source)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SOURCES.items()) + " ELSE 'UNKNOWN' END AS class, count(*) AS n FROM incident_records GROUP BY 1")
def _(spark, d):
    names = F.create_map(*(F.lit(x) for p in _SOURCES.items() for x in p))
    return table(spark, d, "incident_records").groupBy(F.coalesce(F.element_at(names, F.upper(F.trim("label_source"))), F.lit("UNKNOWN")).alias("class")).agg(F.count("*").alias("n"))


@REG.add("t32_exact_patterns", ctes("t") + "SELECT activity, location_asset, barrier_failure, count(*) AS n, min(report_id) AS first_report FROM t GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def _(spark, d):
    return triples(spark, d).groupBy("activity", "location_asset", "barrier_failure").agg(F.count("*").alias("n"), F.min("report_id").alias("first_report")).filter("n >= 2")


@REG.add("s21_group_manifest", "SELECT norm_text, min(id) AS root, count(DISTINCT id) AS n FROM incident_records WHERE norm_text <> '' GROUP BY 1 HAVING count(DISTINCT id) > 1")
def _(spark, d):
    """Groups of copies with more than one member, as the corpus manifest lists them."""
    return table(spark, d, "incident_records").filter("norm_text != ''").groupBy("norm_text").agg(F.min("id").alias("root"), F.countDistinct("id").alias("n")).filter("n > 1")


@REG.add("u06_vocabulary_overlap", "WITH x AS (SELECT DISTINCT id, label, norm_text FROM incident_records), w AS (SELECT DISTINCT id, label, unnest(string_split(norm_text, ' ')) AS w FROM x), v AS (SELECT DISTINCT w FROM w WHERE label) SELECT w.id, round(count(v.w) / count(*), 6) AS known_share FROM w LEFT JOIN v ON v.w = w.w WHERE NOT label GROUP BY 1")
def _(spark, d):
    """Share of a negative record's words that positive records use too."""
    w = table(spark, d, "incident_records").select("id", "label", "norm_text").distinct().select("id", "label", F.explode(F.split("norm_text", " ")).alias("w")).distinct()
    v = w.filter("label").select("w", F.lit(1).alias("known")).distinct()
    return w.filter("not label").join(v, "w", "left").groupBy("id").agg(F.round(F.count("known") / F.count("*"), 6).alias("known_share"))


@REG.add("w05_first_pattern", ctes("t") + "SELECT site_id, activity, location_asset FROM t WHERE site_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY reported_at, report_id) = 1")
def _(spark, d):
    first = triples(spark, d).filter("site_id is not null").groupBy("site_id").agg(F.min_by(F.struct("activity", "location_asset"), F.struct("reported_at", "report_id")).alias("s"))
    return first.select("site_id", "s.activity", "s.location_asset")


@REG.add("w09_capped_queue", R + "SELECT id, report_type FROM r WHERE final_sif_label IS NULL QUALIFY row_number() OVER (PARTITION BY report_type ORDER BY reported_at, id) <= 15")
def _(spark, d):
    """The first 15 open reports of each type. Ranks run within a day-sized share of a type before the final cut."""
    r = reports(spark, d).filter("final_sif_label is null").select("id", "report_type", "reported_at")
    part = F.date_trunc("month", "reported_at")
    near = r.withColumn("k", F.row_number().over(W.partitionBy("report_type", part).orderBy("reported_at", "id"))).filter("k <= 15")
    return near.withColumn("k", F.row_number().over(W.partitionBy("report_type").orderBy("reported_at", "id"))).filter("k <= 15").select("id", "report_type")


@REG.add("x22_challenge_votes", R + f"SELECT id, CAST({texts._named(V.DIRECT_CUES)} AS INT) + CAST({texts._named(V.INDIRECT_CUES)} AS INT) AS pos, CAST({texts._named(V.ROUTINE_CUES)} AND NOT {texts._named(V.DIRECT_CUES)} AS INT) AS neg FROM r")
def _(spark, d):
    t = F.col("raw_text")
    direct = X.named(t, V.DIRECT_CUES)
    pos = direct.cast("int") + X.named(t, V.INDIRECT_CUES).cast("int")
    return reports_of(spark, d, pos.alias("pos"), (X.named(t, V.ROUTINE_CUES) & ~direct).cast("int").alias("neg"))


def _fitted(train, share: float):
    """TF-IDF (1-2-grams, 5,000 features) and logistic regression with class weights, from (y, norm_text); ``share`` of positives."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, SQLTransformer, StopWordsRemover, Tokenizer

    train = train.withColumn("w", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    steps = [Tokenizer(inputCol="norm_text", outputCol="t0"), StopWordsRemover(inputCol="t0", outputCol="t1"), NGram(n=2, inputCol="t1", outputCol="t2"), SQLTransformer(statement="SELECT *, concat(t1, t2) AS t3 FROM __THIS__"), CountVectorizer(vocabSize=5000, minDF=2, inputCol="t3", outputCol="tf"), IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol="y", weightCol="w", maxIter=30, regParam=0.01)]
    return Pipeline(stages=steps).fit(train)


@REG.add("t16_trained_classifier")
def _(spark, d):
    """TF-IDF (1-2-grams, 5,000 features) and logistic regression with class weights, fitted on four folds of the texts,
    scored on the fifth: (id, label, probability). Folds go by text, so copies never part."""
    from pyspark.ml.functions import vector_to_array

    x = table(spark, d, "incident_records").filter("norm_text != '' and label is not null").select("id", "label", "norm_text").distinct()
    x = x.withColumn("fold", F.pmod(F.xxhash64("norm_text"), F.lit(5))).withColumn("y", F.col("label").cast("double"))
    train, held = x.filter("fold < 4"), x.filter("fold = 4")
    share = train.agg(F.avg("y").alias("p")).first()["p"]
    if share is None or share in (0.0, 1.0):
        return held.select("id", "label", F.lit(share).cast("double").alias("probability"))
    return _fitted(train, share).transform(held.withColumn("w", F.lit(1.0))).select("id", "label", F.round(vector_to_array("probability")[1], 6).alias("probability"))


def _stratified(x, folds: int):
    """``x`` (id, y, ...) with a fold: rows of a class in the order of a hash, dealt in turn, so folds differ by one row of a class at most.
    Ranks run inside hash ranges, after the counts of those before."""
    g = x.withColumn("h", F.xxhash64("id", F.lit(42))).withColumn("range", F.pmod("h", F.lit(1024)))
    sizes = g.groupBy("y", "range").agg(F.count("*").alias("k"))
    sizes = sizes.select("y", "range", (F.sum("k").over(W.partitionBy("y").orderBy("range")) - F.col("k")).alias("before"))  # at most 2 x 1024 rows
    rank = F.col("before") + F.row_number().over(W.partitionBy("y", "range").orderBy("h", "id"))
    return g.join(sizes, ["y", "range"]).withColumn("fold", F.pmod(rank, F.lit(folds))).select(*x.columns, "fold")


@REG.add("a34_cross_validation")
def _(spark, d):
    """Means of precision, recall and F1 over stratified folds of the train split: five, or as many as the smaller class has rows; none below two."""
    space = Workspace(spark, "a34")
    train = ingestion.QUERIES["t15_leak_free_split"](spark, d).filter("split = 'train'").select("id")
    rows = table(spark, d, "incident_records").filter("norm_text != '' and label is not null").groupBy("id").agg(F.max("label").cast("double").alias("y"), F.min("norm_text").alias("norm_text"))
    x = space.cut(rows.join(train, "id"), "train")
    n, yes = x.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    folds = int(min(5, yes, n - yes))
    schema = "cv_folds int, cv_precision_mean double, cv_recall_mean double, cv_f1_mean double"
    if folds < 2:
        return spark.createDataFrame([(0, None, None, None)], schema)
    x = space.cut(_stratified(x, folds), "folds")
    share = {r["fold"]: r for r in x.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("yes")).collect()}  # five rows
    got = []
    for k in range(folds):
        p = (yes - share[k]["yes"]) / (n - share[k]["n"])
        said = _fitted(x.filter(F.col("fold") != k), p).transform(x.filter(F.col("fold") == k).withColumn("w", F.lit(1.0)))
        tp, fp, fn = said.agg(*(F.count_if(F.expr(e)) for e in ("prediction = 1 and y = 1", "prediction = 1 and y = 0", "prediction = 0 and y = 1"))).first()
        ratio = lambda a, b: a / b if b else 0.0
        got.append((ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)))
    return spark.createDataFrame([(folds, *(round(sum(m) / folds, 3) for m in zip(*got)))], schema)


@REG.add("t17_calibration")
def _(spark, d):
    """Calibration of the model's probabilities: isotonic from 1,000 fitted rows on, else sigmoid; Brier scores of the held-out
    fifth before and after. Folds go by the hash of the report id. One class or fewer than four rows: no method."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    e = evaluation(spark, d).select("id", F.col("y").cast("double").alias("label"), "p").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(5)))
    fit, held = e.filter("fold < 4"), e.filter("fold = 4")
    n, low, high = fit.agg(F.count("*"), F.min("label"), F.max("label")).first()
    brier = lambda c: F.round(F.avg((F.col(c) - F.col("label")) * (F.col(c) - F.col("label"))), 6)
    method = "none" if n < 4 or low == high else "isotonic" if n >= 1000 else "sigmoid"
    if method == "none":
        done = held.withColumn("q", F.col("p"))
    elif method == "isotonic":
        done = IsotonicRegression(featuresCol="p", labelCol="label").fit(fit).transform(held).withColumnRenamed("prediction", "q")
    else:
        packed = VectorAssembler(inputCols=["p"], outputCol="features")
        done = LogisticRegression(maxIter=50).fit(packed.transform(fit)).transform(packed.transform(held)).withColumn("q", vector_to_array("probability")[1])
    return done.agg(F.lit(method).alias("method"), F.lit(n).alias("n_fitted"), F.count("*").alias("n_held_out"), brier("p").alias("brier_before"), brier("q").alias("brier_after"))


QUERIES, SQL = REG.queries, REG.sql
