"""Problem 5: consensus from several annotators by confidence-aware truth discovery.

Truths and weights alternate until no weight moves any more. An annotator's error is estimated against the current
truths and raised to a chi-squared upper confidence bound: few labels, wide bound, little weight, so the long tail
of annotators can't outvote the known ones. There are two forms:

* ``two_sided=False`` is the plain method: the bounded variance of the labels around the truths gives one weight per
  annotator, 1 / variance, and each truth minimises the weighted squared distance to its labels (their weighted mean).
* ``two_sided=True`` (the default) bounds two error rates, one per true class, and adds up log odds with the share of
  positives as prior, as in naive Bayes. An annotator that always says no has one useless half, and a steady
  contrarian is informative; a single distance weight can express neither.

Items keep their labels in one row, so a round shuffles annotator sums alone; where annotators are too many to be
sent to every task, the rounds join labels with weights instead. Both plans give the same result.

Defined cases: an annotator's label on an item is the non-null one with the latest time, ties going to the
larger decision id; exact duplicates count once; items without a label and null ids are left out; a truth
of exactly one half gives the negative label; an empty input gives no rows; further columns are ignored; rounds
that don't settle are an error, never a silent result.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.operators.skew import join_hot
from hazardloom.storage import Workspace

#: Lower tail of the chi-squared distribution that bounds the variance from above.
ALPHA = 0.25
#: Rounds end when no weight moves by more than this share of itself (or, below 1, by this much); so many rounds without end are an error.
SETTLED, MAX_ROUNDS = 1e-2, 300
#: Weights go to every task up to this many annotators (two arrays of 8 bytes each), joined with salts beyond.
BROADCAST_ANNOTATORS = 100_000
#: Prior labels per class and their error rate, so that a new annotator starts as a fairly good one.
PRIOR_N, PRIOR_ERROR = 1.0, 0.3


def latest_labels(decisions: DataFrame, item: str, annotator: str, label: str, at: str, tie: str) -> DataFrame:
    """(item, annotator, x) with x 1.0 or 0.0: one row per annotator and item."""
    d = decisions.select(F.col(item).cast("string").alias("item"), F.col(annotator).cast("string").alias("annotator"), F.col(label).cast("double").alias("x"), F.col(at).alias("at"), F.col(tie).cast("string").alias("tie"))
    return d.filter("item is not null and annotator is not null and x is not null").groupBy("item", "annotator").agg(F.max_by("x", F.struct("at", "tie", "x")).alias("x"))


def _chi2_lower(n: Column, alpha: float) -> Column:
    """Wilson-Hilferty quantile of the chi-squared distribution with n degrees of freedom."""
    z, n = NormalDist().inv_cdf(alpha), F.greatest(n, F.lit(1.0))
    return F.greatest(n * F.pow(1 - 2 / (9 * n) + z * F.sqrt(2 / (9 * n)), 3), F.lit(1e-3))


def _bounded_error(errors: Column, n: Column, alpha: float) -> Column:
    """Upper bound of the error rate, never past one half; above one half the rate of the contrary label is bounded."""
    rate = (errors + PRIOR_N * PRIOR_ERROR) / (n + PRIOR_N)
    contrary = rate > 0.5
    bound = F.least(F.lit(0.5), F.when(contrary, 1 - rate).otherwise(rate) * F.greatest(n, F.lit(1.0)) / _chi2_lower(n, alpha))
    bound = F.greatest(bound, F.lit(1e-4))
    return F.when(contrary, 1 - bound).otherwise(bound)


_SUMS = ("n", "n1", "m1", "n0", "m0", "d")


def _sums(truth: Column, x: Column) -> list[Column]:
    """What a round learns of an annotator: labels, positive and negative mass with the errors in each, squared distance."""
    values = (F.lit(1.0), truth, truth * (1 - x), 1 - truth, (1 - truth) * x, (x - truth) * (x - truth))
    return [F.sum(v).alias(name) for name, v in zip(_SUMS, values)]


def _weighted(sums: DataFrame, alpha: float, two_sided: bool) -> DataFrame:
    """``sums`` with the bounded error rates e1 and e0 and what a yes and a no of the annotator weigh."""
    if two_sided:
        rated = sums.withColumns({"e1": _bounded_error(F.col("m1"), F.col("n1"), alpha), "e0": _bounded_error(F.col("m0"), F.col("n0"), alpha)})
        return rated.withColumns({"yes": F.log((1 - F.col("e1")) / F.col("e0")), "no": F.log(F.col("e1") / (1 - F.col("e0")))})
    variance = F.greatest(F.col("d") + PRIOR_N * PRIOR_ERROR * (1 - PRIOR_ERROR), F.lit(1e-6)) / _chi2_lower(F.col("n") + PRIOR_N, alpha)
    rated = sums.withColumn("e1", F.least(variance, F.lit(1.0))).withColumn("e0", F.col("e1"))
    return rated.withColumns({"yes": 1 / variance, "no": 1 / variance})


def _log_odds(p: float | None) -> float:
    p = min(0.98, max(0.02, 0.5 if p is None else p))
    return math.log(p / (1 - p))


def _shift(old: Column | float, new: Column | float):
    """How far a weight has moved, as a share of itself where it is above 1."""
    return F.abs(new - old) / F.greatest(F.abs(old), F.lit(1.0))


def _packed_rounds(labels: DataFrame, raters: DataFrame, space: Workspace, alpha: float, rounds: int, two_sided: bool, settled: float) -> tuple[DataFrame, DataFrame]:
    """Items hold their labels as (annotator number, label); weights are two arrays sent to every task."""
    spark = labels.sparkSession
    names = sorted(r[0] for r in raters.select("annotator").collect())  # at most BROADCAST_ANNOTATORS
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), "k int, annotator string"))
    votes = F.sort_array(F.collect_list(F.struct("k", "x")))
    items = labels.join(numbers, "annotator").groupBy("item").agg(votes.alias("votes"), F.count("*").alias("n_labels"), F.sum("x").cast("long").alias("n_positive"))
    items = space.cut(items, "items")
    share = F.col("n_positive") / F.col("n_labels")

    def truth_of(weights: list | None, prior: float) -> DataFrame:
        if weights is None:
            return items.withColumn("truth", share)
        one = F.broadcast(spark.createDataFrame([([float(r["yes"]) for r in weights], [float(r["no"]) for r in weights])], "yes array<double>, no array<double>"))
        part = lambda v: F.when(v["x"] == 1, F.get(F.col("yes"), v["k"])).otherwise(F.get(F.col("no"), v["k"]))
        if two_sided:
            truth = 1 / (1 + F.exp(-(F.aggregate("votes", F.lit(float(prior)), lambda s, v: s + part(v)))))
        else:
            truth = F.aggregate("votes", F.lit(0.0), lambda s, v: s + v["x"] * part(v)) / F.aggregate("votes", F.lit(0.0), lambda s, v: s + part(v))
        return items.crossJoin(one).select("item", "votes", "n_labels", "n_positive", truth.alias("truth"))

    weights, prior = None, 0.0
    for _ in range(rounds):
        # number -1 stands for the items themselves: their count and the share of positives
        whole = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("x")))
        each = truth_of(weights, prior).select("truth", F.explode(F.concat("votes", whole)).alias("v"))
        got = _weighted(each.groupBy(F.col("v.k").alias("k")).agg(*_sums(F.col("truth"), F.col("v.x"))), alpha, two_sided).collect()
        by_number = {r["k"]: r for r in got}
        total = by_number.pop(-1, None)
        new = [by_number[k] for k in range(len(names))]
        prior = _log_odds(total["n1"] / total["n"] if total else None)
        moved = max((abs(b[c] - a[c]) / max(1.0, abs(a[c])) for a, b in zip(weights, new) for c in ("yes", "no")), default=0.0) if weights else None
        weights = new
        if not names or moved is not None and moved <= settled:
            break
    else:
        raise RuntimeError(f"weights still move after {rounds} rounds")
    rows = [(name, *(float(r[c]) for c in (*_SUMS, "e1", "e0", "yes", "no"))) for name, r in zip(names, weights)]
    table = spark.createDataFrame(rows, "annotator string, " + ", ".join(f"{c} double" for c in (*_SUMS, "e1", "e0", "yes", "no")))
    return truth_of(weights if names else None, prior).drop("votes"), table


def _joined_rounds(labels: DataFrame, raters: DataFrame, space: Workspace, alpha: float, rounds: int, two_sided: bool, settled: float) -> tuple[DataFrame, DataFrame]:
    """Any number of annotators: labels meet truths by item and weights by annotator, hot annotators with salts."""
    counts = {"n_labels": F.count("*"), "n_positive": F.sum("x").cast("long")}
    truth = space.cut(labels.groupBy("item").agg(F.avg("x").alias("truth"), *(c.alias(k) for k, c in counts.items())), "truth")
    weights = None
    for _ in range(rounds):
        # an item has one label of an annotator: no item is hotter than there are annotators
        per_item = space.cut(truth.withColumnRenamed("n_labels", "n"), "sized")
        sums = join_hot(labels, per_item.select("item", "truth", "n"), "item", "n", stored=True).groupBy("annotator").agg(*_sums(F.col("truth"), F.col("x")))
        new = space.cut(_weighted(sums, alpha, two_sided), "weights")
        prior = _log_odds(truth.agg(F.avg("truth")).first()[0])
        voted = join_hot(labels, new.select("annotator", "yes", "no", "n"), "annotator", "n", stored=True)
        part = F.when(F.col("x") == 1, F.col("yes")).otherwise(F.col("no"))
        value = 1 / (1 + F.exp(-(F.sum(part) + F.lit(prior)))) if two_sided else F.sum(F.col("x") * part) / F.sum(part)
        nxt = space.cut(voted.groupBy("item").agg(value.alias("truth"), *(c.alias(k) for k, c in counts.items())), "truth")
        moved = None
        if weights is not None:
            both = new.join(weights.select("annotator", F.col("yes").alias("yes_was"), F.col("no").alias("no_was")), "annotator")
            moved = both.agg(F.max(F.greatest(_shift(F.col("yes_was"), F.col("yes")), _shift(F.col("no_was"), F.col("no"))))).first()[0] or 0.0
        space.drop(truth, weights, per_item)
        truth, weights = nxt, new
        if moved is not None and moved <= settled:
            return truth, weights
    raise RuntimeError(f"weights still move after {rounds} rounds")


def discover(labels: DataFrame, space: Workspace, alpha: float = ALPHA, two_sided: bool = True, rounds: int = MAX_ROUNDS, packed: int = BROADCAST_ANNOTATORS, settled: float = SETTLED) -> tuple[DataFrame, DataFrame]:
    """((item, truth, n_labels, n_positive), (annotator, n, e1, e0, yes, no, ...)) once the weights have settled. ``packed``: annotators up to which weights are broadcast."""
    labels = space.cut(labels.select("item", "annotator", "x"), "labels")
    raters = space.cut(labels.groupBy("annotator").agg(F.count("*").alias("n")), "raters")
    run = _packed_rounds if raters.count() <= packed else _joined_rounds
    return run(labels, raters, space, alpha, rounds, two_sided, settled)


def reliability(weights: DataFrame) -> DataFrame:
    """Per annotator: labels, bounded error rates by true class, and a reliability from -1 (contrary) over 0 (no information) to 1."""
    return weights.select("annotator", F.col("n").cast("long").alias("n"), F.round("e1", 6).alias("error_if_positive"), F.round("e0", 6).alias("error_if_negative"), F.round(1 - F.col("e1") - F.col("e0"), 6).alias("reliability"))
