"""Problem 9: mixing sources to target weights by entropy balancing.

Among all document rates that meet the token total of every source, the balanced ones stay closest (in
relative entropy) to one copy each: rate = exp(lambda_source * tokens), cut at the source's cap. The convex
dual is solved by Newton steps over (source, tokens) cells - documents of one source and length share a rate,
so the cells are an exact summary - with each step one distributed aggregate. Rates become copies by
systematic rounding over hashed parts of a source, so no source, however large, is ordered in one task.

The mix is as large as the shares allow: total = min over sources of max_repeats * tokens / share, or the
``total`` asked for, where a source that can't reach its share is used to its cap and its shortfall reported.

Defined cases: sources are compared lower-case and trimmed, a null source is ''; a source without a target
has share 0; documents without tokens get no copies; targets without documents report a share of 0; repeated
target rows count once, a null share or cap is 0; empty documents give an empty mix.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardloom.operators.skew import join_hot
from hazardloom.storage import Workspace, spread

#: Vocabulary file; a path that only the driver has is sent to the executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before byte-pair merging (fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Targets are a small table, broadcast and looped over on the driver; more than this is an error.
MOST_TARGETS = 10_000
#: Documents of a source that are rounded in one task.
PART_ROWS = 50_000
#: Longer texts are encoded in pieces of about this many signs.
PIECE = 200_000
#: Where a piece may end: before single white space between other signs, at which the pattern always splits.
_CUT = re.compile(r"(?<=\S)\s(?=\S)")


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(enc, text: str, piece: int = PIECE) -> int:
    """Tokens of a text, however long; where no cut can be made the piece goes on."""
    n = at = 0
    while len(text) - at > piece:
        cut = _CUT.search(text, at + piece)
        if not cut:
            break
        n += len(enc.encode_ordinary(text[at : cut.start()]))
        at = cut.start()
    return n + len(enc.encode_ordinary(text[at:]))


def token_counts(docs: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """``docs`` with n_tokens in place of the text."""
    keep = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != text) + ", n_tokens long"

    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(SparkFiles.get(name))
        for pdf in batches:
            out = pdf[keep].copy()
            out["n_tokens"] = [count_tokens(enc, t) if isinstance(t, str) else 0 for t in pdf[text]]
            yield out

    return spread(docs).mapInPandas(run, schema)


def _balanced(cells: DataFrame, wanted: dict[str, float], caps: dict[str, int], totals: dict[str, tuple[int, int]], steps: int = 60) -> dict[str, float | None]:
    """lambda of each source (per mean length); None where the source is used to its cap."""
    spark = cells.sparkSession
    lam: dict[str, float | None] = {}
    box: dict[str, tuple[float, float]] = {}
    for s, t in wanted.items():
        full = caps[s] * totals[s][0]
        lam[s] = None if t >= full * (1 - 1e-9) else 0.0
        box[s] = (-60.0, 60.0)
    open_ = {s for s, v in lam.items() if v is not None and wanted[s] > 0}
    for _ in range(steps):
        if not open_:
            break
        now = spark.createDataFrame([(s, float(lam[s]), float(caps[s]), totals[s][0] / totals[s][1]) for s in sorted(open_)], "source string, lam double, cap double, mean double")
        z = F.col("n_tokens") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
        mass = F.col("n_docs") * F.col("n_tokens")
        got = cells.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(mass * F.least(rate, F.col("cap"))).alias("f"), F.sum(F.when(rate < F.col("cap"), mass * z * rate).otherwise(0.0)).alias("g")).collect()  # a row per target
        for s, f, g in got:
            gap = f - wanted[s]
            lo, hi = box[s]
            box[s] = (lo, lam[s]) if gap > 0 else (lam[s], hi)
            if abs(gap) <= 1e-7 * max(1.0, wanted[s]):
                open_.discard(s)
                continue
            step = lam[s] - gap / g if g > 0 else math.inf
            lo, hi = box[s]
            lam[s] = step if lo < step < hi else (lo + hi) / 2
    return lam


def mix(docs: DataFrame, targets: DataFrame, space: Workspace, total: float | None = None, path: str = TOKENIZER, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, n_tokens, rate, copies), (source, target_share, actual_share, ...)). ``docs``: doc_id, source, text."""
    norm = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    sized = space.cut(token_counts(docs.select("doc_id", norm("source").alias("source"), "text"), "text", path), "sized")
    want = {r["source"]: (float(r["share"] or 0.0), int(r["cap"] or 0)) for r in targets.groupBy(norm("source").alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).limit(MOST_TARGETS + 1).collect()}
    if len(want) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target sources")
    want = {s: (a, max(0, c)) for s, (a, c) in want.items() if a > 0}
    cells = space.cut(sized.filter("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("n_docs")), "cells")
    spark = docs.sparkSession
    names = spark.createDataFrame([(s,) for s in sorted(want)], "source string")
    totals = {r["source"]: (int(r["t"]), int(r["n"])) for r in cells.join(F.broadcast(names), "source").groupBy("source").agg(F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"), F.sum("n_docs").alias("n")).collect()}
    usable = {s: v for s, v in want.items() if s in totals and v[1] > 0}
    reach = min((c * totals[s][0] / a for s, (a, c) in usable.items()), default=0.0)
    budget = reach if total is None else float(total)
    wanted = {s: a * budget for s, (a, c) in usable.items()}
    lam = _balanced(cells, wanted, {s: c for s, (a, c) in usable.items()}, totals)
    plan = spark.createDataFrame([(s, lam[s], float(usable[s][1]), totals[s][0] / totals[s][1], max(1, math.ceil(totals[s][1] / PART_ROWS))) for s in sorted(usable)], "source string, lam double, cap double, mean double, parts int")
    rate = F.when(F.col("n_tokens") == 0, 0.0).when(F.col("cap").isNull(), 0.0).when(F.col("lam").isNull(), F.col("cap")).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("mean"), F.lit(50.0))), F.col("cap")))
    rated = sized.join(F.broadcast(plan), "source", "left").withColumn("rate", rate).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.coalesce("parts", F.lit(1))))
    whole, rest = F.floor("rate"), F.col("rate") - F.floor("rate")
    # systematic rounding: a document is rounded up where the running sum of fractions passes a whole number
    order = W.partitionBy("source", "part").orderBy("n_tokens", F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    some = rated.filter(rest > 0).withColumn("sum", F.sum(rest).over(order) + F.pmod(F.xxhash64("source", "part", F.lit(seed)), F.lit(1009)) / 1009.0)
    some = some.withColumn("copies", (whole + F.floor("sum") - F.floor(F.col("sum") - rest)).cast("long"))
    none = rated.filter(rest <= 0).withColumn("copies", whole.cast("long"))
    out = ["doc_id", "source", "n_tokens", "rate", "copies"]
    mixed = space.cut(some.select(*out).union(none.select(*out)), "mix")
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.sum("copies").alias("copies"), F.count("*").alias("n_docs"), F.sum((F.col("copies") > 0).cast("long")).alias("n_docs_used"), F.max("copies").alias("most_copies"))
    goals = spark.createDataFrame([(s, a, c, a * budget) for s, (a, c) in sorted(want.items())], "source string, target_share double, max_repeats int, wanted_tokens double")
    report = used.join(F.broadcast(goals), "source", "full").na.fill(0)
    whole_mix = report.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = report.crossJoin(F.broadcast(whole_mix)).withColumn("actual_share", F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(0.0))
    return mixed, report.withColumn("shortfall_tokens", F.greatest(F.col("wanted_tokens") - F.col("mixed_tokens"), F.lit(0.0))).drop("all_tokens")
