"""Exact set-similarity self-join (Jaccard) by prefix filtering: what shares too little never meets.

Sets are ordered by rising token frequency; two sets of Jaccard t must share a token among their first
n - ceil(t n) + 1 tokens, so only prefixes are joined, on the rare tokens, with lengths that allow t. Where the first
shared token stands, enough tokens must follow in both. A token flips one of 128 bits of its set, so the bits in which
two sets differ are never more than the tokens in which they do: what differs too much is dropped inside the join, and
no true pair with it. Candidates are verified on whole sets. Equal sets are one representative here: callers expand classes by membership.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.operators.skew import join_hot
from hazardloom.storage import Workspace


def jaccard_pairs(sets: DataFrame, threshold: float, space: Workspace, least_tokens: int = 1) -> DataFrame:
    """``sets``: (id, tokens array without repeats), each set once. (a, b, similarity) with a < b and similarity >= threshold."""
    big = sets.filter(F.size("tokens") >= least_tokens).select("id", "tokens", F.size("tokens").alias("n"))
    words = big.select("id", "n", F.explode("tokens").alias("w"))
    # a word that stands in every text is a hot key: its frequency is told with salts
    freq = space.cut(words.groupBy("w").agg(F.count("*").alias("f"), F.count("*").alias("rows")), "frequencies")
    ranked = join_hot(words, freq, "w", "rows", stored=True).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("s"))  # one set per row
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    bits = (F.expr(f"aggregate(s, 0L, (m, x) -> if(pmod(xxhash64(x.w), 128) div 64 = {k}, m ^ shiftleft(1L, cast(pmod(xxhash64(x.w), 64) as int)), m))").alias(f"m{k}") for k in (0, 1))
    marked = ranked.select("id", "n", "s", *bits)
    heads = space.cut(marked.select("id", "n", "m0", "m1", F.posexplode(F.slice("s", F.lit(1), prefix)).alias("at", "x")).select("id", "n", "m0", "m1", "at", "x.w"), "heads")
    a, b = (heads.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("at").alias(f"at{k}"), F.col("m0").alias(f"m0{k}"), F.col("m1").alias(f"m1{k}"), "w") for k in "ab")
    both = F.col("na") + F.col("nb")
    lengths = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    rest = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= threshold / (1 + threshold) * both - 1e-9
    unlike = F.bit_count(F.col("m0a").bitwiseXOR(F.col("m0b"))) + F.bit_count(F.col("m1a").bitwiseXOR(F.col("m1b"))) <= (1 - threshold) / (1 + threshold) * both + 1e-9
    pairs = a.join(b, "w").filter((F.col("a") < F.col("b")) & lengths & rest & unlike).select("a", "b").distinct()
    left = big.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = big.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    sim = common / (F.size("ta") + F.size("tb") - common)
    return pairs.join(left, "a").join(right, "b").select("a", "b", sim.alias("similarity")).filter(F.col("similarity") >= threshold)
