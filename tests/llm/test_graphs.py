"""Problems 5, 6 and 7: brute force and edge cases."""

import random

import pytest

from hazardloom.llm import components, consensus, splits
from hazardloom.storage import Workspace


def union_find(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


PAIRS = "report_id_a string, report_id_b string, root string, u string"


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_by_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(f"r{rng.randrange(150):03d}", f"r{rng.randrange(150):03d}") for _ in range(80)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(50)] + [("h000", f"h{i:03d}") for i in range(1, 90)] + [(f"z{i}", f"z{j}") for i in range(6) for j in range(i)]
    rng.shuffle(links)
    rows = [(f" {a.upper()} ", b, "x", "y") for a, b in links] + [(b, a, "x", "y") for a, b in links[:30]] + [(None, "q1", "", ""), ("N/A", "q1", "", ""), ("q2", "Q2 ", "", ""), ("q3", " ", "", "")]
    pairs = spark.createDataFrame(rows, PAIRS)
    got = components.connected_groups(components.clean_pairs(pairs, "report_id_a", "report_id_b"), Workspace(spark, "t")).collect()
    assert len(got) == len({r["id"] for r in got})
    assert {r["id"]: r["root"] for r in got} == union_find([(a, b) for a, b in links if a != b])


def test_groups_of_nothing(spark):
    pairs = components.clean_pairs(spark.createDataFrame([], PAIRS), "report_id_a", "report_id_b")
    assert components.connected_groups(pairs, Workspace(spark, "t")).count() == 0


RECORDS = "id string, group_id string, text_hash string, label boolean, root string"


def test_bundles_and_splits(spark):
    rng = random.Random(3)
    rows, links, first = [], [], {}
    for i in range(400):
        g = f"G{rng.randrange(90)}" if rng.random() < 0.5 else rng.choice([None, "", "unknown"])
        h = f"h{rng.randrange(120)}" if rng.random() < 0.4 else None
        rows.append((f"i{i:03d}", g and f" {g} ", h and h.upper(), rng.random() < 0.2, "x"))
        for k, v in (("g", g), ("h", h)):
            if v and v.lower() not in ("", "unknown"):
                if (k, v) in first:
                    links.append((first[k, v], f"i{i:03d}"))
                else:
                    first[k, v] = f"i{i:03d}"
    rows += rows[:20] + [(None, "G1", "h1", True, "x"), ("n0", None, None, None, "x")]
    df = spark.createDataFrame(rows, RECORDS)
    space = Workspace(spark, "t")
    edges = splits.tie_edges(df, "id", ["group_id", "text_hash"], space)
    roots, forest = splits.spanning_forest(edges, space)
    got = {r["id"]: r["root"] for r in roots.collect()}
    want = union_find(links)
    assert got == want
    tree = [(r["u"], r["v"]) for r in forest.collect()]
    assert len(tree) == len(want) - len(set(want.values())) and union_find(tree) == want
    out = splits.assign(df, "id", "label", roots).collect()
    assert len(out) == 401 and len({r["record_id"] for r in out}) == 401
    where = {}
    for r in out:
        assert where.setdefault(r["bundle_root"], r["split"]) == r["split"]
    shares = {s: sum(r["split"] == s for r in out) / len(out) for s in ("train", "validation", "test")}
    assert abs(shares["train"] - 0.8) < 0.08 and shares["test"] > 0.03


def test_splits_of_nothing(spark):
    df = spark.createDataFrame([], RECORDS)
    roots = splits.bundles(df, "id", ["group_id", "text_hash"], Workspace(spark, "t"))
    assert roots.count() == 0 and splits.assign(df, "id", "label", roots).count() == 0


def test_consensus(spark):
    """Good raters, a contrarian and a constant one: the truth comes back far better than by votes."""
    rng = random.Random(4)
    truth = {f"r{i:03d}": rng.random() < 0.35 for i in range(500)}
    rows, n = [], 0
    for r, t in truth.items():
        for a in rng.sample(["good1", "good2", "good3", "fair", "contrary", "never"], 4):
            right = {"good1": 0.95, "good2": 0.93, "good3": 0.9, "fair": 0.7, "contrary": 0.1, "never": None}[a]
            x = False if right is None else t if rng.random() < right else not t
            rows.append((f"d{n}", r, a, x, n))
            n += 1
    votes = {r: sum(1 if x[3] else -1 for x in rows if x[1] == r) for r in truth}
    rows += [rows[0], ("d9", None, "good1", True, 1), ("d8", "r000", None, True, 1), ("d7", "only-null", "good1", None, 1)]
    rows += [("e1", "r001", "good1", not truth["r001"], -5)]  # an older label doesn't count
    df = spark.createDataFrame(rows, "id string, report_id string, analyst_id string, analyst_label boolean, reviewed_at int")
    labels = consensus.latest_labels(df, "report_id", "analyst_id", "analyst_label", "reviewed_at", "id")
    assert labels.count() == 2000
    found, weights = consensus.discover(labels, Workspace(spark, "t"))
    got = {r["item"]: r["truth"] > 0.5 for r in found.collect()}
    right = sum(got[r] == t for r, t in truth.items()) / len(truth)
    assert set(got) == set(truth) and right > 0.93 and right > sum((votes[r] > 0) == t for r, t in truth.items()) / len(truth)
    rel = {r["annotator"]: r["reliability"] for r in consensus.reliability(weights).collect()}
    assert rel["good1"] > rel["fair"] > rel["contrary"] and rel["contrary"] < 0


@pytest.mark.parametrize("two_sided", [True, False])
def test_both_consensus_plans_agree(spark, two_sided):
    rng = random.Random(5)
    rows = [(f"i{k:03d}", f"a{a}", float((k % 3 == 0) if rng.random() < 0.6 + 0.05 * a else (k % 3 != 0))) for k in range(120) for a in rng.sample(range(8), 5)]
    labels = spark.createDataFrame(rows, "item string, annotator string, x double")
    got = []
    for packed in (100, 0):
        truth, weights = consensus.discover(labels, Workspace(spark, "t"), two_sided=two_sided, packed=packed, settled=0.05)
        got.append(({r["item"]: (round(r["truth"], 4), r["n_labels"], r["n_positive"]) for r in truth.collect()}, {r["annotator"]: round(r["yes"], 3) for r in weights.collect()}))
    assert got[0][0].keys() == got[1][0].keys() and got[0][1].keys() == got[1][1].keys()
    assert all(abs(a[0] - got[1][0][k][0]) < 0.01 and a[1:] == got[1][0][k][1:] for k, a in got[0][0].items())
    right = sum((t[0] > 0.5) == (int(k[1:]) % 3 == 0) for k, t in got[0][0].items())
    assert right >= 105


def test_unsettled_rounds_are_an_error(spark):
    labels = spark.createDataFrame([("i", "a", 1.0), ("i", "b", 0.0), ("j", "a", 1.0), ("j", "b", 1.0)], "item string, annotator string, x double")
    for packed in (100, 0):
        with pytest.raises(RuntimeError):
            consensus.discover(labels, Workspace(spark, "t"), rounds=1, packed=packed)


def test_consensus_of_nothing(spark):
    df = spark.createDataFrame([], "id string, report_id string, analyst_id string, analyst_label boolean, reviewed_at int")
    found, _ = consensus.discover(consensus.latest_labels(df, "report_id", "analyst_id", "analyst_label", "reviewed_at", "id"), Workspace(spark, "t"))
    assert found.count() == 0
