"""Stratified folds and the cross-validation means of the classifier."""

from hazardloom.plans import governance, registry


def test_folds_hold_equal_shares_of_each_class(spark):
    x = spark.createDataFrame([(f"i{k}", float(k % 4 == 0)) for k in range(210)], "id string, y double")
    rows = governance._stratified(x, 5).collect()
    assert len({r["id"] for r in rows}) == len(rows) == 210
    for y in (0.0, 1.0):
        n = [sum(r["y"] == y and r["fold"] == f for r in rows) for f in range(5)]
        assert max(n) - min(n) <= 1


def test_means(spark, tmp_path):
    rows = [(f"i{k}", None, t, t, None, k % 2 == 0) for k in range(100) for t in [f"{'explosion fatal' if k % 2 == 0 else 'tidy routine'} n{k} m{k}"]]
    spark.createDataFrame(rows, "id string, group_id string, raw_text string, norm_text string, text_hash string, label boolean").write.parquet(f"{tmp_path}/t/incident_records.parquet")
    assert [tuple(r) for r in registry.queries()["a34_cross_validation"](spark, f"{tmp_path}/t").collect()] == [(5, 1.0, 1.0, 1.0)]
