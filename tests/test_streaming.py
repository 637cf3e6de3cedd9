"""Streams over several files: every micro-batch counts, and no key is lost."""

from hazardloom.storage import checkpoint_root
from hazardloom.streaming import events


def test_totals_over_several_micro_batches(spark):
    folder = checkpoint_root(spark).removeprefix("file://") + "/stream-in"
    rows = [[("a", 1.0, "x", 1), ("b", 2.0, "x", 2)], [("a", 3.0, "y", 3), ("c", None, "z", 4)], [("a", 1.0, "w", 5)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "user_id string, value double, event_type string, ts long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{k}")
    stream = spark.readStream.schema("user_id string, value double, event_type string, ts long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    got = events.drain(spark, events.user_totals(stream), "t-totals", ("user_id",))
    assert sorted(map(tuple, got.collect())) == [("a", 3, 5.0, "w"), ("b", 1, 2.0, "x"), ("c", 1, 0.0, "z")]


def test_source_of_a_folder(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "k int").write.parquet(f"{tmp_path}/t.parquet")
    got = events.drain(spark, events.source(spark, str(tmp_path), "t"), "t-folder")
    assert sorted(r["k"] for r in got.collect()) == [1, 2]
