"""Skewed joins and workspace tables."""

import pytest
from pyspark.sql import functions as F

from hazardloom.operators import skew
from hazardloom.storage import Workspace, checkpoint_root


@pytest.fixture
def plain_joins(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("-1", "false")):
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_a_hot_key_spreads_and_nothing_is_lost(spark, plain_joins):
    """A key with a third of the rows goes to many tasks, by a salt that a second run deals alike."""
    big = spark.range(900_000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 1000)) as key").repartition(6)
    small = big.groupBy("key").agg(F.count("*").alias("n")).withColumn("v", F.col("key"))
    spread = skew.join_hot(big, small, "key", "n").withColumn("task", F.spark_partition_id()).filter("key = 'hot'").groupBy("task").count().collect()
    assert sum(r["count"] for r in spread) == 300_000 and len(spread) > 1
    first, second = (skew.join_hot(big, small, "key", "n").selectExpr("count(*)", "sum(id)", "sum(crc32(concat(id, v)))").first() for _ in range(2))
    assert first == second and first[0] == 900_000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_both_plans_give_the_same_rows(spark, monkeypatch, how):
    space = Workspace(spark, "t-plans")
    big = spark.range(3_000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 100)) as key")
    small = spark.range(80).selectExpr("if(id = 0, 'hot', concat('k', id)) as key", "id * 2 as v")
    counted = skew.counted(big, small, "key", space)
    plain = skew.join_hot(big, counted, "key", "n", how, stored=True).collect()
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    salted = skew.join_hot(big, counted, "key", "n", how, parts=50, stored=True).select("key", "id", "v").collect()
    assert sorted(map(str, ((r["id"], r["key"], r["v"]) for r in plain))) == sorted(map(str, ((r["id"], r["key"], r["v"]) for r in salted)))
    assert len(plain) == (3_000 if how == "left" else len(big.join(small, "key").collect()))


def test_only_own_tables_are_dropped(spark):
    space = Workspace(spark, "t-drop")
    t = space.cut(spark.range(3).toDF("id"))
    with pytest.raises(ValueError):
        space.drop(t.select("id"))
    space.drop(t, None)


def test_what_a_table_saw_when_it_was_written(spark):
    space = Workspace(spark, "t-seen")
    seen = {"rows": F.count(F.lit(1)), "most": F.max("id")}
    t, none = space.cut(spark.range(5), "t", **seen), space.cut(spark.range(5).filter("id < 0"), "none", **seen)
    assert (space.seen_of(t, "rows"), space.seen_of(t, "most")) == (5, 4) and (space.seen_of(none, "rows"), space.seen_of(none, "most")) == (0, 0)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        checkpoint_root(Session())
