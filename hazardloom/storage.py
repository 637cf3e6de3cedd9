"""Reading tables and cutting lineage.

Iterative operators never use ``localCheckpoint``: intermediate results are written as Parquet tables
below the folder named by ``spark.checkpoint.dir``, which every executor shares, so a lost executor
costs no more than a re-read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_root: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of this machine only on a local master with none set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _local_root:
        _local_root["root"] = "file://" + tempfile.mkdtemp(prefix="hazardloom-")
    return _local_root["root"]


class Workspace:
    """Tables of one run of an iterative operator, each written once and read back with a short lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/hazardloom/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def cut(self, df: DataFrame, label: str = "t", **seen: Column) -> DataFrame:
        """``df`` as a table on shared storage. The schema is passed on, so no footer has to be read for it.

        ``seen``: aggregates that are taken while the table is written, for ``seen_of``, so that a loop needs no job of
        its own to ask whether it is done. A task that runs again may count twice: ask for maxima and for more than 0.
        """
        self._n += 1
        path = f"{self.base}/{self._n:04d}-{label}"
        told = Observation()
        rows = df.observe(told, *(c.alias(k) for k, c in seen.items())) if seen else df
        rows.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path  # the table's own folder goes with the object, not with its id
        out._workspace_seen = told.get if seen else {}
        return out

    @staticmethod
    def seen_of(table: DataFrame, name: str) -> int:
        """What ``cut`` saw of a table; 0 where it had no rows."""
        return table._workspace_seen[name] or 0

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables made by ``cut`` that nothing will read again; frames derived from them can't be named here."""
        for t in tables:
            path = getattr(t, "_workspace_path", None) if t is not None else None
            if path is None:
                if t is not None:
                    raise ValueError("only tables of this workspace can be dropped")
                continue
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, with time-zone-free timestamps read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def spread(df: DataFrame, waves: int = 3) -> DataFrame:
    """Rows dealt over all cores where the input has fewer partitions than that: for operators that compute much per byte.

    Large inputs come in enough partitions and pass without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(waves * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def utc(spark: SparkSession) -> None:
    """Pin the session zone: every timestamp of the engine is a UTC instant."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
