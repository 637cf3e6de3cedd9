"""Structured Streaming queries over landing folders. The reference streams nothing: these are extensions.

Each query drains its source with ``availableNow`` into a table below the checkpoint folder, with the
exactly-once checkpoint of the sink, and returns that table. Windows run in update mode, so the watermark drops
their state once they are past it while the table keeps their last counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.storage import Workspace


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over the Parquet files of one table, on whatever file system its path names."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(spark: SparkSession, stream: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run the stream to the end of its input and give the result as a table.

    Without keys rows are appended. With keys the stream runs in update mode: every micro-batch writes the rows that
    changed into a folder of its own number (a batch that runs again overwrites it), and the last row of a key counts.
    """
    space = Workspace(spark, name)
    out, progress = f"{space.base}/out", f"{space.base}/progress"
    if not keys:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
    else:

        def store(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = stream.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    if not keys:
        return spark.read.schema(stream.schema).parquet(out)
    values = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    last = spark.read.schema(schema).parquet(out).groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, "v.*")


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("starts"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    return timed.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("starts"), "n")


def first_deliveries(reports: DataFrame, late: str = "400 days") -> DataFrame:
    """One row per id among deliveries within the watermark."""
    return reports.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["id"]).select("id")


def user_totals(events: DataFrame) -> DataFrame:
    """Running count, sum and last event type per user."""
    last = F.max_by("event_type", F.struct("ts", "event_type"))
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total"), last.alias("last_type"))


#: name -> (table, stream, keys of the rows that change)
STREAMS: dict[str, tuple[str, Callable[[DataFrame], DataFrame], tuple[str, ...]]] = {
    "st01_tumbling_counts": ("events", tumbling_counts, ("starts", "event_type")),
    "st02_sliding_counts": ("events", sliding_counts, ("starts",)),
    "st03_first_deliveries": ("reports", first_deliveries, ()),
    "st04_user_totals": ("events", user_totals, ("user_id",)),
}
