"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.storage import Workspace

#: A key with more rows than this counts as hot.
HOT_ROWS = 200_000
#: A salt splits a hot key into parts of about this many rows.
SALT_ROWS = 100_000


def join_hot(big: DataFrame, small: DataFrame, key: str, rows_col: str, how: str = "inner", parts: int = SALT_ROWS, stored: bool = False, most: int | None = None) -> DataFrame:
    """Join ``big`` with ``small`` (unique on ``key``, holding in ``rows_col`` the rows ``big`` has of it).

    The row of a hot key is repeated once per salt and the rows of ``big`` are spread over the salts. ``big``
    can't know the number of salts of its key before the join, so it is told by a join with the hot keys
    alone: at most rows / HOT_ROWS keys, a set that shrinks against the data and is joined without a
    broadcast hint (Spark broadcasts it where its measured size allows). Keys that aren't hot keep salt 0. The salt
    is a hash of the row, so a task that runs again deals its rows as before; equal rows share one.
    ``stored``: ``small`` is a written table, so a look at it tells cheaply that no key is hot, and one join will do.
    ``most``: the rows of the hottest key, where they were seen when ``small`` was written.
    """
    cool = most <= HOT_ROWS if most is not None else stored and small.filter(F.col(rows_col) > HOT_ROWS).isEmpty()
    if cool:
        return big.join(small.drop(rows_col), key, how)
    salts = F.when(F.col(rows_col) > HOT_ROWS, F.ceil(F.col(rows_col) / F.lit(parts)).cast("int")).otherwise(F.lit(1))
    sized = small.withColumn("__salts", salts)
    hot = sized.filter(F.col("__salts") > 1).select(F.col(key).alias("__hot"), F.col("__salts").alias("__of"))
    spread = (
        big.join(hot, F.col(key) == F.col("__hot"), "left")
        .withColumn("__salt", F.when(F.col("__of").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*big.columns), F.col("__of")).cast("int")))
        .drop("__hot", "__of")
    )
    repeated = sized.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts", rows_col)
    return spread.join(repeated, [key, "__salt"], how).drop("__salt")


def counted(big: DataFrame, small: DataFrame, key: str, space: Workspace) -> DataFrame:
    """``small`` (unique on ``key``) with the number n of rows that ``big`` has of each key it holds, as a table for ``join_hot``."""
    return space.cut(small.join(big.groupBy(key).agg(F.count("*").alias("n")), key), "counted", most=F.max("n"))
