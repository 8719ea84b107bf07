"""Joins whose keys may be hot, and tasks that may be large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.plans.storage import cut

#: Keys of more than a SHARE-th of all rows are SHARE at most.
SHARE = 1000
#: Rows that a task of sorts and windows should have.
TASK = 500_000


def dealt(df: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """df dealt out by key into tasks of TASK rows on average at most; where the cluster's cores make smaller ones, Spark sets the number. rows: how many, if that is known."""
    n = -(-(df.count() if rows is None else rows) // TASK)
    return df.repartition(n, *by) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*by)


def ranked(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """df with the place (from 0) of each row among those of its key; keys of any size are ranked by ranges of TASK rows."""
    n = -(-df.count() // TASK)
    if n <= 1:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long"))
    rows = cut(df.repartitionByRange(n, *key, *order).withColumn("_range", F.spark_partition_id()))
    sizes = rows.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*order)) - 1)
    return rows.join(sizes, [*key, "_range"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_before", "_own")


def join_owner(rows: DataFrame, owners: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """rows joined with owners, which has one row for each key at most.

    Owners of keys with more than a SHARE-th of all rows go to the rows by a broadcast (they are SHARE at most), the rest by a shuffle.
    """
    counts = rows.groupBy(*key).count()
    many = rows.count() / SHARE
    hot = F.broadcast(counts.where(F.col("count") > max(many, 10_000)).select(*key).limit(SHARE))
    cold = rows.join(hot, key, "left_anti").join(owners, key, how)
    warm = rows.join(hot, key, "left_semi").join(F.broadcast(owners.join(hot, key, "left_semi")), key, how)
    return cold.unionByName(warm)
