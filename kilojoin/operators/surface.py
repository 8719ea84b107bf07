"""Lookups in tables that grow with the data: curves, surfaces and grids of more dimensions as DataFrames.

Each axis is merged with the distinct values that are asked for: both are dealt into buckets of equal numbers (quantiles of distinct values, so no bucket is
hot), sorted in them, and the axis points on both sides of a value are the last and the next one; what a bucket inherits from its
neighbours is one row for each bucket. The corners of the cells are then found by equal axis values: a cell that many rows ask for goes to
them by a broadcast, all others by a shuffle (skew.join_owner). No axis, table or cell is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.operators.skew import join_owner
from kilojoin.plans.storage import cut

#: Distinct values of a bucket, and buckets at most (their bounds are a literal of the plan; beyond, buckets get larger).
BUCKET, BUCKETS = 500_000, 1024


def brackets(axis: DataFrame, asked: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """x, low, high of each distinct x of ``asked`` (x): the axis points (x) around it, both x itself if it is one; null beyond the ends."""
    points = axis.select(F.col("x").cast("double")).where("x is not null and not isnan(x)").distinct().withColumn("own", F.lit(True))
    values = asked.select(F.col("x").cast("double")).where("x is not null and not isnan(x)").distinct().withColumn("own", F.lit(False))
    rows = cut(points.unionByName(values))
    n = min(BUCKETS, -(-rows.count() // bucket))
    bounds = rows.approxQuantile("x", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("x"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", place)
    up, down = (Window.partitionBy("bucket").orderBy(*o) for o in ((F.col("x"), F.desc("own")), (F.desc("x"), F.desc("own"))))
    point = F.when(F.col("own"), F.col("x"))
    rows = rows.withColumns({"low": F.last(point, True).over(up), "high": F.last(point, True).over(down)}).where("not own")
    ends = points.withColumn("bucket", place).groupBy("bucket").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    all_ = F.broadcast(axis.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket")))
    line = Window.orderBy("bucket")  # a row for each bucket
    ends = ends.join(all_, "bucket", "right").select("bucket", F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min("first").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    return rows.join(F.broadcast(ends), "bucket").select("x", F.coalesce("low", "before").alias("low"), F.coalesce("high", "after").alias("high"))


def lookup(table: DataFrame, asked: DataFrame, axes: Sequence[str], value: str, beyond: str = "none", name: str = "found", bucket: int = BUCKET) -> DataFrame:
    """asked with the table's value at its coordinates, linear along every axis; both have the axes as columns, the table one row for each point.

    beyond: ``none`` (null outside of the axes) or ``last`` (the value at the edge). Null if a corner of the cell is missing. Coordinates that are
    null or not a number have none.
    """
    rows = cut(asked.withColumn("_row", F.monotonically_increasing_id()))
    met = rows.select("_row", *[F.col(a).cast("double").alias(a) for a in axes])
    for a in axes:
        ends = brackets(table.select(F.col(a).alias("x")), rows.select(F.col(a).alias("x")), bucket).withColumnsRenamed({"x": a, "low": f"{a}_0", "high": f"{a}_1"})
        met = join_owner(met, ends, [a], "left")
        if beyond == "last":
            met = met.withColumns({f"{a}_0": F.coalesce(f"{a}_0", f"{a}_1"), f"{a}_1": F.coalesce(f"{a}_1", f"{a}_0")})
    part = {a: F.when(F.col(f"{a}_0") == F.col(f"{a}_1"), F.lit(0.0)).otherwise((F.col(a) - F.col(f"{a}_0")) / (F.col(f"{a}_1") - F.col(f"{a}_0"))) for a in axes}
    corners = []
    for sides in product((0, 1), repeat=len(axes)):
        weight = F.lit(1.0)
        for a, s in zip(axes, sides, strict=True):
            weight = weight * (part[a] if s else 1 - part[a])
        corners.append(F.struct(*[F.col(f"{a}_{s}").alias(f"_{a}") for a, s in zip(axes, sides, strict=True)], weight.alias("_w")))
    asks = cut(met.select("_row", F.inline(F.array(*corners))).where("_w > 0"))  # corners without weight don't matter
    points = table.select(*[F.col(a).cast("double").alias(f"_{a}") for a in axes], F.col(value).cast("double").alias("_v"))
    got = join_owner(asks, points, [f"_{a}" for a in axes], "left")
    sums = got.groupBy("_row").agg(F.sum(F.col("_v") * F.col("_w")).alias(name), F.count(F.when(F.col("_v").isNull(), 1)).alias("_lack"))
    return rows.join(sums.select("_row", F.when(F.col("_lack") == 0, F.col(name)).alias(name)), "_row", "left").drop("_row")
