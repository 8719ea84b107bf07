"""Grids: a row for each point (x0, x1, ..., v); axes are small tables or lists, the first one is the slowest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check_axes(axes: Sequence[Sequence[float]]) -> None:
    if any(len(a) == 0 or any(y <= x for x, y in zip(a, a[1:], strict=False)) for a in axes):
        raise ValueError("an axis must have points and rise")


def size(axes: Sequence[Sequence[float]]) -> int:
    n = 1
    for a in axes:
        n *= len(a)
    return n


def generate(spark: SparkSession, axes: Sequence[Sequence[float]], f: Callable[..., Column]) -> DataFrame:
    """lin, x0, x1, ..., v: f at every point. Points are numbered and cut into axis values by arithmetic, so a large grid is made in parallel."""
    check_axes(axes)
    rows, step = spark.range(size(axes)).select(F.col("id").alias("lin")), size(axes)
    for i, a in enumerate(axes):
        step //= len(a)
        place = F.pmod(F.floor(F.col("lin") / step), F.lit(len(a))).cast("int")
        rows = rows.withColumn(f"x{i}", F.get(F.array(*[F.lit(float(x)) for x in a]), place))
    return rows.withColumn("v", f(*[F.col(f"x{i}") for i in range(len(axes))]))


def to_linear(places: Sequence[Column], sizes: Sequence[int]) -> Column:
    out = F.lit(0)
    for p, n in zip(places, sizes, strict=True):
        out = out * n + p
    return out


def from_linear(lin: Column, sizes: Sequence[int]) -> list[Column]:
    out, step = [], 1
    for n in sizes:
        step *= n
    for n in sizes:
        step //= n
        out.append(F.pmod(F.floor(lin / step), F.lit(n)).cast("int"))
    return out


def map_points(cube: DataFrame, f: Callable[..., Column]) -> DataFrame:
    """f(v, x0, x1, ...) of every point."""
    xs = sorted((c for c in cube.columns if c[0] == "x" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    return cube.withColumn("v", f(F.col("v"), *map(F.col, xs)))


def sub_cube(cube: DataFrame, axis: int, value: float) -> DataFrame:
    """The slice at one value of an axis, without that axis."""
    return cube.where(F.col(f"x{axis}") == value).drop(f"x{axis}")


def zip_with(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], dims: int) -> DataFrame:
    """f of two cubes on the same grid."""
    keys = [f"x{i}" for i in range(dims)]
    return a.join(b.select(*keys, F.col("v").alias("_w")), keys).select(*keys, f(F.col("v"), F.col("_w")).alias("v"))


def matrix(cube: DataFrame) -> DataFrame:
    """x0, xs, vs: one row for each value of the first axis of a 2-d cube, in the order of the second."""
    rows = cube.groupBy("x0").agg(F.array_sort(F.collect_list(F.struct("x1", "v"))).alias("_r"))
    return rows.select("x0", F.transform("_r", lambda r: r["x1"]).alias("xs"), F.transform("_r", lambda r: r["v"]).alias("vs"))


def fold(cube: DataFrame) -> DataFrame:
    return cube.agg(F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"))
