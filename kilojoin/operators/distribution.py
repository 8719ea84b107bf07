"""Distributions of interval values: classes, their samples, and sums of other signals over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.functions import exprs
from kilojoin.operators.record import checked


def class_counts(df: DataFrame, interval: float, offset: float) -> DataFrame:
    """record_id, sig_id, class, n."""
    return df.groupBy("record_id", "sig_id", exprs.classify_even(F.col("v"), interval, offset).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, interval: float, offset: float) -> DataFrame:
    """record_id, sig_id, class, idx: the sample indices of every class, one row each."""
    return df.select("record_id", "sig_id", exprs.classify_even(F.col("v"), interval, offset).alias("class"), "idx")


def distribution_nd(df: DataFrame, signals: Sequence[str], interval: float, offset: float) -> DataFrame:
    """record_id, classes (one for each signal), n: samples by the classes of several signals at once."""
    each = [F.max(F.when(F.col("sig_id") == s, exprs.classify_even(F.col("v"), interval, offset))).alias(f"_c{i}") for i, s in enumerate(signals)]
    rows = df.where(F.col("sig_id").isin(*signals)).groupBy("record_id", "idx").agg(*each)
    classes = [f"_c{i}" for i in range(len(signals))]
    return rows.groupBy("record_id", *classes).agg(F.count(F.lit(1)).alias("n")).select("record_id", F.array(*classes).alias("classes"), "n")


def support_points(axis: Sequence[float], x: Column) -> Column:
    """array of the one (on a hit) or two axis points around x; outside the axis is an error."""
    if len(axis) < 2 or any(b < a for a, b in zip(axis, axis[1:], strict=False)):
        raise ValueError("an axis needs two points and must rise")
    ax = F.array(*[F.lit(float(a)) for a in axis])
    low, high = F.array_max(F.filter(ax, lambda a: a <= x)), F.array_min(F.filter(ax, lambda a: a >= x))
    return F.when(low.isNull() | high.isNull(), F.raise_error(F.lit("a value lies outside the axis")).cast("array<double>")).when(low == high, F.array(low)).otherwise(F.array(low, high))


def active_support_points(df: DataFrame, axis: Sequence[float]) -> DataFrame:
    """record_id, sig_id, points, n."""
    return df.groupBy("record_id", "sig_id", support_points(axis, F.col("v")).alias("points")).agg(F.count(F.lit(1)).alias("n"))


def class_sums(classes: DataFrame, values: DataFrame) -> DataFrame:
    """record_id, class, v: sums of another signal over the samples of each class (record_id, class, idx)."""
    return classes.join(values.select("record_id", "idx", "v"), ["record_id", "idx"]).groupBy("record_id", "class").agg(F.sum("v").alias("v"))


def eta_distribution(rows: DataFrame, interval: float, offset: float) -> DataFrame:
    """record_id, class, p, ein, eout, eta of intervals (record_id, dt, ein, eout, etrigger): by the trigger's mean power; the sign of its sum decides the direction."""
    rows = checked(rows, F.col("dt") == 0, "an interval has no length")
    cls = exprs.classify_even(F.col("etrigger") / F.col("dt"), interval, offset)
    sums = rows.groupBy("record_id", cls.alias("class")).agg(*[F.sum(c).alias(c) for c in ("dt", "ein", "eout", "etrigger")])
    eta = exprs.eta_with_sign(F.col("etrigger"), F.col("ein"), F.col("eout"))
    return sums.select("record_id", "class", exprs.safe_div(F.col("etrigger"), F.col("dt")).alias("p"), "ein", "eout", eta.alias("eta"))
