"""Records: signals of one time axis, as long rows (record_id, idx, t, sig_id, v) or one wide row for each sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.functions import exprs
from kilojoin.operators.signal import KEY, over, stacked


def checked(df: DataFrame, bad: Column, what: str) -> DataFrame:
    """df, failing with ``what`` on the first row where ``bad`` holds."""
    return df.where(F.when(bad, F.raise_error(F.lit(what)).isNull()).otherwise(True))


def wide(df: DataFrame, signals: list[str]) -> DataFrame:
    """record_id, idx, t and a column for each of the named signals."""
    return df.groupBy("record_id", "idx").agg(F.min("t").alias("t"), *[F.max(F.when(F.col("sig_id") == s, F.col("v"))).alias(s) for s in signals])


def long(df: DataFrame, signals: list[str]) -> DataFrame:
    return df.unpivot(["record_id", "idx", "t"], signals, "sig_id", "v").where("v is not null")


def extract(df: DataFrame, ids: list[str]) -> DataFrame:
    """The named signals; an error if a record lacks one."""
    own = df.where(F.col("sig_id").isin(*ids))
    lacking = df.groupBy("record_id").agg(F.collect_set(F.when(F.col("sig_id").isin(*ids), F.col("sig_id"))).alias("_s"))
    lacking = checked(lacking, F.size("_s") < len(set(ids)), "a record lacks a signal").select("record_id")
    return own.join(lacking, "record_id", "left_semi")


def get_signal(df: DataFrame, sig_id: str) -> DataFrame:
    return df.where(F.col("sig_id") == sig_id)


def get_time(df: DataFrame) -> DataFrame:
    return df.groupBy("record_id", "idx").agg(F.min("t").alias("t"))


def time_window(df: DataFrame) -> DataFrame:
    return df.groupBy("record_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))


def value_range(df: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """record_id, low, high over the chosen signals."""
    own = df if ids is None else df.where(F.col("sig_id").isin(*ids))
    return own.groupBy("record_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def norm_to_range(df: DataFrame, low: float, high: float) -> DataFrame:
    """Every signal stretched to low..high; a constant signal sits at low."""
    e = df.groupBy(*KEY).agg(F.min("v").alias("_l"), F.max("v").alias("_h"))
    new = F.when(F.col("_h") == F.col("_l"), F.lit(float(low))).otherwise(low + (high - low) * exprs.safe_div(F.col("v") - F.col("_l"), F.col("_h") - F.col("_l")))
    return df.join(e, KEY).withColumn("v", new).select(*df.columns)


def norm_to_max75(df: DataFrame) -> DataFrame:
    """Every signal scaled so that its largest absolute value is 75 % of the record's."""
    own = df.groupBy(*KEY).agg(F.max(F.abs("v")).alias("_m"))
    both = own.join(own.groupBy("record_id").agg(F.max("_m").alias("_all")), "record_id")
    factor = F.when(F.col("_m") == 0, F.lit(1.0)).otherwise(exprs.safe_div(0.75 * F.col("_all"), F.col("_m")))
    return df.join(both, KEY).withColumn("v", F.col("v") * factor).select(*df.columns)


def rename(df: DataFrame, f) -> DataFrame:
    return df.withColumn("sig_id", f(F.col("sig_id")))


def with_record_name(df: DataFrame) -> DataFrame:
    """Signal names with the record's name before them."""
    return rename(df, lambda s: F.concat_ws("_", F.col("record_id").cast("string"), s))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of signals on the same time axes; an error if times differ or names collide."""
    both = stacked(a, b)
    clash = both.groupBy("record_id", "idx", "sig_id").agg(F.count(F.lit(1)).alias("n"))
    times = both.groupBy("record_id", "idx").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    clash = checked(clash, F.col("n") > 1, "a signal is there twice").select("record_id", "idx", "sig_id")
    times = checked(times, F.col("_t0") != F.col("_t1"), "times differ").select("record_id", "idx")
    return both.join(clash, ["record_id", "idx", "sig_id"], "left_semi").join(times, ["record_id", "idx"], "left_semi")


def resample(df: DataFrame, times: DataFrame, rows: int | None = None) -> DataFrame:
    """Every signal at the times (record_id, idx, t) of another table by straight lines; NaN beyond its own ends.

    Samples and asked times are merged in one sort for each signal; a time that hits a step takes the mean of both values. rows: how many samples and
    asked values there are at most, if that is known.
    """
    w = over(order="t")
    samples = df.withColumn("_s", F.struct("t", "v", F.lag("t").over(over()).alias("pt"), F.lag("v").over(over()).alias("pv")))
    samples = samples.select(*KEY, "t", "idx", F.lit(0).alias("_asked"), "_s")
    asked = df.select(*KEY).distinct().join(times.select("record_id", "idx", "t"), "record_id")
    asked = asked.select(*KEY, "t", "idx", F.lit(1).alias("_asked"), F.lit(None).cast(samples.schema["_s"].dataType).alias("_s"))
    w = Window.partitionBy(*KEY).orderBy("t", "_asked", "idx")
    rows = stacked(samples, asked, *KEY, rows=rows)
    rows = rows.withColumn("_a", F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*KEY).orderBy(F.desc("t"), F.desc("_asked"), F.desc("idx"))  # what follows, as a frame that grows: a shrinking one is summed anew for each row
    rows = rows.withColumn("_b", F.last("_s", True).over(back.rowsBetween(Window.unboundedPreceding, -1))).where("_asked = 1")
    hit = F.when(F.col("_a.pt") == F.col("t"), (F.col("_a.pv") + F.col("_a.v")) / 2).otherwise(F.col("_a.v"))
    line = exprs.linear(F.col("_a.t"), F.col("_b.t"), F.col("_a.v"), F.col("_b.v"), F.col("t"))
    v = F.when(F.col("_a.t") == F.col("t"), hit).when(F.col("_a").isNull() | F.col("_b").isNull(), exprs.nan()).otherwise(line)
    return rows.select("record_id", "idx", "t", "sig_id", v.alias("v"))


def union_with_new_time(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both tables' signals at all their times inside the common window."""
    shared = a.select("record_id", "sig_id").distinct().join(b.select("record_id", "sig_id").distinct(), KEY).limit(1)
    window = time_window(a).alias("x").join(time_window(b).alias("y"), "record_id")
    window = window.select("record_id", F.greatest("x.t0", "y.t0").alias("t0"), F.least("x.t1", "y.t1").alias("t1"))
    # each signal is asked at all times of both tables
    n_a, n_b = a.count(), b.count()
    most = (n_a + n_b) * max([*(x.groupBy("record_id").agg(F.count_distinct("sig_id").alias("n")).agg(F.max("n")).first()[0] or 1 for x in (a, b))])
    times = stacked(get_time(a).select("record_id", "t"), get_time(b).select("record_id", "t"), rows=n_a + n_b)
    times = times.join(window, "record_id").where("t between t0 and t1").select("record_id", "t")
    order = Window.partitionBy("record_id").orderBy("t")
    times = times.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    both = stacked(resample(a, times, n_a + most), resample(b, times, n_b + most), rows=2 * most)
    guard = checked(shared.withColumn("_bad", F.lit(True)), F.col("_bad"), "a signal is in both records").select("record_id")
    return both.join(guard, "record_id", "left_anti")


def add_signals(df: DataFrame, new: DataFrame) -> DataFrame:
    """df and new signals of the same length; an error if lengths differ."""
    size = df.groupBy("record_id").agg(F.max("idx").alias("_n"))
    lengths = new.groupBy(*KEY).agg(F.max("idx").alias("_m")).join(size, "record_id")
    ok = checked(lengths, F.col("_n") != F.col("_m"), "lengths differ").select(*KEY)
    return stacked(df, new.join(ok, KEY, "left_semi"))


def sum_flows(flows: DataFrame) -> DataFrame:
    """record_id, sig_id, t0, t1, e: the sum of each flow over its intervals (record_id, sig_id, idx, t, dt, e)."""
    return flows.groupBy(*KEY).agg(F.min("t").alias("t0"), F.max(F.col("t") + F.col("dt")).alias("t1"), F.sum("e").alias("e"))


def sort_signals(df: DataFrame) -> DataFrame:
    """record_id, rank, sig_id, v: signals by their sums."""
    sums = df.groupBy(*KEY).agg(F.sum("v").alias("v"))
    w = Window.partitionBy("record_id").orderBy("v", "sig_id")
    return sums.select("record_id", (F.row_number().over(w)).alias("rank"), "sig_id", "v")


def approx_equal(a: DataFrame, b: DataFrame, eps: float) -> DataFrame:
    """record_id, equal: the same signals and samples, times and values within eps."""
    x = a.select("record_id", "sig_id", "idx", F.col("t").alias("_t"), F.col("v").alias("_v"))
    both = x.join(b, ["record_id", "sig_id", "idx"], "full")
    ok = F.coalesce((F.abs(F.col("_t") - F.col("t")) <= eps) & (F.abs(F.col("_v") - F.col("v")) <= eps), F.lit(False))
    return both.groupBy("record_id").agg(F.bool_and(ok).alias("equal"))
