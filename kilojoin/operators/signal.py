"""Signals: rows (record_id, idx, t, sig_id, v), one for each sample; idx counts the samples of a record from 0.

Operators on neighbours use a window over one signal; whatever is gathered for a whole signal is a partial
aggregation that is joined back, so that a long record is not one task's memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.functions import exprs, types
from kilojoin.operators.skew import dealt

KEY = ["record_id", "sig_id"]
V = F.col


def over(by: list[str] | None = None, order: str = "idx"):
    return Window.partitionBy(*(KEY if by is None else by)).orderBy(order)


def from_lists(spark, values: dict[str, list[float]], times: list[float] | None = None, record: str = "r") -> DataFrame:
    """A small record from lists."""
    n = max(map(len, values.values()), default=0)
    times = [float(i) for i in range(n)] if times is None else times
    rows = [(record, i, float(times[i]), s, float(x)) for s, xs in values.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "record_id string, idx long, t double, sig_id string, v double")


def stacked(a: DataFrame, b: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """Rows of both tables, dealt out by key (record_id, if none is given); in tasks of a bounded size, if it is known how many rows there are at most.

    Spark 4.1 takes a union of equally partitioned tables as partitioned itself and then joins it wrongly in some plans, so the exchange
    that the next operator needs is stated here.
    """
    both, by = a.unionByName(b), by or ("record_id",)
    return both.repartition(*by) if rows is None else dealt(both, *by, rows=rows)


# element by element ---------------------------------------------------------------------------------


def map_values(df: DataFrame, f: Callable[[Column], Column], only: list[str] | None = None) -> DataFrame:
    """f of every value, or of the named signals' values."""
    new = f(F.col("v"))
    return df.withColumn("v", new if only is None else F.when(F.col("sig_id").isin(*only), new).otherwise(F.col("v")))


def scale(df: DataFrame, k: float) -> DataFrame:
    return map_values(df, lambda v: v * k)


def offset(df: DataFrame, k: float) -> DataFrame:
    return map_values(df, lambda v: v + k)


def neg(df: DataFrame) -> DataFrame:
    return map_values(df, lambda v: -v)


def reciprocal(df: DataFrame) -> DataFrame:
    return map_values(df, lambda v: exprs.safe_div(F.lit(1.0), v))


def absolute(df: DataFrame) -> DataFrame:
    return map_values(df, F.abs)


def sign(df: DataFrame) -> DataFrame:
    return map_values(df, exprs.sign)


def remove_zero_noise(df: DataFrame, threshold: float) -> DataFrame:
    return map_values(df, lambda v: exprs.hard_shrinkage(v, threshold))


def constant_like(df: DataFrame, k: float) -> DataFrame:
    return df.withColumn("v", F.lit(float(k)))


def norm(df: DataFrame) -> DataFrame:
    """(v - min) / (max - min) of each signal; a constant signal keeps its value."""
    ends = df.groupBy(*KEY).agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    new = F.when(F.col("_high") == F.col("_low"), F.col("_low")).otherwise(exprs.safe_div(F.col("v") - F.col("_low"), F.col("_high") - F.col("_low")))
    return df.join(ends, KEY).withColumn("v", new).select(*df.columns)


# two signals ----------------------------------------------------------------------------------------


def zip_with(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], sig_id: str = "zip") -> DataFrame:
    """f of the values of equal position of two signals of each record; the shorter one decides the length."""
    role = types.role(types.role_of(a), types.role_of(b))
    joined = a.alias("a").join(b.alias("b"), ["record_id", "idx"])
    return joined.select("record_id", "idx", F.col("a.t").alias("t"), F.lit(sig_id).alias("sig_id"), types.tag(f(F.col("a.v"), F.col("b.v")), "v", role_=role))


def zip3(a: DataFrame, b: DataFrame, c: DataFrame, f: Callable[[Column, Column, Column], Column], sig_id: str = "zip") -> DataFrame:
    joined = a.alias("a").join(b.alias("b"), ["record_id", "idx"]).join(c.alias("c"), ["record_id", "idx"])
    return joined.select("record_id", "idx", F.col("a.t").alias("t"), F.lit(sig_id).alias("sig_id"), f(F.col("a.v"), F.col("b.v"), F.col("c.v")).alias("v"))


def _typed(a: DataFrame, b: DataFrame, f, typ) -> DataFrame:
    out = typ(types.typ_of(a), types.typ_of(b))  # raises where the types don't fit
    return types.set_type(zip_with(a, b, f), out)


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    return _typed(a, b, lambda x, y: x * y, types.product)


def over_(a: DataFrame, b: DataFrame) -> DataFrame:
    return _typed(a, b, exprs.safe_div, types.quotient)


def plus(a: DataFrame, b: DataFrame) -> DataFrame:
    return _typed(a, b, lambda x, y: x + y, types.total)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b of equal types is their difference."""

    def typ(x: types.Typ, y: types.Typ) -> types.Typ:
        return types.successor(x) if x == y else types.total(x, y)

    return _typed(a, b, lambda x, y: x - y, typ)


def cross_with(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """record_id, i, j, v: f of every pair of samples of two signals of a record (an outer product is what is asked for)."""
    right = b.select("record_id", F.col("idx").alias("j"), F.col("v").alias("_w"))
    return a.join(right, "record_id").select("record_id", F.col("idx").alias("i"), "j", f(F.col("v"), F.col("_w")).alias("v"))


def variation2d(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """record_id, i (of y), j (of x), x, y: the mesh of two axes."""
    y = ys.select("record_id", F.col("idx").alias("i"), F.col("v").alias("y"))
    return xs.select("record_id", F.col("idx").alias("j"), F.col("v").alias("x")).join(y, "record_id").select("record_id", "i", "j", "x", "y")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two rising signals of each record as one, equal values of a first."""
    both = stacked(a.withColumn("_side", F.lit(0)), b.withColumn("_side", F.lit(1)))
    w = Window.partitionBy("record_id").orderBy("v", "_side", "idx")
    return both.withColumn("idx", F.row_number().over(w) - 1).select("record_id", F.col("idx").cast("long").alias("idx"), "v")


def sort_two(x: DataFrame, y: DataFrame) -> DataFrame:
    """record_id, rank, x, y: y in the order of x, stable."""
    both = x.select("record_id", "idx", F.col("v").alias("x")).join(y.select("record_id", "idx", F.col("v").alias("y")), ["record_id", "idx"])
    w = Window.partitionBy("record_id").orderBy("x", "idx")
    return both.select("record_id", (F.row_number().over(w) - 1).cast("long").alias("rank"), "x", "y")


# neighbours -----------------------------------------------------------------------------------------


def delta_map(df: DataFrame, f: Callable[[Column, Column], Column], by: list[str] | None = None) -> DataFrame:
    """f(v[i], v[i+1]): one row fewer; idx and t are the left sample's."""
    w = over(by)
    nxt, there = F.lead("v").over(w), F.lead("idx").over(w)
    return df.withColumn("_n", nxt).withColumn("_i", there).where("_i is not null").withColumn("v", f(F.col("v"), F.col("_n"))).drop("_n", "_i")


def delta(df: DataFrame) -> DataFrame:
    return delta_map(df, lambda a, b: b - a)


def average(df: DataFrame) -> DataFrame:
    return delta_map(df, lambda a, b: (a + b) / 2)


def part_integrate(df: DataFrame) -> DataFrame:
    """record_id, sig_id, idx, t, dt, e: the trapezoid of every interval."""
    w = over()
    rows = df.select("record_id", "sig_id", "idx", "t", (F.lead("t").over(w) - F.col("t")).alias("dt"), ((F.col("v") + F.lead("v").over(w)) / 2).alias("p"))
    return rows.where("dt is not null").select("record_id", "sig_id", "idx", "t", "dt", (F.col("dt") * F.col("p")).alias("e"))


def full_integrate(df: DataFrame) -> DataFrame:
    """record_id, sig_id, e: the trapezoid integral."""
    return part_integrate(df).groupBy(*KEY).agg(F.sum("e").alias("e"))


def diff_time(df: DataFrame) -> DataFrame:
    """record_id, sig_id, idx, dt, p: length and mean power of every interval."""
    return part_integrate(df).select("record_id", "sig_id", "idx", "dt", exprs.safe_div(F.col("e"), F.col("dt")).alias("p"))


def ends(df: DataFrame) -> DataFrame:
    """record_id, sig_id, first, last."""
    return df.groupBy(*KEY).agg(F.min_by("v", "idx").alias("first"), F.max_by("v", "idx").alias("last"))


def reverse(df: DataFrame) -> DataFrame:
    last = df.groupBy(*KEY).agg(F.max("idx").alias("_last"))
    return df.join(last, KEY).withColumn("idx", F.col("_last") - F.col("idx")).drop("_last")


def stepped(df: DataFrame) -> DataFrame:
    """A step record: times t0,t1,t1,t2,..., values v0,v0,v1,v1,...; the last value goes."""
    w = over()
    rows = df.withColumn("_t", F.lead("t").over(w)).where("_t is not null")
    rows = rows.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1))))
    t = F.when(F.col("_k") == 0, F.col("t")).otherwise(F.col("_t"))
    return rows.withColumn("t", t).withColumn("idx", F.col("idx") * 2 + F.col("_k")).drop("_t", "_k")


def densify(df: DataFrame, n: int) -> DataFrame:
    """n points for each interval, evenly spaced, on the straight line; the last sample stays."""
    w = over()
    rows = df.withColumn("_t", F.lead("t").over(w)).withColumn("_v", F.lead("v").over(w))
    rows = rows.withColumn("_k", F.explode(F.when(F.col("_t").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(n - 1)))))
    part = F.col("_k") / F.lit(float(n))
    t = F.when(F.col("_t").isNull(), F.col("t")).otherwise(F.col("t") + part * (F.col("_t") - F.col("t")))
    v = F.when(F.col("_t").isNull(), F.col("v")).otherwise(F.col("v") + part * (F.col("_v") - F.col("v")))
    return rows.withColumn("v", v).withColumn("t", t).withColumn("idx", F.col("idx") * n + F.col("_k")).drop("_t", "_v", "_k")


def scatter(df: DataFrame, noise: list[float], factor: float) -> DataFrame:
    """Each value but the last once for each number of ``noise``, moved by factor times that number."""
    w, n = over(), len(noise)
    rows = df.withColumn("_more", F.lead("idx").over(w).isNotNull())
    rows = rows.withColumn("_k", F.explode(F.when(F.col("_more"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    move = F.when(F.col("_more"), F.element_at(F.array(*[F.lit(float(x)) for x in noise]), F.col("_k") + 1) * factor).otherwise(0.0)
    return rows.withColumn("v", F.col("v") + move).withColumn("idx", F.col("idx") * n + F.col("_k")).drop("_k", "_more")


# folds ----------------------------------------------------------------------------------------------


def total(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def extrema(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"))


def minimum_ignoring_nan(df: DataFrame) -> DataFrame:
    """The least number; NaN if there is none."""
    return df.groupBy(*KEY).agg(F.coalesce(F.min(F.when(~F.isnan("v"), F.col("v"))), exprs.nan()).alias("v"))


def arg_max(df: DataFrame, key: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """record_id, sig_id, idx, v of the first largest value; NaN loses."""
    rows = df.where(~F.isnan("v"))
    best = F.max_by(F.struct("idx", "v"), F.struct(key(F.col("v")), -F.col("idx")))
    return rows.groupBy(*KEY).agg(best.alias("_b")).select(*KEY, F.col("_b.idx").alias("idx"), F.col("_b.v").alias("v"))


def zip_arg_max(df: DataFrame, signals: list[str]) -> DataFrame:
    """record_id, idx, best: which of the signals is the first largest at each sample (from 0)."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(signals) for x in (s, i)]), F.col("sig_id"))
    rows = df.where(F.col("sig_id").isin(*signals)).withColumn("_r", rank)
    return rows.groupBy("record_id", "idx").agg(F.max_by("_r", F.struct("v", -F.col("_r"))).alias("best"), F.max("v").alias("v"))


def unique(df: DataFrame) -> DataFrame:
    return df.select(*KEY, "v").distinct()


def find_indices(df: DataFrame, p: Callable[[Column], Column]) -> DataFrame:
    return df.where(p(F.col("v"))).select(*KEY, "idx")


def has_sign_change(df: DataFrame) -> DataFrame:
    """record_id, sig_id, changes: not all signs are equal."""
    s = exprs.sign(F.col("v"))
    return df.groupBy(*KEY).agg((F.min(s) != F.max(s)).alias("changes"))


def quantified(df: DataFrame, p: Callable[[Column], Column]) -> DataFrame:
    """record_id, sig_id, every, some."""
    return df.groupBy(*KEY).agg(F.bool_and(p(F.col("v"))).alias("every"), F.bool_or(p(F.col("v"))).alias("some"))


def equal_by(a: DataFrame, b: DataFrame, p: Callable[[Column, Column], Column]) -> DataFrame:
    """record_id, equal: the same samples, and p holds for each."""
    x = a.select("record_id", "idx", F.col("v").alias("_a"), F.lit(True).alias("_x"))
    y = b.select("record_id", "idx", F.col("v").alias("_b"), F.lit(True).alias("_y"))
    ok = F.coalesce(F.col("_x") & F.col("_y") & p(F.col("_a"), F.col("_b")), F.lit(False))
    return x.join(y, ["record_id", "idx"], "full").groupBy("record_id").agg(F.bool_and(ok).alias("equal"))


def remove_adjacent_duplicates(df: DataFrame) -> DataFrame:
    before = F.lag("v").over(over())
    return df.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("v"))).drop("_b")


def slice_(df: DataFrame, first: int, last: int) -> DataFrame:
    """Samples first..last, both included, counted anew."""
    return df.where(F.col("idx").between(first, last)).withColumn("idx", F.col("idx") - first)


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """b after a, for each signal."""
    size = a.groupBy(*KEY).agg((F.max("idx") + 1).alias("_n"))
    moved = b.join(size, KEY, "left").withColumn("idx", F.col("idx") + F.coalesce("_n", F.lit(0))).drop("_n")
    return stacked(a, moved)


def split(df: DataFrame, n: int) -> DataFrame:
    """With ``chunk``: signals in groups of n by name."""
    w = Window.partitionBy("record_id").orderBy("sig_id")
    ids = df.select("record_id", "sig_id").distinct().withColumn("chunk", F.floor((F.row_number().over(w) - 1) / n))
    return df.join(ids, KEY)


def lookup(df: DataFrame, at: DataFrame) -> DataFrame:
    """Values at the (record_id, idx) of another table; it is an error to ask for what isn't there."""
    found = at.join(df, ["record_id", "idx"], "left")
    return found.withColumn("v", F.when(F.col("v").isNull() & F.raise_error(F.lit("no such sample")).isNotNull(), None).otherwise(F.col("v")))


# arrays ---------------------------------------------------------------------------------------------


def packed(df: DataFrame) -> DataFrame:
    """record_id, sig_id, ts, vs: a signal as two arrays (for operators that need a short signal whole)."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "t", "v")))
    return df.groupBy(*KEY).agg(rows.alias("_r")).select(*KEY, F.transform("_r", lambda r: r["t"]).alias("ts"), F.transform("_r", lambda r: r["v"]).alias("vs"))


def unpacked(df: DataFrame) -> DataFrame:
    rows = df.select(*KEY, "ts", F.posexplode("vs").alias("idx", "v"))
    return rows.select("record_id", F.col("idx").cast("long").alias("idx"), F.element_at("ts", F.col("idx") + 1).alias("t"), "sig_id", "v")


def transpose(matrix: DataFrame) -> DataFrame:
    """record_id, i, j, v with i and j exchanged."""
    return matrix.select("record_id", F.col("j").alias("i"), F.col("i").alias("j"), "v")


def fold(df: DataFrame, start: Column, f: Callable[[Column, Column], Column], right: bool = False) -> DataFrame:
    """An ordered fold of each signal, from the left or from the right."""
    p = packed(df)
    vs = F.reverse("vs") if right else F.col("vs")
    return p.select(*KEY, F.aggregate(vs, start, f).alias("v"))


def take_until(df: DataFrame, hit: Callable[[Column], Column]) -> DataFrame:
    """The samples of each signal up to the first that satisfies ``hit``, it included; all, if none does."""
    before = Window.partitionBy("record_id", "sig_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_hits", F.coalesce(F.sum(hit(F.col("v")).cast("int")).over(before), F.lit(0)))
    return rows.where("_hits = 0").drop("_hits")


def split_at_length(df: DataFrame, like: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first samples of each record of df, as many as ``like`` has there, and the rest."""
    sizes = like.groupBy("record_id").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("record_id", "sig_id").orderBy("idx")
    rows = dealt(df, "record_id").withColumn("_i", F.row_number().over(w)).join(sizes, "record_id", "left").withColumn("_in", F.col("_i") <= F.coalesce("_n", F.lit(0)))
    return rows.where("_in").drop("_i", "_n", "_in"), rows.where("not _in").drop("_i", "_n", "_in")
