"""Zero crossings and sections of power records.

Rows are (record_id, idx, t, sig_id, v). Samples of a record are gathered by (record_id, idx) into one array over its
signals after a single exchange by record_id, which the windows reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.functions import exprs
from kilojoin.operators.flow import small
from kilojoin.operators.record import checked
from kilojoin.operators.skew import dealt

def _w():
    return Window.partitionBy("record_id").orderBy("idx")


def samples(df: DataFrame) -> DataFrame:
    """record_id, idx, t, s: one row for each sample, s the array of (sig_id, v) by name."""
    return df.groupBy("record_id", "idx").agg(F.min("t").alias("t"), F.array_sort(F.collect_list(F.struct("sig_id", "v"))).alias("s"))


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("record_id", "idx", "t", F.explode("s").alias("x")).select("record_id", "idx", "t", "x.sig_id", "x.v")


def zero_time(t1: Column, t2: Column, p1: Column, p2: Column) -> Column:
    """Where the straight line crosses zero; t1 for a vertical step."""
    return F.when(t1 == t2, t1).otherwise(t1 - p1 * (t2 - t1) / F.when(p2 != p1, p2 - p1))


def add_zero_crossings(df: DataFrame) -> DataFrame:
    """df with one more sample for each change of sign of each signal (times sorted, equal ones kept), all signals on straight lines there and
    the crossing one exactly zero. Falling times are an error."""
    rows = samples(dealt(df, "record_id")).withColumn("_t", F.lead("t").over(_w())).withColumn("_n", F.lead("s").over(_w()))
    rows = checked(rows, F.col("_t") < F.col("t"), "times fall")
    pairs = F.zip_with("s", "_n", lambda a, b: F.struct(a["sig_id"].alias("sig_id"), a["v"].alias("a"), b["v"].alias("b")))
    flips = F.filter(pairs, lambda p: ((p["a"] > 0) & (p["b"] < 0)) | ((p["a"] < 0) & (p["b"] > 0)))
    times = F.array_sort(F.transform(flips, lambda p: F.struct(zero_time(F.col("t"), F.col("_t"), p["a"], p["b"]).alias("t"), p["sig_id"].alias("own"))))
    none = F.lit(None).cast("struct<t:double,own:string>")
    events = F.concat(F.array(none), F.when(F.col("_n").isNotNull(), times).otherwise(F.array().cast("array<struct<t:double,own:string>>")))
    rows = rows.select("record_id", "idx", "t", "_t", "s", pairs.alias("_p"), F.posexplode(events).alias("_k", "_e"))
    at = F.col("_e.t")

    def value(p: Column) -> Column:
        line = F.when(F.col("t") == F.col("_t"), (p["a"] + p["b"]) / 2).otherwise(p["a"] + (p["b"] - p["a"]) / F.when(F.col("_t") != F.col("t"), F.col("_t") - F.col("t")) * (at - F.col("t")))
        # rounding must not put a signal on the wrong side of zero: up to its own crossing it has its old sign, then its new one
        own = zero_time(F.col("t"), F.col("_t"), p["a"], p["b"])
        side = F.when((own > at) | ((own == at) & (p["sig_id"] > F.col("_e.own"))), p["a"]).otherwise(p["b"])
        flips = ((p["a"] > 0) & (p["b"] < 0)) | ((p["a"] < 0) & (p["b"] > 0))
        low = F.when(flips, F.least(side, F.lit(0.0))).otherwise(F.least(p["a"], p["b"]))
        high = F.when(flips, F.greatest(side, F.lit(0.0))).otherwise(F.greatest(p["a"], p["b"]))
        line = F.least(F.greatest(line, low), high)
        return F.struct(p["sig_id"].alias("sig_id"), F.when(p["sig_id"] == F.col("_e.own"), F.lit(0.0)).otherwise(line).alias("v"))

    rows = rows.withColumn("s", F.when(F.col("_k") == 0, F.col("s")).otherwise(F.transform("_p", value)))
    rows = rows.withColumn("t", F.when(F.col("_k") == 0, F.col("t")).otherwise(at))
    order = Window.partitionBy("record_id").orderBy("idx", "_k")
    return _long(rows.withColumn("idx", (F.row_number().over(order) - 1).cast("long")))


def steps(df: DataFrame) -> DataFrame:
    """record_id, idx, t, _t, event: what happens between each sample and the next over all signals.

    Left: some signal leaves zero, none becomes zero; Right: the other way round; Mixed: both; else None. A signal that crosses
    zero without a sample there is an error.
    """
    rows = samples(df).withColumn("_t", F.lead("t").over(_w())).withColumn("_n", F.lead("s").over(_w())).where("_n is not null")
    signs = F.zip_with("s", "_n", lambda a, b: F.struct(exprs.sign(a["v"]).alias("a"), exprs.sign(b["v"]).alias("b")))
    rows = rows.withColumn("_g", signs)
    rows = checked(rows, F.exists("_g", lambda g: g["a"] * g["b"] < 0), "a signal crosses zero between samples")
    left, right = F.exists("_g", lambda g: (g["a"] == 0) & (g["b"] != 0)), F.exists("_g", lambda g: (g["a"] != 0) & (g["b"] == 0))
    event = F.when(left & right, "Mixed").when(left, "Left").when(right, "Right").otherwise("None")
    return rows.select("record_id", "idx", "t", "_t", "s", "_n", event.alias("event"))


def intervals(df: DataFrame) -> DataFrame:
    """record_id, section, idx, t, dt, sig_id, v, w, e: every interval of every signal with its section.

    Sections are cut where signals leave or reach zero; numbers count empty sections too. A record's last interval never cuts.
    """
    rows = steps(df)
    last = F.lead("idx").over(_w()).isNull()
    event = F.when(last, F.lit("None")).otherwise(F.col("event"))
    cut_before = event.isin("Left", "Mixed").cast("long")
    cut_after = event.isin("Right", "Mixed").cast("long")
    rows = rows.withColumn("_b", cut_before).withColumn("_c", cut_after)
    section = F.sum("_b").over(_w().rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_c").over(_w().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("section", section)
    pairs = F.zip_with("s", "_n", lambda a, b: F.struct(a["sig_id"].alias("sig_id"), a["v"].alias("v"), b["v"].alias("w")))
    rows = rows.select("record_id", "section", "idx", "t", (F.col("_t") - F.col("t")).alias("dt"), F.explode(pairs).alias("x"))
    return rows.select("record_id", "section", "idx", "t", "dt", "x.sig_id", "x.v", "x.w", (F.col("dt") * (F.col("x.v") + F.col("x.w")) / 2).alias("e"))


def sections(cut: DataFrame) -> DataFrame:
    """record_id, section, i_from, i_to, t0, t1 from intervals()."""
    return cut.groupBy("record_id", "section").agg(F.min("idx").alias("i_from"), (F.max("idx") + 1).alias("i_to"), F.min("t").alias("t0"), F.max(F.col("t") + F.col("dt")).alias("t1"))


def section_samples(cut: DataFrame) -> DataFrame:
    """record_id, section, idx, t, sig_id, v: each section's samples; neighbours share the one at the cut."""
    w = Window.partitionBy("record_id", "sig_id").orderBy("idx")
    nxt = F.lead("section").over(w)
    start = F.struct("idx", "t", "v")
    end = F.struct((F.col("idx") + 1).alias("idx"), (F.col("t") + F.col("dt")).alias("t"), F.col("w").alias("v"))
    rows = cut.withColumn("_last", nxt.isNull() | (nxt != F.col("section")))
    rows = rows.select("record_id", "section", "sig_id", F.explode(F.when(F.col("_last"), F.array(start, end)).otherwise(F.array(start))).alias("x"))
    return rows.select("record_id", "section", "x.idx", "x.t", "sig_id", "x.v")


def section_energy(cut: DataFrame) -> DataFrame:
    """record_id, section, sig_id, dt, e."""
    return cut.groupBy("record_id", "section", "sig_id").agg(F.sum("dt").alias("dt"), F.sum("e").alias("e"))


def longer(energy: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """Sections that last at least (strictly: more than) so long."""
    rows = energy.withColumn("_d", F.max("dt").over(Window.partitionBy("record_id", "section")))
    return rows.where(F.col("_d") > least if strict else F.col("_d") >= least).drop("_d")


def energy_below(energy: DataFrame, limit: float) -> DataFrame:
    """record_id, section, below: every signal's energy is nearer to zero than the limit."""
    return energy.groupBy("record_id", "section").agg(F.bool_and(F.abs("e") < limit).alias("below"))


def major(energy: DataFrame, limit: float, least: float) -> DataFrame:
    """Sections that last at least so long and in which some signal has at least so much energy."""
    w = Window.partitionBy("record_id", "section")
    rows = energy.withColumns({"_b": F.bool_and(F.abs("e") < limit).over(w), "_d": F.max("dt").over(w)})
    return rows.where(~F.col("_b") & (F.col("_d") >= least)).drop("_b", "_d")


def consistent(cut: DataFrame) -> DataFrame:
    """record_id, section, consistent: no signal has both signs inside the section."""
    low, high = F.min(F.least("v", "w")), F.max(F.greatest("v", "w"))
    each = cut.groupBy("record_id", "section", "sig_id").agg(((low >= 0) | (high <= 0)).alias("_c"))
    return each.groupBy("record_id", "section").agg(F.bool_and("_c").alias("consistent"))


def reindexed(cut: DataFrame) -> DataFrame:
    """Sections numbered without gaps."""
    w = Window.partitionBy("record_id").orderBy("section")
    ids = cut.select("record_id", "section").distinct().withColumn("_new", (F.row_number().over(w) - 1).cast("long"))
    return cut.join(ids, ["record_id", "section"]).withColumn("section", F.col("_new")).drop("_new")


def concatenated(own: DataFrame) -> DataFrame:
    """Sections' samples (section_samples) as one record again; the shared first sample of later sections goes."""
    first = own.groupBy("record_id").agg(F.min("section").alias("_s"))
    start = own.groupBy("record_id", "section").agg(F.min("idx").alias("_i"))
    rows = own.join(first, "record_id").join(start, ["record_id", "section"]).where("section = _s or idx > _i")
    w = Window.partitionBy("record_id", "sig_id").orderBy("section", "idx")
    return rows.withColumn("idx", (F.row_number().over(w) - 1).cast("long")).select("record_id", "idx", "t", "sig_id", "v")


def consistent_edges(cut: DataFrame, edges: DataFrame) -> DataFrame:
    """record_id, section, n_from, n_to, ok: both ends of the edge keep one sign, the same one, throughout the section; edges: n_from, n_to, sig_out, sig_in."""
    ends = edges.select("n_from", "n_to", F.explode(F.array("sig_out", "sig_in")).alias("sig_id"))
    own = cut.join(small(ends), "sig_id")
    low, high = F.min(F.least("v", "w")), F.max(F.greatest("v", "w"))
    return own.groupBy("record_id", "section", "n_from", "n_to").agg(((low >= 0) | (high <= 0)).alias("ok"))


def split_consistent(cut: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The intervals of sections whose edges are all consistent, and those of the others."""
    ok = consistent_edges(cut, edges).groupBy("record_id", "section").agg(F.bool_and("ok").alias("ok"))
    good, bad = (ok.where(c).select("record_id", "section") for c in ("ok", "not ok"))
    return cut.join(good, ["record_id", "section"], "left_semi"), cut.join(bad, ["record_id", "section"], "left_semi")


def chop(signals: DataFrame, cuts: DataFrame, interpolate: bool = False) -> DataFrame:
    """record_id, sig_id, piece, t, v: signals chopped at times (record_id, t); a sample at a cut opens a piece.

    interpolate: the value on the straight line at each cut closes one piece and opens the next. Cuts and samples are merged
    in one sorted pass for each signal, so pieces need no join by ranges.
    """
    keys = signals.select("record_id", "sig_id").distinct()
    marks = cuts.select("record_id", "t").distinct().join(keys, "record_id").select("record_id", "sig_id", "t", F.lit(None).cast("double").alias("v"), F.lit(0).alias("kind"))
    rows = signals.select("record_id", "sig_id", "t", "v", F.lit(1).alias("kind")).unionByName(marks)
    w = Window.partitionBy("record_id", "sig_id").orderBy("t", "kind")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("record_id", "sig_id").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    sample = lambda c: F.when(F.col("kind") == 1, F.col(c))
    rows = rows.withColumn("piece", F.sum((F.col("kind") == 0).cast("long")).over(upto))
    if not interpolate:
        return rows.where("kind = 1").select("record_id", "sig_id", "piece", "t", "v")
    t0, v0 = F.last(sample("t"), True).over(before), F.last(sample("v"), True).over(before)
    t1, v1 = F.last(sample("t"), True).over(after), F.last(sample("v"), True).over(after)
    rows = rows.withColumns({"t0": t0, "v0": v0, "t1": t1, "v1": v1})
    line = F.when(F.col("t1") == F.col("t"), F.col("v1")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / F.when(F.col("t1") != F.col("t0"), F.col("t1") - F.col("t0")))
    # a cut beyond the samples has no value; one on a sample only closes the piece before, as the sample opens the next
    inner = F.col("v0").isNotNull() & F.col("v1").isNotNull()
    both = F.when(F.col("t1") == F.col("t"), F.array(F.col("piece") - 1)).otherwise(F.array(F.col("piece") - 1, F.col("piece")))
    edges = rows.where((F.col("kind") == 0) & inner).select("record_id", "sig_id", F.explode(both).alias("piece"), "t", line.alias("v"))
    return rows.where("kind = 1").select("record_id", "sig_id", "piece", "t", "v").unionByName(edges)
