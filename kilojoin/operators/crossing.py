"""Sign changes of several signals as common events, and records chopped at them.

Between two samples a signal changes sign where its line meets zero; leaving zero or reaching it counts as well, so [1, 0, -1] has two
events. Signals that change at the same fraction of an interval share one event. At an event those signals are exactly zero, all
others lie on their lines; it closes one piece of the record and opens the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.functions import exprs

KEY = ["record_id", "idx"]


def fraction(x0: Column, x1: Column) -> Column:
    """Where between x0 and x1 the sign changes, as a part of the interval; null if it doesn't."""
    return F.when(exprs.sign(x0) != exprs.sign(x1), exprs.safe_div(x0, x0 - x1))


def _intervals(signals: DataFrame) -> DataFrame:
    w = Window.partitionBy("record_id", "sig_id").orderBy("idx")
    rows = signals.withColumns({"t1": F.lead("t").over(w), "v1": F.lead("v").over(w)})
    return rows.withColumn("fraction", F.when(F.col("t1").isNotNull(), fraction(F.col("v"), F.col("v1"))))


def patterns(signals: DataFrame) -> DataFrame:
    """record_id, idx (of the sample before), fraction, t, sig_ids (sorted) of every event of signals (record_id, idx, t, sig_id, v)."""
    rows = _intervals(signals).where("fraction is not null")
    at = F.col("t") + (F.col("t1") - F.col("t")) * F.col("fraction")
    return rows.groupBy(*KEY, "fraction").agg(F.min(at).alias("t"), F.array_sort(F.collect_set("sig_id")).alias("sig_ids")).select(*KEY, "fraction", "t", "sig_ids")


def chopped(signals: DataFrame, duplicates: bool = False) -> DataFrame:
    """record_id, piece, nth (in the piece), t, sig_id, v: the record between its events.

    duplicates: an event at a sample stands beside it; else rows of a piece at equal times count once, the first one. Pieces of fewer than two rows are dropped.
    """
    rows = _intervals(signals)
    events = patterns(signals).select(*KEY, "fraction", F.col("t").alias("te"), "sig_ids")
    own = rows.where("t1 is not null").select(*KEY, "sig_id", "v", "v1").join(events, KEY)
    on_line = F.col("v") + (F.col("v1") - F.col("v")) * F.col("fraction")
    value = F.when(F.array_contains("sig_ids", F.col("sig_id")), F.lit(0.0)).otherwise(on_line)
    cut = own.select(*KEY, "sig_id", F.col("fraction").alias("at"), F.explode(F.array(F.lit(0), F.lit(1))).alias("opens"), F.col("te").alias("t"), value.alias("v"))
    samples = signals.select(*KEY, "sig_id", F.lit(-1.0).alias("at"), F.lit(0).alias("opens"), "t", "v")
    w = Window.partitionBy("record_id", "sig_id").orderBy("idx", "at", "opens")
    out = samples.unionByName(cut).withColumn("piece", F.sum("opens").over(w))
    piece = Window.partitionBy("record_id", "sig_id", "piece").orderBy("idx", "at", "opens")
    if not duplicates:
        out = out.withColumn("_t", F.lag("t").over(piece)).where("_t is null or _t <> t")
    out = out.withColumns({"nth": F.row_number().over(piece) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("record_id", "sig_id", "piece"))})
    return out.where("_n >= 2").select("record_id", "piece", "nth", "t", "sig_id", "v")
