"""Drives for which storages end as full as they began, for all records at once.

A trial is a row. First a ladder of drives (zero, and steps that double to either side) is evaluated for every record in one job; a record's bracket is where
its balance changes sign. Then each round cuts every bracket into equal parts and evaluates all cuts of all records in one job. The number of jobs
depends on the precision only, not on records, storages' courses or trials; nothing but the evaluation's own rows is collected anywhere.

Several storages are balanced in turn, each against the drives found for the others, for a number of turns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.plans.storage import cut

Evaluate = Callable[[DataFrame], DataFrame]


def ladder(step: float, rungs: int) -> list[float]:
    """Zero and ±step, ±2 step, ±4 step, ..."""
    return sorted([0.0, *[s * step * 2**k for k in range(rungs) for s in (1, -1)]])


def _bracketed(tried: DataFrame, keys: Sequence[str], drive: str) -> DataFrame:
    """keys, low, high (the drives on both sides of the first change from below zero), best and its balance, bracketed."""
    w = Window.partitionBy(*keys).orderBy(drive)
    rows = tried.withColumns({"_next": F.lead(drive).over(w), "_after": F.lead("balance").over(w)})
    turn = (F.col("balance") < 0) & (F.col("_after") >= 0)
    low = F.min(F.when(turn, F.struct(F.col(drive).alias("low"), F.col("_next").alias("high"))))
    best = F.min_by(F.struct(F.col(drive).alias("drive"), "balance"), F.struct(F.abs("balance"), F.abs(drive), F.col(drive)))
    return rows.groupBy(*keys).agg(low.alias("b"), best.alias("best")).select(*keys, "b.low", "b.high", F.col("best.drive").alias("drive"), F.col("best.balance").alias("balance"), F.col("b").isNotNull().alias("bracketed"))


def drives(records: DataFrame, evaluate: Evaluate, keys: Sequence[str] = ("record_id",), drive: str = "drive", step: float = 0.125, rungs: int = 8, parts: int = 16, rounds: int = 3, most: float = 1e-3) -> DataFrame:
    """keys, drive, balance, low, high, bracketed, converged (whether the balance is within ``most`` of zero) of every record.

    evaluate: for rows of keys and a drive, the same rows with the balance that each gives, which must not fall as the drive rises. Records without a
    change of sign on the ladder keep their best rung, with null low and high.
    """
    keys = list(keys)
    trials = records.select(*keys, F.explode(F.array(*map(F.lit, ladder(step, rungs)))).alias(drive))
    found = cut(_bracketed(evaluate(trials), keys, drive))
    for _ in range(rounds):
        inner = F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / parts)
        trials = found.where("bracketed").select(*keys, F.explode(inner).alias(drive))
        finer = _bracketed(evaluate(trials), keys, drive)
        better = F.abs(F.col("n.balance")) < F.abs(F.col("o.balance"))
        both = found.alias("o").join(finer.alias("n"), keys, "left")
        pick = lambda c: F.when(better, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)  # noqa: B023, E731
        found = cut(both.select(*keys, F.coalesce("n.low", "o.low").alias("low"), F.coalesce("n.high", "o.high").alias("high"), pick("drive"), pick("balance"), F.col("o.bracketed").alias("bracketed")))
    return found.select(*keys, "drive", "balance", "low", "high", "bracketed", (F.abs("balance") <= most).alias("converged"))


def all_storages(records: DataFrame, evaluate: Callable[[DataFrame, str], DataFrame], storages: Sequence[str], turns: int = 2, **how: object) -> DataFrame:
    """record_id, and drive_<s>, balance_<s>, converged_<s> of each storage: each storage's search sees the others' drives as columns of its trials."""
    own = records.select("record_id", *[F.lit(0.0).alias(f"drive_{s}") for s in storages])
    state = {}
    for _ in range(turns):
        for s in storages:
            others = [f"drive_{o}" for o in storages if o != s]
            keys = ["record_id", *others]
            found = drives(own, lambda t, s=s: evaluate(t, s), keys, f"drive_{s}", **how)
            state[s] = found.select("record_id", F.col("balance").alias(f"balance_{s}"), F.col("converged").alias(f"converged_{s}"))
            own = cut(found.select("record_id", *others, F.col("drive").alias(f"drive_{s}")))
    for s in storages:
        own = own.join(state[s], "record_id")
    return own
