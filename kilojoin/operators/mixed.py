"""Systems of two grains: signals (a value for each interval) and scalars (a value for each section) that determine each other.

Signals obey rules within an interval, scalars rules within a section, and couplings relate the two: a scalar is the sum of a signal over its
section, or its mean over time. Solving alternates. Both grains are solved by their own rules; then known signals go up (partial aggregation to
one row for each section), and known scalars go down: an interval that alone is unknown gets the rest, and where a coupling says so the
rest is spread over all unknown intervals in proportion to time. This goes on until nothing new is known.

Defined results: a section without intervals has scalars only; intervals without a section have signals only; a sum over a section is known if all its intervals
are; nulls are unknown; an interval of no time takes no part of what is spread, and a rest over no time at all stays unknown.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.functions import exprs
from kilojoin.operators import solver
from kilojoin.operators.skew import join_owner
from kilojoin.plans.storage import cut


@dataclass(frozen=True)
class Coupling:
    """scalar = the sum of signal (kind ``integral``) or its mean over time (``mean``); spread: whether unknown intervals share what is left."""

    scalar: str
    signal: str
    kind: str = "integral"
    spread: bool = False

    def weight(self) -> Column:
        return F.col("dt") if self.kind == "mean" else F.lit(1.0)


def _known(df: DataFrame, names: Sequence[str]) -> int:
    return df.agg(F.sum(sum((F.col(c).isNotNull().cast("long") for c in names), F.lit(0).cast("long")))).first()[0] or 0


def _columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in names if c not in df.columns})


def upward(samples: DataFrame, couplings: Sequence[Coupling], part: list[str]) -> DataFrame:
    """part, time, and for each coupling c<i>_sum, c<i>_time of its known intervals and c<i>_open, how many are unknown."""
    out = [F.sum("dt").alias("time")]
    for i, c in enumerate(couplings):
        known = F.col(c.signal).isNotNull()
        out += [F.sum(F.col(c.signal) * c.weight()).alias(f"c{i}_sum"), F.sum(F.when(~known, F.col("dt"))).alias(f"c{i}_time"), F.sum((~known).cast("long")).alias(f"c{i}_open")]
    return samples.groupBy(*part).agg(*out)


def solve(
    samples: DataFrame, sections: DataFrame, signal_rules: list[solver.Rule], scalar_rules: list[solver.Rule], couplings: Sequence[Coupling], part: Sequence[str] = ("record_id", "section")
) -> tuple[DataFrame, DataFrame]:
    """samples (part, dt, further keys, signals) and sections (part, scalars) with all variables of the rules and couplings that follow.

    Each round writes each grain once; rounds end when all is known or a round finds nothing new.
    """
    part = list(part)
    signals = list(dict.fromkeys([*solver.variables(signal_rules), *[c.signal for c in couplings]]))
    scalars = list(dict.fromkeys([*solver.variables(scalar_rules), *[c.scalar for c in couplings]]))
    samples, sections, before = _columns(samples, signals), _columns(sections, scalars), -1
    while True:
        samples = cut(solver.solve(samples, signal_rules, rounds=2))
        sums = cut(upward(samples, couplings, part))
        sections = sections.join(sums, part, "left")
        for i, c in enumerate(couplings):
            whole = F.col(f"c{i}_sum") / (F.col("time") if c.kind == "mean" else 1)
            sections = sections.withColumn(c.scalar, F.coalesce(c.scalar, F.when(F.col(f"c{i}_open") == 0, whole)))
        sections = cut(solver.solve(sections, scalar_rules, rounds=2))
        n = _known(samples, signals) + _known(sections, scalars)
        down = []  # what is left for the unknown intervals of a section, and how it is dealt out
        for i, c in enumerate(couplings):
            total = F.col(c.scalar) * (F.col("time") if c.kind == "mean" else 1)
            left = total - F.coalesce(f"c{i}_sum", F.lit(0.0))
            may = (F.col(f"c{i}_open") == 1) | F.lit(c.spread)
            down.append(F.when(may & (F.col(f"c{i}_open") > 0), F.struct(left.alias("left"), F.col(f"c{i}_open").alias("n"), F.col(f"c{i}_time").alias("time"))).alias(f"c{i}"))
        owners = sections.select(*part, *down)
        sections = sections.drop(*sums.columns[len(part) :])
        if n == before or n == samples.count() * len(signals) + sections.count() * len(scalars):
            return samples, sections
        before = n
        met = join_owner(samples, owners, part)
        for i, c in enumerate(couplings):
            share = F.when(F.col(f"c{i}.n") == 1, F.lit(1.0)).otherwise(exprs.div(F.col("dt"), F.col(f"c{i}.time")))
            met = met.withColumn(c.signal, F.coalesce(c.signal, exprs.div(F.col(f"c{i}.left") * share, c.weight())))
        samples = met.drop(*[f"c{i}" for i in range(len(couplings))])
