"""Matrices of optima with points that have none: filled from the nearest point that has one, and signed by flow direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.operators.topology import BACKWARD, FORWARD
from kilojoin.plans.storage import cut


def sign_corrected(power: Column, direction: Column) -> Column:
    """A power as the topology's edge counts it: negated if the state's flow is reversed, zero if the edge is inactive."""
    return F.when(direction == FORWARD, power).when(direction == BACKWARD, -power).otherwise(F.lit(0.0))


def full_grid(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, i, j, v for every place between the smallest and largest i and j of each key; v is null where there is no point."""
    keys = list(keys)
    span = points.groupBy(*keys).agg(*[f(c).alias(n) for c in "ij" for f, n in ((F.min, f"{c}0"), (F.max, f"{c}1"))])
    places = span.select(*keys, "j0", "j1", F.explode(F.sequence("i0", "i1")).alias("i")).select(*keys, "i", F.explode(F.sequence("j0", "j1")).alias("j"))
    return places.join(points.select(*keys, "i", "j", "v"), [*keys, "i", "j"], "left")


def filled(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, i, j, v, from_i, from_j, away: every place with the value of the nearest valid one (steps along both axes), of equally near ones the smallest (from_i, from_j).

    grid: keys, i, j, v, invalid where v is null or not a number, each place once. Rounds go outward from what the last round has filled, so each place is handled once,
    and end when a round fills nothing; a key without a valid place keeps nulls. Neighbours that are no places of the grid aren't crossed.
    """
    keys = list(keys)
    at = [*keys, "i", "j"]
    valid = F.col("v").isNotNull() & ~F.isnan("v")
    done = cut(grid.where(valid).select(*at, "v", F.col("i").alias("from_i"), F.col("j").alias("from_j"), F.lit(0).alias("away")))
    parts, front = [done], done
    open_ = cut(grid.where(~F.coalesce(valid, F.lit(False))).select(*at))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    while True:
        near = front.select(*keys, "i", "j", "v", "from_i", "from_j", "away", F.inline(steps))
        near = near.select(*keys, (F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j"), F.struct("from_i", "from_j", "v", (F.col("away") + 1).alias("away")).alias("o"))
        best = near.groupBy(*at).agg(F.min("o").alias("o"))
        front = cut(open_.join(best, at).select(*at, "o.v", "o.from_i", "o.from_j", "o.away"))
        if not front.limit(1).count():
            break
        parts.append(front)
        open_ = cut(open_.join(front.select(*at), at, "left_anti"))
    none = {"v": "double", "from_i": done.schema["i"].dataType, "from_j": done.schema["j"].dataType, "away": "int"}
    out = open_.select(*at, *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    for p in parts:
        out = out.unionByName(p)
    return out
