"""Mixes: quantities with parts by origin, through sections and storages.

Within a section each variable has a total and a part for each origin, and all rules hold for each of them. Sums are the sums of their parts; levels
(efficiencies, times, and the shares by which a node deals out what it holds) are the same for every part. What the shares of a node
add up to can be given for each origin (``ones``).

A storage holds parts in proportion: what is taken from it has the mix that it holds. Over a record's sections this is a linear recurrence, whose
solution is a running sum of charges over the running product of what discharges leave: two windows, no iteration. Products are kept in
segments of bounded range, so long records don't underflow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.functions import exprs
from kilojoin.operators import solver
from kilojoin.operators.solver import Rule

#: Kinds of variables that are the same for every part.
LEVELS = ("eta", "dt")
#: Natural logarithm by which a product may shrink within a segment.
RANGE = 300.0


def part(variable: str, origin: object) -> str:
    return f"{variable}__{origin}"


def lifted(rules: Sequence[Rule], origins: Sequence[object], levels: Sequence[str] = LEVELS, ones: bool = False) -> list[Rule]:
    """The rules of totals, of each origin's parts, and between them; ``ones``: the shares of an origin add up to a variable one__<origin> of its own.

    Variables whose kind (the name up to the first _) is in ``levels`` have the total's value for every part.
    """
    to = lambda v, o: (part("one", o) if ones else "one") if v == "one" else part(v, o)
    out = list(rules)
    for o in origins:
        out += [Rule(r.kind, to(r.out, o), tuple(to(a, o) for a in r.args), r.f) for r in rules]
    for v in solver.variables(rules):
        own = [part(v, o) for o in origins]
        out += [solver.equal(x, v) for x in own] if v.split("_")[0] in levels else [] if v.split("_")[0] == "x" else [solver.total(v, own)]
    return out


def outgoing(node: object, others: Sequence[object], section: object = 0) -> list[str]:
    """The shares by which a node deals out: real mixes have the same for every origin."""
    return [solver.name("x", section, node, m) for m in others]


def real(rules: Sequence[Rule], shares: Sequence[str], origins: Sequence[object]) -> list[Rule]:
    """The rules that outgoing shares are the same for every origin."""
    return [*rules, *[solver.equal(part(x, o), x) for x in shares for o in origins]]


def solve(df: DataFrame, rules: Sequence[Rule], origins: Sequence[object], shares: Sequence[str] = (), ones: Mapping[object, float] | None = None, rounds: int = 1) -> DataFrame:
    """df with struct<total, mix> for every variable of the rules that follows; givens are columns v (totals) and v__<origin> (parts).

    shares: outgoing shares that are the same for all origins (real mix). ones: what each origin's shares add up to, 1 where it isn't named.
    """
    own = lifted(rules, origins, ones=ones is not None)
    if ones is not None:
        df = df.withColumns({part("one", o): F.lit(float(ones.get(o, 1.0))) for o in origins})
    solved = solver.solve(df, real(own, shares, origins), rounds)
    names = solver.variables(rules)
    mixes = {v: F.struct(F.col(v).alias("total"), F.array(*[F.col(part(v, o)) for o in origins]).alias("mix")) for v in names}
    keep = [c for c in df.columns if c not in names and "__" not in c]
    return solved.select(*keep, *[m.alias(v) for v, m in mixes.items()])


def stored(rows: DataFrame, n: int, key: Sequence[str] = ("record_id", "node")) -> DataFrame:
    """key, section, content (after the section), out_sum, content_mix and out_mix (n parts) for rows key, section, in_mix (n parts), out_sum, init_mix (n parts).

    In a section charges come first, then the discharge takes the storage's mix. A storage that is emptied starts anew; taking more than there is, is
    taken as emptying it.
    """
    key = list(key)
    w = Window.partitionBy(*key).orderBy("section")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    gain, loss = F.coalesce(total("in_mix"), F.lit(0.0)), F.coalesce("out_sum", F.lit(0.0))
    rows = rows.withColumns({"_in": gain, "_out": loss})
    # contents never fall below zero: the running sum less how far it has been below
    rows = rows.withColumn("_sum", total("init_mix") + F.sum(F.col("_in") - F.col("_out")).over(upto))
    rows = rows.withColumn("_after", F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(upto)))
    taken = F.when(F.col("_after") <= 0, F.lit(1.0)).otherwise(exprs.safe_div(F.col("_out"), F.col("_after") + F.col("_out")))
    rows = rows.withColumn("_share", F.when(F.col("_out") > 0, taken).otherwise(0.0))
    rows = rows.withColumn("_empty", F.coalesce(F.sum((F.col("_share") >= 1).cast("long")).over(before), F.lit(0)))
    rows = rows.withColumn("_log", F.when(F.col("_share") < 1, F.log(1 - F.col("_share"))).otherwise(0.0))
    life = Window.partitionBy(*key, "_empty").orderBy("section")
    rows = rows.withColumn("_l", F.coalesce(F.sum("_log").over(life.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("_seg", F.floor(-F.col("_l") / RANGE))
    # charges, and the first content, as they count against the segment's first factor
    first = F.row_number().over(w) == 1
    scale = F.exp(-(F.col("_l") + F.col("_seg") * RANGE))
    seg = Window.partitionBy(*key, "_empty", "_seg").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key, "_empty", "_seg")
    sums = {}
    for i in range(n):
        own = F.coalesce(F.get("in_mix", F.lit(i)), F.lit(0.0)) + F.when(F.col("_first"), F.get("init_mix", F.lit(i))).otherwise(0.0)
        sums |= {f"_s{i}": F.sum(own * F.col("_scale")).over(seg), f"_t{i}": F.sum(own * F.col("_scale")).over(whole)}
    rows = rows.withColumns({"_first": first, "_scale": scale}).withColumns(sums)
    # what the segment before this one still gives; older ones are below the precision of a double
    ends = rows.groupBy(*key, "_empty", "_seg").agg(*[F.first(f"_t{i}").alias(f"_b{i}") for i in range(n)]).withColumn("_seg", F.col("_seg") + 1)
    rows = rows.join(ends, [*key, "_empty", "_seg"], "left")
    level = [F.exp(F.col("_l") + F.col("_seg") * RANGE) * (F.col(f"_s{i}") + F.coalesce(f"_b{i}", F.lit(0.0)) * F.exp(F.lit(-RANGE))) for i in range(n)]
    left = 1 - F.col("_share")
    return rows.select(*key, "section", F.col("_after").alias("content"), "out_sum", F.array(*[x * left for x in level]).alias("content_mix"), F.array(*[x * F.col("_share") for x in level]).alias("out_mix"))
