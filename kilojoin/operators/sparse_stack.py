"""Attribution over many changed parameters: the terms of a product's change as rows.

A product of n changed parameters has 2^n terms. Terms that can't reach a given part of the whole are left out while the product is formed: what a
term can still become is its value times the largest that later factors can add up to. The number of terms that stay is at most the
product of (|before| + |change|) over that part of the whole, whatever n is. What is left out is known exactly as one number, the whole less what stays.
Every step is a projection; only the rest is one aggregation by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def product(rows: DataFrame, keys: Sequence[str], parameters: Sequence[tuple[str, Column, Column]], least: float) -> DataFrame:
    """keys, changed (names in the given order), value: the terms of the product over parameters (name, before, change) of at least ``least`` of the whole's size.

    A null change is none, a null before is one.
    """
    keys, names = list(keys), [n for n, _, _ in parameters]
    b = [F.coalesce(x.cast("double"), F.lit(1.0)) for _, x, _ in parameters]
    d = [F.coalesce(x.cast("double"), F.lit(0.0)) for _, _, x in parameters]
    rows = rows.select(*keys, F.array(*b).alias("_b"), F.array(*d).alias("_d"))
    after = F.aggregate(F.zip_with("_b", "_d", lambda x, y: x + y), F.lit(1.0), lambda a, x: a * x)
    reach = F.reverse(F.aggregate(F.reverse(F.zip_with("_b", "_d", lambda x, y: F.abs(x) + F.abs(y))), F.array(F.lit(1.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) * x))))
    rows = rows.withColumns({"_whole": after, "_reach": reach, "changed": F.array().cast("array<string>"), "value": F.lit(1.0)})
    for i, n in enumerate(names):
        stays = F.struct(F.col("changed"), (F.col("value") * F.get("_b", F.lit(i))).alias("value"))
        moves = F.struct(F.concat("changed", F.array(F.lit(n))).alias("changed"), (F.col("value") * F.get("_d", F.lit(i))).alias("value"))
        both = F.filter(F.array(stays, moves), lambda t, i=i: (F.abs(t["value"]) * F.get("_reach", F.lit(i + 1)) >= least * F.abs("_whole")) & (t["value"] != 0))
        rows = rows.select(*keys, "_b", "_d", "_whole", "_reach", F.inline(both))
    return rows.where(F.abs("value") >= least * F.abs("_whole")).select(*keys, "changed", "value", F.col("_whole").alias("whole"))


def add(*terms: DataFrame) -> DataFrame:
    """Terms of a sum: those of its members with equal changes are added."""
    keys = [c for c in terms[0].columns if c not in ("value", "whole")]
    out = terms[0]
    for t in terms[1:]:
        out = out.unionByName(t)
    return out.groupBy(*keys).agg(F.sum("value").alias("value"), F.sum("whole").alias("whole"))


def ranked(terms: DataFrame, keys: Sequence[str], digits: int | None = None) -> DataFrame:
    """keys, nth, changed (joined by a comma), value: the largest terms first, ties by name; the rest of the whole comes last with a null name.

    digits: decimals in which terms are compared; those that are equal there are a tie. Values stay as they are.
    """
    keys = list(keys)
    size = F.abs("value" if digits is None else F.round("value", digits))
    own = terms.withColumn("changed", F.coalesce(F.nullif(F.array_join("changed", ","), F.lit("")), F.lit("before")))
    rest = own.groupBy(*keys).agg(F.first("whole").alias("whole"), F.sum("value").alias("kept"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(size.desc(), "changed")
    first = own.select(*keys, F.row_number().over(w).cast("long").alias("nth"), "changed", "value")
    return first.unionByName(rest.select(*keys, (F.col("n") + 1).alias("nth"), F.lit(None).cast("string").alias("changed"), (F.col("whole") - F.col("kept")).alias("value")))
