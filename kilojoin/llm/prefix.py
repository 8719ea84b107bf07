"""Running totals over a whole table or within keys, without a key or the table ever meeting in one task.

Rows are dealt by range of (key, order), so a key with a third of all rows lies in many consecutive parts. Each part
is read once, sorted, and carries its totals from row to row. What a part inherits is the total of the last key of
the parts before it: one row for each part, so that table is bounded by the number of partitions, is summed by a
window and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilojoin.llm.common import materialise


def running(df: DataFrame, key: list[str], order: list[Column | str], sums: dict[str, str] | None = None, xors: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (its columns ``keep``, or all) with a running total (its own row included) of a long column for each entry {new name: column} of ``sums`` and ``xors``.

    ``key`` are long columns without nulls; none means the whole table. Rows that ``order`` leaves equal may come in any
    order. The columns kept should be few and short, as they pass through Python workers.
    """
    sums, xors = sums or {}, xors or {}
    news = [*sums, *xors]
    columns = keep or df.columns
    schema = T.StructType([*df.select(*columns).schema.fields, *[T.StructField(n, T.LongType()) for n in news], T.StructField("part_", T.IntegerType()), T.StructField("at_", T.LongType())])

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, last, held = TaskContext.get().partitionId(), 0, None, dict.fromkeys(news, 0)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = batch[key].to_numpy(np.int64).reshape(n, len(key))
            new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
            begin = np.flatnonzero(new)[np.cumsum(new) - 1]  # where each row's key begins in this batch
            goes_on = last is not None and (keys[0] == last).all()
            first = begin == 0
            for name in news:
                add = name in sums
                own = batch[sums[name] if add else xors[name]].to_numpy(np.int64)
                total = np.cumsum(own) if add else np.bitwise_xor.accumulate(own)
                before = np.where(first, 0, total[begin - 1])
                total = total - before if add else total ^ before
                if goes_on:
                    total[first] = total[first] + held[name] if add else total[first] ^ held[name]
                batch[name], held[name] = total, total[-1]
            batch["part_"], batch["at_"] = np.int32(part), np.arange(at, at + n)
            at, last = at + n, keys[-1]
            yield batch

    dealt = df.repartitionByRange(*[F.asc(c) for c in key], *order).sortWithinPartitions(*key, *order).select(*columns)
    rows = materialise(dealt.mapInPandas(carry, schema), "running")
    mine = F.struct(*key, F.lit(0).alias("none_"))
    parts = rows.groupBy("part_").agg(F.min_by(mine, "at_").alias("first"), F.max_by(F.struct(mine.alias("last"), *news), "at_").alias("end"))
    parts = parts.select("part_", "first", "end.*")
    # one row for each part: the totals of a key over all parts that end with it
    so_far = Window.partitionBy("last").orderBy("part_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = {n: F.sum(n).over(so_far) for n in sums}
    for n in xors:  # there is no running bit_xor over a growing frame in one pass of sums; parts are few
        totals[n] = F.bit_xor(n).over(so_far)
    parts = parts.select("part_", "first", "last", *[totals[n].alias(n) for n in news])
    line = Window.orderBy("part_")
    inherits = parts.select("part_", "first", F.lag("last").over(line).alias("before"), *[F.lag(n).over(line).alias(f"{n}_in") for n in news])
    inherits = inherits.where("first = before").select("part_", "first", *[f"{n}_in" for n in news])
    met = rows.join(F.broadcast(inherits), (rows["part_"] == inherits["part_"]) & (mine == inherits["first"]), "left")
    out = {n: F.col(n) + F.coalesce(f"{n}_in", F.lit(0)) for n in sums} | {n: F.col(n).bitwiseXOR(F.coalesce(f"{n}_in", F.lit(0))) for n in xors}
    return met.select(*columns, *[out[n].cast("long").alias(n) for n in news])


def with_owner(rows: DataFrame, owners: DataFrame, key: list[str], many: str, total: int, share: int = 1000) -> DataFrame:
    """rows joined (inner) with owners, which has one row for each key and in ``many`` how many of the ``total`` rows it has.

    Owners of more than a ``share``-th of all rows are ``share`` at most: they go to the rows by a broadcast, the rest by a shuffle.
    """
    hot = owners[many] > F.lit(total / share)
    large, small = owners.where(hot), owners.where(~hot)
    rest = rows.join(F.broadcast(large.select(*key)), key, "left_anti").join(small, key)
    return rows.join(F.broadcast(large), key).unionByName(rest)
