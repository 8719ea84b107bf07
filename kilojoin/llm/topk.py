"""Exact top-k search by inner product over a bit-sliced index.

Vectors are dealt into blocks by the hash of their id. In a block, bit b of component d of all its vectors is one
bitmap (a slice), in two's complement with an offset that makes it unsigned. The scores of a query over a whole block
are sums of slices: for each component its coarse weight is written in signed binary digits, and for each digit the
component's slices are added to (or subtracted from) the score's slices, shifted, by bitmap arithmetic, 64 vectors
to a machine word. Only the upper slices of the components and the leading digits of the weights are added; what
they leave out is bounded for each query. The k best coarse scores are selected from the most significant score
slice downward; every vector whose coarse score is within twice the bound of the k-th is a boundary row, and their
scores are resolved exactly in integers.

A unit of work is a block and PER_UNIT queries: the block's matrix comes first, its index is built once, and the queries stream past it in
groups of GROUP. Units are dealt out to a bounded number of tasks; a block is copied once for every PER_UNIT queries.
Each unit returns k rows for each query, and the k best of all blocks are taken after.

Defined results: vectors that are null or have a null or non-finite component take no part; every other row does, whatever
its id: rows of one id are candidates of their own, each answers if the id is asked, and is left out only of its own
answers; an id may be null (last among ties, and no query unless ``queries`` says so); shorter vectors count as padded with
zeros, so an empty one scores 0; ties go to the smaller id; fewer candidates than k give fewer
rows; scores beyond a long saturate; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.llm.common import materialise

#: Vectors of a block, queries of a group, groups of a unit.
BLOCK, GROUP, PER_UNIT = 32_768, 256, 16
#: Tasks at most; beyond, a task takes several units one after the other.
TASKS = 100_000
#: Slices of a component that are added (upper ones), signed digits of a weight that are.
SLICES, DIGITS = 8, 3


def quantised(x: Column, scale: int = 1024) -> Column:
    """array<long> of floor(scale * x), each component as double; null if a component is null or not finite."""
    ok = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(x, lambda v: F.floor(F.lit(scale).cast("double") * v.cast("double"))))


# bitmap arithmetic ----------------------------------------------------------------------------------


def signed_digits(w: int, most: int) -> tuple[list[tuple[int, int]], int]:
    """The ``most`` leading (shift, sign) digits of w in signed binary, and what they leave of it."""
    out, rest = [], w
    while rest and len(out) < most:
        size = abs(rest)
        shift = size.bit_length() - 1
        if 2 * size > 3 << shift:
            shift += 1
        sign = 1 if rest > 0 else -1
        out.append((shift, sign))
        rest -= sign << shift
    return out, rest


class BitSlices:
    """The index of a block: a matrix of integers, row by row, as bitmaps."""

    def __init__(self, x: np.ndarray, slices: int = SLICES):
        self.x, self.n, dims = x, len(x), x.shape[1]
        self.words = -(-self.n // 64)
        self.low = x.min(0).astype(np.int64) if self.n else np.zeros(dims, np.int64)
        span = int((x.max(0).astype(np.int64) - self.low).max()) if self.n and dims else 0
        self.cut = max(0, span.bit_length() - slices)  # lower bits that stay out of the sums
        width = max(1, span.bit_length() - self.cut)
        self.left, self.top, self.slices = np.zeros(dims, np.int64), np.zeros(dims, np.int64), []
        padded = np.zeros(self.words * 64, np.uint64)
        for d in range(dims):
            whole = x[:, d].astype(np.int64) - self.low[d]
            coarse = whole >> self.cut
            padded[: self.n] = coarse
            self.slices.append([self._bitmap((padded >> np.uint64(b)) & np.uint64(1)) for b in range(width)])
            self.left[d] = int((whole - (coarse << self.cut)).max()) if self.n else 0
            self.top[d] = int(coarse.max()) << self.cut if self.n else 0
        self.every = self._bitmap((np.arange(self.words * 64) < self.n).astype(np.uint64))

    @staticmethod
    def _bitmap(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits.astype(bool), bitorder="little").view(np.uint64)

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """The coarse scores as slices, the constant that they lack, and how far a score can be from its coarse one on either side."""
        plus: dict[int, list[np.ndarray]] = {}
        minus: dict[int, list[np.ndarray]] = {}
        error, constant, peak = 0, 0, [0, 0]
        for d, w in enumerate(q.tolist()):
            constant += w * int(self.low[d])
            if not w:
                continue
            digits, rest = signed_digits(w, DIGITS)
            for shift, sign in digits:
                side = plus if sign > 0 else minus
                peak[sign < 0] += int(self.top[d] >> self.cut) << shift
                for b, s in enumerate(self.slices[d]):
                    side.setdefault(b + shift, []).append(s)
            error += abs(w) * int(self.left[d]) + abs(rest) * int(self.top[d])
        width = max(peak[0], peak[1], 1).bit_length() + 1
        up, down = self._total(plus, width), self._total(minus, width)
        # plus - minus in two's complement, the sign turned so that the order is unsigned
        out, carry = [], np.full(self.words, ~np.uint64(0))
        for a, b in zip(up, down, strict=True):
            b = ~b
            half = a ^ b
            out.append(half ^ carry)
            carry = (a & b) | (half & carry)
        out[-1] = ~out[-1]
        return out, constant, error

    def _total(self, columns: dict[int, list[np.ndarray]], width: int) -> list[np.ndarray]:
        """Adds bitmaps of equal weight three at a time (sum and carry) until each weight has one."""
        out = []
        for b in range(width):
            left = columns.pop(b, [])
            while len(left) > 1:
                if len(left) >= 3:
                    x, y, z = left.pop(), left.pop(), left.pop()
                    half = x ^ y
                    left.insert(0, half ^ z)
                    columns.setdefault(b + 1, []).append((x & y) | (half & z))
                else:
                    x, y = left.pop(), left.pop()
                    left.append(x ^ y)
                    columns.setdefault(b + 1, []).append(x & y)
            out.append(left[0] if left else np.zeros(self.words, np.uint64))
        return out

    def _at_least_kth(self, slices: list[np.ndarray], k: int) -> tuple[int, np.ndarray]:
        """The k-th largest value of the slices (from the most significant downward), over all rows."""
        equal, above, value = self.every, 0, 0
        for b in range(len(slices) - 1, -1, -1):
            ones = equal & slices[b]
            many = int(np.bitwise_count(ones).sum())
            if above + many >= k:
                equal, value = ones, value | 1 << b
            else:
                above, equal = above + many, equal & ~slices[b]
        return value, equal

    def _over(self, slices: list[np.ndarray], least: int) -> np.ndarray:
        """Rows whose value is ``least`` or more."""
        if least <= 0:
            return self.every
        if least >> len(slices):
            return np.zeros_like(self.every)
        over, equal = np.zeros_like(self.every), self.every
        for b in range(len(slices) - 1, -1, -1):
            if least >> b & 1:
                equal = equal & slices[b]
            else:
                over, equal = over | (equal & slices[b]), equal & ~slices[b]
        return over | equal

    def best(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that hold the k best scores, ties included."""
        if self.n <= k:
            return np.arange(self.n)
        slices, _, error = self.sums(q)
        kth, _ = self._at_least_kth(slices, k)
        # a coarse score counts units of 2^cut
        far = 2 * (error >> self.cut) + 2
        rows = self._over(slices, kth - far)
        return np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little")[: self.n])


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if x.size == 0:
        return np.zeros(len(x), np.int64)
    if max(abs(int(x.min())), abs(int(x.max()))) * int(np.abs(q).max()) * x.shape[1] < 1 << 53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    big = (1 << 63) - 1
    return np.array([max(-big - 1, min(big, sum(a * b for a, b in zip(row, q.tolist(), strict=True)))) for row in x.tolist()], np.int64)


# dealing --------------------------------------------------------------------------------------------


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes that hold them."""
    most = int(max(-x.min(), x.max())) if x.size else 0
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """part, keys, ids, nulls and values (binary; bytes tells the width of a value): about ``size`` vectors a row, dealt by the hash of the row's key."""
    n = max(1, -(-vectors.count() // size))
    dealt = vectors.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        width = max(map(len, rows["q"]))
        x = np.zeros((len(rows), width), np.int64)
        for i, v in enumerate(rows["q"]):
            x[i, : len(v)] = v
        x, null = _narrow(x), rows["vec_id"].isna().to_numpy()
        cols = {"part": [rows["part"].iloc[0]], "keys": [rows["key"].to_numpy(np.int64).tobytes()], "ids": [rows["vec_id"].fillna(0).to_numpy(np.int64).tobytes()]}
        return pd.DataFrame(cols | {"nulls": [null.tobytes()], "x": [x.tobytes()], "width": [width], "bytes": [x.itemsize]})

    return dealt.groupBy("part").applyInPandas(pack, "part int, keys binary, ids binary, nulls binary, x binary, width int, bytes int")


def _unpacked(row) -> tuple[np.ndarray, ...]:
    """keys, ids, whether they are null, and the matrix."""
    keys = np.frombuffer(row.keys, np.int64)
    x = np.frombuffer(row.x, {2: np.int16, 4: np.int32, 8: np.int64}[row.bytes]).reshape(len(keys), row.width)
    return keys, np.frombuffer(row.ids, np.int64), np.frombuffer(row.nulls, bool), x


def search(vectors: DataFrame, queries: Column, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries`` selects, its k best among all other rows."""
    own = vectors.select(F.col(id_).cast("long").alias("vec_id"), quantised(F.col(vector)).alias("q"), F.coalesce(queries, F.lit(False)).alias("asks"))
    # the key tells rows apart; it is fixed by the written table
    own = materialise(own.where("q is not null").withColumn("key", F.monotonically_increasing_id()), "vectors")
    blocks = materialise(_packed(own.select("key", "vec_id", "q"), BLOCK), "blocks")
    asked = materialise(_packed(own.where("asks").select("key", "vec_id", "q"), GROUP), "queries")
    n_blocks, n_groups = blocks.count(), asked.count()
    if not (n_blocks and n_groups):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_slices, last_block = -(-n_groups // PER_UNIT), blocks.agg(F.max("part")).first()[0]
    data = ["keys", "ids", "nulls", "x", "width", "bytes"]
    left = blocks.select(F.col("part").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"), F.lit(0).alias("side"), *data)
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(last_block))).alias("block"), F.pmod("part", F.lit(n_slices)).alias("slice"), F.lit(1).alias("side"), *data)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, index, own = None, None, None
        for batch in batches:
            for row in batch.itertuples():
                if row.side == 0:
                    own = _unpacked(row)
                    unit, index = (row.block, row.slice), BitSlices(own[3])
                elif unit == (row.block, row.slice):
                    yield answers(index, own, _unpacked(row))

    def answers(index: BitSlices, own: tuple, asking: tuple) -> pd.DataFrame:
        (keys, ids, nulls, x), (q_keys, q_ids, q_nulls, q_x) = own, asking
        q = np.zeros((len(q_keys), x.shape[1]), np.int64)
        m = min(x.shape[1], q_x.shape[1])
        q[:, :m] = q_x[:, :m]
        out = []
        for one, id_of, no_id, w in zip(q_keys.tolist(), q_ids.tolist(), q_nulls.tolist(), q, strict=True):
            at = index.best(w, k + 1)  # one may be the query's own row
            at = at[keys[at] != one]
            score = exact_scores(x[at], w)
            order = np.lexsort((ids[at], nulls[at], -score))[:k]
            at = at[order]
            found = pd.array(np.where(nulls[at], 0, ids[at]), dtype="Int64")
            found[nulls[at]] = pd.NA
            out.append(pd.DataFrame({"key": one, "query_id": pd.array([None if no_id else id_of] * len(at), dtype="Int64"), "vec_id": found, "score": score[order]}))
        return pd.concat(out, ignore_index=True)

    units = left.unionByName(right).repartition(min(TASKS, (last_block + 1) * n_slices), "block", "slice").sortWithinPartitions("block", "slice", "side")
    found = units.mapInPandas(meet, "key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH own AS (SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.key, a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
           FROM own a JOIN own b ON a.vec_id % 100 = 0 AND a.key <> b.key),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
