"""k-means in integers with Yinyang bounds.

Centroids are put into groups once. Each vector carries an upper bound of the distance to its centroid, and a lower bound of
the distance to any other centroid of each group. When centroids move, bounds follow by how far they moved. A vector whose upper
bound stays below all lower bounds keeps its centroid (global filter); otherwise the upper bound is made exact, and only
groups whose lower bound is not above it are looked at, and in them only centroids that the group's old bound
and their own movement don't exclude. Those are compared exactly, in integers. Bounds are widened by more than the rounding of
floating point, and filters are strict, so ties reach the exact comparison and go to the smaller number.

Vectors lie in blocks of BLOCK with their bounds beside them, made where the rows are read: no round moves a vector between tasks. A round
writes blocks with new bounds and each block's sums for each centroid; only the sums are read to find new centroids, added up
in each task and then over all, to k rows of a bounded number of components. The driver holds the k centroids.

Defined results: vectors that are null, have another length, or a null or non-finite component take no part; all other rows do,
whatever their ids: a null id counts as empty in the seeds' hash and comes with a null id; rows of equal ids as seeds are in
the order of their components; with fewer vectors than k every one is a centroid; an empty cluster keeps its centroid and has no
rows; components beyond 2^26 are compared in unbounded integers, floor(scale * x) beyond a long saturates, and so do distances; an empty table gives
no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.llm.common import discard, materialise
from kilojoin.llm.topk import quantised

#: Vectors of a block; centroids of a group on average.
BLOCK, PER_GROUP = 4096, 10
#: Components up to here are compared in 64 bits.
SAFE = 1 << 26
#: How much bounds are widened, relative to their size.
SLACK = 1e-9
MOST = (1 << 63) - 1
_BLOCKS = "ids binary, nulls binary, x binary, n int, cluster binary, upper binary, lower binary, sums binary, scanned long"


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors (vec_id, q) with the smallest hex sha256 of ``seed:vec_id``; k rows at most come to the driver."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return _matrix([r["q"] for r in vectors.select(rank.alias("rank"), "q").orderBy("rank", "q").limit(k).collect()])


def _matrix(rows: list) -> np.ndarray:
    """Integers, in 64 bits where squared distances fit."""
    x = np.array([np.asarray(r) for r in rows])
    if x.dtype.kind == "i" and (not x.size or max(-int(x.min()), int(x.max())) <= SAFE):
        return x.astype(np.int64)
    return np.array([[int(v) for v in r] for r in rows], object)


def grouped(centroids: np.ndarray, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids themselves."""
    k = len(centroids)
    n = max(1, k // PER_GROUP)
    c = centroids.astype(np.float64)
    middle = c[np.linspace(0, k - 1, n).astype(int)]
    for _ in range(rounds):
        near = ((c[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)
        middle = np.array([c[near == g].mean(0) if (near == g).any() else middle[g] for g in range(n)])
    return near


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to c (one vector, or one for each row)."""
    if x.dtype == object or c.dtype == object:
        return ((x.astype(object) - c.astype(object)) ** 2).sum(1) if len(x) else np.zeros(0, object)
    return ((x.astype(np.int64) - c) ** 2).sum(1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Step:
    """One round over a block: bounds follow the centroids' movement, then vectors that the filters leave are compared."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None, group: np.ndarray):
        self.c, self.group, self.n_groups = centroids, group, int(group.max()) + 1 if len(group) else 0
        self.moved = np.zeros(len(centroids)) if before is None else np.array([float(sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True))) ** 0.5 for p, q in zip(centroids, before, strict=True)]) * (1 + SLACK)
        self.of_group = [np.flatnonzero(group == g) for g in range(self.n_groups)]
        self.group_moved = np.array([self.moved[m].max() if len(m) else 0.0 for m in self.of_group])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cluster, upper, lower by comparing everything."""
        n = len(x)
        state = np.zeros(n, np.int32), np.full(n, np.inf), np.full((n, self.n_groups), -np.inf)
        self._scan(x, *state, np.arange(n), np.full((n, self.n_groups), -np.inf), [np.arange(n)] * self.n_groups)
        return state

    def again(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Updates the state in place; the number of distances that were computed."""
        old = lower.copy()
        upper += self.moved[cluster]
        upper *= 1 + SLACK
        lower -= self.group_moved
        lower -= np.abs(lower) * SLACK
        left = np.flatnonzero(~(upper < lower.min(1)))
        if not len(left):
            return 0
        upper[left] = _root(squared(x[left], self.c[cluster[left]])) * (1 + SLACK)
        left = left[~(upper[left] < lower[left].min(1))]
        return len(left) and self._scan(x, cluster, upper, lower, left, old, [left[~(upper[left] < lower[left, g])] for g in range(self.n_groups)])

    def _scan(self, x, cluster, upper, lower, left, old, rows_of) -> int:
        """Compares the vectors ``left`` with surviving centroids of the groups' rows."""
        if not len(left):
            return 0
        place = np.full(len(x), -1)
        place[left] = np.arange(len(left))
        was, count = cluster[left].copy(), 0
        own = squared(x[left], self.c[was])
        best, number = own.copy(), was.copy()
        # of each group, the smallest and the second smallest distance or bound, and whose the smallest is
        low = np.full((self.n_groups, 2, len(left)), np.inf)
        whose = np.full((self.n_groups, len(left)), -1)

        def note(g: int, at: np.ndarray, values: np.ndarray, c: int) -> None:
            one, two = low[g, 0, at], low[g, 1, at]
            less = values < one
            low[g, 1, at] = np.where(less, one, np.minimum(two, values))
            low[g, 0, at] = np.where(less, values, one)
            whose[g, at] = np.where(less, c, whose[g, at])

        for g, rows in enumerate(rows_of):
            at = place[rows]
            for c in self.of_group[g]:
                bound = (old[rows, g] - self.moved[c]) * (1 - SLACK)
                mine = was[at] == c
                skip = ~mine & (bound > upper[rows])  # can't be as near as the own centroid
                note(g, at[skip], bound[skip], c)
                live = ~mine & ~skip
                some = at[live]
                d = squared(x[rows[live]], self.c[c])
                count += len(some)
                note(g, some, _root(d) * (1 - SLACK), c)
                nearer = (d < best[some]) | ((d == best[some]) & (c < number[some]))
                best[some[nearer]], number[some[nearer]] = d[nearer], c
                note(g, at[mine], _root(own[at[mine]]) * (1 - SLACK), c)
        for g, rows in enumerate(rows_of):
            at = place[rows]
            lower[rows, g] = np.where(whose[g, at] == number[at], low[g, 1, at], low[g, 0, at])
        # a centroid that was left now counts in its group's bound
        changed = np.flatnonzero(number != was)
        g = self.group[was[changed]]
        lower[left[changed], g] = np.minimum(lower[left[changed], g], _root(own[changed]) * (1 - SLACK))
        cluster[left], upper[left] = number, _root(best) * (1 + SLACK)
        return count


def _pack(x: np.ndarray) -> bytes:
    """Integers as they are stored: a byte for the width, then the values; text where they exceed 64 bits' safe range."""
    if x.dtype == object:
        return b"t" + ",".join(map(str, x.ravel())).encode()
    most = int(np.abs(x).max()) if x.size else 0
    return b"h" + x.astype(np.int16).tobytes() if most < 1 << 15 else b"q" + x.astype(np.int64).tobytes()


def _unpack(data: bytes, dims: int) -> np.ndarray:
    if data[:1] == b"t":
        return np.array([int(v) for v in data[1:].decode().split(",")], object).reshape(-1, dims)
    return np.frombuffer(data[1:], {b"h": np.int16, b"q": np.int64}[data[:1]]).reshape(-1, dims)


def _block(ids: bytes, nulls: bytes, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, k: int, scanned: int) -> dict:
    """A row of the blocks' table, with the block's counts and sums for each centroid."""
    sums = np.zeros((k, x.shape[1] + 1), object if x.dtype == object else np.int64)
    np.add.at(sums[:, 1:], cluster, x if x.dtype == object else x.astype(np.int64))
    sums[:, 0] = np.bincount(cluster, minlength=k)
    return {"ids": ids, "nulls": nulls, "x": _pack(x), "n": len(x), "cluster": cluster.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "sums": _pack(sums), "scanned": scanned}


def _state(row, dims: int, n_groups: int) -> tuple[np.ndarray, ...]:
    lower = np.frombuffer(row.lower, np.float64).reshape(row.n, n_groups).copy()
    return _unpack(row.x, dims), np.frombuffer(row.cluster, np.int32).copy(), np.frombuffer(row.upper, np.float64).copy(), lower


def _pandas(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCKS.split(", ")])


def _blocks(vectors: DataFrame, step: Step, k: int) -> DataFrame:
    """Blocks of the vectors, each assigned for the first time."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                own = batch.iloc[at : at + BLOCK]
                x = _matrix(list(own["q"]))
                cluster, upper, lower = step.first(x)
                ids, nulls = own["vec_id"].fillna(0).to_numpy(np.int64), own["vec_id"].isna().to_numpy()
                yield _pandas([_block(ids.tobytes(), nulls.tobytes(), x, cluster, upper, lower, k, len(x) * k)])

    return materialise(vectors.mapInPandas(pack, _BLOCKS), "blocks")


def _round(blocks: DataFrame, step: Step, k: int, dims: int) -> DataFrame:
    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                x, cluster, upper, lower = _state(row, dims, step.n_groups)
                scanned = int(step.again(x, cluster, upper, lower))
                yield _pandas([_block(row.ids, row.nulls, x, cluster, upper, lower, k, scanned)])

    return materialise(blocks.mapInPandas(again, _BLOCKS), "blocks")


def _means(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every centroid that has vectors; sums are added in tasks, then by a tree, and k of them come to the driver."""
    k, dims = centroids.shape

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, dims + 1), object)
        for batch in batches:
            for data in batch["sums"]:
                total += _unpack(data, dims + 1)
        yield pd.DataFrame({"cluster": np.arange(k), "parts": [[str(v) for v in row] for row in total]})

    parts = blocks.select("sums").mapInPandas(add, "cluster int, parts array<string>")
    sums = parts.select("cluster", F.posexplode("parts").alias("place", "part")).groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38, 0)")).alias("total"))
    out = np.zeros((k, dims + 1), object)
    for r in sums.collect():  # k * (dims + 1) rows
        out[r["cluster"], r["place"]] = int(r["total"])
    return _matrix([[v // row[0] for v in row[1:]] if row[0] else list(c) for row, c in zip(out, centroids, strict=True)])


def rounds(vectors: DataFrame, k: int, seed: int, n_rounds: int) -> tuple[DataFrame | None, np.ndarray]:
    """The blocks after all rounds and one more assignment, and the centroids; vectors has vec_id and q (integers, of one length)."""
    centroids = seeds(vectors, k, seed)
    if not len(centroids):
        return None, centroids
    k, dims = centroids.shape
    group = grouped(centroids)
    blocks = _blocks(vectors, Step(centroids, None, group), k)
    for _ in range(n_rounds):
        before, centroids = centroids, _means(blocks, centroids)
        new = _round(blocks, Step(centroids, before, group), k, dims)
        discard(blocks)
        blocks = new
    return blocks, centroids


def clusters(vectors: DataFrame, k: int = 40, dims: int = 64, scale: int = 256, seed: int = 2, n_rounds: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    own = vectors.where(F.size(vector) == dims).select(F.col(id_).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("q")).where("q is not null")
    blocks, centroids = rounds(own, k, seed, n_rounds)
    spark = vectors.sparkSession
    if blocks is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                x, cluster = _unpack(row.x, dims), np.frombuffer(row.cluster, np.int32)
                distance = np.array([min(int(d), MOST) for d in squared(x, centroids[cluster])], np.int64)
                ids = pd.array(np.frombuffer(row.ids, np.int64), dtype="Int64")
                ids[np.frombuffer(row.nulls, bool)] = pd.NA
                yield pd.DataFrame({"vec_id": ids, "cluster": cluster, "distance": distance})

    found = materialise(blocks.select("ids", "nulls", "x", "cluster").mapInPandas(unpacked, "vec_id long, cluster int, distance long"), "assigned")
    total = _saturated(F.sum(F.col("distance").cast("decimal(38, 0)")))
    inertia = found.agg(total).first()[0]
    hashes = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    each = found.groupBy("cluster").agg(total.alias("cluster_inertia"))  # k rows at most
    each = each.withColumns({"inertia": F.lit(inertia).cast("long"), "centroid_sha256": F.element_at(F.array(*map(F.lit, hashes)), F.col("cluster") + 1)})
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _saturated(total: Column) -> Column:
    return F.least(total, F.lit(MOST)).cast("long")


_NEAREST = """near{i} AS MATERIALIZED (SELECT v.row, arg_min(c.number, struct_pack(d := v.vv + c.cc - 2 * list_inner_product(v.q, c.q), n := c.number)) AS cluster
                     FROM own v, centroids{i} c GROUP BY v.row)"""
_UPDATE = """sums{i} AS (SELECT cluster, d, sum(q[d])::BIGINT AS s, count(*) AS n FROM near{i} JOIN own USING (row), range(1, 65) r(d) GROUP BY cluster, d),
means{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY d) AS q FROM sums{i} GROUP BY cluster),
centroids{j} AS MATERIALIZED (SELECT number, q, list_inner_product(q, q) AS cc FROM (SELECT c.number, coalesce(m.q, c.q) AS q FROM centroids{i} c LEFT JOIN means{i} m ON m.cluster = c.number))"""
ORACLE = f"""
WITH own AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, q, list_inner_product(q, q) AS vv
             FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
centroids0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS number, q, vv AS cc FROM own QUALIFY number < 40),
{",".join(f'''
{_NEAREST.format(i=i)},
{_UPDATE.format(i=i, j=i + 1)}''' for i in range(5))},
{_NEAREST.format(i=5)},
found AS (SELECT v.vec_id, n.cluster::INT AS cluster, (v.vv + c.cc - 2 * list_inner_product(v.q, c.q))::BIGINT AS distance, sha256(array_to_string(list_transform(c.q, lambda x: x::BIGINT), ',')) AS centroid_sha256
          FROM near5 n JOIN own v USING (row) JOIN centroids5 c ON c.number = n.cluster)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM found
"""
