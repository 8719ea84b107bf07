"""The prefix trie, contiguous shards and k-means against plain code, on awkward tables as well."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilojoin.llm import prefix, sharding, trie, yinyang

CONV = "conv_id long, turn long, role string, text string, a string, depth string, label string"


def plain_trie(rows, splice=True):
    """Every node of the rebuilt conversations, by plain dictionaries."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if splice else 0
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = own.get(base, [])[:h] + ts[h:] if splice else ts
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}
    total = {}
    for p in sorted(nodes, key=len, reverse=True):
        cost = (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        total[p] = ((0 if kids[p] else 1) + sum(total[q][0] for q in kids[p]), cost + sum(total[q][1] for q in kids[p]))
    out = []
    for p, cs in nodes.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p))))
        out.append((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids[p]), *total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got_trie(df):
    return sorted(map(tuple, df.collect()), key=str)


def conversations(seed, n=60):
    pick = random.Random(seed)
    rows = []
    for c in range(-3, n):
        if pick.random() < 0.15:
            continue
        for t in range(pick.randrange(0, 12)):
            turn = None if pick.random() < 0.05 else t if pick.random() < 0.9 else t - 1
            rows.append((c, turn, pick.choice(["user", "assistant", None]), pick.choice(["", "é", "yes", None, "no"]), "x", "y", "z"))
    return rows + [(None, 0, "user", "alone", "x", "y", "z"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_code(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, CONV)
    assert got_trie(trie.spliced_trie(df)) == plain_trie(rows)
    assert got_trie(trie.prefix_trie(df)) == plain_trie(rows, splice=False)


def test_trie_of_a_long_chain_of_copies_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(trie, "PACKED", 4)  # ids of a node are hashed in several runs
    rows = [(c, t, "user", f"turn {t}", "", "", "") for c in range(30) for t in range(25 if c < 20 else 300 if c == 20 else 3)]
    assert got_trie(trie.spliced_trie(spark.createDataFrame(rows, CONV))) == plain_trie(rows)
    none = trie.spliced_trie(spark.createDataFrame([], CONV))
    assert none.count() == 0 and none.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_running_totals_over_many_parts(spark):
    pick = random.Random(3)
    rows = [(pick.choice([0, 0, 0, 1, 2]), i, pick.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    got = {r["i"]: (r["s"], r["x"]) for r in prefix.running(df, ["k"], ["i"], sums={"s": "v"}, xors={"x": "v"}).collect()}
    sums, xors = {}, {}
    for k, i, v in rows:
        sums[k], xors[k] = sums.get(k, 0) + v, xors.get(k, 0) ^ v
        assert got[i] == (sums[k], xors[k])
    total = 0
    whole = {r["i"]: r["s"] for r in prefix.running(df, [], ["i"], sums={"s": "v"}).collect()}
    for _, i, v in rows:
        total += v
        assert whole[i] == total


def plain_shards(rows, shards=8):
    size = lambda t: len((t or "").encode()) + 1
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, size(r[1]), zlib.crc32((r[1] or "").encode())))
    whole, until, out, slots = sum(size(t) for _, t in rows), 0, [], {}
    for i, t in order:
        until += size(t)
        s = min((2 * until - size(t)) * shards // (2 * whole), shards - 1)
        out.append((i, size(t), zlib.crc32((t or "").encode()), "bytes", s, slots.setdefault(s, 0), None))
        slots[s] += 1
    return sorted(out, key=str)


def test_shards_equal_plain_code(spark):
    pick = random.Random(4)
    rows = [(pick.choice([None, i, 7]), pick.choice([None, "", "é" * pick.randrange(50), "same text", "x" * pick.randrange(2000)])) for i in range(500)]
    df = spark.createDataFrame([(*r, "other", "other", "other", "other", "other") for r in rows], "doc_id long, text string, row string, id string, part_ string, until string, one string")
    placed = sharding.assign(df)
    assert placed.columns == [*df.columns, *sharding.ADDED]
    assert sorted(map(tuple, sharding.summary(placed).collect()), key=str) == plain_shards(rows)
    sizes = [r["s"] for r in placed.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 2001
    assert sharding.summary(sharding.assign(df.limit(0))).count() == 0


def test_a_document_larger_than_a_shard(spark):
    rows = [(i, "x" * (100_000 if i == 3 else 10)) for i in range(9)]
    placed = sharding.summary(sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(map(tuple, placed.collect()), key=str) == plain_shards(rows)


def test_shard_files_hold_all_texts_in_order(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 17)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "shards"), shards=5, files=2)
    back = spark.read.parquet(str(tmp_path / "shards")).orderBy("shard", "slot").collect()
    assert [(r["doc_id"], r["text"]) for r in back] == rows
    assert {r["shard"] for r in back} == set(range(5))


def plain_clusters(vectors, k=40, scale=256, rounds=5):
    """vectors: (vec_id, list); plain integers of any size."""
    own = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    cs = [v for _, _, v in sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v, v) for i, v in own)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(cs)), key=lambda j: (dist(v, cs[j]), j))
    for _ in range(rounds):
        mine = {}
        for _, v in own:
            mine.setdefault(near(v), []).append(v)
        cs = [[sum(x) // len(mine[j]) for x in zip(*mine[j], strict=True)] if j in mine else c for j, c in enumerate(cs)]
    got = [(i, (j := near(v)), dist(v, cs[j])) for i, v in own]
    most = (1 << 63) - 1
    each = {}
    for _, j, d in got:
        each[j] = each.get(j, 0) + d
    all_ = sum(d for *_, d in got)
    return sorted([(i, j, min(d, most), min(each[j], most), min(all_, most), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, j, d in got], key=str)


VEC = "vec_id long, embedding array<double>, q string, cluster string"


@pytest.mark.parametrize("n, kind", [(400, "apart"), (300, "ties"), (25, "few"), (120, "huge")])
def test_clusters_equal_plain_code(spark, n, kind):
    make = np.random.default_rng(5)
    rows = []
    for i in range(n):
        base = make.integers(0, 12) if kind == "apart" else 0
        v = (np.eye(64)[base] * 3 + make.normal(size=64) / 4) if kind in ("apart", "few") else make.integers(0, 2, 64) * (np.arange(64) < 3) / 256.0 if kind == "ties" else make.normal(size=64) * 1e6
        rows.append((i, [float(x) for x in v], "", ""))
    rows += [(None, rows[0][1], "", ""), (5, rows[1][1], "", ""), (-7, None, "", ""), (1001, [], "", ""), (1002, [1.0] * 63, "", ""), (1003, [None] + [1.0] * 63, "", ""), (1004, [float("nan")] * 64, "", ""), (1005, [float("inf")] * 64, "", "")]
    found = yinyang.clusters(spark.createDataFrame(rows, VEC).repartition(3))
    assert sorted(map(tuple, found.collect()), key=str) == plain_clusters([r[:2] for r in rows])
    assert yinyang.clusters(spark.createDataFrame([], VEC)).count() == 0


def test_bounds_spare_most_distances(spark):
    """The filters leave few comparisons once centroids settle, and never a wrong cluster."""
    make = np.random.default_rng(6)
    x = np.floor(256 * (np.eye(64)[make.integers(0, 40, 4000)] * 4 + make.normal(size=(4000, 64)) / 8)).astype(np.int64)
    df = spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(x)], "vec_id long, q array<long>")
    blocks, centroids = yinyang.rounds(df, 40, 2, 5)
    scanned = blocks.agg(F.sum("scanned")).first()[0]
    assert scanned < 0.2 * 4000 * 40
    got = {}
    for r in blocks.collect():
        ids, cluster = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["cluster"], np.int32)
        got.update(zip(ids.tolist(), cluster.tolist(), strict=True))
    want = ((x[:, None, :] - centroids[None]) ** 2).sum(2).argmin(1)
    assert [got[i] for i in range(len(x))] == want.tolist()
