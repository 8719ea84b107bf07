"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kilojoin.llm import simhash


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(codes, most):
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= most:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(codes))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A b C d E", "x y z w v", "Ä ä É b c d e", "w " * 300, "a\x0bb\x0cc\x1cd e f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near_codes(rng, n, groups, flips):
    heads = [rng.getrandbits(64) for _ in range(groups)]
    out = []
    for _ in range(n):
        c = rng.choice(heads)
        for _ in range(rng.randint(0, flips)):
            c ^= 1 << rng.randrange(64)
        out.append(c)
    return out


@pytest.mark.parametrize("seed, most", [(1, 4), (2, 4), (3, 3), (4, 7)])
def test_index_links_equal_brute_force(seed, most):
    rng = random.Random(seed)
    codes = sorted(set(near_codes(rng, 500, 40, 5)), key=lambda c: int(simhash.gray_rank(np.array([c], np.uint64))[0]))
    label = simhash.GrayIndex(np.array(codes, np.uint64), np.array([0, len(codes)])).link(most)
    assert label.tolist() == plain_components(codes, most)


def test_gray_rank_undoes_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_every_link_shares_a_bucket(blocks):
    rng, masks = random.Random(blocks), simhash.bucket_masks(blocks, 4)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), 4):
            b ^= 1 << i
        assert any(a & m == b & m for m in masks)


def test_a_link_shares_a_finer_bucket():
    rng = random.Random(7)
    for mask in (0, 0xFFFF, 0xFFFFFFFF00000000, (1 << 64) - 8):
        finer = simhash.finer_masks(mask, 4)
        assert len(finer) == 5 and all(m & mask == mask for m in finer)
        free = [i for i in range(64) if not mask >> i & 1]
        for _ in range(50):
            differ = sum(1 << i for i in rng.sample(free, min(4, len(free))))
            assert len(free) < 5 or any(not differ & m & ~mask for m in finer)


@pytest.mark.parametrize("run, finer, groups", [(2048, 2, 25), (40, 2, 25), (40, 0, 25), (24, 1, 2), (24, 0, 1)])
def test_components_equal_brute_force(spark, run, finer, groups):
    rng = random.Random(run + finer)
    codes = sorted(set(near_codes(rng, 400, groups, 6)))
    df = spark.createDataFrame([(simhash._signed(c),) for c in codes], "code long")
    found = simhash.links(df, 4, 5, run, finer)
    got = {r["node"]: r["component"] for r in simhash.components(found, "code", "root").collect()}
    signed = [simhash._signed(c) for c in codes]
    want = plain_components(codes, 4)
    groups = {}
    for c, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(c)
    have = {}
    for c in signed:
        have.setdefault(got.get(c, c), set()).add(c)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, groups.values()))


def test_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(6)]
    rows = []
    for i in range(40):
        w = list(base[i % 6])
        if i >= 12:
            w[rng.randrange(300)] = "changed"
        rows.append((100 - i, " ".join(w), "extra"))
    rows += [(200, None, "e"), (201, "", "e"), (202, "  ", "e"), (7, rows[0][1], "again"), (7, rows[0][1], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, code string")
    got = simhash.near_copies(df).collect()
    assert len(got) == len(rows)
    codes = [plain_fingerprint(t) for _, t, _ in rows]
    want = plain_components(codes, 4)
    least = {}
    for (d, _, _), w in zip(rows, want, strict=True):
        least[w] = min(d, least.get(w, d))
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((d, least[w]) for (d, _, _), w in zip(rows, want, strict=True))


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, "x")], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in simhash.near_copies(df).where("component_id is not null").collect()) == [(False, 3), (True, 3)]
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_components_around_hot_roots(spark):
    """A star of 100,000 nodes, a chain that ends in it, a chain of its own and a second star around its largest node."""
    star = [(0, i) for i in range(1, 100_001)]
    chain = [(i, i + 1) for i in range(200_000, 200_300)] + [(200_300, 77)]
    alone = [(i + 1, i) for i in range(300_000, 300_050)]
    high = [(i, 500_000) for i in range(400_000, 405_000)]
    df = spark.createDataFrame(star + chain + alone + high, "a long, b long")
    got = {(r["component"], r["n"]) for r in simhash.components(df).groupBy("component").count().withColumnRenamed("count", "n").collect()}
    assert got == {(0, 100_301), (300_000, 50), (400_000, 5_000)}


def test_components_end_when_all_edges_are_stars(spark, monkeypatch):
    """Stars take no round, whichever way their edges point, and a chain or two roots of one node take rounds until they are one star."""
    written, of = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, name: written.append(name) or of(df, name))
    got = {}
    for name, edges in {"stars": [(1, 2), (3, 1), (7, 9), (1, 4)], "chain": [(i, i + 1) for i in range(9)], "roots": [(5, 1), (5, 2), (6, 2)], "none": [(3, 3)]}.items():
        written.clear()
        rows = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        got[name] = rows, written.count("small")
    assert got["stars"] == ({2: 1, 3: 1, 4: 1, 9: 7}, 0) and got["none"] == ({}, 0)
    assert got["chain"][0] == dict.fromkeys(range(1, 10), 0) and got["roots"][0] == {5: 1, 2: 1, 6: 1}


def test_owner_join_keeps_hot_rows_off_single_tasks(spark):
    """Rows of a hot key stay where they are; results are those of a plain join."""
    from kilojoin.llm.common import owner_join

    rows = spark.range(40_000).selectExpr("if(id % 3 = 0, -1, id % 5000) AS k", "id")
    owners = rows.groupBy("k").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    got = owner_join(rows, owners, "k", 40_000)
    plain = rows.join(owners, "k")
    assert got.count() == 40_000 and got.exceptAll(plain).count() == 0
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_hex(spark):
    df = spark.createDataFrame([(0,), (-1,), (255,)], "code long")
    assert [r[0] for r in df.select(simhash.hex_column(df["code"])).collect()] == ["0" * 16, "f" * 16, "0" * 14 + "ff"]
