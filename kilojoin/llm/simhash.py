"""SimHash near copies, linked through a Gray-order hierarchical index.

1. Each text gets a 64-bit fingerprint (one pass over the text, nothing is shuffled).
2. Equal fingerprints collapse to one, with the smallest doc_id (partial aggregation first: a group of exact
   copies of any size is one row).
3. Two fingerprints that differ in at most d bits agree in b - d of b blocks of bits. Each fingerprint goes to one
   bucket for each choice of b - d blocks, so every link lies in some bucket. b follows from the number of
   fingerprints, so that buckets keep their size as the corpus grows; every b is exact. A bucket that is still
   large is split by further blocks: its free bits are cut into d + 1 blocks, of which a link has one in common, so each
   of its fingerprints goes to d + 1 finer buckets; this is done FINER times at most.
4. In a bucket, fingerprints are sorted by Gray rank and put under a tree: a leaf node stands for FAN
   neighbours, an upper node for FAN nodes. A node holds the mask of the bits that all below it share and
   their pattern; its children count only the bits that it doesn't. A search adds up the differences on its
   way down and drops a node, and all below it, once they exceed d. A node whose members are already in the
   searcher's component is skipped, so a large group of near copies costs no list of all its pairs.
5. A bucket returns a star for each component found in it. Stars of all buckets are joined into components by
   rounds of large-star and small-star joins on tables in the shared folder.
6. Buckets that stay large are dense: most of their fingerprints are near copies of each other. They are cut into runs by hash.
   First each run is linked by itself, which joins nearly all of a dense bucket into one component at a cost linear in its size.
   Then only the fingerprints outside of the bucket's largest component visit the other runs: two fingerprints that are not joined
   yet can't both be in it.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and are linked like any
other; repeated rows share a component; rows with a null doc_id take the component of their fingerprint and are its
smallest id only if no other is there; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.llm.common import HOT, discard, materialise, maybe_broadcast, owner_join

BITS = 64
#: Members of a leaf node, and nodes of an upper node.
FAN = 16
#: Fingerprints that a bucket should hold on average at most; decides the number of blocks.
BUCKET = 4096
#: Fingerprints of one bucket that go to one task; larger buckets are split FINER times, and cut into runs of half as many if they stay large.
RUN, FINER = 2048, 2
#: (searcher, node) pairs looked at together.
FRONT = 1 << 18

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# fingerprints ---------------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text, as an unsigned number."""
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    line = b" ".join(own)
    if len(own) <= words:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = list(itertools.accumulate([len(w) + 1 for w in own]))
        starts = [0, *ends[: len(own) - words]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)]
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i : i + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = 4, seed: int = 42) -> Column:
    """The fingerprint of a text column as a long (two's complement)."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, words, seed) for t in batch], np.uint64).view(np.int64))

    return of(text)


# the index ------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order (prefix parity from the highest bit)."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Trees over buckets of fingerprints that are sorted by (bucket, Gray rank); bounds: first place of each bucket, and the end."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        self.codes, self.bounds = codes, bounds
        self.levels: list[tuple[np.ndarray, ...]] = []
        ones, zeros, first = codes, ~codes, bounds
        last = np.arange(1, len(codes) + 1)
        while not self.levels or len(ones) > len(first) - 1:
            size = np.diff(first)
            many = -(-size // FAN)
            new = np.concatenate([[0], np.cumsum(many)])
            starts = np.repeat(first[:-1], many) + FAN * (np.arange(new[-1]) - np.repeat(new[:-1], many))
            stops = np.minimum(starts + FAN, np.repeat(first[1:], many))
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            last = last[stops - 1]
            self.levels.append((ones, ones | zeros, starts, stops, last, new))
            first = new
        self.label = np.arange(len(codes))

    def _settled(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The smallest and largest label below each node of each level."""
        out, low, high = [], self.label, self.label
        for _, _, starts, _, _, _ in self.levels:
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append((low, high))
        return out

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the components of a[i] and b[i]; a label is the smallest place of its component."""
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    def link(self, most: int, apart_from: np.ndarray | None = None) -> np.ndarray:
        """Labels after every two codes of a bucket that differ in at most ``most`` bits are joined.

        apart_from: the side of each code, where only codes of different sides need to be compared.
        """
        top = self.levels[-1]
        bucket = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        nodes = np.diff(top[5])[bucket]
        costs = np.concatenate([[0], np.cumsum(nodes)])
        at = 0
        while at < len(self.codes):
            to = max(at + 1, int(np.searchsorted(costs, costs[at] + FRONT, side="right")) - 1)
            who = np.repeat(np.arange(at, to), nodes[at:to])
            node = np.arange(len(who)) - np.repeat(costs[at:to] - costs[at], nodes[at:to]) + np.repeat(top[5][bucket[at:to]], nodes[at:to])
            self._search(who, node, np.zeros(len(who), np.uint8), len(self.levels) - 1, most, apart_from, self._settled())
            at = to
        return self.label

    def _search(self, who, node, less, level, most, sides, settled) -> None:
        ones, mask, starts, stops, last, _ = self.levels[level]
        if level + 1 == len(self.levels):
            less = np.bitwise_count((self.codes[who] ^ ones[node]) & mask[node])
        low, high = settled[level]
        own = self.label[who]
        keep = (less <= most) & (last[node] > who + 1) & ~((low[node] == own) & (high[node] == own))
        who, node, less = who[keep], node[keep], less[keep]
        many = (stops - starts)[node]
        ends = np.cumsum(many)
        i = 0
        while i < len(who):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + FRONT, side="right")))
            m = many[i:j]
            w, parent, acc = np.repeat(who[i:j], m), np.repeat(node[i:j], m), np.repeat(less[i:j], m)
            child = np.arange(len(w)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(starts[node[i:j]], m)
            if level:
                c_ones, c_mask = self.levels[level - 1][:2]
                acc = acc + np.bitwise_count((self.codes[w] ^ c_ones[child]) & c_mask[child] & ~mask[parent])
                self._search(w, child, acc, level - 1, most, sides, settled)
            else:
                acc = acc + np.bitwise_count((self.codes[w] ^ self.codes[child]) & ~mask[parent])
                near = (acc <= most) & (child > w)
                if sides is not None:
                    near &= sides[w] != sides[child]
                if near.any():
                    self._union(w[near], child[near])
            i = j


# buckets --------------------------------------------------------------------------------------------


def blocks_for(n: int, most: int, bucket: int = BUCKET) -> int:
    """The smallest number of blocks for which a bucket holds ``bucket`` of n evenly spread fingerprints at most."""
    b = most + 1
    while b < BITS and n > bucket * 2 ** (BITS * (b - most) // b):
        b += 1
    return b


def bucket_masks(blocks: int, most: int) -> list[int]:
    """The bits of each choice of blocks - most blocks."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in itertools.combinations(bits, blocks - most)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_column(code: Column) -> Column:
    """gray_rank as a column; the sign bit is turned so that longs sort as unsigned numbers do."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(_signed(1 << 63)))


def finer_masks(mask: int, most: int) -> list[int]:
    """The mask with each of most + 1 blocks of its free bits added."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    cuts = [len(free) * i // (most + 1) for i in range(most + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in itertools.pairwise(cuts)]


def buckets(codes: DataFrame, most: int, blocks: int, run: int = RUN, finer: int = FINER) -> tuple[DataFrame, DataFrame]:
    """mask, part, code of all buckets; and mask, part, size of those that are still large after all splits."""
    spark, masks = codes.sparkSession, bucket_masks(blocks, most)

    def dealt(rows: DataFrame, to: list[tuple[int, int]]) -> DataFrame:
        into = F.broadcast(spark.createDataFrame([(_signed(m), _signed(n)) for m, n in to], "mask long, into long"))
        return rows.join(into, "mask").select(F.col("into").alias("mask"), F.col("code").bitwiseAND(F.col("into")).alias("part"), "code")

    rows = codes.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "code")
    rows = rows.select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("part"), "code")
    for level in range(finer + 1):
        large = rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > run)
        large = materialise(large, "large")
        if level == finer or not large.limit(1).count():
            return rows, large
        split = [(m, n) for m in masks for n in finer_masks(m, most)]
        own, key = maybe_broadcast(large.select("mask", "part")), ["mask", "part"]
        deeper = dealt(rows.join(own, key, "left_semi"), split).distinct()
        rows = materialise(rows.join(own, key, "left_anti").union(deeper), "buckets")
        masks = list(dict.fromkeys([*masks, *(n for _, n in split)]))
    return rows, large


def whole_buckets(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows that are sorted by key, in tables that hold all rows of their keys, each with the first place of every key and the end."""
    rest: pd.DataFrame | None = None

    def bounded(own: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        values = own[key].to_numpy()
        return own, np.append(np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]).any(1)])), len(own))

    for batch in batches:
        own = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        values = own[key].to_numpy()
        last = int(np.flatnonzero((values != values[-1]).any(1))[-1]) + 1 if len(own) and (values != values[-1]).any() else 0
        if last:
            yield bounded(own.iloc[:last])
        rest = own.iloc[last:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield bounded(rest)


def stars(rows: DataFrame, most: int) -> DataFrame:
    """code, root: for each (mask, part, run) a star over each component in it, its root the first code in Gray order; codes of one side aren't compared, if it isn't negative."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, bounds in whole_buckets(batches, key):
            code = own["code"].to_numpy(np.int64).view(np.uint64)
            side = own["side"].to_numpy(np.int64)
            label = GrayIndex(code, bounds).link(most, np.where(side < 0, -1 - np.arange(len(own)), side))
            away = np.flatnonzero(label != np.arange(len(label)))
            yield pd.DataFrame({"code": code[away].view(np.int64), "root": code[label[away]].view(np.int64)})

    key = ["mask", "part", "run"]
    return rows.repartition(*key).sortWithinPartitions(*key, gray_column(F.col("code"))).mapInPandas(search, "code long, root long").distinct()


def links(codes: DataFrame, most: int, blocks: int, run: int = RUN, finer: int = FINER) -> DataFrame:
    """code, root: edges that join every two codes that differ in at most ``most`` bits."""
    rows, large = buckets(codes, most, blocks, run, finer)
    if not large.limit(1).count():
        return stars(rows.select("mask", "part", F.lit(0).alias("run"), F.lit(-1).alias("side"), "code"), most)
    key, runs = ["mask", "part"], F.ceil(F.col("size") / F.lit(run / 2)).cast("int")
    own = F.pmod(F.xxhash64("code"), F.coalesce("runs", F.lit(1))).cast("int")
    rows = materialise(rows.join(maybe_broadcast(large.select(*key, runs.alias("runs"))), key, "left").select(*key, "runs", own.alias("run"), "code"), "runs")
    first = materialise(stars(rows.select(*key, "run", F.lit(-1).alias("side"), "code"), most), "stars")
    member = components(first, "code", "root")
    member = materialise(member.select(F.col("node").alias("code"), "component").union(member.select("component", "component").distinct()), "members")
    # in dense buckets, codes outside of the largest component visit the other runs
    dense = materialise(rows.where("runs is not null").join(member, "code", "left").select(*key, "runs", "run", "code", F.coalesce("component", "code").alias("component")), "dense")
    most_of = dense.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max_by("component", "n").alias("top"), F.count(F.lit(1)).alias("many"))
    open_ = maybe_broadcast(materialise(most_of.where("many > 1").select(*key, "top"), "open"))
    dense = dense.join(open_, key)
    visits = dense.where("component <> top").select(*key, F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("at"), "run", "code").where(F.col("at") != F.col("run"))
    met = dense.select(*key, "run", F.col("run").alias("side"), "code").union(visits.select(*key, F.col("at").alias("run"), F.col("run").alias("side"), "code"))
    return first.union(stars(met, most))


# components -----------------------------------------------------------------------------------------


def _ends(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (a, b) there are, and whether they are stars already: no a has two edges or is another's b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
    more = (F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("n") > F.col("ups")))
    n, open_ = ends.agg(F.sum("ups"), F.max(more)).first()
    return n or 0, bool(open_)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node of an edge table, by large-star and small-star rounds.

    Every round is two joins of the edges with one row for each node, and its result is a table in the shared
    folder; the driver only reads counts. Rounds end when all edges lead to the smallest node of a star. The root of a large
    component has most of its edges: such nodes go to their edges by a broadcast (owner_join).
    """
    edges = materialise(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    while True:
        total, more = _ends(edges)
        if not more:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = owner_join(both.where("b > a"), least, "a", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.distinct(), "large")  # total edges at most; a > b, as m is not more than the a it comes from
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = owner_join(large, least, "a", total).select("b", "m").union(least.select("a", "m")).toDF("a", "b")
        small = materialise(small.where("a <> b").distinct(), "small")
        discard(edges, large)
        edges = small


# the operator ---------------------------------------------------------------------------------------


def near_copies(docs: DataFrame, most: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, code (long), component_id of every row of docs (doc_id, text)."""
    prints = materialise(docs.select("doc_id", fingerprint_column(F.col("text"), words, seed).alias("code")), "prints")
    codes = materialise(prints.groupBy("code").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("many")), "codes")
    found = links(codes.select("code"), most, blocks_for(codes.count(), most))
    member = components(found, "code", "root")
    # the component of a code is its smallest code; the contract asks for the smallest doc_id below it
    linked = member.select(F.col("node").alias("code"), F.col("component").alias("root")).union(member.select("component", "component").distinct())
    linked = materialise(linked.join(codes, "code").select("code", "root", "least"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    linked = owner_join(linked, least, "root", linked.count()).select("code", "component_id")
    own = codes.join(linked, "code", "left").select("code", "many", F.coalesce("component_id", "least").alias("component_id"))
    # codes with a HOTth of all rows or more are HOT at most, so these go to the rows by a broadcast and the rest by a shuffle
    own, share = materialise(own, "owners"), F.lit(prints.count() / HOT)
    hot = F.broadcast(own.where(F.col("many") > share).select("code", "component_id"))
    rest = prints.join(hot, "code", "left_anti").join(own.where(F.col("many") <= share).select("code", "component_id"), "code")
    return prints.join(hot, "code").unionByName(rest).select("doc_id", "code", "component_id")


def hex_column(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")
