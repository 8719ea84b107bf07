"""Near copies by the Jaccard similarity of their sets of word shingles, found with SimHash fingerprints in Gray-order trees and checked exactly.

1. Each text turns into its set of hashed shingles of WORDS words. Texts of equal sets are one code. A set has PRINTS SimHash
   fingerprints of 64 bits, and bands of further SimHash bits.
2. At a similarity of 0.8, the vectors of two sets are 27 degrees apart, so that each bit differs with a probability of 0.15. Bands have as many
   bits as keep a band's buckets at BUCKET codes, and there are as many bands as give such a pair a common bucket with a probability above
   0.999 (``shape``). In a bucket, the tree of simhash links codes whose fingerprints differ in at most MOST bits, by one fingerprint after the other: such a pair stays
   linked with a probability of 0.999, codes that aren't alike with one of 3e-6. What is linked in a bucket shares a key.
3. Every code of a key is compared with the smallest code of that key, by the exact similarity of the sets. This links
   nearly all of a large group at a cost that is linear in its size.
4. Keys whose codes are still in different components are looked at again, by groups of keys that share codes. In a group of RUN
   codes or fewer, every two codes that share a bucket and are not linked yet are compared exactly.
5. In a larger group, most codes are too far apart from each other, so that a list of its pairs would grow with the square. Similar sets
   have most shingles in common, so the first shingle in common, from rare to frequent, stands early in both: codes meet
   at their rarest shingles (``prefixes``), and only if size and place still allow the similarity. No similar pair of a group is missed.
   A code meets MEET codes of one larger component first; rounds with MEET times as many follow until none are left out,
   and a round skips what the rounds before have linked.

Keys, heads and groups that hold a large part of all rows are no task's own: what belongs to them goes to their rows by a broadcast
(owner_join), and a hot code's set is copied once for every SALTED codes that are compared with it.

Defined results: null and empty texts and texts without a word have the empty set and are copies of each other; a text of
WORDS words or fewer has one shingle; words are those of the fingerprint (simhash).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.llm.common import BROADCAST_ROWS, discard, is_hot, materialise, owner_join
from kilojoin.llm.simhash import GrayIndex, components, gray_column, gray_rank, whole_buckets

WORDS, LEAST = 5, 0.8
#: Fingerprints of a set, and how many of their bits may differ.
PRINTS, MOST = 2, 20
#: Codes that a band's buckets should hold on average at most, and the least number of a band's bits.
BUCKET, BITS = 256, 14
#: Codes of one group that meet in one task; in larger groups, codes meet by their rarest shingles.
RUN = 256
#: Codes of one larger component that a code meets at a key in the first round; so many times more in each further round.
MEET = 16
#: Codes that are compared with one copy of a hot code's set.
SALTED = 1000


def shingles(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """The sorted different hashes of a text's word shingles."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    line = b" ".join(own)
    if len(own) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = list(itertools.accumulate([len(w) + 1 for w in own]))
    starts = [0, *ends[: len(own) - words]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)], np.uint64))


def shape(n: int) -> tuple[int, int]:
    """How many bands n codes need, and of how many bits."""
    bits = BITS
    while bits < 62 and n > BUCKET << bits:
        bits += 1
    return math.ceil(9 / (1 - math.acos(2 * LEAST / (1 + LEAST)) / math.pi) ** bits), bits


def sketch(own: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """PRINTS fingerprints, then the bands, of a set: each bit is that of most of the mixed hashes; nothing for the empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    n = PRINTS + -(-bands * bits // 64)
    seeds = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(64 * n, np.int64)
    for i in range(0, len(own), 255):
        x = own[i : i + 255, None] + seeds
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        total += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    ones = 2 * total > len(own)
    prints = np.packbits(ones[: 64 * PRINTS], bitorder="little").view(np.int64)
    cut = ones[64 * PRINTS : 64 * PRINTS + bands * bits].reshape(bands, bits)
    return np.concatenate([prints, cut @ (np.int64(1) << np.arange(bits))])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketch_column(text: Column, bands: int, bits: int) -> Column:
    """struct<code, prints, bands> of a text column: the digest of its set, its fingerprints and its bands."""

    @F.pandas_udf("code long, prints array<long>, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t) for t in batch]
            code = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            own = [sketch(s, bands, bits) for s in sets]
            yield pd.DataFrame({"code": code, "prints": [s[:PRINTS] for s in own], "bands": [s[PRINTS:] for s in own]})

    return of(text)


def set_column(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles(t).view(np.int64) for t in batch])

    return of(text)


def _with_roots(linked: DataFrame) -> DataFrame:
    """code, root of components(), the roots themselves included."""
    linked = linked.select(F.col("node").alias("code"), F.col("component").alias("root"))
    return linked.union(linked.select(F.col("root").alias("code"), "root").distinct())


def candidates(codes: DataFrame) -> DataFrame:
    """key, code: codes of one band's bucket that the trees over their fingerprints link share a key; codes: code, prints, bands."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, bounds in whole_buckets(batches, ["band", "part"]):
            part = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            order, first = np.arange(len(own)), bounds
            for p in range(PRINTS):
                if p:  # what the fingerprint before has linked is a bucket for the next
                    prints = own[f"print{p}"].to_numpy(np.int64).view(np.uint64)
                    order = np.lexsort((gray_rank(prints), part))
                    first = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(own))
                label = GrayIndex(own[f"print{p}"].to_numpy(np.int64).view(np.uint64)[order], first).link(MOST)
                part = np.empty(len(own), np.int64)
                part[order] = order[label]
            met = np.flatnonzero(np.bincount(part, minlength=len(own))[part] > 1)
            root = own.iloc[part[met]]
            yield pd.DataFrame({"band": root["band"].to_numpy(), "part": root["part"].to_numpy(), "root": root["code"].to_numpy(), "code": own["code"].to_numpy()[met]})

    prints = [F.get("prints", F.lit(p)).alias(f"print{p}") for p in range(PRINTS)]
    rows = codes.select(F.posexplode("bands").alias("band", "part"), *prints, "code").repartition("band", "part")
    met = rows.sortWithinPartitions("band", "part", gray_column(F.col("print0"))).mapInPandas(search, "band int, part long, root long, code long")
    return met.select(F.xxhash64("band", "part", "root").alias("key"), "code")


def _with_sets(rows: DataFrame, pairs: DataFrame, total: int, key: str, name: str, sets: DataFrame) -> DataFrame:
    """rows, one for each of the total pairs (a, b), with the set of the code in column key; a hot code's set is copied once for every SALTED of its pairs."""
    many = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(is_hot(total))
    many = F.broadcast(many.select(key, F.ceil(F.col("n") / SALTED).cast("int").alias("salts")))
    salted = rows.join(many, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a", "b"), "salts").cast("int"), F.lit(0))).drop("salts")
    copies = sets.select(F.col("code").alias(key), F.col("set").alias(name)).join(many, key, "left")
    copies = copies.select(key, name, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return salted.join(copies, [key, "salt"]).drop("salt")


def _pairs_of_small(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: the links of codes that share a bucket, are in one group and in different components; rows: group, code, component, RUN of a group at most; sets: code, bands, set."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (r for b in batches for r in b.itertuples(index=False, name=None))
        for _, of_group in itertools.groupby(each, key=lambda r: r[0]):
            found, own = [], list(of_group)
            bands = np.array([r[3] for r in own], np.int64)
            sets = [np.asarray(r[4], np.int64) for r in own]
            label = np.unique([r[2] for r in own], return_inverse=True)[1]
            for i in range(1, len(own)):
                for j in np.flatnonzero((bands[:i] == bands[i]).any(1)):
                    if label[i] != label[j] and jaccard(sets[i], sets[j]) >= least:
                        found.append((own[i][1], own[j][1]))
                        label[label == label[i]] = label[j]
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    rows = rows.join(sets, "code").select("group", "code", "component", "bands", "set")
    return rows.repartition("group").sortWithinPartitions("group").mapInPandas(compare, "a long, b long")


def frequencies(own: DataFrame, bound: int = BROADCAST_ROWS) -> tuple[np.ndarray, np.ndarray, bool]:
    """Shingles (sorted) that sets of different components hold, in how many sets each is, and whether these are all; the most frequent ones, if there are more than bound."""
    held = own.select("component", F.explode("set").alias("token")).groupBy("token")
    held = held.agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    held, from_ = materialise(held.select("token", "n"), "frequencies"), 1
    while held.where(F.col("n") >= from_).count() > bound:
        from_ *= 2
    rows = held.where(F.col("n") >= from_).sort("token").toArrow()
    discard(held)
    return rows["token"].to_numpy(), rows["n"].to_numpy(), from_ == 1


def prefixes(own: DataFrame, least: float) -> DataFrame:
    """key, code, size, place: the rarest shingles of each set, and their places among its shingles, from rare to frequent; own: group, code, component, set.

    A key is a shingle in a group. Shingles of one component only come first; they count in the places, but are no keys where they are known.
    """
    tokens, counts, whole = frequencies(own)

    @F.pandas_udf("lone int, tokens array<long>")
    def rarest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lone, out = [], []
            for s in batch:
                at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                n = np.where(tokens[at] == s, counts[at], 0) if len(tokens) else np.zeros(len(s), np.int64)
                lone.append(int((n == 0).sum()) if whole else 0)
                # a later one can't be the first that two similar sets have in common
                out.append(s[np.lexsort((s, n))][lone[-1] : len(s) - math.ceil(least * len(s) - 1e-9) + 1])
            yield pd.DataFrame({"lone": lone, "tokens": out})

    rows = own.select("group", "code", F.size("set").alias("size"), rarest("set").alias("own"))
    rows = rows.select("group", "code", "size", "own.lone", F.posexplode("own.tokens").alias("at", "token"))
    return rows.select(F.xxhash64("group", "token").alias("key"), "code", "size", (F.col("lone") + F.col("at")).alias("place"))


def _meetings(rows: DataFrame, least: float, most: int) -> DataFrame:
    """a, b, cut: codes of different components whose first common shingle may be a key of both; rows: key, code, component, size, place.

    A code meets ``most`` codes of a larger component at a key, and cut says where there are more.
    """

    def found(own: pd.DataFrame, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        codes, sizes, places = (own[c].to_numpy(np.int64) for c in ("code", "size", "place"))
        for lo, hi in itertools.pairwise(bounds):
            label, n = np.unique(own["component"].to_numpy(np.int64)[lo:hi], return_inverse=True, return_counts=True)[1:]
            rank = np.argsort(np.argsort(n, kind="stable"))[label]
            code, size, left = codes[lo:hi], sizes[lo:hi], sizes[lo:hi] - places[lo:hi]
            for i in np.flatnonzero(rank < len(n) - 1):
                # what two sets have in common is not more than what either has from their first common shingle on
                need = np.ceil(least / (1 + least) * (size + size[i]) - 1e-9)
                other = np.flatnonzero((rank > rank[i]) & (np.minimum(left, left[i]) >= need))
                if not len(other):
                    continue
                other = np.roll(other, -np.searchsorted(other, i))
                other = other[np.argsort(rank[other], kind="stable")]
                first = np.searchsorted(rank[other], rank[other])
                keep = np.arange(len(other)) - first < most
                yield np.full(keep.sum(), code[i]), code[other[keep]], np.full(keep.sum(), not keep.all())

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (x for own, bounds in whole_buckets(batches, ["key"]) for x in found(own, bounds))
        while some := list(itertools.islice(each, 1000)):
            yield pd.DataFrame(dict(zip(("a", "b", "cut"), map(np.concatenate, zip(*some, strict=True)), strict=True)))

    rows = rows.select("key", "code", "component", "size", "place")
    return rows.repartition("key").sortWithinPartitions("key", "code").mapInPandas(meet, "a long, b long, cut boolean")


def _pairs_of_large(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: links that join every two similar codes of one group that are in different components; rows: group, code, component; sets: code, set."""
    own = materialise(rows.join(sets, "code").select("group", "code", "component", "set"), "large")
    index = materialise(prefixes(own, least), "prefixes")
    now, most, links = own.select("code", "component"), MEET, None
    while True:
        met = materialise(_meetings(index.join(now, "code"), least, most), "meetings")
        pairs = materialise(met.select("a", "b").distinct(), "pairs")
        found = materialise(_alike(pairs, own, least), "links")
        links = found if links is None else links.unionByName(found)
        left = met.where("cut").limit(1).count()
        discard(met, pairs)
        if not left:
            break
        joined = _with_roots(components(links.unionByName(own.select(F.col("code").alias("a"), F.col("component").alias("b")))))
        now = materialise(own.select("code", "component").join(joined, "code", "left").select("code", F.coalesce("root", "component").alias("component")), "now")
        most *= MEET
    discard(own, index)
    return links


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    both = F.size(F.array_intersect("x", "y"))
    total = pairs.count()
    sides = _with_sets(_with_sets(pairs, pairs, total, "a", "x", sets), pairs, total, "b", "y", sets)
    return sides.where(both / (F.size("x") + F.size("y") - both) >= least).select("a", "b")


def groups(marked: DataFrame, least: float = LEAST) -> DataFrame:
    """code, root of every code that is linked with another; marked: _uid (unique), _own (sketch) and text of every row."""
    one = marked.groupBy(F.col("_own.code").alias("code")).agg(F.min("_uid").alias("_uid"))
    codes = materialise(marked.select("_uid", "_own.*").join(one.select("_uid"), "_uid", "left_semi"), "codes")
    pairs = materialise(candidates(codes), "keys")
    heads = pairs.groupBy("key").agg(F.min("code").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(owner_join(pairs, heads, "key", pairs.count()).drop("n"), "shared")

    members = codes.join(shared.select("code").distinct(), "code", "left_semi").select("_uid", "code", "bands")
    texts = marked.select("_uid", "text").join(members, "_uid")
    sets = materialise(texts.select("code", "bands", set_column(F.col("text")).alias("set")), "sets")

    edges = materialise(shared.where("code <> head").select(F.col("code").alias("a"), F.col("head").alias("b")).distinct(), "edges")
    near = materialise(_alike(edges, sets, least), "near")
    first = materialise(_with_roots(components(near)), "first")

    # keys that hold codes of more than one component
    state = materialise(shared.join(first, "code", "left").select("key", "code", "head", F.coalesce("root", "code").alias("component")), "state")
    open_ = state.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    rest = materialise(owner_join(state, open_, "key", state.count()).drop("low", "high", "n"), "rest")
    own = rest.groupBy("code").agg(F.min("component").alias("component"), F.collect_set("head").alias("heads"))
    own = materialise(own.withColumn("lead", F.array_min("heads")), "own")
    # one group for all heads of a code: edges between heads, of which there are far fewer than codes
    met = _with_roots(components(own.where(F.size("heads") > 1).select(F.explode("heads").alias("a"), F.col("lead").alias("b"))))
    leads = own.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).join(met.withColumnRenamed("code", "lead"), "lead", "left")
    rows = owner_join(own.select("code", "component", "lead"), leads, "lead", own.count())
    rows = materialise(rows.select("code", "component", F.coalesce("root", "lead").alias("group")), "met")
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    sized = materialise(owner_join(rows, sizes, "group", rows.count()), "sized")
    small, large = sized.where(F.col("n") <= RUN), sized.where(F.col("n") > RUN)
    more = materialise(_pairs_of_small(small, sets, least), "more")
    links = first.where("code <> root").toDF("a", "b").unionByName(more)
    if large.limit(1).count():
        links = links.unionByName(_pairs_of_large(large, sets, least))
    out = _with_roots(components(links))
    discard(codes, pairs, shared, edges, sets, near, first, state, rest, own, rows, sized, more)
    return out


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id, a null id last; of equal ids, the smallest hash over all columns.

    All columns are kept, whatever their names.
    """
    own = sketch_column(F.col("text"), *shape(docs.count()))
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text", own.alias("_own"))
    marked = materialise(packed.select("*", F.xxhash64("row").alias("hash"), F.monotonically_increasing_id().alias("_uid")), "marked")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", F.col("_uid").alias("uid"))
    best = marked.groupBy(F.col("_own.code").alias("code")).agg(F.min(place).alias("best"))
    best = best.join(groups(marked, least), "code", "left").groupBy(F.coalesce("root", "code")).agg(F.min("best").alias("best"))
    return marked.join(best.select(F.col("best.uid").alias("_uid")), "_uid", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])
