"""The prefix trie of conversations, and totals over its subtrees by peeling leaves.

Every turn has a digest of its place, role and text; the exclusive or of a prefix's digests names the node, so nodes are
equal if and only if their prefixes are, up to collisions of 120 bits. Nodes are counted by partial aggregation.

Each node takes the member with the smallest hash of its conv_id as its label. Nodes of one label form a path (a member that is the
smallest of a set is the smallest of every subset that holds it), so the paths are chains of nodes that hand their totals straight up. A path
holds how many paths below it haven't reported. Each round those that wait for none send their subtree totals to the path of their
parent node and leave; the rest count down, until only the root's path is left and finishes. On the way from a leaf to the
root the label changes only where a larger set has a new smallest hash, so the number of rounds grows with the logarithm of the number of
conversations, whatever the depth of the trie. Totals inside of a path are running sums from its end.

A parent with a large part of all children is found by a broadcast (there are few such parents), a conversation or a path with a large part of all turns
lies in many parts of a range (prefix.py). The ids that end at a node are hashed as a stream, in packed runs.

Defined results: turns are in ascending order, null first, ties by role and text, and repeated rows are turns of their own; a null
role or text is empty; rows without a conv_id belong to no conversation and take no part; a node's totals don't depend on the order of
rows; an empty table gives no rows, not even a root. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.llm.common import discard, materialise
from kilojoin.llm.prefix import running, with_owner

#: Ids that are packed into one row before they are hashed.
PACKED = 1024
NODE = ["a", "b"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (place from 1), d (digest of role and text), bytes of every turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"d": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")), "bytes": F.octet_length("text").cast("long"), "one": F.lit(1).cast("long")})
    order = [F.asc_nulls_first("turn"), "role", "text"]
    return running(rows, ["conv_id"], order, sums={"k": "one"}, keep=["conv_id", "d", "bytes", "one"]).select("conv_id", "k", "d", "bytes")


def spliced(own: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """conv_id, depth, d, bytes: each conversation c after the first h turns of its group's first one (c - c % group), h = crc32 of c modulo most + 1.

    Conversations that are left without turns have one row of depth 0.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    sizes = materialise(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("many")), "conversations")
    first = materialise(own.where(F.col("k") <= most), "first")
    heads = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    lent = first.select(F.col("conv_id").alias("base"), F.col("k").alias("depth"), "d", "bytes")
    lent = heads.join(lent, "base").where(F.col("depth") <= F.col("h")).select("conv_id", "depth", "d", "bytes")
    # own turns follow as many as the group's first conversation could lend
    has = first.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("has"))
    lends = heads.join(has, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("lent"))
    lends = materialise(lends.join(sizes, "conv_id"), "lends")
    kept = with_owner(own.where(F.col("k") > h), lends, ["conv_id"], "many", sizes.agg(F.sum("many")).first()[0] or 0)
    kept = kept.select("conv_id", (F.col("k") - F.col("h") + F.col("lent")).alias("depth"), "d", "bytes")
    nothing = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("d"), F.lit(0).cast("long").alias("bytes"))
    return materialise(lent.unionByName(kept).unionByName(nothing), "spliced")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, bytes, a, b (digest of the prefix), pa, pb (of the prefix before), for rows (conv_id, depth, d, bytes) with one of depth 0 for each conversation."""
    both = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), "d").cast("binary"))
    own = {n: F.when(F.col("depth") > 0, F.conv(F.substring(both, at, 15), 16, 10).cast("long")).otherwise(F.lit(0).cast("long")) for n, at in (("x", 1), ("y", 17))}
    summed = running(rows.withColumns(own).select("conv_id", "depth", "bytes", "x", "y"), ["conv_id"], ["depth"], xors={"a": "x", "b": "y"})
    return summed.select("conv_id", "depth", "bytes", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"))


def nodes(members: DataFrame) -> DataFrame:
    """a, b, depth, bytes, n_convs, conv_id, label, n_children, parent (label and conv_id of the parent node, null at the root)."""
    label = F.min(F.struct(F.xxhash64("conv_id").alias("hash"), "conv_id"))["conv_id"]
    all_ = members.groupBy(*NODE).agg(*[F.min(c).alias(c) for c in ("depth", "bytes", "pa", "pb", "conv_id")], F.count(F.lit(1)).alias("n_convs"), label.alias("label"))
    all_ = materialise(all_, "nodes")
    kids = all_.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    all_ = all_.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    all_ = materialise(all_, "counted")
    owners = all_.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.struct("label", "conv_id").alias("parent"), "n_children")
    below = with_owner(all_.where("depth > 0").withColumnRenamed("n_children", "own_children"), owners, ["pa", "pb"], "n_children", all_.count())
    below = below.drop("n_children").withColumnRenamed("own_children", "n_children")
    return materialise(below.unionByName(all_.where("depth = 0"), allowMissingColumns=True), "trie")


def peel(paths: DataFrame) -> DataFrame:
    """path, up, and the subtree totals leaves and saved, for paths (path, up (the path above, null at the root), leaves, saved (their own))."""
    below = paths.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.count(F.lit(1)).alias("waits"))
    left = materialise(paths.join(below, "path", "left").withColumn("waits", F.coalesce("waits", F.lit(0).cast("long"))), "paths")
    done = []
    while True:
        ready = left.where("waits = 0")
        done.append(left)
        sent = ready.groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("heard"))
        rest = left.where("waits > 0").join(sent, "path", "left")
        plus = {c: F.col(c) + F.coalesce(f, F.lit(0)) for c, f in (("leaves", "more_leaves"), ("saved", "more_saved"))}
        left = materialise(rest.withColumns(plus | {"waits": F.col("waits") - F.coalesce("heard", F.lit(0))}).drop("more_leaves", "more_saved", "heard"), "paths")
        if not left.limit(1).count():
            discard(left)
            break
    out = done[0].where("waits = 0")
    for df in done[1:]:
        out = out.unionByName(df.where("waits = 0"))
    out = materialise(out.select("path", "up", "leaves", "saved"), "peeled")
    discard(*done)
    return out


def hashed_ends(members: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of the nodes at which conversations end: the digest of their ids, ascending, joined by commas."""
    ends = materialise(members.groupBy("conv_id").agg(F.max_by(F.struct(*NODE), "depth").alias("at")).select("conv_id", "at.*", F.lit(1).cast("long").alias("one")), "ends")
    placed = running(ends, NODE, ["conv_id"], sums={"nth": "one"})
    chunk = F.floor((F.col("nth") - 1) / PACKED).alias("chunk")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")  # PACKED at most
    packed = materialise(placed.groupBy(*NODE, chunk).agg(ids.alias("ids")), "packed")
    many = packed.where("chunk = 1").select(*NODE)
    single = packed.join(many, NODE, "left_anti").select(*NODE, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            out = []
            for a, b, ids_ in zip(batch["a"], batch["b"], batch["ids"], strict=True):
                if (a, b) == at:
                    state.update(f",{ids_}".encode())
                else:
                    if at:
                        out.append((*at, state.hexdigest()))
                    at, state = (a, b), hashlib.sha256(ids_.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if at:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    runs = packed.join(many, NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return single.unionByName(runs.mapInPandas(digests, "a long, b long, ends_sha256 string"))


def trie(members: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the members (conv_id, depth, bytes, a, b, pa, pb; one row of depth 0 for each conversation)."""
    all_ = nodes(members).withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "cost": (F.col("n_convs") - 1) * F.col("bytes")})
    top = F.min_by(F.struct("parent", "pa", "pb"), "depth")
    paths = all_.groupBy(F.col("label").alias("path")).agg(top.alias("top"), F.sum("leaf").alias("leaves"), F.sum("cost").alias("saved"))
    paths = materialise(paths.select("path", F.col("top.parent.label").alias("up"), "top.pa", "top.pb", "leaves", "saved"), "tops")
    total = peel(paths.select("path", "up", "leaves", "saved"))
    # what hangs below each node beside its own path
    hung = total.where("up is not null").select("path", "leaves", "saved").join(paths.select("path", "pa", "pb"), "path")
    hung = hung.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    all_ = all_.join(hung, NODE, "left")
    own = {"leaf": F.col("leaf") + F.coalesce("hung_leaves", F.lit(0)), "cost": F.col("cost") + F.coalesce("hung_saved", F.lit(0))}
    own = all_.withColumns(own).select(*NODE, "label", "depth", "conv_id", F.col("parent.conv_id").alias("parent_conv_id"), "n_convs", "n_children", "leaf", "cost")
    summed = running(own, ["label"], [F.desc("depth")], sums={"n_leaves": "leaf", "saved_tokens": "cost"})
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return summed.join(hashed_ends(members), NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are logged."""
    own = turns(conversations)
    nothing = own.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("k"), F.lit(None).cast("string").alias("d"), F.lit(0).cast("long").alias("bytes"))
    return trie(prefixes(own.unionByName(nothing).withColumnRenamed("k", "depth")))


def spliced_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations after each has taken over its group's first turns."""
    return trie(prefixes(spliced(turns(conversations))))


#: crc32 of a text of digits, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_transform(range(8 * len({0})), lambda i: CASE WHEN i % 8 = 0 THEN ascii({0}[i // 8 + 1]) ELSE 0 END), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384), 4294967295))::BIGINT"
ORACLE = f"""
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format("(conv_id::VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)),
spliced AS (SELECT h.conv_id, 0 AS seg, o.k, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.base AND o.k <= h.h
         UNION ALL SELECT h.conv_id, 1, o.k, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.k > h.h),
chains AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, sha256(string_agg(sha256(len(role) || ':' || role || text), '') OVER w) AS node
           FROM spliced WINDOW w AS (PARTITION BY conv_id ORDER BY seg, k ROWS UNBOUNDED PRECEDING)
           UNION ALL SELECT conv_id, 0, 0, '' FROM heads),
steps AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM chains),
nodes AS (SELECT node, min(depth) AS depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM steps GROUP BY node),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
own_totals AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.up = n.node),
totals AS (SELECT s.node, sum((n.n_children = 0)::INT)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
           FROM own_totals n JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY s.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM own_totals n JOIN totals t ON t.node = n.node LEFT JOIN nodes p ON p.node = n.up
"""
