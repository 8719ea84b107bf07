"""Topologies: nodes (node, type) and edges (n_from, n_to), small graphs that describe a system.

The admissible orientations of a graph's edges (0 forward, 1 inactive, 2 backward) are rows of a DataFrame that grows
edge by edge; rows that break a node's rule go as soon as all edges of that node are oriented.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilojoin.operators.record import checked, stacked

FORWARD, INACTIVE, BACKWARD = 0, 1, 2
# Node types.
TYPES = ["Storage", "Sink", "AlwaysSink", "Source", "AlwaysSource", "Crossing", "DeadNode", "NoRestriction"]
SINKS, SOURCES = ["Sink", "AlwaysSink"], ["Source", "AlwaysSource"]


def graph(spark: SparkSession, nodes: dict[str, str], edges: Iterable[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables; a repeated edge, a loop or an edge to an unknown node is an error."""
    edges = list(edges)
    if len({frozenset(e) for e in edges}) < len(edges) or any(a == b or a not in nodes or b not in nodes for a, b in edges):
        raise ValueError("edges must be between different known nodes, once each")
    return spark.createDataFrame(sorted(nodes.items()), "node string, type string"), spark.createDataFrame(edges, "n_from string, n_to string")


def neighbours(edges: DataFrame) -> DataFrame:
    """node, ins, outs: how many edges come in and go out."""
    ends = F.array(F.struct(F.col("n_to").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("n_from").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return edges.select(F.explode(ends).alias("x")).groupBy(F.col("x.node").alias("node")).agg(F.sum("x.i").alias("ins"), F.sum("x.o").alias("outs"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of two graphs; a repeated edge is an error."""
    both = stacked(a, b, "n_from", "n_to")
    ok = checked(both.groupBy("n_from", "n_to").agg(F.count(F.lit(1)).alias("n")), F.col("n") > 1, "an edge is there twice")
    return both.join(ok.select("n_from", "n_to"), ["n_from", "n_to"], "left_semi")


def delete_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    gone = nodes.select("node")
    return edges.join(gone, edges["n_from"] == gone["node"], "left_anti").join(gone, edges["n_to"] == gone["node"], "left_anti")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"n_from": F.col("n_to"), "n_to": F.col("n_from")})


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """node: what can be reached along the edges from a node (itself included); rounds of joins until nothing is new."""
    from kilojoin.plans.storage import cut

    spark = edges.sparkSession
    found = spark.createDataFrame([(start,)], "node string")
    front = found
    for i in itertools.count(1):
        front = edges.join(front, edges["n_from"] == front["node"], "left_semi").select(F.col("n_to").alias("node")).distinct().join(found, "node", "left_anti")
        front = cut(front)
        if front.isEmpty():
            break
        found = found.union(front)
        if i % 8 == 0:  # keeps the plan short
            found = cut(found)
    return found


def path_exists(edges: DataFrame, a: str, b: str) -> bool:
    return not reachable(edges, a).where(F.col("node") == b).isEmpty()


def flow_from_plain(edges: DataFrame, direction: int = FORWARD) -> DataFrame:
    return edges.withColumn("dir", F.lit(direction))


def directed(flow: DataFrame) -> DataFrame:
    """Active edges in the direction of their flow."""
    ahead = F.col("dir") == FORWARD
    return flow.where(F.col("dir") != INACTIVE).withColumns({"n_from": F.when(ahead, F.col("n_from")).otherwise(F.col("n_to")), "n_to": F.when(ahead, F.col("n_to")).otherwise(F.col("n_from"))}).drop("dir")


def node_rule(type_: str, has_in: Column, has_out: Column) -> Column:
    """Whether a node of a type may have these edges."""
    rules = {
        "Crossing": has_in == has_out,
        "Source": ~has_in,
        "AlwaysSource": has_out & ~has_in,
        "Sink": ~has_out,
        "AlwaysSink": has_in & ~has_out,
        "DeadNode": ~has_in & ~has_out,
    }
    return rules.get(type_, F.lit(True))


def _rule_of(node: str, type_: str, edges: Sequence[tuple[str, str]]) -> Column:
    ins, outs = F.lit(False), F.lit(False)
    for i, (a, b) in enumerate(edges):
        d = F.get("dirs", F.lit(i))
        if a == node:
            ins, outs = ins | (d == BACKWARD), outs | (d == FORWARD)
        elif b == node:
            ins, outs = ins | (d == FORWARD), outs | (d == BACKWARD)
    return node_rule(type_, ins, outs)


def admissible_states(spark: SparkSession, nodes: dict[str, str], edges: Sequence[tuple[str, str]], given: dict[int, int] | None = None) -> DataFrame:
    """dirs (array<int>, one for each edge in order): every orientation that obeys all nodes' rules.

    given: orientations of some edges (by place). Edges are taken in an order that completes nodes early.
    """
    todo, order, seen = set(range(len(edges))), [], set()
    while todo:
        missing = {n: [i for i in todo if n in edges[i]] for n in nodes if any(n in edges[i] for i in todo)}
        node = min(missing, key=lambda n: (len(missing[n]), n not in seen, n))
        order += missing[node]
        seen.update(x for i in missing[node] for x in edges[i])
        todo -= set(missing[node])
    rows = spark.range(1).select(F.array(*[F.lit(INACTIVE)] * len(edges)).alias("dirs"))
    done: set[int] = set()
    for i in order:
        choice = [given[i]] if given and i in given else [FORWARD, INACTIVE, BACKWARD]
        rows = rows.select("dirs", F.explode(F.array(*map(F.lit, choice))).alias("_d"))
        rows = rows.select(_put(i).alias("dirs"))
        done.add(i)
        for node in edges[i]:
            if all(j in done for j, e in enumerate(edges) if node in e):
                rows = rows.where(_rule_of(node, nodes[node], edges))
    return rows


def _put(i: int) -> Column:
    return F.transform("dirs", lambda x, k: F.when(k == i, F.col("_d")).otherwise(x))


def state_index(dirs: Column) -> Column:
    """The number of an orientation: sum of dir * 3^place."""
    return F.aggregate(F.reverse(dirs), F.lit(0).cast("long"), lambda acc, d: acc * 3 + d)


def state_from_index(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.pmod(F.floor(index / F.pow(F.lit(3.0), k)), F.lit(3)).cast("int"))


def identify_state(spark: SparkSession, nodes: dict[str, str], edges: Sequence[tuple[str, str]], given: dict[int, int]) -> list[int]:
    """The only orientation with these given edges; an error if there is none or another."""
    found = admissible_states(spark, nodes, edges, given).limit(2).collect()
    if len(found) != 1:
        raise ValueError("the given edges don't identify one state")
    return list(found[0]["dirs"])


def minimal_givens(states: Sequence[Sequence[int]], target: Sequence[int]) -> list[tuple[int, ...]]:
    """The smallest sets of edges whose orientations tell target from all other states (on the driver: a few states)."""
    from itertools import combinations

    differ = [{i for i, (a, b) in enumerate(zip(s, target, strict=True)) if a != b} for s in map(list, states) if list(s) != list(target)]
    for size in range(len(target) + 1):
        if own := [c for c in combinations(range(len(target)), size) if all(d & set(c) for d in differ)]:
            return own
    return []


def tree(root: str, *children: object) -> list[tuple[str, str]]:
    """Edges of a tree: tree("a", "b", tree("c", "d")) has a-b, a-c and c-d."""
    out: list[tuple[str, str]] = []
    for c in children:
        if isinstance(c, list):
            out += [(root, c[0][0]), *c]
        else:
            out.append((root, c))
    return out


def dot(nodes: DataFrame, edges: DataFrame, label: Callable[[Column], Column] | None = None) -> DataFrame:
    """line: GraphViz text of a small graph, in order."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    body = nodes.select(F.concat(F.lit("  "), q(F.col("node")), F.lit(' [label="'), F.col("node"), F.lit("\\n"), F.col("type"), F.lit('"];')).alias("line"), F.lit(1).alias("_o"))
    arrows = edges.select(F.concat(F.lit("  "), q(F.col("n_from")), F.lit(" -> "), q(F.col("n_to")), F.lit(";")).alias("line"), F.lit(2).alias("_o"))
    spark = nodes.sparkSession
    frame = spark.createDataFrame([("digraph {", 0), ("}", 3)], "line string, _o int")
    return frame.unionByName(body).unionByName(arrows).orderBy("_o", "line").select("line")


def storages(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'Storage'").select("node")


def first_come_numbers(keys: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """by, key, number: keys numbered in the order of their first appearance."""
    first = keys.groupBy(*by, key).agg(F.min(order).alias("_first"))
    return first.withColumn("number", (F.row_number().over(Window.partitionBy(*by).orderBy("_first", key)) - 1).cast("long")).drop("_first")


def map_nodes(nodes: DataFrame, edges: DataFrame, name: Callable[[Column], Column], type_: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with renamed nodes and, by type_(name, type), new types; two nodes of one new name are an error."""
    new = nodes.select(name(F.col("node")).alias("node"), (type_(F.col("node"), F.col("type")) if type_ else F.col("type")).alias("type"))
    twice = checked(new.groupBy("node").agg(F.count(F.lit(1)).alias("n")), F.col("n") > 1, "two nodes get one name")
    return new.join(twice.select("node"), "node", "left_semi"), edges.withColumns({"n_from": name(F.col("n_from")), "n_to": name(F.col("n_to"))})


def map_edges(edges: DataFrame, **labels: Callable[..., Column]) -> DataFrame:
    """Edges with labels worked out from both ends: each function takes (n_from, n_to)."""
    return edges.withColumns({k: f(F.col("n_from"), F.col("n_to")) for k, f in labels.items()})


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with ins and outs, zero where no edge ends."""
    own = nodes.join(neighbours(edges), "node", "left")
    return own.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ins", "outs")})
