"""States against brute force on random graphs, and graph helpers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kilojoin.operators import topology

RULES = {
    "Crossing": lambda i, o: i == o, "Source": lambda i, o: not i, "AlwaysSource": lambda i, o: o and not i, "Sink": lambda i, o: not o,
    "AlwaysSink": lambda i, o: i and not o, "DeadNode": lambda i, o: not (i or o), "Storage": lambda i, o: True, "NoRestriction": lambda i, o: True,
}


def brute(nodes, edges):
    out = set()
    for dirs in itertools.product((0, 1, 2), repeat=len(edges)):
        ins = {n: any((d == 0 and e[1] == n) or (d == 2 and e[0] == n) for d, e in zip(dirs, edges, strict=True)) for n in nodes}
        outs = {n: any((d == 0 and e[0] == n) or (d == 2 and e[1] == n) for d, e in zip(dirs, edges, strict=True)) for n in nodes}
        if all(RULES[t](ins[n], outs[n]) for n, t in nodes.items()):
            out.add(dirs)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_states_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = "abcde"[: rng.randrange(3, 6)]
    nodes = {n: rng.choice(topology.TYPES) for n in names}
    edges = rng.sample(list(itertools.combinations(names, 2)), min(5, len(names) * (len(names) - 1) // 2))
    got = {tuple(r["dirs"]) for r in topology.admissible_states(spark, nodes, edges).collect()}
    want = {d for d in brute(nodes, edges) if all(any(n in e for e in edges) or True for n in nodes)}
    touched = {n: t for n, t in nodes.items() if any(n in e for e in edges)}
    assert got == brute(touched, edges) and (want <= got)


def test_identify_and_minimal(spark):
    nodes, edges = {"s": "AlwaysSource", "x": "Crossing", "k": "AlwaysSink"}, [("s", "x"), ("x", "k")]
    assert topology.identify_state(spark, nodes, edges, {0: 0}) == [0, 0]
    nodes["m"] = "Storage"
    edges.append(("x", "m"))
    with pytest.raises(ValueError):
        topology.identify_state(spark, nodes, edges, {0: 0})
    states = [tuple(r["dirs"]) for r in topology.admissible_states(spark, nodes, edges).collect()]
    assert topology.minimal_givens(states, states[0]) == [(2,)]


def test_graph_checks_and_paths(spark):
    with pytest.raises(ValueError):
        topology.graph(spark, {"a": "Sink"}, [("a", "a")])
    nodes, edges = topology.graph(spark, {"a": "Source", "b": "Crossing", "c": "Sink", "d": "Sink"}, [("a", "b"), ("b", "c")])
    assert topology.path_exists(edges, "a", "c") and not topology.path_exists(edges, "c", "a")
    assert topology.tree("a", "b", topology.tree("c", "d")) == [("a", "b"), ("a", "c"), ("c", "d")]
    lines = [r["line"] for r in topology.dot(nodes, edges).collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and '  "a" -> "b";' in lines
    flow = edges.withColumn("dir", F.lit(topology.BACKWARD))
    assert {(r["n_from"], r["n_to"]) for r in topology.directed(flow).collect()} == {("b", "a"), ("c", "b")}


def test_reachable_follows_long_chains(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)] + [("n70", "n0"), ("x", "n0")], "n_from string, n_to string").coalesce(1).cache()
    assert {r["node"] for r in topology.reachable(edges, "n0").collect()} == {f"n{i}" for i in range(71)}
