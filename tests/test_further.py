"""Parts of the further operators that their queries don't reach."""

import pytest
from pyspark.sql import functions as F

from kilojoin.operators import delta, flow, optimise, segment, signal, solver, sparse_stack, topology
from kilojoin.operators.symbolic import Term
from kilojoin.plans.flow_queries import TRIPOD, TRIPOD_GIVEN


def test_conflicting_givens_are_named():
    rules = [solver.total("c", ["a", "b"]), solver.product("z", "x", "y")]
    assert solver.conflicts(rules, {"a": 1, "b": 2, "c": 3, "x": 2, "y": 3, "z": 6}) == []
    assert sorted(solver.conflicts(rules, {"a": 1, "b": 2, "c": 4, "x": 2, "y": 3, "z": 7})) == [("a", "b", "c"), ("x", "y", "z")]
    (own,) = solver.conflicts(solver.sequence_rules(TRIPOD, [3]), TRIPOD_GIVEN | {"content_1_3": "17"})
    assert "content_1_3" in own


def test_terms_solve_in_both_directions():
    rules = [solver.product("e", "p", "dt"), solver.total("s", ["e", "f"]), solver.equal("t", "s")]
    got = solver.solve_symbolic(rules, {"e": True, "dt": True, "t": "5"})
    assert got["p"] == Term.atom("e") / Term.atom("dt") and got["f"] == Term.number(5) - Term.atom("e")
    assert "x" not in solver.solve_symbolic([solver.product("z", "x", "y")], {"z": True, "y": Term.atom("a") + Term.atom("b")})


def test_shares_that_add_up_to_a_given_one():
    rules = solver.storage_rules([[("a", "s")], [("s", "c")]], "s", one="all")
    got = solver.solve_exact(rules, {"all": 2, "stx_0_1_s": "1/2"})
    assert got["stx_0_exit_s"] == 1 + 1 / 2
    free = solver.cumulated_rules([("a", "b"), ("b", "c")], [], equal_sums=False)
    assert len(free) == len(solver.cumulated_rules([("a", "b"), ("b", "c")], [])) - 1


def test_inconsistent_sections_are_split_off(spark):
    rows = [("r", 0, "x", 1.0, 2.0), ("r", 0, "y", -1.0, 2.0), ("r", 1, "x", 1.0, 0.0), ("r", 1, "y", 0.0, 3.0)]
    cut = spark.createDataFrame(rows, "record_id string, section long, sig_id string, v double, w double")
    edges = spark.createDataFrame([("a", "b", "x", "y")], "n_from string, n_to string, sig_out string, sig_in string")
    good, bad = segment.split_consistent(cut, edges)
    assert {r["section"] for r in good.collect()} == {1} and {r["section"] for r in bad.collect()} == {0}


def test_chop_at_and_between_samples(spark):
    s = signal.from_lists(spark, {"x": [0.0, 2.0, 4.0]}, [0.0, 1.0, 2.0])
    record = s.first()["record_id"]
    cuts = spark.createDataFrame([(record, t) for t in (-1.0, 0.5, 1.0, 9.0)], "record_id string, t double")
    got = sorted((r["piece"], r["t"], r["v"]) for r in segment.chop(s, cuts, interpolate=True).collect())
    assert got == [(1, 0.0, 0.0), (1, 0.5, 1.0), (2, 0.5, 1.0), (2, 1.0, 2.0), (3, 1.0, 2.0), (3, 2.0, 4.0)]


def test_sums_equal_in_every_interval(spark):
    sums = spark.createDataFrame([("r", "n", 0, 1.0, 3.0), ("r", "n", 1, 3.0, 5.0)], "record_id string, node string, idx long, dt double, sum double")
    whole = flow.couple_sums(sums, sums, "integral", ["record_id"])
    assert [r["sum"] for r in whole.collect()] == [8.0]
    assert [r["sum"] for r in flow.couple_sums(sums, whole, "equal", ["record_id"]).collect()] == [8.0, 8.0]
    assert sorted(r["sum"] for r in flow.couple_sums(sums, whole, "spread", ["record_id"]).collect()) == [2.0, 6.0]
    with pytest.raises(ValueError):
        flow.couple_sums(sums, whole, "other")


def test_differences_that_contradict(spark):
    rows = spark.createDataFrame([(1.0, None, 4.0), (None, 3.0, 4.0), (1.0, 3.0, None)], "b double, d double, a double")
    got = rows.select(delta.completed(F.col("b"), F.col("d"), F.col("a")).alias("x")).select("x.*").collect()
    assert {tuple(r) for r in got} == {(1.0, 3.0, 4.0)}
    with pytest.raises(Exception, match="before"):
        rows.select(delta.completed(F.lit(1.0), F.lit(1.0), F.col("a")).alias("x")).collect()


def test_two_nodes_of_one_name(spark):
    nodes, edges = topology.graph(spark, {"a": "Source", "A": "Sink"}, [("a", "A")])
    with pytest.raises(Exception, match="one name"):
        topology.map_nodes(nodes, edges, F.upper)[0].collect()
    assert topology.map_edges(edges, label=lambda a, b: F.concat(a, b)).first()["label"] == "aA"


def test_efficiencies_settle(spark):
    etas = spark.createDataFrame([("a", 0.0), ("b", 8.0)], "k string, eta double")
    got, rounds = optimise.iterate_efficiency(lambda e: e.withColumn("eta", F.col("eta") / 2 + 1), etas, ["k"], most=0.1, rounds=50)
    assert 4 < rounds < 12 and all(abs(r["eta"] - 2) < 0.2 for r in got.collect())
    start = optimise.initial_givens(solver.section_rules([("a", "b")], 0), {"dt_0": 3.0})
    assert start == {"dt_0": 3.0, "eta_0_a_b": 0.5, "x_0_a_b": 0.2, "x_0_b_a": 0.2}


def test_terms_that_round_alike_are_ranked_by_name(spark):
    terms = spark.createDataFrame([(1, ["x2"], -0.25 - 1e-12, 1.0), (1, ["x10"], 0.25, 1.0), (1, ["x3"], 0.5, 1.0)], "k int, changed array<string>, value double, whole double")
    names = lambda **how: [r["changed"] for r in sparse_stack.ranked(terms, ["k"], **how).orderBy("nth").collect()]
    assert names(digits=9) == ["x3", "x10", "x2", None] and names() == ["x3", "x2", "x10", None]


def test_trials_meet_samples_once(spark):
    """A sample is one row with its ways; a trial that is there twice counts once."""
    from kilojoin.plans import mix_queries

    own = spark.createDataFrame([(1, 0, [(0.9, -1.0), (0.7, 0.0), (0.5, 2.0)]), (1, 1, [(0.8, -3.0), (0.8, 1.0)])], "record_id long, idx long, ways array<struct<eta:double,store:double>>")
    trials = spark.createDataFrame([(1, 0.0), (1, 0.0), (1, 1.0), (1, -1.0)], "record_id long, drive double")
    got = {r["drive"]: r["balance"] for r in mix_queries.balances(own)(trials).collect()}
    assert got == {0.0: 0.0, 1.0: 3.0, -1.0: -4.0}


def test_sections_are_dealt_out_by_rows(spark, monkeypatch):
    """Tasks stay small however many rows there are, and the results are the same."""
    from kilojoin.operators import skew

    df = spark.range(600).selectExpr("id div 20 as record_id", "id % 20 as idx", "cast(id % 20 as double) as t", "'p' as sig_id", "cast(id * 7 % 11 - 5 as double) as v")
    want = sorted(map(tuple, segment.add_zero_crossings(df).collect()))
    monkeypatch.setattr(skew, "TASK", 50)
    assert skew.dealt(df, "record_id").rdd.getNumPartitions() == 12
    many = segment.add_zero_crossings(df)
    assert many.rdd.getNumPartitions() == 12 and sorted(map(tuple, many.collect())) == want
