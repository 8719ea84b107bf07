"""Equation systems: a worked sequence with a storage in exact fractions, and the same as columns."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kilojoin.operators import solver
from kilojoin.plans.flow_queries import TRIPOD, TRIPOD_GIVEN

RULES = solver.sequence_rules(TRIPOD, [3])
#: Worked results in fractions (fixed values).
WANT = {
    "content_init_3": "22", "content_0_3": "6", "content_1_3": "16", "content_2_3": "10", "ste_init_0_3": "16", "ste_init_2_3": "9/4", "ste_init_exit_3": "15/4",
    "ste_1_2_3": "15/4", "ste_1_exit_3": "25/4", "stx_init_0_3": "8/11", "stx_init_2_3": "9/88", "stx_2_1_3": "5/8", "maxe_init_0_3": "22", "maxe_init_2_3": "6", "maxe_1_exit_3": "25/4",
    "p_0_0_2": "34/3", "p_1_0_2": "625/12", "p_2_0_2": "162/49", "e_1_0_2": "625/6", "e_1_2_0": "125/3", "e_2_2_3": "27/5", "eta_1_2_1": "4/5", "x_0_2_0": "17/25", "x_2_2_3": "7/10",
    "insum_1_2": "125/3", "outsum_2_0": "162/49", "stinsum_exit_3": "10", "stoutsum_init_3": "22",
}


def test_worked_sequence_is_determined_exactly():
    got = solver.solve_exact(RULES, TRIPOD_GIVEN, tracked=True)
    assert {k: got[k] for k in WANT} == {k: Fraction(v) for k, v in WANT.items()}
    assert set(got) >= set(solver.variables(RULES)) - {v for v in solver.variables(RULES) if v not in got} and len(got) == 116


def test_every_given_is_needed():
    all_ = len(solver.solve_exact(RULES, TRIPOD_GIVEN))
    for name in TRIPOD_GIVEN:
        rest = {k: v for k, v in TRIPOD_GIVEN.items() if k != name}
        assert len(solver.solve_exact(RULES, rest)) < all_


def test_contradictions_are_found():
    with pytest.raises(ValueError):
        solver.solve_exact(RULES, TRIPOD_GIVEN | {"content_1_3": "17"}, tracked=True)


def test_columns_give_the_same(spark):
    row = spark.range(1).select(*[F.lit(float(Fraction(v))).alias(k) for k, v in TRIPOD_GIVEN.items()])
    out = solver.solve(row, RULES)
    got = out.select(*WANT, solver.residual(RULES).alias("residual")).first().asDict()
    assert got.pop("residual") < 1e-9
    assert got == {k: pytest.approx(float(Fraction(v))) for k, v in WANT.items()}


def test_zero_factor_and_zero_over_zero(spark):
    rules = [solver.product("z", "x", "y")]
    assert solver.solve_exact(rules, {"x": 0}) == {"x": 0, "z": 0}
    assert solver.solve_exact(rules, {"z": 0, "x": 0}) == {"x": 0, "z": 0}
    assert solver.solve_exact(rules, {"z": 6, "x": 3})["y"] == 2
    rows = spark.createDataFrame([(0.0, None), (None, 4.0), (2.0, 5.0)], "x double, y double")
    assert [r["z"] for r in solver.solve(rows, rules).collect()] == [0.0, None, 10.0]


def test_cumulated_and_states():
    edges = [("a", "b"), ("b", "c")]
    got = solver.solve_exact(solver.cumulated_rules(edges, []), {"dt_c": 4, "e_c_a_b": 8, "eta_c_a_b": "1/2", "eta_c_b_c": "1/4"}, tracked=True)
    assert (got["e_c_c_b"], got["p_c_a_b"]) == (1, 2)
    states = [[("a", "s")], [("s", "c")]]
    got = solver.solve_exact(solver.state_rules(states, ["s"]), {"dt_0": 1, "dt_1": 1, "p_0_a_s": 4, "eta_0_a_s": 1, "p_1_s_c": 3, "stx_0_1_s": "1/2", "stoutsum_init_s": 1, "stx_init_1_s": 1}, tracked=True)
    assert got["ste_0_1_s"] == 2 and got["stinsum_exit_s"] == 2


def test_curve_as_rule(spark):
    rules = solver.section_rules([("a", "b")], 0, etas={("a", "b"): lambda p: p / 10})
    out = solver.solve(spark.createDataFrame([(4.0, 2.0)], "p_0_a_b double, dt_0 double"), rules).first()
    assert (out["eta_0_a_b"], out["p_0_b_a"], out["e_0_b_a"]) == (pytest.approx(0.4), pytest.approx(1.6), pytest.approx(3.2))
