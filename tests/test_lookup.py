"""Interpolation against worked values: hits, insides, steps and what lies beyond."""

import math

import pytest
from pyspark.sql import functions as F

from kilojoin.functions import exprs
from kilojoin.operators import lookup


def at(spark, column):
    v, q = spark.range(1).select(column.alias("g")).first()["g"]
    return v, q


CASES = [
    ([1, 2], [1, 11], 1.0, "linear", "none", (1, "I")),
    ([1, 2], [1, 11], 2.0, "linear", "none", (11, "I")),
    ([1, 2], [1, 11], 1.2, "linear", "none", (3, "I")),
    ([1, 2], [1, 11], 1.5, "linear", "none", (6, "I")),
    ([1, 2], [1, 11], 1.2, "nearest", "none", (1, "I")),
    ([1, 2], [1, 11], 1.5, "nearest", "none", (11, "I")),
    ([1, 2], [1, 11], 0.0, "linear", 99, (99, "E")),
    ([1, 2], [1, 11], 0.0, "linear", "last", (1, "E")),
    ([1, 2], [1, 11], 2.2, "linear", "last", (11, "E")),
    ([1, 2], [1, 11], 0.0, "linear", "linear", (-9, "E")),
    ([1, 2], [1, 11], 2.2, "linear", "linear", (13, "E")),
    ([1, 2], [1, 11], 0.0, "linear", "none", (math.nan, "X")),
    ([1, 1, 2], [1, 2, 3], 1.0, "linear", "none", (1.5, "I")),
    ([1, 1, 2], [1, 2, 3], 0.0, "linear", "linear", (math.nan, "X")),
    ([1, 1, 2], [1, 2, 3], 0.0, "linear", "last", (1, "E")),
    ([1, 1, 2], [1, 2, 3], 1.5, "linear", "none", (2.5, "I")),
    ([1, 2], [1, 11], math.nan, "linear", "last", (math.nan, "X")),
]


@pytest.mark.parametrize("xs, ys, x, method, beyond, want", CASES)
def test_curve(spark, xs, ys, x, method, beyond, want):
    v, q = at(spark, lookup.interp1(xs, ys, F.lit(x), method, beyond))
    assert q == want[1] and (math.isnan(v) if math.isnan(want[0]) else v == pytest.approx(want[0]))


@pytest.mark.parametrize("x, y, want", [(1, 3, 10), (2, 3, 20), (1, 4, 30), (2, 4, 40), (1.5, 3, 15), (1.5, 4, 35), (1, 3.5, 20), (2, 3.5, 30), (1.5, 3.5, 25)])
def test_surface(spark, x, y, want):
    v, q = at(spark, lookup.interp2([1, 2], [[3, 4], [3, 4]], [[10, 30], [20, 40]], F.lit(float(x)), F.lit(float(y))))
    assert (v, q) == (pytest.approx(want), "I")


def test_three_dimensions_equal_a_product(spark):
    axes = [[0.0, 1.0, 3.0], [0.0, 2.0], [1.0, 2.0, 4.0]]
    values = [[[2 * a + 3 * b - c for c in axes[2]] for b in axes[1]] for a in axes[0]]
    v, q = at(spark, lookup.multilinear(axes, values, [F.lit(2.0), F.lit(1.5), F.lit(3.0)]))
    assert (v, q) == (pytest.approx(2 * 2 + 3 * 1.5 - 3), "I")
    n = len(axes[1])
    w, _ = at(spark, lookup.interp3(axes[0], [axes[1]] * 3, [[axes[2]] * n] * 3, values, F.lit(2.0), F.lit(1.5), F.lit(3.0)))
    assert w == pytest.approx(v)


def test_extrapolation_contaminates_and_invalid_absorbs(spark):
    one, far, bad = exprs.val(F.lit(1.0), "I"), exprs.val(F.lit(2.0), "E"), exprs.invalid()
    add = lambda a, b: a + b
    assert at(spark, exprs.combine(one, far, add)) == (3.0, "E")
    assert at(spark, exprs.combine(far, bad, add))[1] == "X"


def test_axes_are_checked():
    for xs in ([1.0], [2.0, 1.0]):
        with pytest.raises(ValueError):
            lookup.check_axis(xs)
    with pytest.raises(ValueError):
        lookup.check_axis([1.0, 1.0], strict=True)


def test_errors_beyond(spark):
    with pytest.raises(Exception, match="extrapolation"):
        at(spark, lookup.interp1([1, 2], [1, 2], F.lit(3.0), beyond="error"))
