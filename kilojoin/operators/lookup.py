"""Lookup tables of one, two and three dimensions.

A table is small (an axis and its values), so it is a literal array in the plan: bracketing is an array
expression on each row and nothing is joined or shuffled. Tables that grow with the data go through
record.resample, which merges them with the asked points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilojoin.functions import exprs

#: Points of a literal axis at most.
AXIS = 4096


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def check_axis(xs: Sequence[float], strict: bool = False) -> None:
    """An axis has two points at least (at most AXIS) and rises."""
    if not 2 <= len(xs) <= AXIS:
        raise ValueError("an axis needs between 2 and %d points" % AXIS)
    if any(b < a or (strict and b == a) for a, b in zip(xs, xs[1:], strict=False)):
        raise ValueError("an axis must rise")


def bracket(xs: Column, n: int, x: Column) -> Column:
    """The right end (from 1 on, counted from 0) of the interval that x falls into; the outer intervals stand for what lies beyond."""

    def place(upto: Column) -> Column:
        step = (upto >= 2) & (F.get(xs, upto - 2) == F.get(xs, upto - 1)) & (F.get(xs, upto - 1) == x)
        return F.when(upto == 0, 1).when(upto == n, n - 1).when(step, upto - 1).otherwise(upto)

    return exprs.let(F.size(F.filter(xs, lambda a: a <= x)), place)


def _on_axis(xs: Sequence[float], x: Column, values: Column, join) -> Column:
    """join(x0, x1, a, b, x) at the interval of x; each part is worked out once a row, however deep lookups are nested."""
    check_axis(xs)
    ax = _array(xs)

    def ends(i: Column) -> Column:
        return F.struct(F.get(ax, i - 1).alias("x0"), F.get(ax, i).alias("x1"), F.get(values, i - 1).alias("a"), F.get(values, i).alias("b"))

    return exprs.let(x.cast("double"), lambda at: exprs.let(exprs.let(bracket(ax, len(xs), at), ends), lambda p: join(p["x0"], p["x1"], p["a"], p["b"], at)))


def interp1(xs: Sequence[float], ys: Sequence[float], x: Column, method: str = "linear", beyond: str | float = "none") -> Column:
    """struct<v, q> of a curve at x."""
    if len(xs) != len(ys):
        raise ValueError("axis and values differ in length")
    return _on_axis(xs, x, _array(ys), lambda x0, x1, a, b, at: exprs.interpolate(x0, x1, a, b, at, method, beyond))


def _between(xs: Sequence[float], x: Column, values: list[Column], method: str, beyond: str | float) -> Column:
    """Interpolates along xs between values (struct<v, q>) that are there already."""
    first = lambda p, q: p

    def join(x0: Column, x1: Column, a: Column, b: Column, at: Column) -> Column:
        own = exprs.interpolate(x0, x1, a["v"], b["v"], at, method, beyond)
        return exprs.let(F.struct(own.alias("own"), exprs.combine(a, b, first).alias("ends")), lambda s: exprs.combine(s["own"], s["ends"], first))

    return exprs.let(F.array(*values), lambda all_: _on_axis(xs, x, all_, join))


def interp2(xs: Sequence[float], ys: Sequence[Sequence[float]], zs: Sequence[Sequence[float]], x: Column, y: Column, method: str = "linear", beyond: str | float = "none") -> Column:
    """struct<v, q> of a surface at (x, y): a curve over y at each x."""
    return _between(xs, x, [interp1(a, b, y, method, beyond) for a, b in zip(ys, zs, strict=True)], method, beyond)


def interp3(xs, ys, zs, ws, x: Column, y: Column, z: Column, method: str = "linear", beyond: str | float = "none") -> Column:
    """struct<v, q> of a table of surfaces: at each x a surface over (y, z)."""
    return _between(xs, x, [interp2(a, b, c, y, z, method, beyond) for a, b, c in zip(ys, zs, ws, strict=True)], method, beyond)


def multilinear(axes: Sequence[Sequence[float]], values, at: Sequence[Column], method: str = "linear", beyond: str | float = "none") -> Column:
    """struct<v, q> of a grid of any dimension; values are nested in the order of the axes."""
    if len(axes) == 1:
        return interp1(axes[0], values, at[0], method, beyond)
    return _between(axes[0], at[0], [multilinear(axes[1:], v, at[1:], method, beyond) for v in values], method, beyond)


def eta_function(xs: Sequence[float], ys: Sequence[float], x_scale: float = 1.0, y_scale: float = 1.0):
    """An efficiency curve over power with scaled axes: a function of columns; last values beyond the ends."""
    sx, sy = [a * x_scale for a in xs], [a * y_scale for a in ys]
    return lambda p: interp1(sx, sy, p, beyond="last")["v"]


def abs_eta_function(forward, backward):
    """forward(x) for x >= 0, 1 / backward(-x) for x < 0."""
    return lambda x: F.when(x >= 0, forward(x)).otherwise(exprs.safe_div(F.lit(1.0), backward(-x)))
