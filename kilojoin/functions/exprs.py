"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row; a plan with nested expressions stays linear in their depth."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nan() -> Column:
    return F.lit(float("nan"))


def safe_div(a: Column, b: Column) -> Column:
    """a / b as IEEE doubles do it: x/0 is infinite, 0/0 is NaN; null if a side is null."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), nan()).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def sign(v: Column) -> Column:
    """1, 0 or -1 by exact comparison; NaN is 0."""
    return F.when(F.isnan(v), 0).when(v > 0, 1).when(v < 0, -1).otherwise(0)


def sign_approx(v: Column, eps: float) -> Column:
    return F.when(F.abs(v) <= eps, 0).when(v > 0, 1).otherwise(-1)


def hard_shrinkage(v: Column, threshold: float) -> Column:
    """Values nearer to zero than the threshold are zero."""
    return F.when(F.abs(v) < threshold, F.lit(0.0)).otherwise(v)


def classify_even(x: Column, interval: float, offset: float) -> Column:
    """The middle of the class of x; borders go to the even class."""
    return F.rint((x + offset) / interval) * interval - offset


def eta_with_sign(trigger: Column, p1: Column, p2: Column) -> Column:
    """p2/p1 where the trigger is not negative, p1/p2 elsewhere."""
    return F.when(trigger >= 0, safe_div(p2, p1)).otherwise(safe_div(p1, p2))


def power(v: Column, n: int) -> Column:
    """v to a whole power by squaring; n is 1 at least."""
    if n < 1:
        raise ValueError("the exponent must be positive")
    half = None
    out = None
    while n:
        half = v if half is None else half * half
        if n & 1:
            out = half if out is None else out * half
        n >>= 1
    return out


def mul(x: Column, y: Column) -> Column:
    """Product of unknowns: zero times an unknown (null) is zero."""
    return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(x * y)


def div(z: Column, y: Column) -> Column:
    """The other factor of a product: unknown for 0/0 and x/0; zero for 0/unknown is not concluded."""
    return F.when(y != 0, F.try_divide(z, y))


# interpolation --------------------------------------------------------------------------------------


def linear(x0: Column, x1: Column, y0: Column, y1: Column, x: Column) -> Column:
    return (y0 * (x1 - x) + y1 * (x - x0)) / F.when(x1 != x0, x1 - x0)


def nearest(x0: Column, x1: Column, y0: Column, y1: Column, x: Column) -> Column:
    """The value of the nearer end; the right one in the middle."""
    return F.when(F.abs(x0 - x) < F.abs(x1 - x), y0).otherwise(y1)


VAL = "struct<v:double,q:string>"


def val(v: Column, q: str) -> Column:
    """An interpolated value: I inside, E extrapolated, X invalid (its value is NaN)."""
    return F.struct(v.cast("double").alias("v"), F.lit(q).alias("q"))


def invalid() -> Column:
    return val(nan(), "X")


def interpolate(x0: Column, x1: Column, y0: Column, y1: Column, x: Column, method: str = "linear", beyond: str | float = "none") -> Column:
    """struct<v, q> at x between two points. method: linear, nearest; beyond: linear, none, last, error or a number.

    A step (x0 = x1 = x) gives the mean of both values.
    """
    inside = linear(x0, x1, y0, y1, x) if method == "linear" else nearest(x0, x1, y0, y1, x)
    step = x0 == x1
    out = {
        "linear": F.when(step, invalid()).otherwise(val(linear(x0, x1, y0, y1, x), "E")),
        "last": val(F.when(step, F.when(x < x0, y0).otherwise(y1)).otherwise(nearest(x0, x1, y0, y1, x)), "E"),
        "none": invalid(),
        "error": val(F.raise_error(F.lit("extrapolation is not allowed")), "X"),
    }
    outside = val(F.lit(float(beyond)), "E") if isinstance(beyond, (int, float)) else out[beyond]
    return (
        F.when(x.isNull() | F.isnan(x) | F.isnan(x0) | F.isnan(x1), invalid())
        .when(x0 > x1, val(F.raise_error(F.lit("the axis falls")), "X"))
        .when(step & (x == x0), val((y0 + y1) / 2, "I"))
        .when(~step & (x == x0), val(y0, "I"))
        .when(~step & (x == x1), val(y1, "I"))
        .when((x > x0) & (x < x1), val(inside, "I"))
        .otherwise(outside)
    )


def combine(a: Column, b: Column, f) -> Column:
    """f of two values: invalid if one is, extrapolated if one is."""
    q = F.when((a["q"] == "X") | (b["q"] == "X"), "X").when((a["q"] == "E") | (b["q"] == "E"), "E").otherwise("I")
    return F.struct(F.when(q == "X", nan()).otherwise(f(a["v"], b["v"])).alias("v"), q.alias("q"))
