"""Before/after attribution: stacks of differences over several changed parameters.

A multi-value of n indices holds 2^n values in an array: bit i of the place says whether index i is after its change. A stack
holds the same as before-value and differences, so its corners add up to the last value. Sums and products of values
with different indices align these first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilojoin.functions import exprs


def record(before: Column, after: Column) -> Column:
    """struct<before, delta, after>."""
    return F.struct(before.alias("before"), (after - before).alias("delta"), after.alias("after"))


def record_from_delta(before: Column, delta: Column) -> Column:
    return F.struct(before.alias("before"), delta.alias("delta"), (before + delta).alias("after"))


def _along(values: Column, n: int, f: Callable[[Column, Column], Column]) -> Column:
    """For each index, f(after, before) in place of each value after its change."""

    def one(i: int) -> Callable[[Column], Column]:
        return lambda v: F.array(*[f(F.get(v, k), F.get(v, k ^ 1 << i)) if k >> i & 1 else F.get(v, k) for k in range(1 << n)])

    for i in range(n):
        values = exprs.let(values, one(i))
    return values


def multi_to_stack(values: Column, n: int) -> Column:
    """Differences of a multi-value: for each index the values after less those before."""
    return _along(values, n, lambda after, before: after - before)


def stack_to_multi(values: Column, n: int) -> Column:
    return _along(values, n, lambda delta, before: delta + before)


def align(values: Column, own: Sequence[str], all_: Sequence[str], stack: bool) -> Column:
    """A value of fewer indices over more: a multi-value repeats, a stack has no difference along the new ones."""
    if list(own) == list(all_):
        return values
    at = {name: i for i, name in enumerate(all_)}

    def spread(v: Column) -> Column:
        out = []
        for k in range(1 << len(all_)):
            place = sum(1 << j for j, name in enumerate(own) if k >> at[name] & 1)
            new = any(k >> at[name] & 1 for name in all_ if name not in own)
            out.append(F.lit(0.0) if stack and new else F.get(v, place))
        return F.array(*out)

    return exprs.let(values, spread)


class Stack:
    """A stack column with the names of its indices."""

    def __init__(self, values: Column, indices: Sequence[str]):
        self.values, self.indices = values, list(indices)

    @classmethod
    def pair(cls, index: str, before: Column, delta: Column) -> Stack:
        return cls(F.array(before.cast("double"), delta.cast("double")), [index])

    @classmethod
    def single(cls, value: Column) -> Stack:
        return cls(F.array(value.cast("double")), [])

    def _both(self, other: Stack) -> tuple[Column, Column, list[str]]:
        names = sorted({*self.indices, *other.indices})
        return align(self.values, self.indices, names, True), align(other.values, other.indices, names, True), names

    def __add__(self, other: Stack) -> Stack:
        a, b, names = self._both(other)
        return Stack(F.zip_with(a, b, lambda x, y: x + y), names)

    def __sub__(self, other: Stack) -> Stack:
        a, b, names = self._both(other)
        return Stack(F.zip_with(a, b, lambda x, y: x - y), names)

    def _by_corner(self, other: Stack, f) -> Stack:
        a, b, names = self._both(other)
        n = len(names)
        return Stack(multi_to_stack(F.zip_with(stack_to_multi(a, n), stack_to_multi(b, n), f), n), names)

    def __mul__(self, other: Stack) -> Stack:
        """Terms of stacks without a common index are single products, exact to the last rounding; corners would cancel."""
        if {*self.indices} & {*other.indices}:
            return self._by_corner(other, lambda x, y: x * y)
        names = sorted([*self.indices, *other.indices])

        def place(k: int, own: list[str]) -> int:
            return sum(1 << j for j, name in enumerate(own) if k >> names.index(name) & 1)

        def terms(a: Column, b: Column) -> Column:
            return F.array(*[F.get(a, place(k, self.indices)) * F.get(b, place(k, other.indices)) for k in range(1 << len(names))])

        return Stack(exprs.let(self.values, lambda a: exprs.let(other.values, lambda b: terms(a, b))), names)

    def __truediv__(self, other: Stack) -> Stack:
        return self._by_corner(other, lambda x, y: x / y)

    def evaluate(self) -> Column:
        """The value after all changes."""
        return F.aggregate(self.values, F.lit(0.0), lambda a, x: a + x)

    def filtered(self, before: Sequence[str] = (), delta: Sequence[str] = ()) -> Column:
        """The sum of the terms in which these indices are before, those delta."""
        at = {name: i for i, name in enumerate(self.indices)}
        keep = [k for k in range(1 << len(self.indices)) if not any(k >> at[i] & 1 for i in before) and all(k >> at[i] & 1 for i in delta)]
        return exprs.let(self.values, lambda v: sum((F.get(v, k) for k in keep[1:]), F.get(v, keep[0])))

    def terms(self) -> Column:
        """map of the changed indices of each term (joined by ,) to its value."""
        keys = [",".join(name for i, name in enumerate(self.indices) if k >> i & 1) or "before" for k in range(1 << len(self.indices))]
        return exprs.let(self.values, lambda v: F.create_map(*[x for k, key in enumerate(keys) for x in (F.lit(key), F.get(v, k))]))


def mix_total(mix: Column) -> Column:
    """struct<total, mix>: a value and its parts by origin."""
    return F.struct(F.aggregate(mix, F.lit(0.0), lambda a, x: a + x).alias("total"), mix.alias("mix"))


def threshold(terms: Column, least: float) -> Column:
    """Terms of a map at least so far from zero."""
    return F.map_filter(terms, lambda _, v: F.abs(v) >= least)


def completed(before: Column, delta: Column, after: Column) -> Column:
    """struct<before, delta, after> from any two of them; a third that contradicts them is an error."""
    b, d, a = F.coalesce(before, after - delta), F.coalesce(delta, after - before), F.coalesce(after, before + delta)
    wrong = F.abs(before + delta - after) > 1e-9 * (F.abs(before) + F.abs(delta) + F.abs(after))
    return F.when(wrong, F.raise_error(F.lit("before + delta is not after"))).otherwise(F.struct(b.alias("before"), d.alias("delta"), a.alias("after")))


def nested(index: str, *levels: tuple[str, Column, Column]) -> Stack:
    """A quantity that several parameters change one after the other: levels (kind, x, y) with kind before_delta, before_after or after_delta.

    The first level's before is the quantity; each further level states how its parameter scales it: the stack of the product of all levels.
    """
    out: Stack | None = None
    for i, (kind, x, y) in enumerate(levels):
        before, change = {"before_delta": (x, y), "before_after": (x, y - x), "after_delta": (x - y, y)}[kind]
        own = Stack.pair(f"{index}{i}", before, change)
        out = own if out is None else out * own
    if out is None:
        raise ValueError("no level is given")
    return out
