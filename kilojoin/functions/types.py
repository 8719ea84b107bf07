"""Roles and physical types of signals, kept as column metadata and checked when a plan is made.

A type is (delta, kind, part): delta A absolute, D, DD or DDD differences; kind e.g. T time, P power, F energy flow,
N efficiency, X divider, Y merger, E storage energy, M mix; part Tt total or Pt partial. "UT" is untyped.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Typ(NamedTuple):
    delta: str = "UT"
    kind: str = "UT"
    part: str = "UT"


UNTYPED = Typ()
KINDS = "UT T P P' F N X Y FI FO E NE M BZ IZ UZ SZ STy ETy".split()
DELTAS = ["A", "D", "DD", "DDD"]
ROLES = ["Scalar", "Signal", "Sample", "FSignal", "FSample", "FDistrib", "FClass", "TestRow"]

# Which kinds may be multiplied. (left delta, left kind, right delta, right kind) -> (delta, kind)
_PRODUCTS = {
    ("A", "P'", "D", "T"): ("D", "P"),
    ("A", "P'", "A", "T"): ("A", "P"),
    ("D", "T", "A", "P"): ("A", "F"),
}
# Kinds whose product keeps the delta, and the parts it asks for and gives.
_SAME = {("F", "N"): "F", ("P", "N"): "P"}
_PARTIAL = {("E", "M"): "E", ("FO", "X"): "F", ("FI", "Y"): "F"}


def product(a: Typ, b: Typ) -> Typ:
    """The type of a * b; TypeError if there is none."""
    for x, y in ((a, b), (b, a)):
        if x == y == UNTYPED:
            return UNTYPED
        if x.part == y.part and (x.delta, x.kind, y.delta, y.kind) in _PRODUCTS:
            return Typ(*_PRODUCTS[x.delta, x.kind, y.delta, y.kind], x.part)
        if x.delta == y.delta and x.part == y.part and (x.kind, y.kind) in _SAME:
            return Typ(x.delta, _SAME[x.kind, y.kind], x.part)
        if x.delta == y.delta and x.part == y.part == "Tt" and (x.kind, y.kind) in _PARTIAL:
            return Typ(x.delta, _PARTIAL[x.kind, y.kind], "Pt")
    raise TypeError(f"no product of {a} and {b}")


def quotient(z: Typ, b: Typ) -> Typ:
    """The type of a in a * b = z."""
    for delta in DELTAS:
        for kind in KINDS:
            for part in ("Tt", "Pt"):
                try:
                    if product(Typ(delta, kind, part), b) == z:
                        return Typ(delta, kind, part)
                except TypeError:
                    continue
    if z == b == UNTYPED:
        return UNTYPED
    raise TypeError(f"no quotient of {z} and {b}")


def total(a: Typ, b: Typ) -> Typ:
    """The type of a + b: a value and its difference."""
    if a == b == UNTYPED:
        return UNTYPED
    if (a.kind, a.part) == (b.kind, b.part) and {a.delta, b.delta} <= set(DELTAS):
        i, j = DELTAS.index(a.delta), DELTAS.index(b.delta)
        if abs(i - j) == 1:
            return a if i < j else b
    raise TypeError(f"no sum of {a} and {b}")


def successor(a: Typ) -> Typ:
    """The type of differences of a."""
    return Typ(DELTAS[DELTAS.index(a.delta) + 1], a.kind, a.part) if a != UNTYPED else UNTYPED


# Roles that may be combined sample by sample, and outer products.
_ARITH = {
    ("Signal", "Signal"): "Signal", ("Sample", "Signal"): "Signal", ("Signal", "Sample"): "Signal", ("Sample", "Sample"): "Sample",
    ("Scalar", "Signal"): "Signal", ("Signal", "Scalar"): "Signal", ("Scalar", "Scalar"): "Scalar", ("FSignal", "FSignal"): "FSignal",
    ("FSample", "FSample"): "FSample", ("Scalar", "FSignal"): "FSignal", ("FSignal", "Scalar"): "FSignal", ("FDistrib", "FDistrib"): "FDistrib",
    ("TestRow", "TestRow"): "TestRow", ("Scalar", "TestRow"): "TestRow", ("TestRow", "Scalar"): "TestRow",
}


def role(a: str, b: str) -> str:
    """The role of a combination; TypeError if these may not be combined."""
    if (a, b) not in _ARITH:
        raise TypeError(f"{a} and {b} can't be combined")
    return _ARITH[a, b]


def tag(column: Column, name: str, typ: Typ = UNTYPED, role_: str = "Signal") -> Column:
    """column named ``name`` with its type and role as metadata."""
    return column.alias(name, metadata={"delta": typ.delta, "kind": typ.kind, "part": typ.part, "role": role_})


def typ_of(df: DataFrame, name: str = "v") -> Typ:
    m = df.schema[name].metadata
    return Typ(m.get("delta", "UT"), m.get("kind", "UT"), m.get("part", "UT"))


def role_of(df: DataFrame, name: str = "v") -> str:
    return df.schema[name].metadata.get("role", "Signal")


def set_type(df: DataFrame, typ: Typ, name: str = "v", role_: str | None = None) -> DataFrame:
    """df with another type of a column; the data stay."""
    return df.select(*[tag(F.col(c), c, typ, role_ or role_of(df, c)) if c == name else F.col(c) for c in df.columns])


def untype(df: DataFrame, name: str = "v") -> DataFrame:
    return set_type(df, UNTYPED, name)


def make_delta(df: DataFrame, name: str = "v") -> DataFrame:
    return set_type(df, successor(typ_of(df, name)), name)


def make_absolute(df: DataFrame, name: str = "v") -> DataFrame:
    t = typ_of(df, name)
    return set_type(df, Typ("A", t.kind, t.part) if t != UNTYPED else t, name)


#: Display units (fixed values): kind -> unit, and what a number is multiplied by.
UNITS = {"T": ("s", 1.0), "P": ("kW", 1e-3), "F": ("kWh", 1 / 3.6e6), "E": ("kWh", 1 / 3.6e6), "N": ("%", 100.0), "X": ("-", 1.0), "M": ("-", 1.0)}


def display(column: Column, kind: str, digits: int = 3) -> Column:
    unit, scale = UNITS.get(kind, ("-", 1.0))
    return F.concat(F.format_number(column * scale, digits), F.lit(f" {unit}"))
