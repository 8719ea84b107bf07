"""Terms over named quantities: sums of products with fractions as coefficients, evaluated exactly or as columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

Product = tuple[tuple[str, int], ...]


class Term:
    """A normal form: {((atom, exponent), ...): coefficient}. Division is by a single product."""

    def __init__(self, parts: Mapping[Product, Fraction] | None = None):
        self.parts = {p: c for p, c in (parts or {}).items() if c}

    @classmethod
    def atom(cls, name: str) -> Term:
        return cls({((name, 1),): Fraction(1)})

    @classmethod
    def number(cls, x: object) -> Term:
        return cls({(): Fraction(x)})

    @staticmethod
    def _of(x: object) -> Term:
        return x if isinstance(x, Term) else Term.number(x)

    def __add__(self, other: object) -> Term:
        out = dict(self.parts)
        for p, c in self._of(other).parts.items():
            out[p] = out.get(p, Fraction(0)) + c
        return Term(out)

    __radd__ = __add__

    def __neg__(self) -> Term:
        return Term({p: -c for p, c in self.parts.items()})

    def __sub__(self, other: object) -> Term:
        return self + -self._of(other)

    def __mul__(self, other: object) -> Term:
        out: dict[Product, Fraction] = {}
        for p, c in self.parts.items():
            for q, d in self._of(other).parts.items():
                powers: dict[str, int] = dict(p)
                for a, n in q:
                    powers[a] = powers.get(a, 0) + n
                key = tuple(sorted((a, n) for a, n in powers.items() if n))
                out[key] = out.get(key, Fraction(0)) + c * d
        return Term(out)

    __rmul__ = __mul__

    def recip(self) -> Term:
        if len(self.parts) != 1:
            raise ZeroDivisionError("only a single product has a reciprocal here")
        ((p, c),) = self.parts.items()
        return Term({tuple((a, -n) for a, n in p): 1 / c})

    def __truediv__(self, other: object) -> Term:
        return self * self._of(other).recip()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Term) and self.parts == other.parts

    def __hash__(self) -> int:
        return hash(frozenset(self.parts.items()))

    def is_zero(self) -> bool:
        return not self.parts

    def atoms(self) -> set[str]:
        return {a for p in self.parts for a, _ in p}

    def evaluate(self, values: Mapping[str, object]) -> Fraction:
        total = Fraction(0)
        for p, c in self.parts.items():
            for a, n in p:
                c *= Fraction(values[a]) ** n
            total += c
        return total

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        """The term as an expression over columns named by its atoms."""
        out = F.lit(0.0)
        for p, c in self.parts.items():
            one = F.lit(float(c))
            for a, n in p:
                for _ in range(abs(n)):
                    one = one * of(a) if n > 0 else F.try_divide(one, of(a))
            out = out + one
        return out

    def delta(self, before: str = "before", after: str = "after") -> Term:
        """The term of after-atoms less that of before-atoms."""
        rename = lambda suffix: Term({tuple((f"{a}.{suffix}", n) for a, n in p): c for p, c in self.parts.items()})
        return rename(after) - rename(before)

    def grouped(self) -> dict[frozenset[str], Term]:
        """Parts by the set of atoms in them."""
        out: dict[frozenset[str], dict] = {}
        for p, c in self.parts.items():
            out.setdefault(frozenset(a for a, _ in p), {})[p] = c
        return {k: Term(v) for k, v in out.items()}

    def __repr__(self) -> str:
        def one(p: Product, c: Fraction) -> str:
            return "*".join([*([str(c)] if c != 1 or not p else []), *(a if n == 1 else f"{a}^{n}" for a, n in p)])

        return " + ".join(one(p, c) for p, c in sorted(self.parts.items())) or "0"
