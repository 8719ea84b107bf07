"""Quotients of polynomials over named quantities, in lowest terms, so that efficiencies and shares of sums have terms.

A few small terms on the driver; they are evaluated over tables as column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilojoin.operators.solver import Rule
from kilojoin.operators.symbolic import Product, Term

ZERO, ONE = Term.number(0), Term.number(1)


def _leading(p: Term, order: list[str]) -> Product:
    return max(p.parts, key=lambda m: [dict(m).get(a, 0) for a in order])


def divided(p: Term, q: Term) -> Term | None:
    """p / q if q divides p, else none; by leading products in alphabetical order."""
    order = sorted(p.atoms() | q.atoms())
    at, out, rest = _leading(q, order), ZERO, p
    while not rest.is_zero():
        top = _leading(rest, order)
        part = Term({top: rest.parts[top]}) / Term({at: q.parts[at]})
        if any(n < 0 for m in part.parts for _, n in m):
            return None
        out, rest = out + part, rest - part * q
    return out


def _by_power(p: Term, x: str) -> dict[int, Term]:
    """Coefficients of the powers of x."""
    out: dict[int, dict[Product, Fraction]] = {}
    for m, c in p.parts.items():
        n = dict(m).get(x, 0)
        out.setdefault(n, {})[tuple((a, k) for a, k in m if a != x)] = c
    return {n: Term(parts) for n, parts in out.items()}


def _content(p: Term, x: str) -> Term:
    out = ZERO
    for c in _by_power(p, x).values():
        out = gcd(out, c)
    return out


def _pseudo_rest(p: Term, q: Term, x: str) -> Term:
    """What is left of a multiple of p after division by q, as polynomials in x."""
    by, own = _by_power(q, x), Term.atom(x)
    n = max(by)
    while not p.is_zero() and (m := max(of := _by_power(p, x))) >= n:
        shift = ONE
        for _ in range(m - n):
            shift = shift * own
        p = p * by[n] - q * of[m] * shift
    return p


def _may_share(p: Term, q: Term, x: str) -> bool:
    """Whether a common divisor may hold x: not if p and q with numbers for all other quantities have none, as long as their highest powers of x remain."""
    at = {a: Fraction(k * k + 7, 3 * k + 2) for k, a in enumerate(sorted((p.atoms() | q.atoms()) - {x}), 2)}
    a, b = ({n: v for n, c in _by_power(t, x).items() if (v := c.evaluate(at))} for t in (p, q))
    if not a or not b or max(a) < max(_by_power(p, x)) or max(b) < max(_by_power(q, x)):
        return True
    while b:  # Euclid's algorithm with numbers as coefficients
        while a and max(a) >= max(b):
            n, m = max(a), max(b)
            f = a[n] / b[m]
            for k, v in b.items():
                a[k + n - m] = a.get(k + n - m, Fraction(0)) - f * v
            a = {k: v for k, v in a.items() if v}
        a, b = b, a
    return max(a) > 0


def gcd(p: Term, q: Term) -> Term:
    """A greatest common divisor of two polynomials, by Euclid's algorithm in one quantity after the other; leading coefficient 1."""
    if p.is_zero() or q.is_zero():
        p = q if p.is_zero() else p
        return p if p.is_zero() else p / p.parts[_leading(p, sorted(p.atoms()))]
    for a, b in ((p, q), (q, p)):
        if divided(a, b) is not None:
            return b / b.parts[_leading(b, sorted(b.atoms()))]
    shared = [n for n in sorted(p.atoms() & q.atoms()) if _may_share(p, q, n)]
    if not shared:
        return ONE
    for n in sorted((p.atoms() | q.atoms()) - set(shared)):  # a common divisor without n divides all coefficients of n's powers
        if n in p.atoms():
            return gcd(_content(p, n), q)
        return gcd(p, _content(q, n))
    x = shared[0]
    a, b = _content(p, x), _content(q, x)
    common = gcd(a, b)
    p, q = divided(p, a), divided(q, b)
    while not q.is_zero():
        rest = _pseudo_rest(p, q, x) if max(_by_power(p, x)) >= max(_by_power(q, x)) else p
        p, q = q, rest if rest.is_zero() else divided(rest, _content(rest, x))
    if max(_by_power(p, x)) == 0:
        p = ONE
    out = common * p
    return out / out.parts[_leading(out, sorted(out.atoms()))]


class Ratio:
    """over / under without common divisors; the leading coefficient of under is 1."""

    def __init__(self, over: Term, under: Term = ONE):
        if under.is_zero():
            raise ZeroDivisionError("a quotient by a term that is zero")
        low: dict[str, int] = {}
        for m in (*over.parts, *under.parts):
            for a, n in m:
                low[a] = min(low.get(a, 0), n)
        lift = Term({tuple(sorted((a, -n) for a, n in low.items() if n)): Fraction(1)})
        over, under = over * lift, under * lift
        common = gcd(over, under)
        over, under = divided(over, common), divided(under, common)
        lead = under.parts[_leading(under, sorted(under.atoms()))]
        self.over, self.under = over / lead, under / lead

    @classmethod
    def atom(cls, name: str) -> Ratio:
        return cls(Term.atom(name))

    @staticmethod
    def of(x: object) -> Ratio:
        return x if isinstance(x, Ratio) else Ratio(x if isinstance(x, Term) else Term.number(x))

    def __add__(self, other: object) -> Ratio:
        o = Ratio.of(other)
        return Ratio(self.over * o.under + o.over * self.under, self.under * o.under)

    def __neg__(self) -> Ratio:
        return Ratio(-self.over, self.under)

    def __sub__(self, other: object) -> Ratio:
        return self + -Ratio.of(other)

    def __mul__(self, other: object) -> Ratio:
        o = Ratio.of(other)
        return Ratio(self.over * o.over, self.under * o.under)

    def __truediv__(self, other: object) -> Ratio:
        o = Ratio.of(other)
        return Ratio(self.over * o.under, self.under * o.over)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Ratio) and (self.over, self.under) == (other.over, other.under)

    def __hash__(self) -> int:
        return hash((self.over, self.under))

    def is_zero(self) -> bool:
        return self.over.is_zero()

    def atoms(self) -> set[str]:
        return self.over.atoms() | self.under.atoms()

    def evaluate(self, values: Mapping[str, object]) -> Fraction:
        return self.over.evaluate(values) / self.under.evaluate(values)

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        """The quotient over columns named by its atoms; null where it is by zero."""
        return F.try_divide(self.over.column(of), self.under.column(of))

    def renamed(self, suffix: str, names: Iterable[str] | None = None) -> Ratio:
        """Atoms (all, or those named) with a suffix."""
        own = None if names is None else set(names)
        to = lambda t: Term({tuple(sorted((f"{a}.{suffix}" if own is None or a in own else a, n) for a, n in m)): c for m, c in t.parts.items()})
        return Ratio(to(self.over), to(self.under))

    def replaced(self, by: Mapping[str, Ratio]) -> Ratio:
        """The quotient with terms in place of atoms."""

        def put(t: Term) -> Ratio:
            out = Ratio(ZERO)
            for m, c in t.parts.items():
                one = Ratio(Term.number(c))
                for a, n in m:
                    for _ in range(n):
                        one = one * by.get(a, Ratio.atom(a))
                out = out + one
            return out

        return put(self.over) / put(self.under)

    def __repr__(self) -> str:
        return repr(self.over) if self.under == ONE else f"({self.over!r}) / ({self.under!r})"


def solve(rules: list[Rule], givens: Mapping[str, object]) -> dict[str, Ratio]:
    """Quotients for all that follows from given terms, numbers or, for True, symbols of the variables' own names.

    A factor of a product that is zero stays unknown; everything else that a rule determines has a term.
    """
    known = {"one": Ratio(ONE)} | {k: Ratio.atom(k) if v is True else Ratio.of(v) for k, v in givens.items()}
    moved = True
    while moved:
        moved = False
        for r in rules:
            lacking = [v for v in dict.fromkeys((r.out, *r.args)) if v not in known]
            if r.kind == "apply" or len(lacking) != 1:
                continue
            (v,) = lacking
            if r.kind == "equal":
                value = known[r.args[0] if v == r.out else r.out]
            elif r.kind == "total":
                value = Ratio(ZERO) if v == r.out else known[r.out]
                for a in r.args:
                    if a != v:
                        value = value + known[a] if v == r.out else value - known[a]
            elif v == r.out:
                value = known[r.args[0]] * known[r.args[1]]
            else:
                by = known[r.args[1] if v == r.args[0] else r.args[0]]
                if by.is_zero():
                    continue
                value = known[r.out] / by
            known[v], moved = value, True
    known.pop("one")
    return known


def parameter(name: str, kind: str = "before_delta") -> tuple[Ratio, Ratio]:
    """A changed parameter's value before and after, over the symbols that are given for it: name.before, name.delta, name.after."""
    b, d, a = (Ratio.atom(f"{name}.{x}") for x in ("before", "delta", "after"))
    return {"before_delta": (b, b + d), "before_after": (b, a), "after_delta": (a - d, a)}[kind]


def differences(rules: list[Rule], givens: Mapping[str, object], changed: Mapping[str, str | tuple[object, object]]) -> dict[str, tuple[Ratio, Ratio, Ratio]]:
    """before, delta and after of all that follows when some givens change: by symbols (their kind, as parameter() takes it) or by numbers (before, delta)."""
    ends = {}
    for v, how in changed.items():
        ends[v] = parameter(v, how) if isinstance(how, str) else (Ratio.of(how[0]), Ratio.of(how[0]) + Ratio.of(how[1]))
    before = solve(rules, dict(givens) | {v: b for v, (b, _) in ends.items()})
    after = solve(rules, dict(givens) | {v: a for v, (_, a) in ends.items()})
    return {v: (before[v], after[v] - before[v], after[v]) for v in before if v in after}
