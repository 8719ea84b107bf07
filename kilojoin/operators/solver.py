"""Equation systems over source-to-sink flows, solved by propagation in either direction.

A rule relates variables: ``total`` says z is the sum of xs, ``product`` says z = x * y, ``equal`` says a = b. A variable that is null is unknown.
The plan is made once on the driver from the set of known variables: each step names one variable and the
expression that gives it, and the steps of a layer become one projection. Every row of a DataFrame is one system (a
section, a sample, a sweep point), so any number of them is solved side by side without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.functions import exprs
from kilojoin.operators.symbolic import Term

INIT, EXIT = "init", "exit"


@dataclass(frozen=True)
class Rule:
    kind: str
    out: str
    args: tuple[str, ...]
    f: Callable[..., Column] | None = None


def total(z: str, xs: Iterable[str]) -> Rule:
    return Rule("total", z, tuple(xs))


def product(z: str, x: str, y: str) -> Rule:
    return Rule("product", z, (x, y))


def equal(a: str, b: str) -> Rule:
    return Rule("equal", a, (b,))


def apply_(z: str, f: Callable[..., Column], *xs: str) -> Rule:
    """A one-way assignment z = f(xs), e.g. an efficiency curve."""
    return Rule("apply", z, tuple(xs), f)


def name(kind: str, *index: object) -> str:
    return "_".join([kind, *map(str, index)])


def variables(rules: Iterable[Rule]) -> list[str]:
    return list(dict.fromkeys(v for r in rules for v in (r.out, *r.args) if v != "one"))


# rules ----------------------------------------------------------------------------------------------


def split_rules(sum_: str, parts: list[tuple[str, str]], one: str = "one") -> list[Rule]:
    """parts: (energy, share). The energies add up to the sum, the shares to one, each energy is sum times share."""
    return [total(sum_, [e for e, _ in parts]), total(one, [x for _, x in parts]), *[product(e, sum_, x) for e, x in parts]]


def section_rules(edges: list[tuple[object, object]], part: object = 0, equal_sums: bool = True, etas: Mapping[tuple, Callable[[Column], Column]] | None = None) -> list[Rule]:
    """The rules of one section with oriented edges (from, to); etas: efficiency as a function of the power at the start of an edge."""
    dt, out = name("dt", part), []
    ins: dict[object, list[object]] = {}
    outs: dict[object, list[object]] = {}
    for f, t in edges:
        outs.setdefault(f, []).append(t)
        ins.setdefault(t, []).append(f)
        for a, b in ((f, t), (t, f)):
            out.append(product(name("e", part, a, b), dt, name("p", part, a, b)))
        out.append(product(name("p", part, t, f), name("eta", part, f, t), name("p", part, f, t)))
        if etas and (f, t) in etas:
            out.append(apply_(name("eta", part, f, t), etas[f, t], name("p", part, f, t)))
    for side, kind in ((ins, "insum"), (outs, "outsum")):
        for n, others in side.items():
            out += split_rules(name(kind, part, n), [(name("e", part, n, m), name("x", part, n, m)) for m in others])
    if equal_sums:
        out += [equal(name("insum", part, n), name("outsum", part, n)) for n in ins if n in outs]
    return out


def _charges(sections: list[list[tuple[object, object]]], storage: object) -> tuple[list[int], list[int]]:
    charging = [i for i, edges in enumerate(sections) if any(t == storage for _, t in edges)]
    return charging, [i for i, edges in enumerate(sections) if any(f == storage for f, _ in edges)]


def carry_edges(charging: list[int], discharging: list[int], ordered: bool = True) -> list[tuple[object, object]]:
    """From the start and every charging section to each later discharging section (any, if not ordered) and the end."""
    starts, ends = [INIT, *charging], [*discharging, EXIT]
    return [(p, q) for p in starts for q in ends if not ordered or p == INIT or q == EXIT or p < q]


def storage_rules(sections: list[list[tuple[object, object]]], storage: object, ordered: bool = True, one: str = "one") -> list[Rule]:
    """Contents, carried energies and their shares of one storage over sections (or states, which have no order); the shares add up to ``one``."""
    charging, discharging = _charges(sections, storage)
    edges, out = carry_edges(charging, discharging, ordered), []
    if ordered:
        before = name("content", INIT, storage)
        for i in range(len(sections)):
            after, both = name("content", i, storage), name("level", i, storage)
            out.append(total(both, [after, *([name("outsum", i, storage)] if i in discharging else [])]))
            out.append(total(both, [before, *([name("insum", i, storage)] if i in charging else [])]))
            before = after
        out += [equal(name("stoutsum", INIT, storage), name("content", INIT, storage)), equal(name("stinsum", EXIT, storage), before)]
    out += [equal(name("stoutsum", i, storage), name("insum", i, storage)) for i in charging]
    out += [equal(name("stinsum", i, storage), name("outsum", i, storage)) for i in discharging]
    e = lambda p, q: name("ste", p, q, storage)
    x = lambda p, q: name("stx", p, q, storage)
    m = lambda p, q: name("maxe", p, q, storage)
    for p in dict.fromkeys(p for p, _ in edges):
        to = [q for a, q in edges if a == p]
        out += split_rules(name("stoutsum", p, storage), [(e(p, q), x(p, q)) for q in to], one)
        if ordered:
            out.append(equal(m(p, to[0]), name("stoutsum", p, storage)))
            out += [total(m(p, a), [m(p, b), e(p, a)]) for a, b in zip(to, to[1:], strict=False)]
    for q in dict.fromkeys(q for _, q in edges):
        by = [p for p, b in edges if b == q]
        out += split_rules(name("stinsum", q, storage), [(e(p, q), x(q, p)) for p in by], one)
        if ordered:
            local = name("local", q, storage)
            out += [total(local, [m(p, q) for p in by]), *[product(m(p, q), local, x(q, p)) for p in by]]
    return out


def sequence_rules(sections: list[list[tuple[object, object]]], storages: list[object], equal_sums: bool = True, one: str = "one") -> list[Rule]:
    """All sections, and every storage between them. equal_sums: what comes into a node goes out; one: what the shares of storages add up to."""
    out: list[Rule] = []
    for i, edges in enumerate(sections):
        out += section_rules(edges, i, equal_sums)
    for s in storages:
        out += storage_rules(sections, s, one=one)
    return out


def state_rules(states: list[list[tuple[object, object]]], storages: list[object], equal_sums: bool = True) -> list[Rule]:
    """States have no order: no contents and no largest energies."""
    out: list[Rule] = []
    for i, edges in enumerate(states):
        out += section_rules(edges, i, equal_sums)
    for s in storages:
        out += storage_rules(states, s, ordered=False)
    return out


def cumulated_rules(edges: list[tuple[object, object]], storages: list[object], equal_sums: bool = True) -> list[Rule]:
    """One section of all time; sums of a node are equal unless it is a storage, or equal_sums is off."""
    rules = section_rules(edges, "c", equal_sums=False)
    nodes = {f for f, _ in edges} & {t for _, t in edges} if equal_sums else set()
    return rules + [equal(name("insum", "c", n), name("outsum", "c", n)) for n in sorted(nodes, key=str) if n not in storages]


def mix_rules(variable: str, parts: Iterable[object], kind: str = "real") -> list[Rule]:
    """A quantity that is a mix of parts. real: it is their sum. cumulative: each part also counts the parts before it, so the last is the whole."""
    own = [name(variable, "part", p) for p in parts]
    if kind == "real":
        return [total(variable, own)]
    if kind != "cumulative":
        raise ValueError(kind)
    steps = [name(variable, "step", i) for i in range(len(own))]
    return [equal(own[0], steps[0]), *[total(b, [a, s]) for a, b, s in zip(own, own[1:], steps[1:], strict=False)], equal(variable, own[-1])]


# exact values ---------------------------------------------------------------------------------------


def solve_exact(rules: list[Rule], givens: Mapping[str, object], tracked: bool = False) -> dict[str, Fraction]:
    """Values of one small system as fractions (on the driver). tracked: a rule that doesn't hold in the end is an error.

    A product is zero if a factor is; 0/0 concludes nothing.
    """
    known: dict[str, Fraction] = {"one": Fraction(1)} | {k: Fraction(v) for k, v in givens.items()}
    moved = True
    while moved:
        moved = False
        for r in rules:
            for var, value in _conclusions(r, known):
                if var not in known:
                    known[var], moved = value, True
    if tracked:
        for r in rules:
            if r.kind != "apply" and all(v in known for v in (r.out, *r.args)):
                parts = [known[a] for a in r.args]
                right = parts[0] * parts[1] if r.kind == "product" else sum(parts)
                if right != known[r.out]:
                    raise ValueError(f"{r.out} = {known[r.out]}, but its rule gives {right}")
    known.pop("one")
    return known


def _conclusions(r: Rule, known: Mapping[str, Fraction]) -> list[tuple[str, Fraction]]:
    has = [a for a in r.args if a in known]
    if r.kind == "equal":
        a, b = r.out, r.args[0]
        return [(b, known[a])] if a in known else [(a, known[b])] if b in known else []
    if r.kind == "total":
        if len(has) == len(r.args):
            return [(r.out, sum((known[a] for a in r.args), Fraction(0)))]
        if r.out in known and len(has) == len(r.args) - 1:
            (rest,) = [a for a in r.args if a not in known]
            return [(rest, known[r.out] - sum((known[a] for a in has), Fraction(0)))]
        return []
    if r.kind == "product":
        x, y = r.args
        if any(known.get(a) == 0 for a in r.args):
            return [(r.out, Fraction(0))]
        if len(has) == 2:
            return [(r.out, known[x] * known[y])]
        if r.out in known and has:
            other = y if has[0] == x else x
            return [(other, known[r.out] / known[has[0]])] if known[has[0]] else []
    return []


def solve_symbolic(rules: list[Rule], givens: Mapping[str, object]) -> dict[str, Term]:
    """Terms for what follows from given terms, numbers or, for True, symbols of the variables' own names (on the driver).

    A quotient by a sum has no term of its own and concludes nothing; a term that is zero is a number like any other.
    """
    known = {"one": Term.number(1)} | {k: Term.atom(k) if v is True else v if isinstance(v, Term) else Term.number(v) for k, v in givens.items()}
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
                value = sum((known[a] for a in r.args), Term.number(0)) if v == r.out else known[r.out] - sum((known[a] for a in r.args if a != v), Term.number(0))
            elif v == r.out:
                value = known[r.args[0]] * known[r.args[1]]
            else:
                by = known[r.args[1] if v == r.args[0] else r.args[0]]
                if len(by.parts) != 1:
                    continue
                value = known[r.out] / by
            known[v], moved = value, True
    known.pop("one")
    return known


def conflicts(rules: list[Rule], givens: Mapping[str, object]) -> list[tuple[str, ...]]:
    """The smallest sets of givens that contradict each other: without any one of a set's members its contradiction is gone (a few givens, on the driver)."""
    left, out = dict(givens), []
    while True:
        try:
            solve_exact(rules, left, tracked=True)
            return out
        except ValueError:
            own = dict(left)
            for k in list(own):
                rest = {a: b for a, b in own.items() if a != k}
                try:
                    solve_exact(rules, rest, tracked=True)
                except ValueError:
                    own = rest
            out.append(tuple(sorted(own)))
            left = {k: v for k, v in left.items() if k not in own}


# many systems ---------------------------------------------------------------------------------------


def plan(rules: list[Rule], known: Iterable[str]) -> list[list[tuple[str, Rule]]]:
    """Layers of (variable, rule): what follows from the known variables, by the rule that first gives it."""
    have, layers = {"one", *known}, []
    while True:
        layer: dict[str, Rule] = {}
        for r in rules:
            for v in _given_by(r, have):
                if v not in have:
                    layer.setdefault(v, r)
        if not layer:
            return layers
        layers.append(list(layer.items()))
        have.update(layer)


def _given_by(r: Rule, have: set[str]) -> list[str]:
    lacking = [v for v in dict.fromkeys((r.out, *r.args)) if v not in have]
    if r.kind == "apply":
        return [r.out] if lacking == [r.out] else []
    if len(lacking) == 1:
        return lacking
    return []


def _value(r: Rule, var: str) -> Column:
    c = lambda v: F.lit(1.0) if v == "one" else F.col(v)
    if r.kind == "apply":
        return r.f(*map(c, r.args))
    if r.kind == "equal":
        return c(r.args[0] if var == r.out else r.out)
    if r.kind == "total":
        if var == r.out:
            return sum((c(a) for a in r.args[1:]), c(r.args[0]))
        return sum((-c(a) for a in r.args if a != var), c(r.out))
    x, y = r.args
    if var == r.out:
        return exprs.mul(c(x), c(y))
    return exprs.div(c(r.out), c(y if var == x else x))


def solve(df: DataFrame, rules: list[Rule], rounds: int | None = 1) -> DataFrame:
    """df with a column for every variable that follows from its own columns.

    Unknowns are null. A variable may be known in some rows only: known columns are coalesced with what their rules give. rounds: how often
    the rules of all variables are applied again, for zeros and partial rows that open further ways; None goes on until no row learns anything new, each
    round being a table in the shared folder.
    """
    wanted = variables(rules)
    known = [v for v in wanted if v in df.columns]
    for layer in plan(rules, known):
        df = df.withColumns({v: _value(r, v) for v, r in layer})
    lacking = [v for v in wanted if v not in df.columns]
    df = df.withColumns({v: F.lit(None).cast("double") for v in lacking})
    if rounds is None:
        return _until_known(df, rules, wanted)
    for _ in range(rounds if lacking or rounds > 1 else 0):
        df = _again(df, rules)
    return df


def _again(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Unknowns coalesced with what any of their rules gives."""
    new: dict[str, list[Column]] = {}
    for r in rules:
        if r.kind != "apply":
            for v in dict.fromkeys((r.out, *r.args)):
                if v != "one":
                    new.setdefault(v, []).append(_value(r, v))
    return df.withColumns({v: F.coalesce(F.col(v), *cs) for v, cs in new.items()})


def _until_known(df: DataFrame, rules: list[Rule], wanted: list[str]) -> DataFrame:
    from kilojoin.plans.storage import cut

    count = lambda t: t.agg(F.sum(sum((F.col(v).isNotNull().cast("long") for v in wanted), F.lit(0).cast("long")))).first()[0] or 0
    df = cut(df)
    before, after = -1, count(df)
    while after != before:
        df = cut(_again(df, rules))
        before, after = after, count(df)
    return df


def residual(rules: list[Rule]) -> Column:
    """The largest deviation of any rule whose variables are all known; over a tolerance, the system contradicts itself."""
    out = []
    for r in rules:
        if r.kind != "apply":
            c = lambda v: F.lit(1.0) if v == "one" else F.col(v)
            right = c(r.args[0]) * c(r.args[1]) if r.kind == "product" else sum((c(a) for a in r.args[1:]), c(r.args[0]))
            out.append(F.coalesce(F.abs(c(r.out) - right), F.lit(0.0)))
    return F.greatest(*out, F.lit(0.0))


def tidy(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """keys, variable, value: solved columns as rows, unknown ones left out."""
    own = [v for v in variables(rules) if v in df.columns]
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in own]).unpivot(keys, own, "variable", "value").where("value is not null")
