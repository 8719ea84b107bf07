"""Tracked solving: every value names the rule and the givens that gave it, and contradictions name theirs.

What follows from what depends only on which variables are given, so it is worked out once for each distinct pattern of givens, on the
driver: a plan with its provenance, and the redundancies of the system. A redundancy is a smallest set of givens that says something twice: without any one
of them nothing can be checked. Each becomes a column, the deviation of its rule computed from these givens alone, so a row's contradictions
are found side by side with its values, without another pass. If a row has several, those with the fewest givens come first.

Defined results: null givens are unknown; zero times an unknown is not concluded here (its provenance would depend on the row); a quotient by zero
is unknown and contradicts nothing; rows with equal keys are systems of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.operators import solver
from kilojoin.operators.solver import Rule
from kilojoin.plans.storage import cut


def label(r: Rule) -> str:
    """A rule as text: z = x * y, z = a + b, a = b, z = f(x)."""
    if r.kind == "apply":
        return f"{r.out} = f({', '.join(r.args)})"
    return f"{1 if r.out == 'one' else r.out} = {(' * ' if r.kind == 'product' else ' + ').join('1' if a == 'one' else a for a in r.args)}"


def provenance(rules: Sequence[Rule], known: Iterable[str]) -> dict[str, tuple[Rule | None, frozenset[str]]]:
    """Of each variable that follows, the rule and the givens that it rests on; the fewest givens that a layered plan meets."""
    out: dict[str, tuple[Rule | None, frozenset[str]]] = {v: (None, frozenset([v])) for v in known} | {"one": (None, frozenset())}
    for layer in solver.plan(list(rules), known):
        new = {}
        for v, _ in layer:
            ways = [(frozenset().union(*(out[a][1] for a in (r.out, *r.args) if a != v)), i) for i, r in enumerate(rules) if v in solver._given_by(r, set(out))]
            support, i = min(ways, key=lambda w: (len(w[0]), w[1]))
            new[v] = (rules[i], support)
        out |= new
    out.pop("one")
    return out


def redundant(rules: Sequence[Rule], known: frozenset[str]) -> Rule | None:
    """A rule that the known variables fulfil without having been needed, or none."""
    used = {id(r) for layer in solver.plan(list(rules), sorted(known)) for _, r in layer}
    have = {"one", *known, *(v for layer in solver.plan(list(rules), sorted(known)) for v, _ in layer)}
    return next((r for r in rules if r.kind != "apply" and id(r) not in used and {r.out, *r.args} <= have), None)


def redundancies(rules: Sequence[Rule], known: Iterable[str]) -> list[tuple[frozenset[str], Rule]]:
    """All smallest sets of givens with a rule that they check: each is found by leaving out givens while a check remains, others by leaving out members of those found."""
    found: dict[frozenset[str], Rule] = {}
    seen: set[frozenset[str]] = set()

    def search(own: frozenset[str]) -> None:
        if own in seen:
            return
        seen.add(own)
        base = redundant(rules, frozenset())  # rules that hold among constants check nothing
        rule = redundant(rules, own)
        if rule is None or (base is not None and rule is base):
            return
        least = own
        for v in sorted(own):
            if redundant(rules, least - {v}) is not None:
                least -= {v}
        found.setdefault(least, redundant(rules, least))
        for v in sorted(least):
            search(own - {v})

    search(frozenset(known))
    return sorted(found.items(), key=lambda x: (len(x[0]), sorted(x[0])))


def _deviation(df: DataFrame, rules: Sequence[Rule], own: frozenset[str], rule: Rule, name: str) -> DataFrame:
    """df with the deviation of a rule when only the givens ``own`` are known; helper columns carry the name as a prefix."""
    to = lambda v: f"{name}:{v}" if v != "one" else v
    mine = [Rule(r.kind, to(r.out), tuple(map(to, r.args)), r.f) for r in rules]
    df = df.withColumns({to(v): F.col(f"`{v}`") for v in sorted(own)})
    need, layers = {rule.out, *rule.args}, solver.plan(list(rules), sorted(own))
    for layer in reversed(layers):  # only what the rule rests on
        for v, r in layer:
            if v in need:
                need |= {r.out, *r.args}
    by = {id(a): b for a, b in zip(rules, mine, strict=True)}
    for layer in layers:
        df = df.withColumns({to(v): solver._value(by[id(r)], to(v)) for v, r in layer if v in need})
    c = lambda v: F.lit(1.0) if v == "one" else F.col(f"`{to(v)}`")
    right = c(rule.args[0]) * c(rule.args[1]) if rule.kind == "product" else sum((c(a) for a in rule.args[1:]), c(rule.args[0]))
    df = df.withColumn(name, c(rule.out) - right)
    return df.drop(*[to(v) for v in need if v != "one"], *[to(v) for v in own])


def solve(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """values: keys, variable, value, rule (null for givens), givens; contradictions: keys, nth (from 1), rule, givens, deviation.

    df has the keys and columns of given variables. Rows are grouped by which variables are given; the driver holds a row for each such pattern.
    tolerance is relative to the largest given, 1 at least.
    """
    spark, keys = df.sparkSession, list(keys)
    names = [v for v in solver.variables(rules) if v in df.columns]
    pattern = F.concat(*[F.col(v).isNotNull().cast("int").cast("string") for v in names])
    df = cut(df.select(*keys, *[F.col(v).cast("double").alias(v) for v in names], pattern.alias("pattern")))
    scale = F.greatest(F.lit(1.0), *[F.coalesce(F.abs(v), F.lit(0.0)) for v in names])
    values, against = [], []
    for (bits,) in df.select("pattern").distinct().collect():
        known = [v for v, b in zip(names, bits, strict=True) if b == "1"]
        own = df.where(F.col("pattern") == bits)
        from_ = provenance(rules, known)
        solved = own.select(*keys, *known)
        for layer in solver.plan(list(rules), known):
            solved = solved.withColumns({v: solver._value(from_[v][0], v) for v, _ in layer})
        told = lambda v: (F.lit(label(from_[v][0])) if from_[v][0] else F.lit(None).cast("string"))  # noqa: B023, E731
        values.append(solved.select(*keys, F.inline(F.array(*[
            F.struct(F.lit(v).alias("variable"), F.col(v).alias("value"), told(v).alias("rule"), F.array(*map(F.lit, sorted(from_[v][1]))).cast("array<string>").alias("givens")) for v in from_
        ]))).where("value is not null"))
        checks = redundancies(rules, known)
        wide = own
        for i, (mine, rule) in enumerate(checks):
            wide = _deviation(wide, rules, mine, rule, f"check{i}")
        if checks:
            off = [F.when(F.abs(f"check{i}") > tolerance * scale, F.struct(F.lit(label(rule)).alias("rule"), F.array(*map(F.lit, sorted(mine))).alias("givens"), F.col(f"check{i}").alias("deviation"))) for i, (mine, rule) in enumerate(checks)]
            wide = wide.withColumn("off", F.array_compact(F.array(*off))).where("size(off) > 0")
            against.append(wide.select(*keys, F.posexplode("off").alias("nth", "o")).select(*keys, (F.col("nth") + 1).alias("nth"), "o.*"))
    none = lambda kind: spark.createDataFrame([], df.select(*keys).schema).select(*keys, *kind)
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    return (
        _all(values) if values else none([null("string", "variable"), null("double", "value"), null("string", "rule"), null("array<string>", "givens")]),
        _all(against) if against else none([null("int", "nth"), null("string", "rule"), null("array<string>", "givens"), null("double", "deviation")]),
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
