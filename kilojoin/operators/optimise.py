"""Sweeps over operating points, the best of them, and storages brought into balance.

A sweep is rows: (state, req..., dof..., efficiency, feasible, powers). Points are numbered and made in parallel, the
equations are solved as columns on each row, and the choice of the best is an aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilojoin.functions import exprs
from kilojoin.operators import cube, solver, surface


def points(spark: SparkSession, requirements: Mapping[str, Sequence[float]], freedoms: Mapping[str, Sequence[float]], states: Sequence[int] = (0,)) -> DataFrame:
    """state, req_<name>..., dof_<name>..., i: every combination; i counts the freedoms' combinations from 0."""
    names = [f"req_{n}" for n in requirements] + [f"dof_{n}" for n in freedoms]
    axes = [list(map(float, states)), *requirements.values(), *freedoms.values()]
    n = cube.size(list(freedoms.values()))
    rows = cube.generate(spark, axes, lambda *_: F.lit(0.0))
    return rows.select(F.col("x0").cast("int").alias("state"), *[F.col(f"x{i + 1}").alias(c) for i, c in enumerate(names)], F.pmod("lin", F.lit(n)).alias("i"))


def feasible(powers: Sequence[Column]) -> Column:
    """Every determined power is positive and a number."""
    return F.forall(F.array(*powers), lambda p: p.isNull() | (~F.isnan(p) & (p > 0)))


def objective(eta: Column, forcing: Column, condition: Column) -> Column:
    """struct<obj, eta>, null where the condition fails or the sum is no number."""
    total = eta + forcing
    return F.when(condition & ~F.isnan(total), F.struct(total.alias("obj"), eta.alias("eta")))


def forcing(drives: Mapping[str, float], powers: Mapping[str, Column]) -> Column:
    """Sum of each storage's drive times its power."""
    return sum((F.lit(float(d)) * powers[s] for s, d in drives.items()), F.lit(0.0))


def find_best(rows: DataFrame, by: Sequence[str], index: str = "i", obj: str = "obj", eta: str = "eta", condition: Column | None = None) -> DataFrame:
    """by, i, obj, eta of the first largest objective among feasible points whose objective is a number."""
    ok = F.col(obj).isNotNull() & ~F.isnan(obj)
    ok = ok if condition is None else ok & condition
    best = F.max_by(F.struct(index, obj, eta), F.struct(F.col(obj), -F.col(index)))
    return rows.where(ok).groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def expected(rows: DataFrame, by: Sequence[str], eta: str = "eta", condition: Column | None = None) -> DataFrame:
    """by, expected: the mean efficiency of feasible points; NaN without any."""
    value = F.col(eta) if condition is None else F.when(condition, F.col(eta))
    return rows.groupBy(*by).agg(F.coalesce(F.avg(value), exprs.nan()).alias("expected"))


def per_state_sweep(rows: DataFrame, rules: list[solver.Rule], given: Mapping[str, Column]) -> DataFrame:
    """rows with every variable of a section that follows from the given ones (over requirement and freedom columns)."""
    return solver.solve(rows.withColumns({v: c.cast("double") for v, c in given.items()}), rules)


def best_of_two(a: Column, b: Column) -> Column:
    """The larger number; a NaN loses."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def optimal_states(signal: DataFrame) -> DataFrame:
    """record_id, idx, obj, states: the best objective at each time (record_id, idx, state, obj) and all states that have it."""
    w = signal.where(~F.isnan("obj")).groupBy("record_id", "idx").agg(F.max("obj").alias("_best"))
    rows = signal.join(w, ["record_id", "idx"], "left")
    none = rows.groupBy("record_id", "idx").agg(F.coalesce(F.max("_best"), exprs.nan()).alias("obj"), F.array_sort(F.collect_list(F.when(F.col("obj") == F.col("_best"), F.col("state")))).alias("states"))
    return none


def force_states(signal: DataFrame) -> DataFrame:
    """Objectives shifted for each state so that it touches the optimum somewhere: every state is best at least once."""
    best = signal.where(~F.isnan("obj")).groupBy("record_id", "idx").agg(F.max("obj").alias("_best"))
    rows = signal.join(best, ["record_id", "idx"])
    gap = rows.where(~F.isnan("obj")).groupBy("record_id", "state").agg(F.min(F.col("_best") - F.col("obj")).alias("_gap"))
    return rows.join(gap, ["record_id", "state"]).select("record_id", "idx", "state", (F.col("obj") + F.col("_gap")).alias("obj"))


def stepped_time(chosen: DataFrame, times: DataFrame) -> DataFrame:
    """record_id, idx, k, state, t0, t1: each interval dealt out evenly among its best states."""
    w = Window.partitionBy("record_id").orderBy("idx")
    rows = chosen.join(times, ["record_id", "idx"]).withColumn("_t", F.lead("t").over(w)).where("_t is not null and size(states) > 0")
    rows = rows.withColumn("_n", F.size("states")).select("record_id", "idx", "t", "_t", "_n", F.posexplode("states").alias("k", "state"))
    at = lambda k: F.col("t") + (F.col("_t") - F.col("t")) * k / F.col("_n")
    return rows.select("record_id", "idx", "k", "state", at(F.col("k")).alias("t0"), at(F.col("k") + 1).alias("t1"))


def power_matrix(best: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """x0, xs, vs: an optimum over a two-dimensional room of requirements as rows of a matrix."""
    return cube.matrix(best.select(F.col(x).alias("x0"), F.col(y).alias("x1"), F.col(value).alias("v")))


#: How a bracket's width becomes the next step (fixed value).
SHRINK = 1.7


@dataclass
class Drive:
    """The search for a storage's drive: the step doubles until the balance changes sign, then the bracket shrinks."""

    value: float = 0.0
    step: float = 0.1
    low: tuple[float, float] | None = None
    high: tuple[float, float] | None = None
    best: tuple[float, float] | None = None
    seen: list[tuple[float, float]] = field(default_factory=list)

    def update(self, balance: float) -> None:
        """Takes the balance that the current drive gave and sets the next one."""
        self.seen.append((self.value, balance))
        if self.best is None or abs(balance) < abs(self.best[1]):
            self.best = (self.value, balance)
        if balance < 0:
            self.low = (self.value, balance)
        else:
            self.high = (self.value, balance)
        if self.low and self.high:
            self.step = (self.high[0] - self.low[0]) / SHRINK
            self.value = self.low[0] + self.step if balance < 0 else self.high[0] - self.step
        else:
            self.value += self.step if balance < 0 else -self.step
            self.step *= 2


def balance_storages(evaluate: Callable[[dict[str, float]], dict[str, float]], storages: Sequence[str], most: float = 1e-3, rounds: int = 100, steps: int = 100) -> dict[str, Drive]:
    """Drives for which every storage ends as full as it began; one storage after the other, all again until the sum is small.

    evaluate runs the sweep's choice for given drives and gives the balance of each storage (one number each reaches the driver).
    """
    drives = {s: Drive() for s in storages}
    now = lambda: {s: d.value for s, d in drives.items()}
    for _ in range(rounds):
        for s in storages:
            drives[s] = Drive(value=drives[s].best[0] if drives[s].best else 0.0)
            for _ in range(steps):
                got = evaluate(now())[s]
                drives[s].update(got)
                if abs(got) <= most:
                    break
            drives[s].value = drives[s].best[0]
        balances = evaluate(now())
        if all(abs(balances[s]) <= most for s in storages):
            break
    return drives


def deviation(balances: Mapping[str, float]) -> float:
    """Sum of squares, and of the sum's size."""
    return sum(b * b for b in balances.values()) + abs(sum(balances.values()))


def simulate(signals: DataFrame, rules: list[solver.Rule], given: Mapping[str, str]) -> DataFrame:
    """Wide samples with all variables of a section: powers from signals at given positions, one second for each sample."""
    rows = signals.withColumns({v: F.col(c).cast("double") for v, c in given.items()})
    return solver.solve(rows, rules)


def interpolate_optimum(best: DataFrame, demand: DataFrame, values: Sequence[str], x: str = "req_x", y: str = "req_y") -> DataFrame:
    """demand (record_id, idx, dx, dy, further columns) with each of ``values`` for every state, bilinear between the optima (state, x, y, values) of a grid.

    Each point of the grid knows its neighbours; a demand finds its cell by merging its coordinates with the grid's axes, which are
    small, and joins the cell by number; a grid with an axis of more than AXIS points is looked up as a table (surface.lookup), states being one more
    axis. Demands beyond the grid, or in a cell whose corners lack an optimum, have none (null).
    """
    axes = {c: sorted(r[0] for r in best.select(c).distinct().limit(AXIS + 1).collect()) for c in (x, y)}
    if any(len(a) > AXIS for a in axes.values()):
        return _interpolate_table(best, demand, values, x, y)
    cell = lambda a, v: F.size(F.filter(F.array(*map(F.lit, a)), lambda p: p < v))  # noqa: E731  number of the right end
    place = {c: F.array_position(F.array(*map(F.lit, a)), F.col(c)) - 1 for c, a in axes.items()}
    grid = best.select("state", place[x].alias("i"), place[y].alias("j"), F.col(x).alias("gx"), F.col(y).alias("gy"), *values)
    corner = F.explode(F.array(*[F.struct((F.col("i") + di).alias("ci"), (F.col("j") + dj).alias("cj")) for di in (0, 1) for dj in (0, 1)]))
    corners = grid.select("*", corner.alias("c")).groupBy("state", F.col("c.ci").alias("ci"), F.col("c.cj").alias("cj")).agg(
        F.count(F.lit(1)).alias("n"), F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"),
        *[F.sort_array(F.collect_list(F.struct("gx", "gy", F.col(v).cast("double").alias("v")))).alias(v) for v in values],
    ).where("n = 4")
    inside = lambda a, v: (v >= a[0]) & (v <= a[-1])
    asked = demand.withColumns({"ci": F.when(inside(axes[x], F.col("dx")), F.greatest(cell(axes[x], F.col("dx")), F.lit(1)).cast("long")), "cj": F.when(inside(axes[y], F.col("dy")), F.greatest(cell(axes[y], F.col("dy")), F.lit(1)).cast("long"))})
    met = asked.join(corners, ["ci", "cj"], "left")
    fx, fy = (F.col("dx") - F.col("x0")) / (F.col("x1") - F.col("x0")), (F.col("dy") - F.col("y0")) / (F.col("y1") - F.col("y0"))
    v = lambda c, k: F.get(F.col(c), F.lit(k))["v"]  # noqa: E731  corners in the order of x, then y
    between = lambda c: (v(c, 0) * (1 - fy) + v(c, 1) * fy) * (1 - fx) + (v(c, 2) * (1 - fy) + v(c, 3) * fy) * fx
    return met.select(*demand.columns, "state", *[between(c).alias(c) for c in values])


#: Points of an axis of the grid of optima that are literals of the plan at most.
AXIS = 4096


def _interpolate_table(best: DataFrame, demand: DataFrame, values: Sequence[str], x: str, y: str) -> DataFrame:
    """interpolate_optimum() for grids of any size: every state of the grid is asked at every demand."""
    states = [r[0] for r in best.select("state").distinct().orderBy("state").collect()]  # the states of one system
    asked = demand.select("*", F.col("dx").alias(x), F.col("dy").alias(y), F.explode(F.array(*map(F.lit, states))).alias("state"))
    for v in values:
        asked = surface.lookup(best, asked, ["state", x, y], v, name=v)
    return asked.select(*demand.columns, "state", *values)


def signal_based_solution(states: DataFrame, obj: str = "obj") -> DataFrame:
    """record_id, idx, and the row of the best state at each time, of interpolated optima (record_id, idx, state, obj, ...); ties go to the smaller state."""
    rows = states.where(F.col(obj).isNotNull() & ~F.isnan(obj))
    rest = [c for c in states.columns if c not in ("record_id", "idx")]
    best = F.max_by(F.struct(*rest), F.struct(F.col(obj), -F.col("state")))
    return rows.groupBy("record_id", "idx").agg(best.alias("_b")).select("record_id", "idx", "_b.*")


def optimise_and_simulate(best: DataFrame, demand: DataFrame, values: Sequence[str], rules: list[solver.Rule], given: Mapping[str, str], obj: str = "obj") -> DataFrame:
    """One pass: optima interpolated along the demand, the best state at each time, and its section solved from the chosen controls."""
    return simulate(signal_based_solution(interpolate_optimum(best, demand, values), obj), rules, given)


def iterate_efficiency(evaluate: Callable[[DataFrame], DataFrame], etas: DataFrame, keys: Sequence[str], most: float = 1e-3, rounds: int = 5) -> tuple[DataFrame, int]:
    """The outer loop: evaluate(etas) gives new efficiencies (keys, eta) until none changes by more than ``most``; the table, and the rounds it took.

    Each round is a table in the shared folder, so that plans don't grow; only the largest change reaches the driver.
    """
    from kilojoin.plans.storage import cut

    for k in range(1, rounds + 1):
        new = cut(evaluate(etas).select(*keys, "eta"))
        change = new.join(etas.select(*keys, F.col("eta").alias("_old")), list(keys), "left").agg(F.max(F.abs(F.col("eta") - F.coalesce("_old", F.lit(float("inf")))))).first()[0]
        etas = new
        if change is None or change <= most:
            break
    return etas, k


#: What an optimisation starts from where nothing is known (fixed values).
INITIAL = {"eta": 0.5, "x": 0.2, "stx": 0.5, "dt": 1.0}


def initial_givens(rules: list[solver.Rule], known: Mapping[str, float], kinds: Sequence[str] = ("eta", "x", "stx", "dt")) -> dict[str, float]:
    """Known values, and starting values for unknown efficiencies, shares and times."""
    start = {v: INITIAL[k] for v in solver.variables(rules) if (k := v.split("_")[0]) in kinds and k in INITIAL}
    return start | dict(known)
