"""Sequences from data, two grains, tracked solving, terms, mixes, drives, crossings, grown tables, sparse stacks and holes."""

import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kilojoin.operators import balance, crossing, delta, holes, mix, mixed, optimise, rational, record, segment, sequence, skew, solver, sparse_stack, surface, track
from kilojoin.operators.symbolic import Term
from kilojoin.plans.flow_queries import TRIPOD, TRIPOD_GIVEN

# sequences ------------------------------------------------------------------------------------------


def as_rows(given, record=1):
    rows = []
    for k, v in given.items():
        kind, i, *rest = k.split("_")
        rows.append((record, sequence.START if i == "init" else int(i), "_".join([kind, *rest]), float(Fraction(v))))
    return rows


def solved(spark, sections, given, storages, **how):
    one = spark.range(1).select(F.lit(1).cast("long").alias("r"))
    flows = sequence.edges_of(one, sections, F.col("r"))
    out = sequence.solve(flows, spark.createDataFrame(given, "record_id long, section long, variable string, value double"), storages, **how)
    return {(r["section"], r["until"], r["variable"]): r["value"] for r in out.collect()}


def test_worked_sequence_with_all_carried_energies(spark):
    got = solved(spark, TRIPOD, as_rows(TRIPOD_GIVEN), ["3"], ends=False)
    want = solver.solve_exact(solver.sequence_rules(TRIPOD, [3]), TRIPOD_GIVEN)
    part = {"init": sequence.START, "exit": sequence.END}
    for k, v in want.items():
        kind, *at = k.split("_")
        if kind in ("ste", "maxe"):
            if "exit" in at and kind == "maxe":
                continue
            key = (part.get(at[0], at[0]), part.get(at[1], at[1]), f"{kind}_3")
            assert got[int(key[0]), int(key[1]), key[2]] == pytest.approx(float(v))
        elif kind in ("e", "p", "eta", "x", "insum", "outsum", "dt", "content"):
            assert got[int(part.get(at[0], at[0])), None, "_".join([kind, *at[1:]])] == pytest.approx(float(v))


def test_contents_on_both_sides_give_a_sum_that_solves_its_section(spark):
    sections = [[("a", "s")], [("s", "c")], [("a", "s")]]
    given = {"content_init_s": 10, "content_0_s": 14, "content_2_s": 20, "dt_0": 2, "eta_0_a_s": "1/2", "outsum_1_s": 3, "dt_1": 1, "eta_1_s_c": "1/2", "dt_2": 4, "eta_2_a_s": "1/4"}
    got = solved(spark, sections, as_rows(given), ["s"])
    assert got[0, None, "e_a_s"] == pytest.approx(8) and got[0, None, "p_a_s"] == pytest.approx(4)
    assert got[1, None, "content_s"] == pytest.approx(11) and got[1, None, "e_c_s"] == pytest.approx(1.5)
    assert got[2, None, "insum_s"] == pytest.approx(9) and got[2, None, "e_a_s"] == pytest.approx(36)


def test_what_isnt_known_stays_unknown(spark):
    got = solved(spark, [[("a", "s")], [("s", "c")]], as_rows({"dt_0": 1, "content_1_s": 5, "outsum_1_s": 2}), ["s"])
    assert got[0, None, "content_s"] == 7 and (sequence.START, None, "content_s") not in got
    assert (0, None, "e_a_s") not in got and not any(k[2].startswith("ste") for k in got)
    none = spark.createDataFrame([], "record_id long, section long, n_from string, n_to string, dir int")
    values = spark.createDataFrame([], "record_id long, section long, variable string, value double")
    assert sequence.solve(none, values, ["s"]).count() == 0


def test_a_storage_without_flow_keeps_its_content(spark):
    flows = spark.createDataFrame([(1, 0, "a", "s", 0), (1, 1, "a", "s", 1), (1, 2, "s", "a", 2)], "record_id long, section long, n_from string, n_to string, dir int")
    given = spark.createDataFrame(as_rows({"content_init_s": 1, "insum_0_s": 2, "outsum_2_s": 1}), "record_id long, section long, variable string, value double")
    got = {(r["section"], r["variable"]): r["value"] for r in sequence.solve(flows, given, ["s"]).where("until is null").collect()}
    assert [got[i, "content_s"] for i in (-1, 0, 1, 2)] == [1, 3, 3, 2]


# two grains -----------------------------------------------------------------------------------------


def test_rest_goes_to_the_only_unknown_interval_and_spreads_by_time(spark):
    rows = [("r", 0, 0, 1.0, 2.0, None), ("r", 0, 1, 3.0, None, None), ("r", 1, 0, 1.0, None, None), ("r", 1, 1, 4.0, None, 7.0)]
    samples = spark.createDataFrame(rows, "record_id string, section long, idx long, dt double, e double, f double")
    sections = spark.createDataFrame([("r", 0, 5.0, 8.0), ("r", 1, 5.0, None), ("r", 2, 1.0, 1.0)], "record_id string, section long, E double, M double")
    got, whole = mixed.solve(samples, sections, [solver.total("g", ["e", "f"])], [solver.product("W", "E", "M")], [mixed.Coupling("E", "e"), mixed.Coupling("M", "f", "mean", spread=True), mixed.Coupling("G", "g")])
    at = {(r["section"], r["idx"]): r for r in got.collect()}
    assert at[0, 1]["e"] == 3.0 and at[0, 0]["f"] == 8.0 and at[0, 1]["f"] == 8.0 and at[0, 0]["g"] == 10.0
    assert at[1, 0]["e"] is None and at[1, 0]["f"] is None  # two unknown, and no scalar
    s = {r["section"]: r for r in whole.collect()}
    assert s[0]["G"] == 21.0 and s[0]["W"] == 40.0 and s[1]["G"] is None and s[2]["W"] == 1.0


# tracked solving ------------------------------------------------------------------------------------


def test_redundancies_are_the_smallest_sets(spark):
    rules = [solver.total("c", ["a", "b"]), solver.product("z", "c", "y"), solver.equal("z", "w")]
    found = {tuple(sorted(s)) for s, _ in track.redundancies(rules, ["a", "b", "c", "y", "w"])}
    assert found == {("a", "b", "c"), ("c", "w", "y"), ("a", "b", "w", "y")}
    assert track.redundancies(rules, ["a", "b", "y"]) == []
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 2.0, 6.0), (2, 1.0, 2.0, 4.0, 2.0, 6.0), (3, 1.0, 2.0, None, 2.0, 7.0), (4, 1.0, None, None, None, None), (4, 1.0, 2.0, 3.0, 2.0, 9.0)], "k long, a double, b double, c double, y double, w double")
    values, off = track.solve(df, rules, ["k"])
    got = {}
    for r in off.orderBy("k", "nth").collect():
        got.setdefault(r["k"], []).append(tuple(r["givens"]))
    assert got == {2: [("a", "b", "c"), ("c", "w", "y")], 3: [("a", "b", "w", "y")], 4: [("c", "w", "y"), ("a", "b", "w", "y")]}
    z = values.where("k = 3 and variable = 'c'").first()
    assert z["value"] == 3.0 and z["rule"] == "c = a + b" and z["givens"] == ["a", "b"]
    assert values.where("k = 1 and variable = 'a'").first()["rule"] is None
    none, nothing = track.solve(df.limit(0), rules, ["k"])
    assert none.count() == nothing.count() == 0 and none.columns == values.columns and nothing.columns == off.columns


# terms ----------------------------------------------------------------------------------------------


def test_common_divisors_and_quotients():
    x, y, z = map(Term.atom, "xyz")
    assert rational.gcd((x + y) * (x - z), (x + y) * (y + z * 2)) == x + y
    assert rational.Ratio(x * x - y * y, x + y) == rational.Ratio(x - y)
    a, b, c = (rational.Ratio.atom(n) for n in "xyz")
    assert a / (a + b) + b / (a + b) == rational.Ratio.of(1)
    assert (a / b).replaced({"y": b + c}) == a / (b + c)
    with pytest.raises(ZeroDivisionError):
        a / (b - b)


def test_field_laws_on_random_terms():
    pick = random.Random(7)

    def some():
        p = sum((Term({((n, pick.randrange(1, 3)),): Fraction(pick.randrange(-3, 4))}) for n in pick.sample("xy", 2)), Term.number(pick.randrange(1, 4)))
        q = sum((Term({((n, 1),): Fraction(pick.randrange(-2, 3))}) for n in pick.sample("xy", 2)), Term.number(pick.randrange(1, 4)))
        return rational.Ratio(p, q)

    at = {"x": Fraction(5, 7), "y": Fraction(11, 3), "z": Fraction(-13, 5)}
    for _ in range(20):
        a, b, c = some(), some(), some()
        assert (a + b) * c == a * c + b * c
        assert (a * b + c).evaluate(at) == a.evaluate(at) * b.evaluate(at) + c.evaluate(at)
        if not b.is_zero():
            assert a / b * b == a


def test_terms_of_a_sequence_equal_its_numbers():
    """Every variable of the worked sequence as a quotient of some givens, put in numbers."""
    rules = solver.sequence_rules(TRIPOD[:1], [3])
    given = {k: v for k, v in TRIPOD_GIVEN.items() if k.split("_")[1] == "0"} | {"content_init_3": "22"}
    terms = rational.solve(rules, dict.fromkeys(given, True))
    want = solver.solve_exact(rules, given)
    assert set(want) <= set(terms)
    assert all(terms[k].evaluate({a: Fraction(v) for a, v in given.items()}) == v for k, v in want.items())
    before, change, after = rational.differences(rules, {k: True for k in given if k != "p_0_2_3"}, {"p_0_2_3": (Fraction(4), Fraction(1))})["e_0_0_2"]
    at = {a: Fraction(v) for a, v in given.items()}
    assert before.evaluate(at) + change.evaluate(at) == after.evaluate(at) == solver.solve_exact(rules, given | {"p_0_2_3": "5"})["e_0_0_2"]


# mixes ----------------------------------------------------------------------------------------------


def test_parts_determine_totals_and_totals_parts(spark):
    rules = solver.section_rules([("s", "b"), ("u", "b"), ("b", "c"), ("b", "d")], 0)
    df = spark.createDataFrame([(1.0, 4.0, 0.0, 0.0, 6.0, 0.5, 0.5, 0.25)], "dt_0 double, e_0_s_b__s double, e_0_s_b__u double, e_0_u_b__s double, e_0_u_b__u double, eta_0_s_b double, eta_0_u_b double, x_0_b_c double")
    r = mix.solve(df, rules, ["s", "u"], mix.outgoing("b", ["c", "d"])).first()
    assert r["insum_0_b"]["total"] == 5.0 and list(r["insum_0_b"]["mix"]) == [2.0, 3.0]
    assert list(r["e_0_b_c"]["mix"]) == [0.5, 0.75] and list(r["e_0_b_d"]["mix"]) == [1.5, 2.25]
    split = [solver.total("one", ["x_0_a", "x_0_b"]), solver.product("e_0_a", "sum_0", "x_0_a")]
    free = spark.createDataFrame([(0.5, 0.25, 0.5, 8.0, 4.0, 4.0)], "x_0_a double, x_0_a__p double, x_0_a__q double, sum_0 double, sum_0__p double, sum_0__q double")
    r = mix.solve(free, split, ["p", "q"], ones={"p": 1.0, "q": 2.0}).first()
    assert list(r["x_0_b"]["mix"]) == [0.75, 1.5] and r["x_0_b"]["total"] == 0.5 and list(r["e_0_a"]["mix"]) == [1.0, 2.0]


def plain_store(rows, init):
    level, out = list(init), []
    for gains, loss in rows:
        level = [a + b for a, b in zip(level, gains, strict=True)]
        share = min(1.0, loss / sum(level)) if sum(level) else (1.0 if loss else 0.0)
        out.append(([a * (1 - share) for a in level], [a * share for a in level]))
        level = out[-1][0]
    return out


@pytest.mark.parametrize("rows, init", [
    ([([1.0, 0.0], 0.0), ([0.0, 2.0], 3.0), ([0.0, 0.0], 1.0), ([5.0, 1.0], 0.0), ([0.0, 0.0], 7.0), ([1.0, 1.0], 1.0)], [4.0, 0.0]),
    ([([1.0, 0.0] if i % 2 else [0.0, 1.0], 10.0 if i % 3 == 0 else 0.9) for i in range(40)], [10.0, 20.0]),
    ([([9.0, 1.0] if i < 400 else [1.0, 9.0], 10.0) for i in range(1500)], [5.0, 5.0]),
])
def test_storage_mix_equals_a_loop(spark, rows, init):
    """Emptied storages, and a product that would leave the range of doubles."""
    table = [("r", "s", i, g, out, init) for i, (g, out) in enumerate(rows)]
    df = spark.createDataFrame(table, "record_id string, node string, section long, in_mix array<double>, out_sum double, init_mix array<double>")
    got = mix.stored(df, 2).orderBy("section").collect()
    for r, (level, out) in zip(got, plain_store(rows, init), strict=True):
        if sum(level) > 1e-9:
            assert list(r["content_mix"]) == pytest.approx(level, abs=1e-7)
        if r["content"] > 1e-9 or sum(level) > 1e-9:
            assert list(r["out_mix"]) == pytest.approx(out, abs=1e-7)


# drives ---------------------------------------------------------------------------------------------


def test_drives_of_all_records_at_once(spark):
    zeros = {i: x for i, x in enumerate([0.3, -1.7, 5.0, 100.0, 0.0])}
    known = spark.createDataFrame([(i, x) for i, x in zeros.items()], "record_id long, zero double")
    evaluate = lambda trials: trials.join(known, "record_id").withColumn("balance", F.col("drive") - F.col("zero")).drop("zero")
    got = {r["record_id"]: r for r in balance.drives(known, evaluate, step=0.125, rungs=7, parts=8, rounds=4).collect()}
    for i, x in zeros.items():
        if x == 100.0:
            assert not got[i]["bracketed"] and not got[i]["converged"] and got[i]["drive"] == 8.0
        else:
            assert got[i]["low"] <= x <= got[i]["high"] and abs(got[i]["drive"] - x) <= got[i]["high"] - got[i]["low"] and got[i]["converged"] == (abs(got[i]["balance"]) <= 1e-3)


def test_two_storages_in_turn(spark):
    records = spark.createDataFrame([(1,), (2,)], "record_id long")
    pull = {"a": (1.0, 0.25, -1.0), "b": (0.25, 1.0, 0.5)}

    def evaluate(trials, s):
        x, y, z = pull[s]
        return trials.withColumn("balance", x * F.col("drive_a") + y * F.col("drive_b") + z * F.col("record_id"))

    got = balance.all_storages(records, evaluate, ["a", "b"], turns=4, step=0.125, rungs=6, parts=16, rounds=3, most=1e-2).collect()
    for r in got:
        assert abs(r["drive_a"] + 0.25 * r["drive_b"] - r["record_id"]) < 1e-2 and abs(0.25 * r["drive_a"] + r["drive_b"] + 0.5 * r["record_id"]) < 1e-2
        assert r["converged_a"] and r["converged_b"]


# crossings ------------------------------------------------------------------------------------------


def test_signals_that_cross_together(spark):
    rows = [("r", i, float(i), s, v) for s, vs in {"x": [1.0, 0.0, -1.0, 3.0], "y": [2.0, 0.0, 0.0, 1.0], "z": [5.0, 5.0, 5.0, 5.0]}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "record_id string, idx long, t double, sig_id string, v double")
    got = sorted((r["idx"], r["fraction"], r["t"], tuple(r["sig_ids"])) for r in crossing.patterns(df).collect())
    assert got == [(0, 1.0, 1.0, ("x", "y")), (1, 0.0, 1.0, ("x",)), (2, 0.0, 2.0, ("y",)), (2, 0.25, 2.25, ("x",))]
    pieces = {}
    for r in crossing.chopped(df).where("sig_id = 'x'").orderBy("piece", "nth").collect():
        pieces.setdefault(r["piece"], []).append((r["t"], r["v"]))
    assert pieces == {0: [(0.0, 1.0), (1.0, 0.0)], 2: [(1.0, 0.0), (2.0, -1.0)], 3: [(2.0, -1.0), (2.25, 0.0)], 4: [(2.25, 0.0), (3.0, 3.0)]}
    twice = crossing.chopped(df, duplicates=True).where("sig_id = 'x'")
    assert {r["piece"]: r["n"] for r in twice.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 2, 1: 3, 2: 3, 3: 2, 4: 2}


# tables that grow -----------------------------------------------------------------------------------


@pytest.mark.parametrize("beyond", ["none", "last"])
def test_grid_of_three_axes(spark, beyond):
    axes = [[0.0, 1.0, 4.0], [-1.0, 2.0], [0.0, 0.5, 0.75, 2.0]]
    f = lambda x, y, z: 2 * x - 3 * y + z + 7  # noqa: E731  linear, so exact within the grid
    points = [(x, y, z, f(x, y, z)) for x, y, z in itertools.product(*axes) if (x, y, z) != (4.0, 2.0, 2.0)]
    table = spark.createDataFrame(points, "x double, y double, z double, v double")
    pick = random.Random(8)
    asks = [(i, pick.uniform(-1, 5), pick.uniform(-2, 3), pick.uniform(-1, 3)) for i in range(200)] + [(900, 1.0, 2.0, 0.5), (901, None, 1.0, 1.0), (902, float("nan"), 1.0, 1.0), (903, 4.0, 2.0, 2.0), (900, 1.0, 2.0, 0.5)]
    asked = spark.createDataFrame(asks, "k long, x double, y double, z double")
    got = sorted(((r["k"], r["found"]) for r in surface.lookup(table, asked, ["x", "y", "z"], "v", beyond, bucket=7).collect()), key=str)
    want = []
    for k, *at in asks:
        inside = all(a is not None and not math.isnan(a) for a in at)
        if inside and beyond == "last":
            at = [min(max(a, ax[0]), ax[-1]) for a, ax in zip(at, axes, strict=True)]
        inside = inside and all(ax[0] <= a <= ax[-1] for a, ax in zip(at, axes, strict=True))
        lacking = inside and at[0] > 1 and at[1] > -1 and at[2] > 0.75
        want.append((k, None if not inside or lacking else f(*at)))
    for (k, a), (j, b) in zip(got, sorted(want, key=str), strict=True):
        assert k == j and (a is None) == (b is None)
    by = {}
    for k, v in want:
        by[k] = v
    assert all(by[k] is None or abs(by[k] - v) < 1e-9 for k, v in got)


def test_hot_keys_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 4)
    rows = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("long").alias("k"), "id")
    owners = spark.range(0, 50_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.join_owner(rows, owners, ["k"]).agg(F.count(F.lit(1)), F.count("v"), F.sum("v")).first()
    want = rows.join(owners, "k", "left").agg(F.count(F.lit(1)), F.count("v"), F.sum("v")).first()
    assert tuple(got) == tuple(want)


# attribution ----------------------------------------------------------------------------------------


def test_sparse_terms_equal_the_whole_stack(spark):
    pick = random.Random(9)
    names = [f"p{i}" for i in range(4)]
    rows = [(k, *[x for _ in names for x in (pick.uniform(0.5, 2), pick.uniform(-1, 1))]) for k in range(5)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n}_b double, {n}_d double" for n in names))
    whole = delta.Stack.single(F.lit(1.0))
    for n in names:
        whole = whole * delta.Stack.pair(n, F.col(f"{n}_b"), F.col(f"{n}_d"))
    want = {(r["k"], key): v for r in df.select("k", whole.terms().alias("t")).collect() for key, v in r["t"].items()}
    terms = sparse_stack.product(df, ["k"], [(n, F.col(f"{n}_b"), F.col(f"{n}_d")) for n in names], 0.0)
    got = {(r["k"], ",".join(r["changed"]) or "before"): r["value"] for r in terms.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    few = sparse_stack.ranked(sparse_stack.product(df, ["k"], [(n, F.col(f"{n}_b"), F.col(f"{n}_d")) for n in names], 0.2), ["k"]).collect()
    for k in range(5):
        own = [r for r in few if r["k"] == k]
        total = sum(v for (i, _), v in want.items() if i == k)
        assert sum(r["value"] for r in own) == pytest.approx(total)
        big = {key for (i, key), v in want.items() if i == k and abs(v) >= 0.2 * abs(total)}
        assert {r["changed"] for r in own if r["changed"]} == big
    both = sparse_stack.add(terms, terms)
    assert both.agg(F.sum("value")).first()[0] == pytest.approx(2 * sum(want.values()))


# holes ----------------------------------------------------------------------------------------------


def test_holes_take_the_nearest_valid_value(spark):
    pick = random.Random(10)
    rows = [(s, i, j, None if pick.random() < 0.8 else float("nan") if pick.random() < 0.2 else float(10 * i + j)) for s in ("a", "b") for i in range(9) for j in range(7)]
    rows += [("none", i, 0, None) for i in range(3)]
    got = {(r["s"], r["i"], r["j"]): (r["v"], r["from_i"], r["from_j"], r["away"]) for r in holes.filled(spark.createDataFrame(rows, "s string, i long, j long, v double"), ["s"]).collect()}
    assert len(got) == len(rows)
    for s, i, j, _ in rows:
        near = [(abs(i - a) + abs(j - b), a, b, v) for t, a, b, v in rows if t == s and v is not None and not math.isnan(v)]
        want = min(near) if near else None
        assert got[s, i, j] == ((want[3], want[1], want[2], want[0]) if want else (None, None, None, None))
    grid = holes.full_grid(spark.createDataFrame([("a", 0, 0, 1.0), ("a", 2, 1, 2.0)], "s string, i long, j long, v double"), ["s"])
    assert grid.count() == 6 and grid.where("v is null").count() == 4


# long records, long chains, large grids -------------------------------------------------------------


def test_windows_of_a_long_record_take_time_in_proportion(spark):
    """A record of 200,000 samples: frames over what follows must not be worked out anew for each row."""
    n = 200_000
    signals = spark.range(n).select(F.lit("r").alias("record_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("t"), F.lit("x").alias("sig_id"), (F.col("id") * 2.0).alias("v"))
    times = spark.range(n - 1).select(F.lit("r").alias("record_id"), F.col("id").alias("idx"), (F.col("id") + 0.5).alias("t"))
    got = record.resample(signals, times).agg(F.count(F.lit(1)), F.max(F.abs(F.col("v") - F.col("t") * 2))).first()
    assert tuple(got) == (n - 1, 0.0)
    cuts = spark.range(0, n - 1, 100).select(F.lit("r").alias("record_id"), (F.col("id") + 0.25).alias("t"))
    pieces = segment.chop(signals, cuts, interpolate=True)
    assert pieces.agg(F.count(F.lit(1)), F.countDistinct("piece"), F.max(F.abs(F.col("v") - F.col("t") * 2))).first()[:] == (n + 2 * (n // 100), n // 100 + 1, 0.0)


def test_a_chain_of_partial_rows_is_solved_to_its_end(spark):
    rules = [solver.equal(f"v{i}", f"v{i + 1}") for i in range(12)]
    df = spark.createDataFrame([(1, 5.0, None), (2, None, 7.0), (3, None, None)], "k long, v0 double, v12 double")
    got = {r["k"]: r for r in solver.solve(df, rules, rounds=None).collect()}
    assert all(got[1][f"v{i}"] == 5.0 and got[2][f"v{i}"] == 7.0 and got[3][f"v{i}"] is None for i in range(13))


def test_optima_of_a_large_grid(spark, monkeypatch):
    best = spark.createDataFrame([(s, float(i), float(j), 10.0 * s + i + 2 * j) for s in (0, 1) for i in range(4) for j in range(3) if (s, i, j) != (1, 3, 2)], "state int, req_x double, req_y double, p double")
    demand = spark.createDataFrame([("r", i, x, y) for i, (x, y) in enumerate([(0.5, 0.5), (2.5, 1.5), (3.0, 1.0), (9.0, 1.0), (1.0, 2.0)])], "record_id string, idx long, dx double, dy double")
    want = sorted(map(tuple, optimise.interpolate_optimum(best, demand, ["p"]).where("p is not null").collect()))
    monkeypatch.setattr(optimise, "AXIS", 2)
    got = sorted(map(tuple, optimise.interpolate_optimum(best, demand, ["p"]).where("p is not null").collect()))
    assert set(want) <= set(got) and all(abs(p - (10 * s + x + 2 * y)) < 1e-9 for _, _, x, y, s, p in got)
