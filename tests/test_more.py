"""Types, stacks, terms, the search for a balance, and energies of a stream."""

import itertools
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kilojoin.functions import exprs, types
from kilojoin.operators import cube, delta, optimise, record, signal, symbolic
from kilojoin.streaming import energy


def test_types():
    p, dt = types.Typ("A", "P", "Tt"), types.Typ("D", "T", "Tt")
    f, n = types.product(dt, p), types.Typ("A", "N", "Tt")
    assert f == types.Typ("A", "F", "Tt") and types.product(f, n) == f and types.quotient(f, dt) == p
    assert types.total(p, types.successor(p)) == p
    with pytest.raises(TypeError):
        types.product(p, p)
    with pytest.raises(TypeError):
        types.role("Signal", "FSignal")


def test_types_travel_with_signals(spark):
    a = types.set_type(signal.from_lists(spark, {"a": [1.0, 2.0]}), types.Typ("A", "P", "Tt"))
    assert types.typ_of(signal.minus(a, a)) == types.Typ("D", "P", "Tt")
    with pytest.raises(TypeError):
        signal.times(a, a)
    assert types.typ_of(types.untype(a)) == types.UNTYPED
    assert types.typ_of(types.make_absolute(types.make_delta(a))).delta == "A"


def test_stack_algebra(spark):
    a, b, c = delta.Stack.pair("x", F.lit(2.0), F.lit(1.0)), delta.Stack.pair("y", F.lit(5.0), F.lit(-1.0)), delta.Stack.single(F.lit(10.0))
    row = spark.range(1).select((a * b).terms().alias("m"), (a * b).evaluate().alias("v"), ((a + b) * c / c - b).evaluate().alias("w"), (a * b).filtered(before=["x"], delta=["y"]).alias("f"), (a / a).evaluate().alias("one")).first()
    assert row["m"] == {"before": 10.0, "x": 5.0, "y": -2.0, "x,y": -1.0}
    assert (row["v"], row["w"], row["f"], row["one"]) == (12.0, pytest.approx(3.0), -2.0, pytest.approx(1.0))


def test_symbolic_normal_form():
    a, b = symbolic.Term.atom("a"), symbolic.Term.atom("b")
    assert (a + b) * (a - b) == a * a - b * b
    assert (a * b / b - a).is_zero() and ((a + 1) * 2).evaluate({"a": "1/2"}) == 3
    assert (a * b).delta().atoms() == {"a.before", "a.after", "b.before", "b.after"}
    assert set((a * b + a).grouped()) == {frozenset("ab"), frozenset("a")}
    assert repr(a * a / 2) == "1/2*a^2"


def test_balance_search_ends_near_zero():
    drives = optimise.balance_storages(lambda d: {"s": d["s"] - 0.7321, "u": 2 * d["u"] + 1 + 0.01 * d["s"]}, ["s", "u"], most=1e-3)
    assert abs(drives["s"].value - 0.7321) < 1e-3 and abs(2 * drives["u"].value + 1 + 0.01 * drives["s"].value) < 1e-3
    assert optimise.deviation({"a": 1.0, "b": -3.0}) == 12.0


def test_best_index_cases(spark):
    eta = [1.0, 2.0, 3.0]

    def best(objs, oks):
        rows = spark.createDataFrame([(0, i, float(o), float(e), k) for i, (o, e, k) in enumerate(zip(objs, eta, oks, strict=True))], "g int, i int, obj double, eta double, ok boolean")
        got = optimise.find_best(rows, ["g"], condition=F.col("ok")).collect()
        return tuple(got[0])[1:] if got else None

    assert best([5, 1, 4.0], [True, False, True]) is not None
    assert best([5.0, 1.0, 4.0], [True, True, True]) == (0, 5.0, 1.0)
    assert best([5.0, 1.0, 4.0], [False] * 3) is None
    assert best([-5.0, -1.0, -4.0], [True, False, True]) == (2, -4.0, 3.0)
    assert best([-5.0, -1.0, -4.0], [True] * 3) == (1, -1.0, 2.0)
    assert best([float("nan"), 1.0, 1.0], [True] * 3) == (1, 1.0, 2.0)


def test_division_like_doubles(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (6.0, 3.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in rows.select(exprs.safe_div(F.col("a"), F.col("b"))).collect()]
    assert got[0] == float("inf") and got[1] != got[1] and got[2] == float("-inf") and got[3:] == [2.0, None]


def test_record_errors(spark):
    a = signal.from_lists(spark, {"x": [1.0, 2.0]})
    with pytest.raises(Exception, match="twice"):
        record.union(a, a).collect()
    with pytest.raises(Exception, match="times differ"):
        record.union(a, signal.from_lists(spark, {"y": [1.0, 2.0]}, [0.0, 5.0])).collect()
    with pytest.raises(Exception, match="lacks"):
        record.extract(a, ["x", "z"]).collect()
    with pytest.raises(Exception, match="lengths"):
        record.add_signals(a, signal.from_lists(spark, {"y": [1.0]})).collect()


def test_resample_hits_steps(spark):
    df = signal.from_lists(spark, {"x": [1.0, 2.0, 4.0]}, [0.0, 1.0, 1.0])
    times = spark.createDataFrame([("r", 0, 0.5), ("r", 1, 1.0), ("r", 2, 7.0)], "record_id string, idx long, t double")
    got = [r["v"] for r in record.resample(df, times).orderBy("idx").collect()]
    assert got[:2] == [1.5, 3.0] and got[2] != got[2]


def test_cube_axes():
    with pytest.raises(ValueError):
        cube.check_axes([[1.0, 1.0]])


def test_stream_energy_equals_batch(spark, tmp_path):
    """Samples in any order within the lateness count, those beyond it don't."""
    rows = [("a", "s", f"2024-01-01 00:00:{i:02d}", float(i * i % 7)) for i in range(20)]
    far = [("b", "s", "2024-01-01 00:10:00", 0.0)]
    too_late = [("a", "s", "2024-01-01 00:00:03.5", 1000.0), ("b", "s", "2024-01-01 00:10:01", 2.0), ("b", "s", "2024-01-01 00:30:00", 0.0)]
    schema = "record_id string, sig_id string, ts string, v double"
    for batch in (rows[:4] + rows[5:10], rows[12:] + [rows[4]] + rows[10:12], far, too_late):
        spark.createDataFrame(batch, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        time.sleep(0.02)
    stream = spark.readStream.schema("record_id string, sig_id string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = energy.intervals(stream).writeStream.format("memory").queryName("energy_test").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    v = [r[3] for r in rows]
    got = spark.table("energy_test").where("record_id = 'a'").orderBy("ts").collect()
    assert [r["e"] for r in got] == pytest.approx([(a + b) / 2 for a, b in itertools.pairwise(v)]) and all(r["dt"] == pytest.approx(1) for r in got)
    assert [(r["dt"], r["e"]) for r in spark.table("energy_test").where("record_id = 'b'").collect()][0] == (pytest.approx(1), pytest.approx(1))
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
    assert energy.windowed(df, "10 seconds", "1 minute").agg(F.sum("n")).first()[0] == 20


def test_terms_of_products_are_single_products(spark):
    """A term at the threshold counts: corners that cancel would put it a last digit below."""
    before, change, other = 14.230000000000004, -45.64, -2.115000000000002
    s = delta.Stack.pair("b", F.lit(before), F.lit(change)) * delta.Stack.pair("a", F.lit(other), F.lit(2.0)) * delta.Stack.pair("c", F.lit(1.0), F.lit(0.5))
    got, large = spark.range(1).select(s.terms(), delta.threshold(s.terms(), change * other)).first()
    want = {"before": before * other, "b": change * other, "a": before * 2.0, "a,b": change * 2.0}
    assert got == want | {(f"{k},c" if k != "before" else "c"): v * 0.5 for k, v in want.items()}
    assert set(large) == {"b"}
