"""Plans and tasks of queries over tables that grow."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kilojoin.operators import flow, mixed, record, signal, skew
from kilojoin.plans import registry, table_queries
from kilojoin.sources import readers

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(skew, "TASK", 20)


def samples(spark, sig="a", records=40, n=10):
    return spark.createDataFrame([(r, i, float(i), sig, float(i * r)) for r in range(records) for i in range(n)], "record_id long, idx long, t double, sig_id string, v double")


def test_split_at_length_runs_in_bounded_tasks(spark, small_tasks):  # F11
    taken, rest = signal.split_at_length(samples(spark), samples(spark).where("v > 50"))
    assert taken.rdd.getNumPartitions() >= 20 and taken.count() + rest.count() == 400


def test_union_with_new_time_runs_in_bounded_tasks(spark, small_tasks):  # F5
    own = record.union_with_new_time(samples(spark), samples(spark, "b"))
    assert len(re.findall(r"RepartitionByExpression \[record_id#\d+L?(?:, sig_id#\d+)?\], \d\d", analyzed(own))) >= 4 and own.count() == 1600


def test_stream_is_read_in_bounded_tasks(spark, small_tasks):  # F9
    stream = table_queries._stream(spark, DATA)
    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert re.search(rf"RepartitionByExpression \[record_id#\d+\], {-(-n // 20)}\b", analyzed(stream))


@pytest.mark.parametrize("name", ["longer_sections", "major_sections", "edge_eta", "accumulate"])  # F17, F18, F21, F20
def test_sections_are_worked_out_once(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, DATA)).split("Initial Plan")[-1]
    assert plan.count("Scan parquet") == 1 and "SortMergeJoin" not in plan


def test_two_grains_are_written_once_a_round(spark, monkeypatch):  # F13, F14
    tables, cut = [], mixed.cut
    monkeypatch.setattr(mixed, "cut", lambda df: tables.append("idx" in df.columns) or cut(df))
    assert registry.QUERIES["mixed_scalars"](spark, DATA).count() and sum(tables) == 2


def test_sections_of_records_are_read_from_one_table(spark, monkeypatch):  # F7
    from kilojoin.plans import sequence_queries

    asked, flows = [], sequence_queries.flow_queries.flows
    monkeypatch.setattr(sequence_queries.flow_queries, "flows", lambda *a: asked.append(flows(*a)) or asked[-1])
    plans, solve = [], sequence_queries.sequence.solve
    monkeypatch.setattr(sequence_queries.sequence, "solve", lambda f, g, s: plans.append(plan_of(g)) or solve(f, g, s))
    sequence_queries.solve_record_sequences(spark, DATA)
    assert "events.parquet" not in plans[0]


def test_attach_keeps_edges_apart_and_drops_half_known_ones(spark):  # F21
    energy = spark.createDataFrame([(1, 0, "p", 2.0, 5.0), (1, 0, "q", 2.0, None), (1, 1, "p", 3.0, 6.0)], "record_id long, section long, sig_id string, dt double, e double")
    edges = spark.createDataFrame([("a", "b", "p", "q"), ("b", "c", "p", "p")], "n_from string, n_to string, sig_out string, sig_in string")
    got = sorted(map(tuple, flow.attach(energy, edges).collect()))
    assert got == [(1, 0, "a", "b", 2.0, 5.0, None), (1, 0, "b", "c", 2.0, 5.0, 5.0), (1, 1, "b", "c", 3.0, 6.0, 6.0)]


def test_ranks_of_a_key_of_any_size(spark, small_tasks):  # F4
    rng = random.Random(1)
    df = spark.createDataFrame([(i % 7 // 5, rng.randrange(60), i) for i in range(500)], "k long, t long, i long")
    got = skew.ranked(df, ["k"], ["t", "i"], "n")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "i")) - 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and plan_of(got).count("_range")


def test_tables_are_written_in_pieces_and_read_by_splits(spark, tmp_path):  # F4
    t = spark.range(5000).select((F.col("id") % 2).cast("string").alias("table"), (F.col("id") / 2).cast("int").alias("row"), F.posexplode(F.array(F.col("id") / 4, F.lit(-0.5))).alias("col", "v"))
    readers.write_tables(t, str(tmp_path / "out"), piece=300)
    (tmp_path / "in.txt").write_text("#1\n1 2\ndouble m(1000, 3) # c\n" + "\n".join(f" {i}\t{i + 1} # x\n{i + 2}" for i in range(1000)) + "\ndouble n(1,2) 4 4.5\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        back, own = (readers.read_tables(spark, str(tmp_path / p)) for p in ("out", "in.txt"))
        assert "Python" not in plan_of(own) and "MapInPandas" not in plan_of(own)
        assert sorted(map(tuple, back.drop("file").collect())) == sorted(map(tuple, t.collect()))
        want = [("m", i, j, float(i + j)) for i in range(1000) for j in range(3)] + [("n", 0, 0, 4.0), ("n", 0, 1, 4.5)]
        assert sorted(map(tuple, own.drop("file").collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "bad.txt").write_text("double m(2,2)\n1 2 3\n")
    with pytest.raises(Exception, match="table m has 3 numbers"):
        readers.read_tables(spark, str(tmp_path / "bad.txt")).collect()


def test_plots_of_one_file(spark, tmp_path):  # F10
    plot = lambda k: f"Title: {k}\nmore\n\nDataSet: time\n0, 0\n1, 0.5\n\nDataSet: a\n0, {k}\n1, 8\n"
    (tmp_path / "a.plt").write_text(plot(3) + plot(4).replace("\n", "\r\n"))
    got = sorted((r["record_id"].rpartition("/")[2], r["idx"], r["t"], r["v"]) for r in readers.read_plt(spark, str(tmp_path / "a.plt")).collect())
    assert got == [("a.plt", 0, 0.0, 3.0), ("a.plt", 1, 0.5, 8.0), ("a.plt#1", 0, 0.0, 4.0), ("a.plt#1", 1, 0.5, 8.0)]
