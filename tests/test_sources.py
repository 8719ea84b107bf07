"""Readers against small files, and the table writer against its reader."""

import pytest
from pyspark.sql import functions as F

from kilojoin.sources import readers


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def rows(df):
    return sorted((r["idx"], r["t"], r["sig_id"], r["v"]) for r in df.collect())


def test_modelica_csv(spark, tmp_path):
    p = write(tmp_path, "a.csv", '"time","x","y ""q""",\n0,1.5,,\n1,2,3e1,\n')
    assert rows(readers.read_modelica_csv(spark, p)) == [(0, 0.0, "x", 1.5), (0, 0.0, 'y "q"', 0.0), (1, 1.0, "x", 2.0), (1, 1.0, 'y "q"', 30.0)]
    bad = write(tmp_path, "b.csv", "t,x,\n0,1,\n")
    with pytest.raises(Exception, match="time"):
        readers.read_modelica_csv(spark, bad).collect()


def test_lines_keep_their_place_over_splits(spark, tmp_path):
    """Files that are cut into many splits, in any order of the splits."""
    (tmp_path / "many").mkdir()
    for name, n in (("a", 3000), ("b", 700), ("c", 1)):
        write(tmp_path / "many", f"{name}.csv", '"time","x;y","' + name + '",\r\n\r\n' + "".join(f"{i},{i * 2},,\r\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = readers.read_modelica_csv(spark, str(tmp_path / "many")).collect()
        ascii_ = readers.read_modelica_ascii(spark, write(tmp_path, "l.asc", "".join(f"{i} {i + 1} 0\n" for i in range(2000)))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["record_id"][-5], r["sig_id"], r["idx"], r["t"], r["v"]) for r in got) == sorted(
        (name, s, i, float(i), v) for name, n in (("a", 3000), ("b", 700), ("c", 1)) for i in range(n) for s, v in (("x;y", 2.0 * i), (name, 0.0))
    )
    assert sorted((r["idx"], r["t"], r["v"]) for r in ascii_) == [(i, float(i), i + 1.0) for i in range(2000)]


def test_rows_of_another_length(spark, tmp_path):
    with pytest.raises(Exception, match="length"):
        readers.read_modelica_csv(spark, write(tmp_path, "g.csv", "time,x,\n0,1,\n1,2,3,\n")).collect()


def test_columns_csv(spark, tmp_path):
    p = write(tmp_path, "c.csv", "name; wert; zwei\n0; 1; 5\n1; 2; 6\n2; 3; 7\n")
    assert rows(readers.read_columns_csv(spark, p, [0, 2], where=F.col("c1") > 1)) == [(1, 1.0, "zwei", 6.0), (2, 2.0, "zwei", 7.0)]
    typed = readers.read_typed_csv(spark, p, "name long, wert double, zwei double")
    assert typed.count() == 3 and typed.agg(F.sum("wert")).first()[0] == 6.0


def test_ascii(spark, tmp_path):
    p = write(tmp_path, "d.asc", " 0 1 2 9\n 1  3 4 9\n")
    assert rows(readers.read_modelica_ascii(spark, p)) == [(0, 0.0, "sig_0", 1.0), (0, 0.0, "sig_1", 2.0), (1, 1.0, "sig_0", 3.0), (1, 1.0, "sig_1", 4.0)]


def test_plt(spark, tmp_path):
    p = write(tmp_path, "e.plt", "Title: x\nmore\n\nDataSet: time\n0, 0\n1, 0.5\n\nDataSet: a.b\n0, 7\n1, 8\n")
    assert rows(readers.read_plt(spark, p)) == [(0, 0.0, "a.b", 7.0), (1, 0.5, "a.b", 8.0)]


def test_tables_round_trip(spark, tmp_path):
    p = write(tmp_path, "f.txt", "#1\ndouble m(2,3) # c\n0 1 2\n1 5 6\ndouble n(1,2)\n4 4.5\n")
    t = readers.read_tables(spark, p).drop("file")
    assert t.count() == 8
    readers.write_tables(t, str(tmp_path / "out"))
    back = readers.read_tables(spark, str(tmp_path / "out")).drop("file")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
    assert sorted(map(tuple, readers.surface(t.where("table = 'm'")).collect())) == [("m", 1.0, 1.0, 5.0), ("m", 1.0, 2.0, 6.0)]
    assert readers.power_signals(t, ["n"]).first()["v"] == 4.5
    with pytest.raises(ValueError):
        readers.parse_tables("double m(2,2)\n1 2 3\n")
