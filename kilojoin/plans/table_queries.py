"""Types, table files, graphs, states, checked combinations and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kilojoin.functions import exprs, types
from kilojoin.operators import delta, flow, lookup, optimise, signal, skew, topology
from kilojoin.plans import fixtures as fx
from kilojoin.plans import flow_queries
from kilojoin.plans.fixtures import FLOW, SIG
from kilojoin.plans.register import query, r
from kilojoin.plans.storage import shared_dir
from kilojoin.sources import readers
from kilojoin.streaming import energy


def _path(spark, kind):
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


# types ----------------------------------------------------------------------------------------------


@query(SIG + """SELECT record_id, idx, round(v * (t2 - t), 6) + 0.0 AS energy, 'A' AS delta, 'F' AS kind, 'D' AS of_change, 'P' AS back FROM nxt WHERE sig_id = 'p1' AND t2 IS NOT NULL""")
def typed_energy(spark, d):
    """Power times time: the type of the product is worked out and checked when the plan is made."""
    w = signal.over()
    rows = fx.one(spark, d).withColumn("dt", F.lead("t").over(w) - F.col("t")).where("dt is not null")
    power, time = types.set_type(rows, types.Typ("A", "P", "Tt")), types.Typ("D", "T", "Tt")
    typ = types.product(time, types.typ_of(power))
    out = types.set_type(power.withColumn("v", F.col("v") * F.col("dt")), typ, role_=types.role("Signal", "Scalar"))
    change, back = types.typ_of(types.make_delta(out)), types.quotient(typ, time)
    assert types.typ_of(types.make_absolute(types.make_delta(out))) == typ and types.total(typ, change) == typ and types.typ_of(types.untype(out)) == types.UNTYPED
    return out.select("record_id", "idx", r(F.col("v"), 6).alias("energy"), *[F.lit(x).alias(n) for n, x in (("delta", typ.delta), ("kind", typ.kind), ("of_change", change.delta), ("back", back.kind))])


@query("SELECT l_orderkey, l_linenumber, (l_quantity * l_quantity * l_quantity)::BIGINT AS cubed, CASE WHEN abs(l_discount - 0.05) <= 0.011 THEN 0 WHEN l_discount > 0.05 THEN 1 ELSE -1 END AS side FROM lineitem")
def whole_powers(spark, d):
    rows = fx.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", exprs.power(F.col("l_quantity"), 3).cast("long").alias("cubed"), exprs.sign_approx(F.col("l_discount") - 0.05, 0.011).alias("side"))


# files ----------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_returnflag AS flag FROM lineitem")
def read_typed_csv(spark, d):
    """Every line through a separated file with a schema."""
    path = _path(spark, "csv")
    fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")).write.option("header", True).option("sep", ";").csv(path)
    return readers.read_typed_csv(spark, path, "l_orderkey long, l_linenumber int, quantity double, flag string")


@query("SELECT c_custkey, c_name || '|' || c_mktsegment AS names, c_nationkey + c_custkey AS total FROM customer")
def read_structured_csv(spark, d):
    """Customers as rows of fields that have several cells."""
    path = _path(spark, "csv")
    c = fx.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.col("c_custkey").alias("again"))
    c.write.option("header", True).option("sep", ";").csv(path)
    rows = readers.read_structured_csv(spark, f"{path}/*.csv", [("key", 1), ("names", 2), ("numbers", 2)])
    number = lambda i: F.get("numbers", F.lit(i)).cast("long")
    return rows.select(F.get("key", F.lit(0)).cast("long").alias("c_custkey"), F.array_join("names", "|").alias("names"), (number(0) + number(1)).alias("total"))


PRICES = "WITH m AS (SELECT l_linenumber AS i, round(l_discount * 100)::INT AS j, round(avg(l_extendedprice), 2) AS v FROM lineitem GROUP BY ALL) "


def _prices(spark, d):
    """Mean prices over line numbers and discounts as a table file with both axes, written and read back."""
    m = fx.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("row"), (F.round(F.col("l_discount") * 100).cast("int") + 1).alias("col")).agg(F.round(F.avg("l_extendedprice"), 2).alias("v"))
    whole = m.unionByName(m.select("row", F.lit(0).alias("col"), F.col("row").cast("double").alias("v")).distinct())
    whole = whole.unionByName(m.select(F.lit(0).alias("row"), "col", (F.col("col") - 1).cast("double").alias("v")).distinct())
    path = _path(spark, "tables")
    readers.write_tables(whole.unionByName(spark.createDataFrame([(0, 0, 0.0)], "row int, col int, v double")).withColumn("table", F.lit("price")), path)
    return readers.read_tables(spark, path)


@query(PRICES + "SELECT i::DOUBLE AS x, j::DOUBLE AS y, v AS z FROM m")
def table_surface(spark, d):
    return readers.surface(_prices(spark, d)).select("x", "y", "z")


@query(PRICES + "SELECT i::DOUBLE AS x, j::DOUBLE AS y, v AS z FROM m")
def table_transposed(spark, d):
    own = readers.surface(readers.transposed(_prices(spark, d)))
    return own.select(F.col("y").alias("x"), F.col("x").alias("y"), "z")


@query("""SELECT 'p' || user_id AS sig_id, ts_s AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts_s, event_id) - 1 AS idx FROM (SELECT user_id % 3 AS user_id, epoch_us(ts) / 1e6 AS ts_s, value, event_id FROM events)""")
def table_power_signals(spark, d):
    """Events in three named tables of times and powers, written, read back and taken as signals."""
    rows = fx.table(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id") % 3).alias("table"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value", "event_id")
    rows = skew.ranked(rows, ["table"], ["t", "event_id"], "row").withColumn("row", F.col("row").cast("int"))
    path = _path(spark, "tables")
    readers.write_tables(rows.select("table", "row", F.posexplode(F.array("t", "value")).alias("col", "v")), path)
    return readers.power_signals(readers.read_tables(spark, path), ["p0", "p1", "p2"]).select("sig_id", "t", "v", "idx")


# graphs and states ----------------------------------------------------------------------------------


def _supply(spark, d):
    n, s = fx.table(spark, d, "nation"), fx.table(spark, d, "supplier")
    regions = n.select(F.concat(F.lit("r"), "n_regionkey").alias("n_from"), F.concat(F.lit("n"), "n_nationkey").alias("n_to"))
    return topology.union(regions, s.select(F.concat(F.lit("n"), "s_nationkey").alias("n_from"), F.concat(F.lit("s"), "s_suppkey").alias("n_to")))


SUPPLY = "WITH e AS (SELECT 'r' || n_regionkey AS n_from, 'n' || n_nationkey AS n_to FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier) "


@query(SUPPLY + "SELECT n_to AS n_from, n_from AS n_to, 2 AS dir FROM e WHERE n_from NOT IN ('r1', 'n2') AND n_to NOT IN ('r1', 'n2')")
def changed_graph(spark, d):
    """Regions, nations and suppliers as one graph, without two nodes, turned around."""
    gone = spark.createDataFrame([("r1",), ("n2",)], "node string")
    return topology.flow_from_plain(topology.reverse(topology.delete_nodes(_supply(spark, d), gone)), topology.BACKWARD)


@query(SUPPLY + "SELECT n_from, n_to FROM e")
def directed_graph(spark, d):
    return topology.directed(topology.flow_from_plain(topology.reverse(_supply(spark, d)), topology.BACKWARD))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 27 = 2 * 9 + 0 * 3 + 0")
def identified_state(spark, d):
    """The lines in the only admissible state that two given edges leave."""
    dirs = topology.identify_state(spark, flow_queries.GRID_NODES, flow_queries.GRID_EDGES, {0: 0, 1: 0, 2: 2})
    return fx.table(spark, d, "lineitem").where(F.col("l_partkey") % 27 == topology.state_index(F.array(*map(F.lit, dirs)))).select("l_orderkey", "l_linenumber")


@query(FLOW + flow_queries.CSUM + """, g AS (SELECT record_id, sum(CASE WHEN node = 'c' THEN in_sum END) AS i, sum(CASE WHEN node = 'a' THEN out_sum END) AS o FROM csum GROUP BY ALL)
SELECT record_id, round(i / (o + 20 * record_id), 6) + 0.0 AS eta FROM g""")
def system_eta_with_storage(spark, d):
    own = flow.cumulate(flow_queries.flows(spark, d))
    content = own.select("record_id").distinct().select("record_id", F.col("record_id").cast("double").alias("init"), F.lit(0.0).alias("exit"))
    return flow.system_eta_with_storage(own, fx.nodes(spark), content).withColumn("eta", r("eta", 6))


@query(FLOW + " SELECT record_id, section, n_from, n_to, round(e_out + e_in, 3) + 0.0 AS both FROM orient WHERE dir <> 1")
def checked_sums(spark, d):
    """Two tables of one set of keys combined; a key that one of them lacks would be an error."""
    own = flow_queries.flows(spark, d).where("dir <> 1")
    keys = ["record_id", "section", "n_from", "n_to"]
    return flow.checked_zip(own.withColumnRenamed("e_out", "value"), own.withColumnRenamed("e_in", "value"), keys, lambda a, b: a + b, name="both").withColumn("both", r("both"))


@query(FLOW + """ SELECT record_id, node, round(sum(v), 3) + 0.0 AS value FROM (SELECT record_id, n_from AS node, -e_out AS v FROM orient WHERE dir <> 1 UNION ALL SELECT record_id, n_to, e_in FROM orient WHERE dir <> 1) GROUP BY ALL""")
def folded_nodes(spark, d):
    """What comes into a node less what goes out of it."""
    own = flow_queries.flows(spark, d).where("dir <> 1")
    return flow.fold_nodes(own, ["record_id"], lambda: -F.col("e_out"), lambda: F.col("e_in")).withColumn("value", r("value"))


# optima, terms, curves ------------------------------------------------------------------------------


@query("""WITH b AS (SELECT l_linenumber AS x, round(l_discount * 100)::INT AS y, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT x::DOUBLE AS x0, string_agg(y::VARCHAR, ',' ORDER BY y) AS ys, round(sum(v), 2) AS total FROM b GROUP BY x""")
def power_matrix(spark, d):
    best = fx.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y")).agg(F.max("l_extendedprice").alias("v"))
    m = optimise.power_matrix(best, "x", "y", "v")
    return m.select("x0", F.array_join(F.transform("xs", lambda y: y.cast("string")), ",").alias("ys"), F.round(F.aggregate("vs", F.lit(0.0), lambda a, v: a + v), 2).alias("total"))


@query(SIG + """, n AS (SELECT *, lead(p1) OVER w - p1 AS d1, lead(p2) OVER w - p2 AS d2 FROM wide WINDOW w AS (PARTITION BY record_id ORDER BY idx))
SELECT record_id, idx, (abs(p1 * p2) >= 100)::INT + (abs(d1 * p2) >= 100)::INT + (abs(p1 * d2) >= 100)::INT + (abs(d1 * d2) >= 100)::INT AS n FROM n WHERE d1 IS NOT NULL""")
def term_threshold(spark, d):
    """How many terms of a product's change are large."""
    w = signal.over(["record_id"])
    rows = fx.wide(spark, d).withColumns({"d1": F.lead("p1").over(w) - F.col("p1"), "d2": F.lead("p2").over(w) - F.col("p2")}).where("d1 is not null")
    s = delta.Stack.pair("a", F.col("p1"), F.col("d1")) * delta.Stack.pair("b", F.col("p2"), F.col("d2"))
    return rows.select("record_id", "idx", F.size(delta.threshold(s.terms(), 100.0)).alias("n"))


@query(SIG + """SELECT record_id, idx, round(CASE WHEN p1 >= 0 THEN 0.5 + least(p1, 100) * 0.004 ELSE 1 / (0.6 + least(-p1, 50) * 0.006) END, 6) AS eta FROM wide""")
def abs_eta_lookup(spark, d):
    """An efficiency of either direction of flow from two curves."""
    f = lookup.abs_eta_function(lookup.eta_function([0.0, 100.0], [0.5, 0.9]), lookup.eta_function([0.0, 50.0], [0.6, 0.9]))
    return fx.wide(spark, d).select("record_id", "idx", F.round(f(F.col("p1")), 6).alias("eta"))


@query(SIG + "SELECT record_id, idx, sig_id, 7.5::DOUBLE AS v, CASE sig_id WHEN 'p3' THEN 1 ELSE 0 END AS chunk FROM sig")
def constant_chunks(spark, d):
    """Signals of one value, two of a record in each chunk."""
    return signal.split(signal.constant_like(fx.signals(spark, d), 7.5), 2).select("record_id", "idx", "sig_id", "v", F.col("chunk").cast("int").alias("chunk"))


# streams --------------------------------------------------------------------------------------------


def _stream(spark, d):
    """Events as files that a stream reads, all in one batch, in tasks of a bounded size."""
    source = _path(spark, "stream")
    ev = fx.table(spark, d, "events").select(F.col("user_id").cast("string").alias("record_id"), F.lit("value").alias("sig_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    ev.write.parquet(source)
    return skew.dealt(spark.readStream.schema(ev.schema).parquet(source), "record_id", rows=ev.count())


def _run(spark, out):
    sink = _path(spark, "sink")
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", _path(spark, "progress")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


@query("""WITH w AS (SELECT user_id::VARCHAR AS record_id, time_bucket(INTERVAL '6 hours', ts) AS w, value FROM events), last AS (SELECT max(ts) - INTERVAL '1 minute' AS m FROM events)
SELECT record_id, epoch_us(w) // 1000000 AS began, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS v_max FROM w, last WHERE w + INTERVAL '6 hours' <= m GROUP BY ALL""")
def stream_windows(spark, d):
    """Windows of event time over a stream of all events; those that the watermark has passed are final."""
    out = _run(spark, energy.windowed(_stream(spark, d), "6 hours", "1 minute"))
    return out.select("record_id", F.unix_seconds(F.col("window.start")).alias("began"), "n", F.round("mean", 6).alias("mean"), "v_max")
