"""Flows on a topology, states, solvers and differences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kilojoin.operators import delta, flow, segment, solver, symbolic, topology
from kilojoin.plans import fixtures as fx
from kilojoin.plans.fixtures import FLOW, SIG
from kilojoin.plans.register import query, r
from kilojoin.plans.segment_queries import cut


def flows(spark, d):
    return flow.oriented(flow.attach(segment.section_energy(cut(spark, d)), fx.edges(spark)))


def rounded(df, *names):
    return df.withColumns({n: r(F.col(n)) for n in names})


R = "round({0}, 3) + 0.0 AS {0}"


def rs(*names: str) -> str:
    return ", ".join(R.format(n) for n in names)


@query(FLOW + f"SELECT record_id, section, n_from, n_to, dir, {rs('dt', 'e_out', 'e_in')} FROM orient")
def flow_orientation(spark, d):
    return rounded(flows(spark, d), "dt", "e_out", "e_in")


@query(FLOW + "SELECT record_id, section, state_key, state FROM states")
def state_numbering(spark, d):
    return flow.states(flows(spark, d))


@query(FLOW + f"""SELECT record_id, state, n_from, n_to, {rs('dt', 'e_out', 'e_in')} FROM (SELECT record_id, state, n_from, n_to, sum(dt) AS dt, sum(e_out) AS e_out, sum(e_in) AS e_in
FROM orient JOIN states USING (record_id, section) WHERE dir <> 1 GROUP BY ALL)""")
def state_cumulate(spark, d):
    return rounded(flow.cumulate_states(flows(spark, d)), "dt", "e_out", "e_in")


CUM = ", cum AS (SELECT record_id, n_from, n_to, sum(dt) AS dt, sum(e_out) AS e_out, sum(e_in) AS e_in FROM orient WHERE dir <> 1 GROUP BY ALL)"


@query(FLOW + CUM + f" SELECT record_id, n_from, n_to, {rs('dt', 'e_out', 'e_in')} FROM cum")
def cumulated_flow(spark, d):
    return rounded(flow.cumulate(flows(spark, d)), "dt", "e_out", "e_in")


@query(FLOW + f"SELECT record_id, section, node, {rs('in_sum', 'out_sum')} FROM sums")
def node_sums(spark, d):
    return rounded(flow.node_sums(flows(spark, d)), "in_sum", "out_sum")


CSUM = CUM + """, csum AS (SELECT record_id, node, sum(i) AS in_sum, sum(o) AS out_sum FROM (SELECT record_id, n_to AS node, e_in AS i, NULL::DOUBLE AS o FROM cum
  UNION ALL SELECT record_id, n_from, NULL, e_out FROM cum) GROUP BY ALL)"""


@query(FLOW + CSUM + """ SELECT c.record_id, n_from, n_to, round(e_out / a.out_sum, 3) + 0.0 AS x_out, round(CASE WHEN b.in_sum <> 0 THEN e_in / b.in_sum END, 3) + 0.0 AS x_in
FROM cum c JOIN csum a ON a.record_id = c.record_id AND a.node = n_from JOIN csum b ON b.record_id = c.record_id AND b.node = n_to""")
def split_factors(spark, d):
    return rounded(flow.split_factors(flow.cumulate(flows(spark, d)), ["record_id"]), "x_out", "x_in")


@query(FLOW + CUM + " SELECT record_id, n_from, n_to, round(e_in / e_out, 3) + 0.0 AS eta, round(e_out / dt, 3) + 0.0 AS power FROM cum")
def edge_eta(spark, d):
    return rounded(flow.edge_etas(flow.cumulate(flows(spark, d)), ["record_id"]), "eta", "power")


@query(FLOW + CSUM + """ SELECT record_id, round(sum(CASE WHEN node = 'c' THEN in_sum END) / sum(CASE WHEN node = 'a' THEN out_sum END), 3) + 0.0 AS eta FROM csum GROUP BY ALL""")
def system_eta(spark, d):
    return flow.system_eta(flow.cumulate(flows(spark, d)), fx.nodes(spark), ["record_id"]).withColumn("eta", r("eta"))


STORE = ", stor AS (SELECT * FROM sums WHERE node = 'b')"


@query(FLOW + STORE + """ SELECT record_id, section, node, round(1000 + sum(coalesce(in_sum, 0) - coalesce(out_sum, 0)) OVER (PARTITION BY record_id, node ORDER BY section), 3) + 0.0 AS content FROM stor""")
def storage_content(spark, d):
    return flow.storage_content(flow.storage_sums(flows(spark, d), fx.nodes(spark)), 1000.0).withColumn("content", r("content"))


@query(FLOW + STORE + " SELECT record_id, node, round(sum(coalesce(in_sum, 0) - coalesce(out_sum, 0)), 3) + 0.0 AS balance FROM stor GROUP BY ALL")
def storage_balance(spark, d):
    return flow.balance(flow.storage_sums(flows(spark, d), fx.nodes(spark))).withColumn("balance", r("balance"))


@query("""WITH s AS (SELECT l_suppkey % 10 AS record_id, l_linenumber::BIGINT AS section, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
g AS (SELECT record_id, section, CASE WHEN section % 2 = 1 THEN q END AS i, CASE WHEN section % 2 = 0 THEN q / 4 END AS o FROM s),
c AS (SELECT *, 1000 + sum(coalesce(i, 0) - coalesce(o, 0)) OVER w AS after_ FROM g WINDOW w AS (PARTITION BY record_id ORDER BY section)),
k AS (SELECT *, CASE WHEN o > 0 THEN o / (after_ + o) ELSE 0 END AS share FROM c),
ch AS (SELECT DISTINCT record_id, -1::BIGINT AS f, 1000.0::DOUBLE AS e FROM k UNION ALL SELECT record_id, section, i FROM k WHERE i > 0),
di AS (SELECT record_id, section AS t, share FROM k WHERE o > 0 UNION ALL SELECT DISTINCT record_id, 9223372036854775807, 1.0 FROM k)
SELECT ch.record_id, 'b' AS node, f AS part_from, t AS part_to, round(e * p, 3) AS max_energy, round(e * p * share, 3) AS energy FROM (
  SELECT ch.record_id, f, t, e, share, coalesce((SELECT product(1 - k.share) FROM k WHERE k.record_id = ch.record_id AND k.section > f AND k.section < t), 1) AS p
  FROM ch JOIN di ON ch.record_id = di.record_id AND f < t) ch""")
def carry_edges(spark, d):
    s = fx.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("record_id"), F.col("l_linenumber").cast("long").alias("section")).agg(F.sum("l_quantity").alias("q"))
    sums = s.select("record_id", "section", F.lit("b").alias("node"), F.when(F.col("section") % 2 == 1, F.col("q")).alias("in_sum"), F.when(F.col("section") % 2 == 0, F.col("q") / 4).alias("out_sum"))
    return rounded(flow.carry_edges(sums, 1000.0), "max_energy", "energy")


RULES = solver.section_rules([("a", "b"), ("b", "c"), ("b", "d")], 0)


@query(SIG + """, g AS (SELECT record_id, idx, abs(p1) + 1 AS p, 0.5 + idx % 10 / 25.0 AS eta, 0.25 AS x, 2.0 AS dt FROM wide)
SELECT record_id, idx, round(p * dt, 6) AS e_0_a_b, round(p * eta * dt, 6) AS e_0_b_a, round(p * eta * dt * x, 6) AS e_0_b_c, round(p * eta * dt * (1 - x), 6) AS e_0_b_d,
  round(p * eta * x * 0.5, 6) AS p_0_c_b, round(1 - x, 6) AS x_0_b_d, round(p * eta * dt, 6) AS insum_0_b FROM g""")
def solve_section(spark, d):
    """Power, efficiencies and one share are given for every sample; the rest follows."""
    given = fx.wide(spark, d).select("record_id", "idx", (F.abs("p1") + 1).alias("p_0_a_b"), (0.5 + F.col("idx") % 10 / 25.0).alias("eta_0_a_b"), F.lit(0.25).alias("x_0_b_c"), F.lit(2.0).alias("dt_0"), F.lit(0.5).alias("eta_0_b_c"))
    out = solver.solve(given, RULES)
    return out.select("record_id", "idx", *[F.round(c, 6).alias(c) for c in ("e_0_a_b", "e_0_b_a", "e_0_b_c", "e_0_b_d", "p_0_c_b", "x_0_b_d", "insum_0_b")])


#: A sequence of three sections with a storage: givens of a worked example, of which everything else follows.
TRIPOD = [[(0, 2), (2, 1), (3, 2)], [(0, 2), (2, 1), (2, 3)], [(0, 2), (2, 1), (3, 2)]]
TRIPOD_GIVEN = {
    "dt_0": "1", "dt_1": "2", "dt_2": "1", "content_2_3": "10", "x_0_2_3": "8/25", "p_0_2_3": "4", "p_1_3_2": "5", "p_2_3_2": "6", "eta_0_3_2": "1/4", "eta_0_2_1": "1/2",
    "eta_0_0_2": "3/4", "eta_1_0_2": "2/5", "eta_1_2_3": "3/5", "eta_2_0_2": "7/10", "eta_2_3_2": "9/10", "eta_2_2_1": "1", "x_1_2_3": "2/5", "x_2_2_0": "3/10", "insum_1_1": "20",
}


#: The golden results of the worked sequence (fixed values).
@query("""SELECT s_suppkey, variable, round(a::DOUBLE / b * CASE WHEN split_part(variable, '_', 1) IN ('dt', 'x', 'eta', 'stx') THEN 1 ELSE s_suppkey % 7 + 1 END, 6) + 0.0 AS value FROM supplier, (VALUES
('dt_0', 1, 1), ('dt_1', 2, 1), ('dt_2', 1, 1), ('content_2_3', 10, 1), ('x_0_2_3', 8, 25), ('p_0_2_3', 4, 1), ('p_1_3_2', 5, 1), ('p_2_3_2', 6, 1), ('eta_0_3_2', 1, 4),
('eta_0_2_1', 1, 2), ('eta_0_0_2', 3, 4), ('eta_1_0_2', 2, 5), ('eta_1_2_3', 3, 5), ('eta_2_0_2', 7, 10), ('eta_2_3_2', 9, 10), ('eta_2_2_1', 1, 1), ('x_1_2_3', 2, 5),
('x_2_2_0', 3, 10), ('insum_1_1', 20, 1), ('e_0_2_3', 4, 1), ('p_0_3_2', 16, 1), ('x_0_2_0', 17, 25), ('insum_0_2', 25, 2), ('x_0_1_2', 1, 1), ('x_0_0_2', 1, 1),
('x_0_2_1', 1, 1), ('x_0_3_2', 1, 1), ('outsum_0_2', 25, 2), ('e_1_3_2', 10, 1), ('p_1_2_3', 25, 3), ('x_1_2_0', 1, 1), ('e_1_1_2', 20, 1), ('x_1_1_2', 1, 1),
('insum_1_3', 10, 1), ('x_1_3_2', 1, 1), ('x_1_0_2', 1, 1), ('x_1_2_1', 3, 5), ('e_2_3_2', 6, 1), ('p_2_2_3', 27, 5), ('x_2_2_3', 7, 10), ('x_2_1_2', 1, 1), ('x_2_0_2',
1, 1), ('x_2_2_1', 1, 1), ('outsum_2_3', 6, 1), ('x_2_3_2', 1, 1), ('level_2_3', 16, 1), ('content_1_3', 16, 1), ('stinsum_exit_3', 10, 1), ('stoutsum_1_3', 10, 1),
('stinsum_2_3', 6, 1), ('maxe_1_2_3', 10, 1), ('stx_0_init_3', 1, 1), ('e_0_3_2', 16, 1), ('e_0_2_0', 17, 2), ('e_0_2_1', 25, 2), ('outsum_0_3', 16, 1), ('p_1_1_2', 10,
1), ('e_1_2_3', 50, 3), ('outsum_1_2', 125, 3), ('insum_1_2', 125, 3), ('e_2_2_3', 27, 5), ('insum_2_2', 54, 7), ('outsum_2_2', 54, 7), ('level_1_3', 16, 1),
('content_0_3', 6, 1), ('stinsum_0_3', 16, 1), ('ste_init_0_3', 16, 1), ('p_0_2_0', 17, 2), ('p_0_0_2', 34, 3), ('p_0_2_1', 25, 2), ('p_0_1_2', 25, 4), ('e_1_2_0', 125,
3), ('e_1_2_1', 25, 1), ('e_2_2_0', 81, 35), ('e_2_2_1', 54, 7), ('level_0_3', 22, 1), ('content_init_3', 22, 1), ('stoutsum_init_3', 22, 1), ('stx_init_0_3', 8, 11),
('maxe_init_0_3', 22, 1), ('maxe_init_2_3', 6, 1), ('local_0_3', 22, 1), ('local_2_3', 16, 1), ('stx_2_init_3', 3, 8), ('stx_2_1_3', 5, 8), ('e_0_0_2', 34, 3),
('e_0_1_2', 25, 4), ('insum_0_1', 25, 4), ('outsum_0_0', 34, 3), ('p_1_2_0', 125, 6), ('p_1_0_2', 625, 12), ('p_1_2_1', 25, 2), ('eta_1_2_1', 4, 5), ('p_2_2_0', 81, 35),
('p_2_0_2', 162, 49), ('p_2_2_1', 54, 7), ('p_2_1_2', 54, 7), ('ste_init_2_3', 9, 4), ('ste_1_2_3', 15, 4), ('e_1_0_2', 625, 6), ('outsum_1_0', 625, 6), ('e_2_0_2', 162,
49), ('e_2_1_2', 54, 7), ('insum_2_1', 54, 7), ('outsum_2_0', 162, 49), ('ste_init_exit_3', 15, 4), ('stx_init_2_3', 9, 88), ('stx_init_exit_3', 15, 88),
('maxe_init_exit_3', 15, 4), ('ste_1_exit_3', 25, 4), ('stx_1_2_3', 3, 8), ('stx_1_exit_3', 5, 8), ('maxe_1_exit_3', 25, 4), ('stx_exit_init_3', 3, 8), ('stx_exit_1_3',
5, 8), ('local_exit_3', 10, 1)
) AS x(variable, a, b)""")
def solve_sequence(spark, d):
    """Every variable of the worked sequence for every supplier, whose number scales all powers; the SQL has the exact fractions."""
    from fractions import Fraction

    rules = solver.sequence_rules(TRIPOD, [3])
    scale = (F.col("s_suppkey") % 7 + 1).cast("double")
    given = {k: F.lit(float(Fraction(v))) * (scale if k.split("_")[0] in ("p", "insum", "content") else F.lit(1.0)) for k, v in TRIPOD_GIVEN.items()}
    rows = solver.tidy(solver.solve(fx.table(spark, d, "supplier").select("s_suppkey", *[c.alias(k) for k, c in given.items()]), rules), rules, ["s_suppkey"])
    return rows.select("s_suppkey", "variable", r("value", 6))


HALVES = """, halves AS (SELECT o.*, o.section * 2 > max(o.section) OVER (PARTITION BY o.record_id) AS late FROM orient o),
hcum AS (SELECT record_id, late, n_from, n_to, sum(e_out) AS e_out FROM halves WHERE dir <> 1 GROUP BY ALL)"""


@query(FLOW + HALVES + """ SELECT record_id, n_from, n_to, round(a.e_out, 3) + 0.0 AS before, round(b.e_out - a.e_out, 3) + 0.0 AS delta, round(b.e_out, 3) + 0.0 AS after
FROM (SELECT * FROM hcum WHERE NOT late) a FULL JOIN (SELECT * FROM hcum WHERE late) b USING (record_id, n_from, n_to)""")
def delta_before_after(spark, d):
    """The cumulated flows of the earlier sections of every record against those of the later ones."""
    last = F.max("section").over(Window.partitionBy("record_id"))
    halves = flows(spark, d).withColumn("late", F.col("section") * 2 > last)
    early, late = flow.cumulate(halves.where("not late")), flow.cumulate(halves.where("late"))
    return rounded(flow.differences(early, late, ["record_id", "n_from", "n_to"], "e_out"), "before", "delta", "after")


@query(SIG + """SELECT record_id, idx, round(p1 * p2, 6) + 0.0 AS before, round((q1 - p1) * p2, 6) + 0.0 AS by_first, round(p1 * (q2 - p2), 6) + 0.0 AS by_second, round((q1 - p1) * (q2 - p2), 6) + 0.0 AS by_both
FROM (SELECT *, lead(p1) OVER w AS q1, lead(p2) OVER w AS q2 FROM wide WINDOW w AS (PARTITION BY record_id ORDER BY idx)) WHERE q1 IS NOT NULL""")
def stack_product(spark, d):
    from kilojoin.operators.signal import over

    w = over(["record_id"])
    rows = fx.wide(spark, d).withColumns({"q1": F.lead("p1").over(w), "q2": F.lead("p2").over(w)}).where("q1 is not null")
    s = delta.Stack.pair("a", F.col("p1"), F.col("q1") - F.col("p1")) * delta.Stack.pair("b", F.col("p2"), F.col("q2") - F.col("p2"))
    t = rows.select("record_id", "idx", s.terms().alias("m"))
    return t.select("record_id", "idx", *[r(F.element_at("m", k), 6).alias(n) for n, k in (("before", "before"), ("by_first", "a"), ("by_second", "b"), ("by_both", "a,b"))])


@query(SIG + "SELECT record_id, idx, round(p1 * p2 + 2 * p1 * p1 / 3.0 - p3, 6) + 0.0 AS v FROM wide")
def symbolic_evaluate(spark, d):
    a, b, c = map(symbolic.Term.atom, ("p1", "p2", "p3"))
    term = a * (b + a * 2 / 3) - c
    return fx.wide(spark, d).select("record_id", "idx", r(term.column(), 6).alias("v"))


GRID_NODES = {"s": "Source", "x": "Crossing", "k": "Sink", "m": "Storage"}
GRID_EDGES = [("s", "x"), ("x", "k"), ("x", "m")]


@query("""WITH s AS (SELECT l_partkey % 27 AS state, l_partkey % 3 AS d0, l_partkey // 3 % 3 AS d1, l_partkey // 9 % 3 AS d2 FROM lineitem),
f AS (SELECT *, (d0 = 0)::INT + (d1 = 2)::INT + (d2 = 2)::INT AS ins, (d0 = 2)::INT + (d1 = 0)::INT + (d2 = 0)::INT AS outs FROM s WHERE d0 <> 2 AND d1 <> 2)
SELECT state, count(*) AS n FROM f WHERE (ins > 0) = (outs > 0) GROUP BY state""")
def admissible_states(spark, d):
    """How many lines are in each admissible state of a topology, if their part numbers tell the state."""
    states = topology.admissible_states(spark, GRID_NODES, GRID_EDGES).select(topology.state_index(F.col("dirs")).alias("state"))
    own = fx.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 27).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return own.join(flow.small(states), "state").select("state", "n")


@query("SELECT l_orderkey, l_linenumber, l_partkey % 27 AS state, l_partkey % 3 AS d0, l_partkey // 3 % 3 AS d1, l_partkey // 9 % 3 AS d2 FROM lineitem")
def absolute_state_index(spark, d):
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", topology.state_from_index(F.col("l_partkey") % 27, 3).alias("dirs"))
    return rows.select("l_orderkey", "l_linenumber", topology.state_index(F.col("dirs")).alias("state"), *[F.get("dirs", F.lit(i)).cast("long").alias(f"d{i}") for i in range(3)])


@query("""SELECT 'r' || n_regionkey AS node, 0::BIGINT AS ins, count(*) AS outs FROM nation GROUP BY ALL UNION ALL SELECT 'n' || n_nationkey, 1, 0 FROM nation""")
def node_degrees(spark, d):
    n = fx.table(spark, d, "nation")
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("n_from"), F.concat(F.lit("n"), "n_nationkey").alias("n_to"))
    return topology.neighbours(edges)


@query("SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'r1'")
def reachable_nodes(spark, d):
    n = fx.table(spark, d, "nation")
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("n_from"), F.concat(F.lit("n"), "n_nationkey").alias("n_to"))
    return topology.reachable(edges, "r1")


@query("""SELECT n_name AS n_from, c_mktsegment AS n_to, round(sum(o_totalprice), 2) AS e_out, round(sum(o_totalprice) / any_value(all_), 6) AS x_out
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT c_nationkey AS k, sum(o_totalprice) AS all_ FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) ON k = c_nationkey GROUP BY ALL""")
def trade_flows(spark, d):
    """Orders as flows from nations to market segments, with each segment's share of the nation."""
    o, c, n = (fx.table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = o.select("o_custkey", "o_totalprice").join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy("c_nationkey", "c_mktsegment").agg(F.sum("o_totalprice").alias("e_out")).join(flow.small(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    f = rows.select(F.lit(0).alias("part"), F.col("n_name").alias("n_from"), F.col("c_mktsegment").alias("n_to"), "e_out", F.col("e_out").alias("e_in"))
    shares = flow.split_factors(f, ["part"]).select("n_from", "n_to", "x_out")
    return f.join(shares, ["n_from", "n_to"]).select("n_from", "n_to", F.round("e_out", 2).alias("e_out"), F.round("x_out", 6).alias("x_out"))
