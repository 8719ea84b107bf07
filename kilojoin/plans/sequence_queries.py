"""Sequences of sections from data."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from kilojoin.operators import mixed, sequence, solver, track
from kilojoin.plans import fixtures as fx
from kilojoin.plans import flow_queries, segment_queries
from kilojoin.plans.fixtures import FLOW, SEG, SIG
from kilojoin.plans.register import query, r
from kilojoin.plans.storage import cut

#: The record number of the worked example among the records of the events.
EXAMPLE = -1


def _example(spark, d):
    """The worked sequence as a record beside those of the table (one row of nation names it)."""
    own = fx.table(spark, d, "nation").where("n_nationkey = 0").select(F.lit(EXAMPLE).cast("long").alias("record_id"))
    values = F.array(*[F.struct(F.lit(int(i)).cast("long").alias("section"), F.lit("_".join([kind, *rest])).alias("variable"), F.lit(float(Fraction(v))).alias("value")) for k, v in flow_queries.TRIPOD_GIVEN.items() for kind, i, *rest in [k.split("_")]])
    return sequence.edges_of(own, flow_queries.TRIPOD, F.col("record_id")), own.select("record_id", F.inline(values))


def record_givens(own):
    """Of every section its time; of forward edges the energy at their start, of backward ones the power at their end; efficiencies; one content of each record: before all of it or after its last section."""
    part, eta = ["record_id", "section"], 0.5 + F.col("section") % 5 / 10.0
    e = F.abs("e_out") / 1e6 + 1
    pair = lambda v, x: F.struct(v.alias("variable"), x.alias("value"))
    known = F.when(F.col("dir") == 0, pair(F.concat_ws("_", F.lit("e"), "n_from", "n_to"), e)).otherwise(pair(F.concat_ws("_", F.lit("p"), "n_to", "n_from"), e * eta / F.col("dt")))
    on = own.where("dir <> 1")
    rows = on.select(*part, F.inline(F.array(known, pair(F.concat_ws("_", F.lit("eta"), "n_from", "n_to"), eta), pair(F.lit("dt"), F.col("dt")))))
    last = own.groupBy("record_id").agg(F.max("section").alias("last"))
    anchor = last.select("record_id", F.when(F.col("record_id") % 2 == 0, F.lit(sequence.START)).otherwise(F.col("last")).alias("section"), F.lit("content_b").alias("variable"), F.lit(1e6).alias("value"))
    return rows.unionByName(anchor).distinct()


#: The golden results of the worked sequence, without those of carried energies that neither begin at the start nor end at the end (fixed values).
EXAMPLE_SQL = """
(0, NULL, 'dt', 1, 1), (1, NULL, 'dt', 2, 1), (2, NULL, 'dt', 1, 1), (2, NULL, 'content_3', 10, 1), (1, NULL, 'content_3', 16, 1), (0, NULL, 'content_3', 6, 1), (-1, NULL, 'content_3', 22, 1),
(0, NULL, 'x_2_3', 8, 25), (0, NULL, 'p_2_3', 4, 1), (1, NULL, 'p_3_2', 5, 1), (2, NULL, 'p_3_2', 6, 1), (0, NULL, 'eta_3_2', 1, 4), (0, NULL, 'eta_2_1', 1, 2),
(0, NULL, 'eta_0_2', 3, 4), (1, NULL, 'eta_0_2', 2, 5), (1, NULL, 'eta_2_3', 3, 5), (2, NULL, 'eta_0_2', 7, 10), (2, NULL, 'eta_3_2', 9, 10), (2, NULL, 'eta_2_1', 1, 1), (1, NULL, 'x_2_3', 2, 5),
(2, NULL, 'x_2_0', 3, 10), (1, NULL, 'insum_1', 20, 1), (0, NULL, 'e_2_3', 4, 1), (0, NULL, 'p_3_2', 16, 1), (0, NULL, 'x_2_0', 17, 25), (0, NULL, 'insum_2', 25, 2), (0, NULL, 'x_1_2', 1, 1),
(0, NULL, 'x_0_2', 1, 1), (0, NULL, 'x_2_1', 1, 1), (0, NULL, 'x_3_2', 1, 1), (0, NULL, 'outsum_2', 25, 2), (1, NULL, 'e_3_2', 10, 1), (1, NULL, 'p_2_3', 25, 3), (1, NULL, 'x_2_0', 1, 1),
(1, NULL, 'e_1_2', 20, 1), (1, NULL, 'x_1_2', 1, 1), (1, NULL, 'insum_3', 10, 1), (1, NULL, 'x_3_2', 1, 1), (1, NULL, 'x_0_2', 1, 1), (1, NULL, 'x_2_1', 3, 5), (2, NULL, 'e_3_2', 6, 1),
(2, NULL, 'p_2_3', 27, 5), (2, NULL, 'x_2_3', 7, 10), (2, NULL, 'x_1_2', 1, 1), (2, NULL, 'x_0_2', 1, 1), (2, NULL, 'x_2_1', 1, 1), (2, NULL, 'outsum_3', 6, 1), (2, NULL, 'x_3_2', 1, 1),
(0, NULL, 'e_3_2', 16, 1), (0, NULL, 'e_2_0', 17, 2), (0, NULL, 'e_2_1', 25, 2), (0, NULL, 'outsum_3', 16, 1), (1, NULL, 'p_1_2', 10, 1), (1, NULL, 'e_2_3', 50, 3), (1, NULL, 'outsum_2', 125, 3),
(1, NULL, 'insum_2', 125, 3), (2, NULL, 'e_2_3', 27, 5), (2, NULL, 'insum_2', 54, 7), (2, NULL, 'outsum_2', 54, 7), (0, NULL, 'p_2_0', 17, 2), (0, NULL, 'p_0_2', 34, 3), (0, NULL, 'p_2_1', 25, 2),
(0, NULL, 'p_1_2', 25, 4), (1, NULL, 'e_2_0', 125, 3), (1, NULL, 'e_2_1', 25, 1), (2, NULL, 'e_2_0', 81, 35), (2, NULL, 'e_2_1', 54, 7), (0, NULL, 'e_0_2', 34, 3), (0, NULL, 'e_1_2', 25, 4),
(0, NULL, 'insum_1', 25, 4), (0, NULL, 'outsum_0', 34, 3), (1, NULL, 'p_2_0', 125, 6), (1, NULL, 'p_0_2', 625, 12), (1, NULL, 'p_2_1', 25, 2), (1, NULL, 'eta_2_1', 4, 5), (2, NULL, 'p_2_0', 81, 35),
(2, NULL, 'p_0_2', 162, 49), (2, NULL, 'p_2_1', 54, 7), (2, NULL, 'p_1_2', 54, 7), (1, NULL, 'e_0_2', 625, 6), (1, NULL, 'outsum_0', 625, 6), (2, NULL, 'e_0_2', 162, 49), (2, NULL, 'e_1_2', 54, 7),
(2, NULL, 'insum_1', 54, 7), (2, NULL, 'outsum_0', 162, 49), (-1, 0, 'ste_3', 16, 1), (-1, 0, 'maxe_3', 22, 1), (-1, 2, 'ste_3', 9, 4), (-1, 2, 'maxe_3', 6, 1),
(-1, 9223372036854775807, 'ste_3', 15, 4), (-1, 9223372036854775807, 'maxe_3', 15, 4), (1, 9223372036854775807, 'ste_3', 25, 4), (1, 9223372036854775807, 'maxe_3', 25, 4)
"""

SOLVED = FLOW + """, own AS (SELECT record_id, section, n_from, n_to, dir, dt, abs(e_out) / 1e6 + 1 AS e, 0.5 + section % 5 / 10.0 AS eta FROM orient WHERE dir <> 1),
sides AS (SELECT record_id, section, n_from AS node, n_to AS other, e AS en, dt, 'o' AS side FROM own UNION ALL SELECT record_id, section, n_to, n_from, e * eta, dt, 'i' FROM own),
ssum AS (SELECT record_id, section, node, side, sum(en) AS s FROM sides GROUP BY ALL),
vals AS (SELECT record_id, section, 'dt' AS variable, min(dt) AS value FROM own GROUP BY ALL
  UNION ALL SELECT record_id, section, 'eta_' || n_from || '_' || n_to, eta FROM own
  UNION ALL SELECT record_id, section, 'e_' || node || '_' || other, en FROM sides
  UNION ALL SELECT record_id, section, 'p_' || node || '_' || other, en / dt FROM sides
  UNION ALL SELECT a.record_id, a.section, 'x_' || a.node || '_' || other, en / s FROM sides a JOIN ssum b ON a.record_id = b.record_id AND a.section = b.section AND a.node = b.node AND a.side = b.side
  UNION ALL SELECT record_id, section, CASE side WHEN 'i' THEN 'insum_' ELSE 'outsum_' END || node, s FROM ssum),
secs AS (SELECT DISTINCT record_id, section FROM orient UNION ALL SELECT DISTINCT record_id, -1 FROM orient),
stor AS (SELECT s.record_id, s.section, coalesce(i.s, 0) AS i, coalesce(o.s, 0) AS o FROM secs s
  LEFT JOIN ssum i ON i.record_id = s.record_id AND i.section = s.section AND i.node = 'b' AND i.side = 'i' LEFT JOIN ssum o ON o.record_id = s.record_id AND o.section = s.section AND o.node = 'b' AND o.side = 'o'),
lvl AS (SELECT *, 1e6 + sum(i - o) OVER (PARTITION BY record_id ORDER BY section) - CASE WHEN record_id % 2 = 0 THEN 0 ELSE sum(i - o) OVER (PARTITION BY record_id) END AS content FROM stor),
shr AS (SELECT *, CASE WHEN o > 0 THEN o / (content + o) ELSE 0 END AS share, first_value(content) OVER (PARTITION BY record_id ORDER BY section) AS init FROM lvl),
lg AS (SELECT *, sum(ln(1 - share)) OVER (PARTITION BY record_id ORDER BY section) AS l1, sum(ln(1 - share)) OVER (PARTITION BY record_id) AS lend FROM shr),
car AS (SELECT record_id, -1 AS section, section AS until, init * exp(l1 - ln(1 - share)) AS m, init * exp(l1 - ln(1 - share)) * share AS e FROM lg WHERE o > 0
  UNION ALL SELECT record_id, -1, 9223372036854775807, any_value(init * exp(lend)), any_value(init * exp(lend)) FROM lg GROUP BY ALL
  UNION ALL SELECT record_id, section, 9223372036854775807, i * exp(lend - l1), i * exp(lend - l1) FROM lg WHERE i > 0),
"""


@query(SOLVED + f"""all_ AS (SELECT record_id, section, NULL::BIGINT AS until, variable, value FROM vals UNION ALL SELECT record_id, section, NULL, 'content_b', content FROM lvl
  UNION ALL SELECT record_id, section, until, 'ste_b', e FROM car UNION ALL SELECT record_id, section, until, 'maxe_b', m FROM car
  UNION ALL SELECT {EXAMPLE}, section, until, variable, a::DOUBLE / b FROM (VALUES {EXAMPLE_SQL}) AS x(section, until, variable, a, b))
SELECT record_id, section::BIGINT AS section, until, variable, round(value, 4) + 0.0 AS value FROM all_""")
def solve_record_sequences(spark, d):
    """Every variable of every section of all records, and of the worked example, each section with the directions that its data has."""
    own = cut(flow_queries.flows(spark, d))  # flows and givens read it several times
    edges, values = _example(spark, d)
    all_ = own.select("record_id", "section", "n_from", "n_to", "dir").unionByName(edges)
    out = sequence.solve(all_, record_givens(own).unionByName(values), ["b", "3"])
    return out.select("record_id", "section", "until", "variable", r("value", 4))


BRANCH = solver.section_rules([("a", "b"), ("b", "c"), ("b", "d")], 0)
#: What a sample's section is given by in the tracked queries, and what some rows know twice.
TRACKED = SIG + """, g AS (SELECT record_id, idx, abs(p1) + 1 AS p, 0.5 + idx % 10 / 25.0 AS eta, 0.25 AS x, 2.0 AS dt,
  idx % 3 = 0 AS twice, CASE WHEN idx % 7 = 0 THEN 0.5 ELSE 0 END AS wrong FROM wide)"""


def tracked_given(spark, d):
    """Every third sample also measures the power behind the first edge, which every seventh measures wrong."""
    eta, p = 0.5 + F.col("idx") % 10 / 25.0, F.abs("p1") + 1
    again = F.when(F.col("idx") % 3 == 0, p * eta + F.when(F.col("idx") % 7 == 0, 0.5).otherwise(0.0))
    return fx.wide(spark, d).select("record_id", "idx", p.alias("p_0_a_b"), eta.alias("eta_0_a_b"), F.lit(0.25).alias("x_0_b_c"), F.lit(2.0).alias("dt_0"), again.alias("p_0_b_a"))


@query(TRACKED + """ SELECT record_id, idx, 1 AS nth, 'p_0_b_a = eta_0_a_b * p_0_a_b' AS rule, 'eta_0_a_b,p_0_a_b,p_0_b_a' AS givens, round(wrong::DOUBLE, 6) AS deviation FROM g WHERE twice AND wrong > 0""")
def tracked_contradictions(spark, d):
    """Of all samples those that contradict themselves, with the rule and the fewest givens that do."""
    _, off = track.solve(tracked_given(spark, d), BRANCH, ["record_id", "idx"])
    return off.select("record_id", "idx", "nth", "rule", F.array_join("givens", ",").alias("givens"), F.round("deviation", 6).alias("deviation"))


@query(TRACKED + """, v AS (SELECT record_id, idx, 'p_0_b_a' AS variable, CASE WHEN twice THEN p * eta + wrong ELSE p * eta END AS value, CASE WHEN NOT twice THEN 'p_0_b_a = eta_0_a_b * p_0_a_b' END AS rule,
  CASE WHEN twice THEN 'p_0_b_a' ELSE 'eta_0_a_b,p_0_a_b' END AS givens FROM g
UNION ALL SELECT record_id, idx, 'e_0_a_b', p * dt, 'e_0_a_b = dt_0 * p_0_a_b', 'dt_0,p_0_a_b' FROM g
UNION ALL SELECT record_id, idx, 'x_0_b_d', 1 - x, '1 = x_0_b_c + x_0_b_d', 'x_0_b_c' FROM g
UNION ALL SELECT record_id, idx, 'outsum_0_b', dt * CASE WHEN twice THEN p * eta + wrong ELSE p * eta END, 'insum_0_b = outsum_0_b', CASE WHEN twice THEN 'dt_0,p_0_b_a' ELSE 'dt_0,eta_0_a_b,p_0_a_b' END FROM g)
SELECT record_id, idx, variable, round(value, 6) AS value, rule, givens FROM v""")
def tracked_values(spark, d):
    """Some values of every sample, each with the rule and the givens that it rests on."""
    values, _ = track.solve(tracked_given(spark, d), BRANCH, ["record_id", "idx"])
    values = values.where(F.col("variable").isin("p_0_b_a", "e_0_a_b", "x_0_b_d", "outsum_0_b"))
    return values.select("record_id", "idx", "variable", F.round("value", 6).alias("value"), "rule", F.array_join("givens", ",").alias("givens"))


MIXED = SEG + """, s AS (SELECT record_id, section, idx, dt / 3600 AS dt, abs(v + w) / 2 + 1 AS p FROM cut WHERE sig_id = 'p1' AND dt > 0),
m AS (SELECT *, p * dt AS e_ab, p * dt * (0.5 + idx % 5 / 10.0) AS e_ba FROM s),
sec AS (SELECT record_id, section, sum(dt) AS time, sum(e_ab) AS ab, sum(e_ba) AS ba, 0.25 + section % 3 / 10.0 AS mean_bc FROM m GROUP BY ALL)
"""


def mixed_grains(spark, d):
    """Samples know what goes into the first edge and how much of it comes out; sections know only the mean power of the second edge."""
    own = segment_queries.cut(spark, d).where("sig_id = 'p1' and dt > 0")
    p, dt = F.abs(F.col("v") + F.col("w")) / 2 + 1, F.col("dt") / 3600
    samples = own.select("record_id", "section", "idx", dt.alias("dt"), p.alias("p_ab"), (0.5 + F.col("idx") % 5 / 10.0).alias("eta_ab"))
    sections = samples.select("record_id", "section").distinct().withColumn("P_bc", 0.25 + F.col("section") % 3 / 10.0)
    signal_rules = [solver.product("e_ab", "dt", "p_ab"), solver.product("e_bc", "dt", "p_bc"), solver.product("e_ba", "eta_ab", "e_ab"), solver.total("e_ba", ["e_bc", "e_bd"])]
    scalar_rules = [solver.product("E_bc", "T", "P_bc"), solver.total("E_ba", ["E_bc", "E_bd"]), solver.product("E_ba", "eta", "E_ab")]
    couplings = [mixed.Coupling("T", "dt"), mixed.Coupling("E_ab", "e_ab"), mixed.Coupling("E_ba", "e_ba"), mixed.Coupling("E_bd", "e_bd"), mixed.Coupling("P_bc", "p_bc", "mean", spread=True)]
    return mixed.solve(samples, sections, signal_rules, scalar_rules, couplings)


@query(MIXED + """SELECT record_id, section, round(time, 4) + 0.0 AS time, round(ab, 4) + 0.0 AS e_ab, round(time * mean_bc, 4) + 0.0 AS e_bc, round(ba - time * mean_bc, 4) + 0.0 AS e_bd, round(ba / ab, 4) + 0.0 AS eta FROM sec""")
def mixed_scalars(spark, d):
    """Section values that follow from samples and section means together."""
    _, sections = mixed_grains(spark, d)
    return sections.select("record_id", "section", *[r(F.col(c), 4).alias(n) for c, n in (("T", "time"), ("E_ab", "e_ab"), ("E_bc", "e_bc"), ("E_bd", "e_bd"), ("eta", "eta"))])


@query(MIXED + """SELECT record_id, section, idx, round(dt * mean_bc, 4) + 0.0 AS e_bc, round(e_ba - dt * mean_bc, 4) + 0.0 AS e_bd FROM m JOIN sec USING (record_id, section)""")
def mixed_signals(spark, d):
    """Sample values that follow from section means, spread over time, and from samples."""
    samples, _ = mixed_grains(spark, d)
    return samples.select("record_id", "section", "idx", r(F.col("e_bc"), 4).alias("e_bc"), r(F.col("e_bd"), 4).alias("e_bd"))
