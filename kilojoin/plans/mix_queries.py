"""Quotients of sums, mixes by origin, and drives of all records."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilojoin.operators import balance, mix, rational, segment, solver
from kilojoin.plans import fixtures as fx
from kilojoin.plans import segment_queries
from kilojoin.plans.fixtures import SEG, SIG
from kilojoin.plans.register import query, r

# symbolic results with quotients by sums ------------------------------------------------------------

BRANCH = solver.section_rules([("a", "b"), ("b", "c"), ("b", "d")], 0)
BRANCH_GIVEN = ["dt_0", "p_0_c_b", "p_0_d_b", "eta_0_a_b", "eta_0_b_c", "eta_0_b_d"]
GIVEN_SQL = SIG + """, g AS (SELECT record_id, idx, 2.0 AS dt, abs(p1) + 1 AS pc, abs(p2) + 2 AS pd, 0.5 + idx % 10 / 25.0 AS ea, 0.8 AS ec, 0.5 + idx % 3 / 10.0 AS ed FROM wide),
s AS (SELECT *, pc / ec AS bc, pd / ed AS bd FROM g)"""


def branch_given(spark, d):
    idx = F.col("idx")
    return fx.wide(spark, d).select("record_id", "idx", F.lit(2.0).alias("dt_0"), (F.abs("p1") + 1).alias("p_0_c_b"), (F.abs("p2") + 2).alias("p_0_d_b"), (0.5 + idx % 10 / 25.0).alias("eta_0_a_b"), F.lit(0.8).alias("eta_0_b_c"), (0.5 + idx % 3 / 10.0).alias("eta_0_b_d"))


@query(GIVEN_SQL + """ SELECT record_id, idx, round(bc / (bc + bd), 9) AS x_b_c, round((bc + bd) / ea, 6) AS p_a_b, round((pc + pd) * ea / (bc + bd), 9) AS eta_all FROM s""")
def symbolic_section(spark, d):
    """Share, demand and efficiency of a section as terms of what its sinks need, evaluated for every sample."""
    terms = rational.solve(BRANCH, dict.fromkeys(BRANCH_GIVEN, True))
    all_ = (terms["e_0_c_b"] + terms["e_0_d_b"]) / terms["e_0_a_b"]
    return branch_given(spark, d).select("record_id", "idx", F.round(terms["x_0_b_c"].column(), 9).alias("x_b_c"), F.round(terms["p_0_a_b"].column(), 6).alias("p_a_b"), F.round(all_.column(), 9).alias("eta_all"))


@query(GIVEN_SQL + """, n AS (SELECT *, lead(pc) OVER w AS qc FROM s WINDOW w AS (PARTITION BY record_id ORDER BY idx))
SELECT record_id, idx, round(bc / (bc + bd), 9) AS before, round(qc / ec / (qc / ec + bd) - bc / (bc + bd), 9) + 0.0 AS delta, round(qc / ec / (qc / ec + bd), 9) AS after FROM n WHERE qc IS NOT NULL""")
def symbolic_differences(spark, d):
    """How a share changes when one need does, as terms of the need before and of its change."""
    from kilojoin.operators.signal import over

    terms = rational.differences(BRANCH, {v: True for v in BRANCH_GIVEN if v != "p_0_c_b"}, {"p_0_c_b": "before_delta"})["x_0_b_c"]
    rows = branch_given(spark, d).withColumn("next", F.lead("p_0_c_b").over(over(["record_id"]))).where("next is not null")
    own = {"p_0_c_b.before": F.col("p_0_c_b"), "p_0_c_b.delta": F.col("next") - F.col("p_0_c_b")}
    of = lambda a: own.get(a, F.col(a) if a not in own else None)
    return rows.select("record_id", "idx", *[r(t.column(of), 9).alias(n) for n, t in zip(("before", "delta", "after"), terms, strict=True)])


# mixes ----------------------------------------------------------------------------------------------

FORK = solver.section_rules([("s", "b"), ("u", "b"), ("b", "c"), ("b", "d")], 0)


@query(SIG + """, g AS (SELECT record_id, idx, abs(p1) + 1 AS es, abs(p2) + 2 AS eu, 0.5 + idx % 10 / 25.0 AS eta FROM wide)
SELECT record_id, idx, round((es * eta + eu * 0.9) * 0.3, 6) AS total, round(es * eta * 0.3, 6) AS from_s, round(eu * 0.9 * 0.3, 6) AS from_u, round(es * eta / (es * eta + eu * 0.9), 6) AS share_s FROM g""")
def section_mix(spark, d):
    """What reaches a sink from two sources through a crossing, by origin, in every sample."""
    given = fx.wide(spark, d).select(
        "record_id", "idx", F.lit(1.0).alias("dt_0"), (F.abs("p1") + 1).alias("e_0_s_b__s"), F.lit(0.0).alias("e_0_s_b__u"), F.lit(0.0).alias("e_0_u_b__s"), (F.abs("p2") + 2).alias("e_0_u_b__u"),
        (0.5 + F.col("idx") % 10 / 25.0).alias("eta_0_s_b"), F.lit(0.9).alias("eta_0_u_b"), F.lit(0.3).alias("x_0_b_c"),
    )
    out = mix.solve(given, FORK, ["s", "u"], mix.outgoing("b", ["c", "d"]))
    e = F.col("e_0_b_c")
    at = lambda v, i: F.get(v["mix"], F.lit(i))
    sums = F.col("insum_0_b")
    return out.select("record_id", "idx", F.round(e["total"], 6).alias("total"), F.round(at(e, 0), 6).alias("from_s"), F.round(at(e, 1), 6).alias("from_u"), F.round(at(sums, 0) / sums["total"], 6).alias("share_s"))


STORED = SEG + """, e AS (SELECT record_id, section, max(CASE WHEN sig_id = 'p1' THEN abs(e) END) / 1e6 AS a, max(CASE WHEN sig_id = 'p2' THEN abs(e) END) / 1e6 AS b, max(CASE WHEN sig_id = 'p3' THEN abs(e) END) / 1e6 AS c FROM energy GROUP BY ALL),
x AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY section) AS k, section, CASE WHEN section % 2 = 0 THEN a + 1 ELSE 0 END AS i1, CASE WHEN section % 3 = 0 THEN b + 1 ELSE 0 END AS i2, CASE WHEN section % 2 = 1 THEN c + 0.5 ELSE 0 END AS o FROM e)
"""


@query("WITH RECURSIVE " + STORED.removeprefix("WITH ") + """, run AS (
  SELECT record_id, k, section, (1000.0::DOUBLE) * (1 - o / (1000 + i1 + i2)) AS c0, (i1::DOUBLE) * (1 - o / (1000 + i1 + i2)) AS c1, (i2::DOUBLE) * (1 - o / (1000 + i1 + i2)) AS c2, (o::DOUBLE) * i1 / (1000 + i1 + i2) AS out1 FROM x WHERE k = 1
  UNION ALL SELECT x.record_id, x.k, x.section, c0 * (1 - o / (c0 + c1 + c2 + i1 + i2)), (c1 + i1) * (1 - o / (c0 + c1 + c2 + i1 + i2)), (c2 + i2) * (1 - o / (c0 + c1 + c2 + i1 + i2)), o * (c1 + i1) / (c0 + c1 + c2 + i1 + i2)
  FROM run JOIN x ON x.record_id = run.record_id AND x.k = run.k + 1)
SELECT record_id, section, round(c0 + c1 + c2, 4) AS content, round(c0, 4) AS from_start, round(c1, 4) AS from_first, round(c2, 4) AS from_second, round(out1, 4) + 0.0 AS out_first FROM run""")
def storage_mix(spark, d):
    """Origins of what a storage holds, and of what is taken from it, over the sections of every record: two sources and what it held at the start."""
    e = segment.section_energy(segment_queries.cut(spark, d)).groupBy("record_id", "section").agg(*[F.max(F.when(F.col("sig_id") == s, F.abs("e"))).alias(s) for s in ("p1", "p2", "p3")])
    n = F.col("section")
    on = lambda test, c, plus: F.when(test, F.col(c) / 1e6 + plus).otherwise(0.0)
    rows = e.select("record_id", F.lit("b").alias("node"), "section", F.array(F.lit(0.0), on(n % 2 == 0, "p1", 1), on(n % 3 == 0, "p2", 1)).alias("in_mix"), on(n % 2 == 1, "p3", 0.5).alias("out_sum"), F.array(F.lit(1000.0), F.lit(0.0), F.lit(0.0)).alias("init_mix"))
    at = lambda c, i: r(F.get(c, F.lit(i)), 4)
    out = mix.stored(rows, 3)
    return out.select("record_id", "section", r("content", 4), *[at("content_mix", i).alias(f"from_{s}") for i, s in enumerate(("start", "first", "second"))], at("out_mix", 1).alias("out_first"))


# drives ---------------------------------------------------------------------------------------------

#: Three ways to meet a sample's need: its efficiency, and what it puts into the storage.
WAYS = SIG + """, w AS (SELECT record_id, idx, unnest([0.9 - abs(p1) / 400, 0.6 + abs(p2) / 400, 0.7]) AS eta, unnest([-abs(p1) / 20 - 1, 2.0, 0.0]) AS store FROM wide)"""


def ways(spark, d):
    """record_id, idx, ways (array of eta, store)."""
    a, b = F.abs("p1"), F.abs("p2")
    way = lambda eta, store: F.struct(eta.alias("eta"), store.alias("store"))
    return fx.wide(spark, d).select("record_id", "idx", F.array(way(0.9 - a / 400, -a / 20 - 1), way(0.6 + b / 400, F.lit(2.0)), way(F.lit(0.7), F.lit(0.0))).alias("ways"))


def balances(own):
    """For trials (record_id, drive) the sum of what the best ways put into the storage, if the storage's content is worth the drive.

    A record's trials meet its samples as one array, and a sample's best way is found within its row, so that only samples and sums are shuffled.
    """

    def evaluate(trials):
        met = own.join(trials.groupBy("record_id").agg(F.collect_set("drive").alias("drives")), "record_id")
        met = met.select("record_id", "ways", F.explode("drives").alias("drive"))
        best = F.array_max(F.transform("ways", lambda w: F.struct((w["eta"] + F.col("drive") * w["store"]).alias("value"), w["store"].alias("store"))))
        return met.groupBy("record_id", "drive").agg(F.round(F.sum(best["store"]), 6).alias("balance"))

    return evaluate


@query(WAYS + """, rungs AS (SELECT 0.0::DOUBLE AS drive UNION ALL SELECT s * 0.0625 * (2 ** k) FROM range(5) a(k), (VALUES (1), (-1)) b(s)),
bal AS (SELECT record_id, drive, round(sum(store), 6) AS balance FROM (SELECT record_id, idx, drive, arg_max(store, (eta + drive * store, store)) AS store FROM w, rungs GROUP BY ALL) GROUP BY ALL),
nb AS (SELECT *, lead(drive) OVER v AS d2, lead(balance) OVER v AS b2 FROM bal WINDOW v AS (PARTITION BY record_id ORDER BY drive)),
br AS (SELECT record_id, min(drive) FILTER (WHERE balance < 0 AND b2 >= 0) AS low, arg_min(d2, drive) FILTER (WHERE balance < 0 AND b2 >= 0) AS high FROM nb GROUP BY ALL),
fine AS (SELECT record_id, low + (high - low) * i / 256 AS drive FROM br, range(257) g(i) WHERE low IS NOT NULL),
fb AS (SELECT record_id, drive, round(sum(store), 6) AS balance FROM (SELECT w.record_id, idx, drive, arg_max(store, (eta + drive * store, store)) AS store FROM w JOIN fine ON fine.record_id = w.record_id GROUP BY ALL) GROUP BY ALL),
fn AS (SELECT *, lead(drive) OVER v AS d2, lead(balance) OVER v AS b2 FROM fb WINDOW v AS (PARTITION BY record_id ORDER BY drive))
SELECT br.record_id, round(min(fn.drive), 9) AS low, round(min(fn.d2), 9) AS high, br.low IS NOT NULL AS bracketed FROM br LEFT JOIN fn ON fn.record_id = br.record_id AND fn.balance < 0 AND fn.b2 >= 0 GROUP BY br.record_id, br.low""")
def balanced_drives(spark, d):
    """The drives between which every record's storage turns from emptying to filling, by batches of trials; the SQL tries a whole fine grid."""
    from kilojoin.plans.storage import cut as written

    own = written(ways(spark, d))
    found = balance.drives(own.select("record_id").distinct(), balances(own), step=0.0625, rungs=5, parts=16, rounds=2)
    return found.select("record_id", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "bracketed")
