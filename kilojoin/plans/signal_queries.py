"""Signal algebra, records, lookup tables and distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kilojoin.functions import exprs, types
from kilojoin.operators import distribution, lookup, record, signal
from kilojoin.plans import fixtures as fx
from kilojoin.plans.fixtures import SIG
from kilojoin.plans.register import query, r

ALL = "SELECT record_id, idx, t, sig_id, {v} AS v FROM sig"


@query(SIG + ALL.format(v="v * 2.5"))
def signal_scale(spark, d):
    return signal.scale(fx.signals(spark, d), 2.5)


@query(SIG + ALL.format(v="v + 7"))
def signal_offset(spark, d):
    return signal.offset(fx.signals(spark, d), 7.0)


@query(SIG + ALL.format(v="0.0 - v"))
def signal_negate(spark, d):
    return signal.map_values(fx.signals(spark, d), lambda v: 0.0 - v)


@query(SIG + ALL.format(v="CASE WHEN v = 0 THEN 'inf'::DOUBLE ELSE 1 / v END") + " WHERE v <> 0")
def signal_reciprocal(spark, d):
    return signal.reciprocal(fx.signals(spark, d).where("v <> 0"))


@query(SIG + ALL.format(v="abs(v)"))
def signal_abs(spark, d):
    return signal.absolute(fx.signals(spark, d))


@query(SIG + ALL.format(v="CASE WHEN v > 0 THEN 1 WHEN v < 0 THEN -1 ELSE 0 END"))
def signal_sign(spark, d):
    return signal.sign(fx.signals(spark, d))


@query(SIG + ALL.format(v="CASE WHEN abs(v) < 20 THEN 0.0 ELSE v END"))
def hard_shrinkage(spark, d):
    return signal.remove_zero_noise(fx.signals(spark, d), 20.0)


@query(SIG + ALL.format(v="CASE WHEN sig_id = 'p1' THEN v * v * v ELSE v END"))
def modify_signals(spark, d):
    return signal.map_values(fx.signals(spark, d), lambda v: exprs.power(v, 3), ["p1"])


@query(SIG + """, e AS (SELECT record_id, sig_id, min(v) AS lo, max(v) AS hi FROM sig GROUP BY ALL)
SELECT s.record_id, idx, t, s.sig_id, CASE WHEN hi = lo THEN lo ELSE (v - lo) / (hi - lo) END AS v FROM sig s JOIN e USING (record_id, sig_id)""")
def signal_norm(spark, d):
    return signal.norm(fx.signals(spark, d))


@query(SIG + """, m AS (SELECT record_id, sig_id, max(abs(v)) AS m FROM sig GROUP BY ALL), a AS (SELECT record_id, max(m) AS am FROM m GROUP BY ALL)
SELECT record_id, idx, t, sig_id, v * (CASE WHEN m = 0 THEN 1.0 ELSE 0.75 * am / m END) AS v FROM sig JOIN m USING (record_id, sig_id) JOIN a USING (record_id)""")
def norm_max75(spark, d):
    return record.norm_to_max75(fx.signals(spark, d))


@query(SIG + """, e AS (SELECT record_id, sig_id, min(v) AS lo, max(v) AS hi FROM sig GROUP BY ALL)
SELECT record_id, idx, t, sig_id, CASE WHEN hi = lo THEN -1.0 ELSE -1 + 2 * ((v - lo) / (hi - lo)) END AS v FROM sig JOIN e USING (record_id, sig_id)""")
def norm_range(spark, d):
    return record.norm_to_range(fx.signals(spark, d), -1.0, 1.0)


@query(SIG + "SELECT record_id, idx, t, sig_id, v2 - v AS v FROM nxt WHERE v2 IS NOT NULL")
def signal_delta(spark, d):
    return signal.delta(fx.signals(spark, d))


@query(SIG + "SELECT record_id, idx, t, sig_id, (v + v2) / 2 AS v FROM nxt WHERE v2 IS NOT NULL")
def signal_average(spark, d):
    return signal.average(fx.signals(spark, d))


@query(SIG + "SELECT record_id, sig_id, idx, t, t2 - t AS dt, (t2 - t) * ((v + v2) / 2) AS e FROM nxt WHERE v2 IS NOT NULL")
def part_integrate(spark, d):
    return signal.part_integrate(fx.signals(spark, d))


@query(SIG + "SELECT record_id, sig_id, round(sum((t2 - t) * ((v + v2) / 2)), 3) + 0.0 AS e FROM nxt WHERE v2 IS NOT NULL GROUP BY ALL")
def full_integrate(spark, d):
    return signal.full_integrate(fx.signals(spark, d)).withColumn("e", r("e"))


@query(SIG + "SELECT record_id, sig_id, idx, t2 - t AS dt, (t2 - t) * ((v + v2) / 2) / (t2 - t) AS p FROM nxt WHERE v2 IS NOT NULL")
def interval_powers(spark, d):
    return signal.diff_time(fx.signals(spark, d))


@query(SIG + "SELECT record_id, sig_id, min(t) AS t0, max(t + (t2 - t)) AS t1, round(sum((t2 - t) * ((v + v2) / 2)), 3) + 0.0 AS e FROM nxt WHERE v2 IS NOT NULL GROUP BY ALL")
def sum_flow_record(spark, d):
    return record.sum_flows(signal.part_integrate(fx.signals(spark, d))).withColumn("e", r("e"))


@query(SIG + "SELECT record_id, min(t) AS t0, max(t) AS t1 FROM sig GROUP BY ALL")
def time_window(spark, d):
    return record.time_window(fx.signals(spark, d))


@query(SIG + "SELECT record_id, min(v) AS low, max(v) AS high FROM sig WHERE sig_id IN ('p1', 'p3') GROUP BY ALL")
def max_range(spark, d):
    return record.value_range(fx.signals(spark, d), ["p1", "p3"])


@query(SIG + "SELECT record_id, sig_id, min(v) AS low, max(v) AS high, count(v) AS n FROM sig GROUP BY ALL")
def extrema(spark, d):
    return signal.extrema(fx.signals(spark, d))


@query(SIG + "SELECT record_id, sig_id, round(sum(v), 3) + 0.0 AS v FROM sig GROUP BY ALL")
def signal_sum(spark, d):
    return signal.total(fx.signals(spark, d)).withColumn("v", r("v"))


@query(SIG + "SELECT record_id, sig_id, min(CASE WHEN v > 0 THEN v END) AS v FROM sig GROUP BY ALL")
def minimum_with_nan(spark, d):
    rows = signal.map_values(fx.signals(spark, d), lambda v: F.when(v > 0, v).otherwise(exprs.nan()))
    return signal.minimum_ignoring_nan(rows).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@query(SIG + "SELECT record_id, idx, t, sig_id, v FROM sig WHERE sig_id IN ('p1', 'p2')")
def record_extract(spark, d):
    return record.extract(fx.signals(spark, d), ["p1", "p2"])


@query(SIG + "SELECT record_id, idx, t, sig_id, v FROM sig WHERE sig_id = 'p2'")
def record_signal(spark, d):
    return record.get_signal(fx.signals(spark, d), "p2")


@query(SIG + "SELECT record_id, idx, t, sig_id, v FROM sig")
def record_union(spark, d):
    return record.union(fx.signals(spark, d, ["p1", "p2"]), fx.one(spark, d, "p3"))


@query(SIG + "SELECT record_id, idx, t, sig_id, v FROM sig")
def record_add_signals(spark, d):
    return record.add_signals(fx.signals(spark, d, ["p1", "p2"]), fx.one(spark, d, "p3"))


@query(SIG + "SELECT record_id, idx - 5 AS idx, t, sig_id, v FROM sig WHERE idx BETWEEN 5 AND 20")
def record_slice(spark, d):
    return signal.slice_(fx.signals(spark, d), 5, 20)


@query(SIG + "SELECT record_id, idx, t, record_id || '_' || sig_id AS sig_id, v FROM sig")
def record_rename(spark, d):
    return record.with_record_name(fx.signals(spark, d))


@query(SIG + "SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY round(sum(v), 6), sig_id)::INT AS rank, sig_id FROM sig GROUP BY record_id, sig_id")
def sort_signals(spark, d):
    return record.sort_signals(fx.signals(spark, d)).select("record_id", "rank", "sig_id")


@query(SIG + "SELECT record_id, idx, t, 'zip' AS sig_id, p1 * p2 AS v FROM wide")
def signal_times(spark, d):
    return signal.times(fx.one(spark, d, "p1"), fx.one(spark, d, "p2"))


@query(SIG + "SELECT record_id, idx, t, 'zip' AS sig_id, p1 / p2 AS v FROM wide WHERE p2 <> 0")
def signal_over(spark, d):
    return signal.over_(fx.one(spark, d, "p1"), fx.one(spark, d, "p2").where("v <> 0"))


@query(SIG + "SELECT record_id, idx, t, 'zip' AS sig_id, p1 - p2 AS v FROM wide")
def signal_minus(spark, d):
    typed = lambda s: types.set_type(fx.one(spark, d, s), types.Typ("A", "P", "Tt"))
    return signal.minus(typed("p1"), typed("p2"))


@query(SIG + "SELECT record_id, idx, t, 'zip' AS sig_id, p1 + p2 * p3 AS v FROM wide")
def zip_three(spark, d):
    return signal.zip3(fx.one(spark, d, "p1"), fx.one(spark, d, "p2"), fx.one(spark, d, "p3"), lambda a, b, c: a + b * c)


def _axis(sig: str, width: int) -> str:
    """The middles of a signal's classes in each record, numbered, with the samples of each."""
    return f"SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY k) - 1 AS idx, (k + 0.5) * {width} AS v, n FROM (SELECT record_id, floor({sig} / {width}) AS k, count(*) AS n FROM wide GROUP BY ALL)"


def axis(spark, d, sig, width):
    """record_id, idx, t (samples), sig_id, v (middle) of the classes that all samples of a signal fall into; as many as the range of values holds."""
    classes = fx.wide(spark, d).groupBy("record_id", F.floor(F.col(sig) / width).alias("k")).agg(F.count(F.lit(1)).cast("double").alias("t"))
    w = Window.partitionBy("record_id").orderBy("k")
    return classes.select("record_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "t", F.lit(sig).alias("sig_id"), ((F.col("k") + 0.5) * width).alias("v"))


@query(SIG + f", a AS ({_axis('p1', 20)}), b AS ({_axis('p2', 10)}) SELECT a.record_id, a.idx AS i, b.idx AS j, a.v * b.v AS v FROM a JOIN b USING (record_id)")
def cross_product(spark, d):
    """The classes of one signal against those of another, in each record; every sample is in its class."""
    return signal.cross_with(axis(spark, d, "p1", 20), axis(spark, d, "p2", 10), lambda a, b: a * b)


@query(SIG + f", a AS ({_axis('p1', 20)}), b AS ({_axis('p3', 1)}) SELECT a.record_id, b.idx AS i, a.idx AS j, a.v AS x, b.v AS y FROM a JOIN b USING (record_id)")
def mesh_grid(spark, d):
    return signal.variation2d(axis(spark, d, "p1", 20), axis(spark, d, "p3", 1))


@query(SIG + "SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY p1, idx) - 1 AS rank, p1 AS x, p2 AS y FROM wide")
def sort_two(spark, d):
    return signal.sort_two(fx.one(spark, d, "p1"), fx.one(spark, d, "p2"))


@query(SIG + """SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY v, sig_id, idx) - 1 AS idx, v FROM sig WHERE sig_id IN ('p1', 'p2')""")
def merge_sorted(spark, d):
    return signal.merge(fx.one(spark, d, "p1"), fx.one(spark, d, "p2"))


@query(SIG + "SELECT DISTINCT record_id, sig_id, v FROM sig WHERE sig_id = 'p3'")
def unique_values(spark, d):
    return signal.unique(fx.one(spark, d, "p3"))


@query(SIG + "SELECT record_id, sig_id, idx FROM sig WHERE v > 100")
def find_indices(spark, d):
    return signal.find_indices(fx.signals(spark, d), lambda v: v > 100)


@query(SIG + "SELECT record_id, sig_id, min(sign(v)) <> max(sign(v)) AS changes FROM sig GROUP BY ALL")
def has_sign_change(spark, d):
    return signal.has_sign_change(fx.signals(spark, d))


@query(SIG + "SELECT record_id, sig_id, bool_and(v > -60) AS every, bool_or(v > 200) AS some FROM sig GROUP BY ALL")
def all_any(spark, d):
    return signal.quantified(fx.signals(spark, d), lambda v: v > -60).drop("some").join(signal.quantified(fx.signals(spark, d), lambda v: v > 200).drop("every"), ["record_id", "sig_id"])


@query(SIG + "SELECT record_id, bool_and(p1 > p2) AS equal FROM wide GROUP BY ALL")
def equal_by(spark, d):
    return signal.equal_by(fx.one(spark, d, "p1"), fx.one(spark, d, "p2"), lambda a, b: a > b)


@query(SIG + "SELECT record_id, true AS equal FROM wide GROUP BY ALL")
def approx_equal(spark, d):
    return record.approx_equal(fx.signals(spark, d), signal.offset(fx.signals(spark, d), 1e-9), 1e-6)


@query(SIG + ", b AS (SELECT *, lag(v) OVER (PARTITION BY record_id, sig_id ORDER BY idx) AS b FROM sig WHERE sig_id = 'p3') SELECT record_id, idx, t, sig_id, v FROM b WHERE b IS NULL OR b <> v")
def remove_duplicates(spark, d):
    return signal.remove_adjacent_duplicates(fx.one(spark, d, "p3"))


@query(SIG + "SELECT record_id, sig_id, max_by(idx, struct_pack(v := v, i := -idx)) AS idx, max(v) AS v FROM sig GROUP BY ALL")
def arg_max(spark, d):
    return signal.arg_max(fx.signals(spark, d))


@query(SIG + "SELECT record_id, idx, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 0 WHEN p2 >= p3 THEN 1 ELSE 2 END AS best, greatest(p1, p2, p3) AS v FROM wide")
def zip_arg_max(spark, d):
    return signal.zip_arg_max(fx.signals(spark, d), ["p1", "p2", "p3"])


@query(SIG + "SELECT record_id, sig_id, min_by(v, idx) AS first, max_by(v, idx) AS last FROM sig GROUP BY ALL")
def head_last(spark, d):
    return signal.ends(fx.signals(spark, d))


@query(SIG + "SELECT record_id, max(idx) OVER (PARTITION BY record_id, sig_id) - idx AS idx, t, sig_id, v FROM sig")
def signal_reverse(spark, d):
    return signal.reverse(fx.signals(spark, d)).select("record_id", "idx", "t", "sig_id", "v")


@query(SIG + "SELECT record_id, 2 * idx + k AS idx, CASE WHEN k = 0 THEN t ELSE t2 END AS t, sig_id, v FROM nxt, (VALUES (0), (1)) AS x(k) WHERE t2 IS NOT NULL")
def make_stepped(spark, d):
    return signal.stepped(fx.signals(spark, d))


@query(SIG + """SELECT record_id, idx * 4 + k AS idx, CASE WHEN t2 IS NULL THEN t ELSE t + k / 4.0 * (t2 - t) END AS t, sig_id,
  CASE WHEN t2 IS NULL THEN v ELSE v + k / 4.0 * (v2 - v) END AS v FROM nxt, (VALUES (0), (1), (2), (3)) AS x(k) WHERE t2 IS NOT NULL OR k = 0""")
def densify_time(spark, d):
    return signal.densify(fx.signals(spark, d), 4)


@query(SIG + """SELECT record_id, idx * 2 + k AS idx, t, sig_id, v + CASE WHEN t2 IS NULL THEN 0 WHEN k = 0 THEN 1.5 ELSE -2.5 END AS v
  FROM nxt, (VALUES (0), (1)) AS x(k) WHERE t2 IS NOT NULL OR k = 0""")
def scatter(spark, d):
    return signal.scatter(fx.signals(spark, d), [0.3, -0.5], 5.0)


@query(SIG + "SELECT record_id, idx, t, sig_id, v FROM sig WHERE sig_id = 'p1' UNION ALL SELECT s.record_id, idx + n, t, 'p1', v FROM sig s JOIN (SELECT record_id, count(*) AS n FROM wide GROUP BY ALL) USING (record_id) WHERE sig_id = 'p2'")
def signal_append(spark, d):
    return signal.append(fx.one(spark, d, "p1"), fx.one(spark, d, "p2").withColumn("sig_id", F.lit("p1")))


@query(SIG + "SELECT record_id, sig_id, sum(v * pow(0.5, n - 1 - idx)) IS NOT NULL AS ok, round(sum(v * pow(0.5, n - 1 - idx)), 3) + 0.0 AS v FROM sig JOIN (SELECT record_id, count(*) AS n FROM wide GROUP BY ALL) USING (record_id) GROUP BY ALL")
def ordered_fold(spark, d):
    rows = signal.fold(fx.signals(spark, d), F.lit(0.0), lambda acc, v: acc * 0.5 + v)
    return rows.select("record_id", "sig_id", F.col("v").isNotNull().alias("ok"), r("v"))


@query(SIG + "SELECT record_id, sig_id, idx, t, v FROM sig")
def pack_unpack(spark, d):
    return signal.unpacked(signal.packed(fx.signals(spark, d)))


@query(SIG + """, ask AS (SELECT record_id, (t0 + t1) / 2 + k * (t1 - t0) / 7 AS t, k + 4 AS idx FROM (SELECT record_id, min(t) AS t0, max(t) AS t1 FROM wide GROUP BY ALL), (SELECT unnest(range(-4, 5)) AS k))
SELECT a.record_id, a.idx, a.t, s.sig_id, s.v * (s.t2 - a.t) / (s.t2 - s.t) IS NOT NULL AS hit, round((s.v * (s.t2 - a.t) + s.v2 * (a.t - s.t)) / (s.t2 - s.t), 3) + 0.0 AS v
FROM ask a CROSS JOIN (SELECT DISTINCT sig_id FROM sig) g LEFT JOIN nxt s ON s.record_id = a.record_id AND s.sig_id = g.sig_id AND s.t <= a.t AND a.t < s.t2 WHERE s.sig_id IS NOT NULL""")
def resample(spark, d):
    w = record.time_window(fx.one(spark, d))
    k = F.explode(F.sequence(F.lit(-4), F.lit(4)))
    times = w.select("record_id", "t0", "t1", k.alias("k")).select("record_id", (F.col("k") + 4).cast("long").alias("idx"), ((F.col("t0") + F.col("t1")) / 2 + F.col("k") * (F.col("t1") - F.col("t0")) / 7).alias("t"))
    rows = record.resample(fx.signals(spark, d), times).where(~F.isnan("v"))
    return rows.select("record_id", "idx", "t", "sig_id", F.lit(True).alias("hit"), r("v"))


@query(SIG + "SELECT record_id, count(*) * 2 AS n, min(t) AS t0, max(t) AS t1 FROM wide GROUP BY ALL")
def union_new_time(spark, d):
    rows = record.union_with_new_time(fx.one(spark, d, "p1"), fx.one(spark, d, "p2")).where(~F.isnan("v"))
    each = rows.dropDuplicates(["record_id", "sig_id", "t"])
    return each.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


XS, YS = [-40.0, 0.0, 20.0, 20.0, 100.0], [1.0, 2.0, 4.0, 8.0, 10.0]
CURVE = """CASE WHEN p1 < -40 OR p1 > 100 THEN NULL WHEN p1 = 20 THEN 6 WHEN p1 <= 0 THEN (1 * (0 - p1) + 2 * (p1 + 40)) / 40.0
  WHEN p1 < 20 THEN (2 * (20 - p1) + 4 * (p1 - 0)) / 20.0 ELSE (8 * (100 - p1) + 10 * (p1 - 20)) / 80.0 END"""


@query(SIG + f"SELECT record_id, idx, round({CURVE}, 9) AS v, CASE WHEN p1 < -40 OR p1 > 100 THEN 'X' ELSE 'I' END AS q FROM wide")
def interp1(spark, d):
    got = lookup.interp1(XS, YS, F.col("p1"))
    rows = fx.wide(spark, d).select("record_id", "idx", got.alias("g"))
    return rows.select("record_id", "idx", F.when(F.col("g.q") != "X", F.round("g.v", 9)).alias("v"), F.col("g.q").alias("q"))


@query(SIG + "SELECT record_id, idx, round(CASE WHEN p1 < 0 THEN (1 * (0 - p1) + 3 * (p1 + 50)) / 50.0 ELSE (3 * (100 - p1) + 4 * p1) / 100.0 END, 9) AS v FROM wide")
def interp1_extrapolated(spark, d):
    got = lookup.interp1([-50.0, 0.0, 100.0], [1.0, 3.0, 4.0], F.col("p1"), beyond="linear")
    return fx.wide(spark, d).select("record_id", "idx", F.round(got["v"], 9).alias("v"))


@query(SIG + """SELECT record_id, idx, round((( (10 * (100 - p1) + 30 * (p1 + 50)) / 150.0) * (2 - p3) + ((20 * (100 - p1) + 40 * (p1 + 50)) / 150.0) * (p3 + 2)) / 4.0, 9) AS v
FROM wide WHERE p1 BETWEEN -50 AND 100""")
def interp2(spark, d):
    got = lookup.interp2([-2.0, 2.0], [[-50.0, 100.0]] * 2, [[10.0, 30.0], [20.0, 40.0]], F.col("p3"), F.col("p1"))
    rows = fx.wide(spark, d).select("record_id", "idx", got.alias("g")).where("g.q <> 'X'")
    return rows.select("record_id", "idx", F.round("g.v", 9).alias("v"))


@query(SIG + "SELECT record_id, idx, CASE WHEN p1 >= 0 THEN round(least(greatest((p1) / 400.0, 0), 1), 9) ELSE round(1 / (0.5 + least(-p1, 100) / 200.0), 9) END AS v FROM wide")
def eta_lookup(spark, d):
    f = lookup.abs_eta_function(lookup.eta_function([0.0, 4.0], [0.0, 10.0], 100.0, 0.1), lookup.eta_function([0.0, 100.0], [0.5, 1.0]))
    return fx.wide(spark, d).select("record_id", "idx", F.round(f(F.col("p1")), 9).alias("v"))


CLASS = "round_even((v + 5) / 10, 0) * 10 - 5"


@query(SIG + f"SELECT record_id, sig_id, {CLASS} AS class, count(*) AS n FROM sig GROUP BY ALL")
def class_histogram(spark, d):
    return distribution.class_counts(fx.signals(spark, d), 10.0, 5.0)


@query(SIG + f"SELECT record_id, sig_id, {CLASS} AS class, idx FROM sig")
def class_indices(spark, d):
    return distribution.distribution(fx.signals(spark, d), 10.0, 5.0)


@query(SIG + "SELECT record_id, round_even((p1 + 5) / 50, 0) * 50 - 5 AS c0, round_even((p3 + 5) / 50, 0) * 50 - 5 AS c1, count(*) AS n FROM wide GROUP BY ALL")
def distribution_nd(spark, d):
    rows = distribution.distribution_nd(fx.signals(spark, d), ["p1", "p3"], 50.0, 5.0)
    return rows.select("record_id", F.get("classes", F.lit(0)).alias("c0"), F.get("classes", F.lit(1)).alias("c1"), "n")


@query(SIG + """SELECT record_id, sig_id, CASE WHEN v = 0 THEN '0' WHEN v < 0 THEN '-100 0' ELSE '0 1000' END AS points, count(*) AS n FROM sig WHERE sig_id = 'p1' GROUP BY ALL""")
def support_points(spark, d):
    rows = distribution.active_support_points(fx.one(spark, d), [-100.0, 0.0, 1000.0])
    return rows.withColumn("points", F.array_join(F.transform("points", lambda p: p.cast("long").cast("string")), " "))


@query(SIG + f", c AS (SELECT record_id, {CLASS} AS class, idx FROM sig WHERE sig_id = 'p1') SELECT record_id, class, round(sum(p2), 3) + 0.0 AS v FROM c JOIN wide USING (record_id, idx) GROUP BY ALL")
def distribution_values(spark, d):
    classes = distribution.distribution(fx.one(spark, d), 10.0, 5.0)
    return distribution.class_sums(classes, fx.one(spark, d, "p2")).withColumn("v", r("v"))


@query(SIG + """, i AS (SELECT a.record_id, a.t2 - a.t AS dt, (a.t2 - a.t) * (a.v + a.v2) / 2 AS e1, (b.t2 - b.t) * (b.v + b.v2) / 2 AS e2
  FROM nxt a JOIN nxt b USING (record_id, idx) WHERE a.sig_id = 'p1' AND b.sig_id = 'p2' AND a.t2 IS NOT NULL),
c AS (SELECT record_id, round_even((e1 / dt + 25) / 50, 0) * 50 - 25 AS class, sum(dt) AS dt, sum(e1) AS ein, sum(e2) AS eout FROM i GROUP BY ALL)
SELECT record_id, class, round(ein / dt, 3) + 0.0 AS p, round(ein, 3) + 0.0 AS ein, round(eout, 3) + 0.0 AS eout, round(CASE WHEN ein >= 0 THEN eout / ein ELSE ein / eout END, 3) + 0.0 AS eta FROM c""")
def eta_distribution(spark, d):
    rows = fx.wide(spark, d).withColumns({f"{c}_": F.lead(c).over(signal.over(["record_id"])) for c in ("t", "p1", "p2")}).where("t_ is not null")
    dt = F.col("t_") - F.col("t")
    rows = rows.select("record_id", dt.alias("dt"), (dt * (F.col("p1") + F.col("p1_")) / 2).alias("ein"), (dt * (F.col("p2") + F.col("p2_")) / 2).alias("eout"))
    out = distribution.eta_distribution(rows.withColumn("etrigger", F.col("ein")), 50.0, 25.0)
    return out.select("record_id", "class", r("p"), r("ein"), r("eout"), r("eta"))


@query(SIG + "SELECT record_id, idx, round(CASE WHEN p1 >= 0 THEN p2 / p3 ELSE p3 / p2 END, 9) AS eta FROM wide WHERE p2 <> 0 AND p3 <> 0")
def calc_eta_with_sign(spark, d):
    rows = fx.wide(spark, d).where("p2 <> 0 and p3 <> 0")
    return rows.select("record_id", "idx", F.round(exprs.eta_with_sign(F.col("p1"), F.col("p3"), F.col("p2")), 9).alias("eta"))
