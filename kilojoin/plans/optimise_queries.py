"""Grids, sweeps and the choice of operating points."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilojoin.functions import exprs
from kilojoin.operators import cube, optimise, solver
from kilojoin.plans import fixtures as fx
from kilojoin.plans.fixtures import SIG
from kilojoin.plans.register import query, r

def classes(df, column):
    """The distinct values of a column that has few (classes of a table's values), in order; they become an axis."""
    return [r[0] for r in df.select(column.alias("k")).distinct().orderBy("k").collect()]


#: Axes of a grid: the line numbers, discounts and taxes that lineitem has.
GRID = """WITH a AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT l_linenumber::DOUBLE AS x FROM lineitem)),
b AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT l_discount AS x FROM lineitem)), c AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT l_tax AS x FROM lineitem)),
g AS (SELECT a.i * (SELECT count(*) FROM b) * (SELECT count(*) FROM c) + b.i * (SELECT count(*) FROM c) + c.i AS lin, a.x AS x0, b.x AS x1, c.x AS x2 FROM a, b, c),
v AS (SELECT *, x0 * x1 - x2 AS v FROM g) """


def grid(spark, d):
    rows = fx.table(spark, d, "lineitem")
    axes = [classes(rows, F.col(c).cast("double")) for c in ("l_linenumber", "l_discount", "l_tax")]
    return cube.generate(spark, axes, lambda x, y, z: x * y - z)


@query(GRID + "SELECT * FROM v")
def cube_generate(spark, d):
    return grid(spark, d)


@query(GRID + "SELECT lin, x0, x1, x2, v + x0 AS v FROM v")
def cube_map(spark, d):
    return cube.map_points(grid(spark, d), lambda v, x, y, z: v + x)


@query(GRID + "SELECT lin, x0, x2, v FROM v WHERE x1 = 0.05")
def sub_cube(spark, d):
    return cube.sub_cube(grid(spark, d), 1, 0.05)


@query(GRID + "SELECT x0, x1, x2, v * v AS v FROM v")
def cube_zip(spark, d):
    return cube.zip_with(grid(spark, d), grid(spark, d), lambda a, b: a * b, 3)


@query(GRID + "SELECT round(sum(v), 6) + 0.0 AS total, min(v) AS low, max(v) AS high, count(*) AS n FROM v")
def cube_fold(spark, d):
    return cube.fold(grid(spark, d)).withColumn("total", F.round("total", 6))


@query(GRID + "SELECT x0, string_agg(round(v * 100)::INT::VARCHAR, ' ' ORDER BY x1) AS row FROM v WHERE x2 = 0.02 GROUP BY x0")
def cube_matrix(spark, d):
    m = cube.matrix(cube.sub_cube(grid(spark, d), 2, 0.02))
    return m.select("x0", F.array_join(F.transform("vs", lambda v: F.round(v * 100).cast("int").cast("string")), " ").alias("row"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 600 AS lin, l_partkey % 600 // 60 AS a, l_partkey % 600 // 3 % 20 AS b, l_partkey % 600 % 3 AS c FROM lineitem")
def cube_linear_index(spark, d):
    """The places along three axes of a point's number, and the number again, for every line."""
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 600).alias("id"))
    a, b, c = cube.from_linear(F.col("id"), [10, 20, 3])
    rows = rows.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"), c.alias("c"))
    return rows.select("l_orderkey", "l_linenumber", cube.to_linear([F.col("a").cast("long"), F.col("b"), F.col("c")], [10, 20, 3]).alias("lin"), *[F.col(x).cast("long").alias(x) for x in "abc"])


#: Requirements from classes of events' values and of lineitem's discounts, freedoms from classes of taxes and quantities, states from event types.
POINTS = """WITH st AS (SELECT DISTINCT length(event_type) AS s FROM events), ra AS (SELECT DISTINCT least(floor(value / 25), 12)::INT AS a FROM events),
rb AS (SELECT DISTINCT round(l_discount * 100)::INT AS b FROM lineitem), dc AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM (SELECT DISTINCT round(l_tax * 100)::INT AS c FROM lineitem)),
de AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i FROM (SELECT DISTINCT (l_quantity // 7)::INT AS e FROM lineitem)),
p AS (SELECT s AS state, 0.5::DOUBLE * a + 0.1::DOUBLE AS req_rest, 0.2::DOUBLE * b + 0.1::DOUBLE AS req_local, 0.1::DOUBLE * c + 0.1::DOUBLE AS dof_water, 0.1::DOUBLE * e + 0.1::DOUBLE AS dof_gas, dc.i * (SELECT count(*) FROM de) + de.i AS i
FROM st, ra, rb, dc, de),
o AS (SELECT *, (req_rest - dof_water) * (state + 1) AS p0, (req_local - dof_gas * 0.9) AS p1, (dof_water * 0.9 + dof_gas * 0.6) / (req_rest + req_local + state * 0.1) AS eta,
 0.1 * (req_rest - dof_gas) AS force FROM p) """


def sweep_rows(spark, d):
    """Every combination of the classes that the tables have."""
    events, lines = fx.table(spark, d, "events"), fx.table(spark, d, "lineitem")
    whole = lambda df, c: classes(df, c.cast("int"))
    rest = whole(events, F.least(F.floor(F.col("value") / 25), F.lit(12)))
    local, water = whole(lines, F.round(F.col("l_discount") * 100)), whole(lines, F.round(F.col("l_tax") * 100))
    gas = whole(lines, F.floor(F.col("l_quantity") / 7))
    states = whole(events, F.length("event_type"))
    return optimise.points(spark, {"rest": [0.5 * k + 0.1 for k in rest], "local": [0.2 * k + 0.1 for k in local]}, {"water": [0.1 * k + 0.1 for k in water], "gas": [0.1 * k + 0.1 for k in gas]}, states)


def sweep(spark, d):
    rows = sweep_rows(spark, d)
    c = F.col
    rows = rows.withColumns({"p0": (c("req_rest") - c("dof_water")) * (c("state") + 1), "p1": c("req_local") - c("dof_gas") * 0.9})
    eta = (c("dof_water") * 0.9 + c("dof_gas") * 0.6) / (c("req_rest") + c("req_local") + c("state") * 0.1)
    return rows.withColumns({"eta": eta, "force": optimise.forcing({"battery": 0.1}, {"battery": c("req_rest") - c("dof_gas")})})


@query(POINTS + "SELECT state, round(req_rest, 6) AS req_rest, round(req_local, 6) AS req_local, round(dof_water, 6) AS dof_water, round(dof_gas, 6) AS dof_gas, i FROM p")
def sweep_points(spark, d):
    return sweep_rows(spark, d).select("state", *[F.round(c, 6).alias(c) for c in ("req_rest", "req_local", "dof_water", "dof_gas")], "i")


@query(POINTS + """, b AS (SELECT state, req_rest, req_local, max_by(i, struct_pack(o := eta + force, i := -i)) AS i, max(eta + force) AS obj, max_by(eta, struct_pack(o := eta + force, i := -i)) AS eta
FROM o WHERE p0 > 0 AND p1 > 0 GROUP BY ALL) SELECT state, round(req_rest, 6) AS req_rest, round(req_local, 6) AS req_local, i, round(obj, 9) AS obj, round(eta, 9) AS eta FROM b""")
def find_best_index(spark, d):
    rows = sweep(spark, d)
    got = optimise.objective(F.col("eta"), F.col("force"), optimise.feasible([F.col("p0"), F.col("p1")]))
    rows = rows.withColumn("got", got).withColumn("obj", F.col("got.obj"))
    best = optimise.find_best(rows, ["state", "req_rest", "req_local"])
    return best.select("state", F.round("req_rest", 6).alias("req_rest"), F.round("req_local", 6).alias("req_local"), "i", F.round("obj", 9).alias("obj"), F.round("eta", 9).alias("eta"))


@query(POINTS + "SELECT state, round(req_rest, 6) AS req_rest, round(req_local, 6) AS req_local, round(avg(CASE WHEN p0 > 0 AND p1 > 0 THEN eta END), 10) AS expected FROM o GROUP BY ALL")
def expected_value(spark, d):
    rows = optimise.expected(sweep(spark, d), ["state", "req_rest", "req_local"], condition=optimise.feasible([F.col("p0"), F.col("p1")]))
    value = F.when(~F.isnan("expected"), F.round("expected", 10))
    return rows.select("state", F.round("req_rest", 6).alias("req_rest"), F.round("req_local", 6).alias("req_local"), value.alias("expected"))


@query(POINTS + "SELECT state, i, round(req_rest, 6) AS req_rest, round(req_local, 6) AS req_local, p0 > 0 AND p1 > 0 AS ok, CASE WHEN p0 > 0 AND p1 > 0 THEN round(eta + force, 9) + 0.0 END AS obj FROM o")
def forcing_objective(spark, d):
    got = optimise.objective(F.col("eta"), F.col("force"), optimise.feasible([F.col("p0"), F.col("p1")]))
    rows = sweep(spark, d).withColumn("got", got)
    return rows.select("state", "i", F.round("req_rest", 6).alias("req_rest"), F.round("req_local", 6).alias("req_local"), F.col("got").isNotNull().alias("ok"), r(F.col("got.obj"), 9).alias("obj"))


@query(POINTS + """SELECT state, i, round(req_rest, 6) AS req_rest, round(req_local, 6) AS req_local, round(req_rest + req_local, 6) AS insum_0_k, round((req_rest + req_local) / 0.8, 6) AS p_0_s_k,
round(req_rest / (req_rest + req_local), 6) AS share FROM p""")
def per_state_sweep(spark, d):
    """Every point's section: a source feeds a crossing that splits to two sinks; powers at the sinks are given."""
    rules = solver.section_rules([("s", "k"), ("k", "a"), ("k", "b")], 0)
    given = {"dt_0": F.lit(1.0), "p_0_a_k": F.col("req_rest"), "p_0_b_k": F.col("req_local"), "eta_0_k_a": F.lit(1.0), "eta_0_k_b": F.lit(1.0), "eta_0_s_k": F.lit(0.8)}
    out = optimise.per_state_sweep(sweep_rows(spark, d), rules, given)
    return out.select("state", "i", *[F.round(c, 6).alias(n) for c, n in (("req_rest", "req_rest"), ("req_local", "req_local"), ("insum_0_k", "insum_0_k"), ("p_0_s_k", "p_0_s_k"), ("x_0_k_a", "share"))])


OBJ = SIG + ", s AS (SELECT record_id, idx, CASE sig_id WHEN 'p1' THEN 0 WHEN 'p2' THEN 1 ELSE 2 END AS state, CASE WHEN v < -20 THEN NULL ELSE floor(v / 10) END AS obj FROM sig)"


def objectives(spark, d):
    s = fx.signals(spark, d)
    state = F.when(F.col("sig_id") == "p1", 0).when(F.col("sig_id") == "p2", 1).otherwise(2)
    return s.select("record_id", "idx", state.alias("state"), F.when(F.col("v") < -20, exprs.nan()).otherwise(F.floor(F.col("v") / 10).cast("double")).alias("obj"))


@query(OBJ + """, b AS (SELECT record_id, idx, max(obj) AS best FROM s GROUP BY ALL) SELECT record_id, idx, any_value(best) AS obj, string_agg(state::VARCHAR, ',' ORDER BY state) FILTER (obj = best) AS states FROM s JOIN b USING (record_id, idx) GROUP BY ALL""")
def optimal_state_signal(spark, d):
    out = optimise.optimal_states(objectives(spark, d))
    return out.select("record_id", "idx", F.when(~F.isnan("obj"), F.col("obj")).alias("obj"), F.array_join(F.transform("states", lambda s: s.cast("string")), ",").alias("states"))


@query(OBJ + """, b AS (SELECT record_id, idx, max(obj) AS best FROM s GROUP BY ALL), g AS (SELECT record_id, state, min(best - obj) AS gap FROM s JOIN b USING (record_id, idx) WHERE obj IS NOT NULL GROUP BY ALL)
SELECT record_id, idx, state, obj + gap AS obj FROM s JOIN g USING (record_id, state) WHERE obj IS NOT NULL""")
def state_forcing(spark, d):
    return optimise.force_states(objectives(spark, d)).where(~F.isnan("obj"))


@query(OBJ + """, b AS (SELECT record_id, idx, max(obj) AS best FROM s GROUP BY ALL), c AS (SELECT record_id, idx, state, row_number() OVER (PARTITION BY record_id, idx ORDER BY state) - 1 AS k, count(*) OVER (PARTITION BY record_id, idx) AS n
  FROM s JOIN b USING (record_id, idx) WHERE obj = best), t AS (SELECT record_id, idx, t, t2 FROM nxt WHERE sig_id = 'p1' AND t2 IS NOT NULL)
SELECT record_id, idx, k::INT AS k, state, t + (t2 - t) * k / n AS t0, t + (t2 - t) * (k + 1) / n AS t1 FROM c JOIN t USING (record_id, idx)""")
def stepped_time(spark, d):
    return optimise.stepped_time(optimise.optimal_states(objectives(spark, d)), fx.wide(spark, d).select("record_id", "idx", "t"))
