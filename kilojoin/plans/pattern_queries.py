"""Crossing patterns, lookups in tables that come from data, sparse attribution and matrices with holes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilojoin.operators import crossing, holes, sparse_stack, surface
from kilojoin.plans import fixtures as fx
from kilojoin.plans.fixtures import SIG
from kilojoin.plans.register import query, r

# crossings ------------------------------------------------------------------------------------------

CROSS = SIG + """, s AS (SELECT record_id, idx, t, 'p1' AS sig_id, p1 AS v FROM wide UNION ALL SELECT record_id, idx, t, 'q1', -2 * p1 FROM wide UNION ALL SELECT record_id, idx, t, 'p3', p3 FROM wide),
iv AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY record_id, sig_id ORDER BY idx)),
fr AS (SELECT *, v / (v - v1) AS fraction FROM iv WHERE t1 IS NOT NULL AND sign(v) <> sign(v1)),
pat AS (SELECT record_id, idx, fraction, min(t + (t1 - t) * fraction) AS te, list(DISTINCT sig_id ORDER BY sig_id) AS sig_ids FROM fr GROUP BY ALL)"""


def three(spark, d):
    """p1, p3, and a signal that crosses zero where p1 does."""
    w = fx.wide(spark, d).withColumn("q1", -2 * F.col("p1"))
    return w.unpivot(["record_id", "idx", "t"], ["p1", "q1", "p3"], "sig_id", "v")


@query(CROSS + " SELECT record_id, idx, round(fraction, 9) + 0.0 AS fraction, array_to_string(sig_ids, ',') AS sig_ids FROM pat")
def crossing_patterns(spark, d):
    """Every event at which signals change sign, with the signals that do."""
    out = crossing.patterns(three(spark, d))
    return out.select("record_id", "idx", r("fraction", 9), F.array_join("sig_ids", ",").alias("sig_ids"))


CHOPPED = CROSS + """, evt AS (SELECT iv.record_id, iv.idx, sig_id, fraction AS place, te AS t, CASE WHEN list_contains(sig_ids, sig_id) THEN 0 ELSE v + (v1 - v) * fraction END AS v FROM iv JOIN pat USING (record_id, idx) WHERE t1 IS NOT NULL),
al AS (SELECT record_id, idx, sig_id, -1.0 AS place, 0 AS opens, t, v FROM s UNION ALL SELECT record_id, idx, sig_id, place, o, t, v FROM evt, (VALUES (0), (1)) x(o)),
pc AS (SELECT *, (sum(opens) OVER (PARTITION BY record_id, sig_id ORDER BY idx, place, opens ROWS UNBOUNDED PRECEDING))::BIGINT AS piece FROM al),
ln AS (SELECT *, lag(t) OVER (PARTITION BY record_id, sig_id, piece ORDER BY idx, place, opens) AS before FROM pc)"""


@query(CHOPPED + """, k AS (SELECT *, count(*) OVER (PARTITION BY record_id, sig_id, piece) AS n, row_number() OVER (PARTITION BY record_id, sig_id, piece ORDER BY idx, place, opens) - 1 AS nth FROM ln WHERE before IS NULL OR before <> t)
SELECT record_id, piece, nth::INT AS nth, round(t, 3) + 0.0 AS t, sig_id, round(v, 6) + 0.0 AS v FROM k WHERE n >= 2""")
def chopped_at_crossings(spark, d):
    return crossing.chopped(three(spark, d)).select("record_id", "piece", "nth", r("t"), "sig_id", r("v", 6))


@query(CHOPPED + """, k AS (SELECT *, count(*) OVER (PARTITION BY record_id, sig_id, piece) AS n FROM pc)
SELECT record_id, piece, count(*) AS n, round(min(t), 3) + 0.0 AS t0, round(max(t), 3) + 0.0 AS t1 FROM k WHERE n >= 2 AND sig_id = 'p3' GROUP BY ALL""")
def chopped_with_duplicates(spark, d):
    out = crossing.chopped(three(spark, d), duplicates=True).where("sig_id = 'p3'")
    return out.groupBy("record_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1")).select("record_id", "piece", "n", r("t0"), r("t1"))


# lookups in tables from data ------------------------------------------------------------------------

SURFACE = """WITH g AS (SELECT l_quantity AS x, l_discount AS y, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
a AS (SELECT event_id, value / 12 AS x, event_id % 97 / 1000.0::DOUBLE AS y FROM events),
xs AS (SELECT DISTINCT x FROM g), ys AS (SELECT DISTINCT y FROM g),
b AS (SELECT a.*, (SELECT max(x) FROM xs WHERE xs.x <= a.x) AS x0, (SELECT min(x) FROM xs WHERE xs.x >= a.x) AS x1, (SELECT max(y) FROM ys WHERE ys.y <= a.y) AS y0, (SELECT min(y) FROM ys WHERE ys.y >= a.y) AS y1 FROM a),
c AS (SELECT b.*, CASE WHEN x0 = x1 THEN 0 ELSE (b.x - x0) / (x1 - x0) END AS u, CASE WHEN y0 = y1 THEN 0 ELSE (b.y - y0) / (y1 - y0) END AS w FROM b)
"""


@query(SURFACE + """SELECT event_id, round((1 - u) * (1 - w) * g00.v + (1 - u) * w * g01.v + u * (1 - w) * g10.v + u * w * g11.v, 4) AS price FROM c
LEFT JOIN g g00 ON g00.x = x0 AND g00.y = y0 LEFT JOIN g g01 ON g01.x = x0 AND g01.y = y1 LEFT JOIN g g10 ON g10.x = x1 AND g10.y = y0 LEFT JOIN g g11 ON g11.x = x1 AND g11.y = y1""")
def surface_lookup(spark, d):
    """A surface of mean prices over quantity and discount, made from lineitem, at the coordinates of every event."""
    table = fx.table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")).agg(F.avg("l_extendedprice").alias("v"))
    asked = fx.table(spark, d, "events").select("event_id", (F.col("value") / 12).alias("x"), (F.col("event_id") % 97 / 1000.0).alias("y"))
    return surface.lookup(table, asked, ["x", "y"], "v", name="price").select("event_id", F.round("price", 4).alias("price"))


@query("""WITH g AS (SELECT o_totalprice AS x, avg(o_custkey)::DOUBLE AS v FROM orders GROUP BY ALL), a AS (SELECT event_id, value * 1000 AS x FROM events),
n AS (SELECT *, lead(x) OVER (ORDER BY x) AS x1, lead(v) OVER (ORDER BY x) AS v1 FROM g), e AS (SELECT min(x) AS lo, max(x) AS hi, arg_min(v, x) AS vlo, arg_max(v, x) AS vhi FROM g)
SELECT event_id, round(CASE WHEN a.x <= lo THEN vlo WHEN a.x >= hi THEN vhi ELSE n.v + (n.v1 - n.v) * (a.x - n.x) / (n.x1 - n.x) END, 3) AS v FROM a CROSS JOIN e LEFT JOIN n ON a.x >= n.x AND a.x < n.x1""")
def curve_lookup(spark, d):
    """A curve with a point for every distinct price of orders, at every event; last values beyond the ends."""
    table = fx.table(spark, d, "orders").groupBy(F.col("o_totalprice").alias("x")).agg(F.avg("o_custkey").alias("v"))
    asked = fx.table(spark, d, "events").select("event_id", (F.col("value") * 1000).alias("x"))
    return surface.lookup(table, asked, ["x"], "v", beyond="last", bucket=5000).select("event_id", F.round("found", 3).alias("v"))


# attribution ----------------------------------------------------------------------------------------

N, LEAST = 30, 1e-3


@query(f"""WITH RECURSIVE d AS (SELECT user_id AS record_id, event_id % {N} AS i, (sum(round(value * 100)::BIGINT) - 5000 * count(*)) / (199999.0::DOUBLE * count(*)) AS d FROM events GROUP BY ALL),
w AS (SELECT record_id, product(1 + d) AS whole, product(1 + abs(d)) AS reach FROM d GROUP BY ALL),
t AS (SELECT record_id, -1::BIGINT AS last, ''::VARCHAR AS changed, 1.0::DOUBLE AS value FROM w
  UNION ALL SELECT t.record_id, d.i, CASE t.changed WHEN '' THEN '' ELSE t.changed || ',' END || 'x' || d.i, t.value * d.d FROM t JOIN d ON d.record_id = t.record_id AND d.i > t.last JOIN w ON w.record_id = t.record_id
    WHERE abs(t.value * d.d) * reach >= {LEAST} * abs(whole) AND d.d <> 0),
k AS (SELECT t.*, whole FROM t JOIN w USING (record_id) WHERE abs(value) >= {LEAST} * abs(whole)),
rk AS (SELECT record_id, CASE changed WHEN '' THEN 'before' ELSE changed END AS changed, value FROM k)
SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY abs(round(value, 9)) DESC, changed) AS nth, changed, round(value, 9) + 0.0 AS value FROM rk
UNION ALL SELECT record_id, count(*) + 1, NULL, round(any_value(whole) - sum(value), 9) + 0.0 FROM k GROUP BY record_id""")
def sparse_attribution(spark, d):
    """How thirty parameters of every record, each changed a little, change their product: the terms that matter, and the rest as one."""
    name = F.concat(F.lit("x"), F.col("event_id") % N)
    own = fx.table(spark, d, "events").select(F.col("user_id").alias("record_id"), name.alias("x"), "value").groupBy("record_id", "x").agg(((F.sum(F.round(F.col("value") * 100).cast("long")) - 5000 * F.count(F.lit(1))) / (199999.0 * F.count(F.lit(1)))).alias("d"))
    rows = own.groupBy("record_id").pivot("x", [f"x{i}" for i in range(N)]).agg(F.first("d"))
    terms = sparse_stack.product(rows, ["record_id"], [(f"x{i}", F.lit(1.0), F.col(f"x{i}")) for i in range(N)], LEAST)
    return sparse_stack.ranked(terms, ["record_id"], digits=9).select("record_id", "nth", "changed", r("value", 9))


# matrices with holes --------------------------------------------------------------------------------

HOLES = """WITH p AS (SELECT event_type AS state, least(floor(value / 15), 12)::INT AS i, (event_id % 11)::INT AS j, avg(value) AS v, count(*) AS n FROM events GROUP BY ALL),
sp AS (SELECT state, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM p GROUP BY ALL),
g AS (SELECT state, i, unnest(range(j0, j1 + 1)) AS j FROM (SELECT state, j0, j1, unnest(range(i0, i1 + 1)) AS i FROM sp)),
ok AS (SELECT state, i, j, v FROM p WHERE n % 3 <> 0),
near AS (SELECT g.state, g.i, g.j, min(struct_pack(away := abs(g.i - ok.i) + abs(g.j - ok.j), i := ok.i, j := ok.j, v := ok.v)) AS o FROM g JOIN ok ON ok.state = g.state GROUP BY ALL)"""


@query(HOLES + """ SELECT state, i::INT AS i, j::INT AS j, round(CASE WHEN length(state) % 3 = 0 THEN o.v WHEN length(state) % 3 = 2 THEN -o.v ELSE 0 END, 6) + 0.0 AS power, o.i AS from_i, o.j AS from_j, o.away::INT AS away FROM near""")
def filled_power_matrices(spark, d):
    """Matrices of powers over classes of events, a third of which have no valid value; signs follow each state's direction."""
    rows = fx.table(spark, d, "events").groupBy(F.col("event_type").alias("state"), F.least(F.floor(F.col("value") / 15), F.lit(12)).cast("int").alias("i"), (F.col("event_id") % 11).cast("int").alias("j"))
    points = rows.agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n")).withColumn("v", F.when(F.col("n") % 3 != 0, F.col("v")))
    out = holes.filled(holes.full_grid(points, ["state"]), ["state"])
    direction = F.length("state") % 3
    return out.select("state", "i", "j", r(holes.sign_corrected(F.col("v"), F.when(direction == 0, 0).when(direction == 2, 2).otherwise(1)), 6).alias("power"), "from_i", "from_j", "away")
