"""Tables of the benchmark as signals, powers and topologies, in Spark and as SQL.

Each user's events are one record: idx counts them by time, t is seconds since 2024, and three signals derive from value and event_id.
Orders give flows from nations (sources) over regions (crossings, storages) to market segments (sinks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, idx, t, p1, p2, p3."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col("ts")) / 1e6
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    rows = ev.select(F.col("user_id").alias("record_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), t.alias("t"), "value", "event_id")
    return rows.select("record_id", "idx", "t", (F.col("value") - 50).alias("p1"), (30 - F.col("value") * 0.5).alias("p2"), (F.col("event_id") % 5 - 2).cast("double").alias("p3"))


def signals(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> DataFrame:
    """record_id, idx, t, sig_id, v of p1, p2, p3."""
    return wide(spark, sf_dir).unpivot(["record_id", "idx", "t"], only or ["p1", "p2", "p3"], "sig_id", "v")


def one(spark: SparkSession, sf_dir: str, sig: str = "p1") -> DataFrame:
    return signals(spark, sf_dir, [sig])


#: The same as SQL, to be followed by a SELECT.
SIG = f"""WITH ev AS (SELECT user_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  (epoch_us(ts) - epoch_us(TIMESTAMP '{EPOCH}')) / 1e6 AS t, value, event_id FROM events),
wide AS (SELECT record_id, idx, t, value - 50 AS p1, 30 - value * 0.5 AS p2, (event_id % 5 - 2)::DOUBLE AS p3 FROM ev),
sig AS (SELECT record_id, idx, t, 'p1' AS sig_id, p1 AS v FROM wide UNION ALL SELECT record_id, idx, t, 'p2', p2 FROM wide
  UNION ALL SELECT record_id, idx, t, 'p3', p3 FROM wide),
nxt AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM sig WINDOW w AS (PARTITION BY record_id, sig_id ORDER BY idx))
"""


def _at_crossing(n: str) -> str:
    """Signal n at a crossing: zero at its own, else on its line, on the side of zero that it is on by then."""
    p, q = f"p{n}", f"q{n}"
    side = f"CASE WHEN t - {p} * (t2 - t) / ({q} - {p}) > tz OR (t - {p} * (t2 - t) / ({q} - {p}) = tz AND 'p{n}' > own) THEN {p} ELSE {q} END"
    bound = lambda f: f"CASE WHEN {p} * {q} < 0 THEN {f}({side}, 0) ELSE {f}({p}, {q}) END"
    return f"CASE own WHEN 'p{n}' THEN 0 ELSE least(greatest({p} + ({q} - {p}) / (t2 - t) * (tz - t), {bound('least')}), {bound('greatest')}) END"


#: Zero crossings, events and sections on top of SIG.
SEG = SIG + """, wl AS (SELECT *, lead(t) OVER w AS t2, lead(p1) OVER w AS q1, lead(p2) OVER w AS q2, lead(p3) OVER w AS q3 FROM wide
  WINDOW w AS (PARTITION BY record_id ORDER BY idx)),
cross_ AS (
  SELECT record_id, idx, t - p1 * (t2 - t) / (q1 - p1) AS tz, 'p1' AS own, t, t2, p1, q1, p2, q2, p3, q3 FROM wl WHERE p1 * q1 < 0
  UNION ALL SELECT record_id, idx, t - p2 * (t2 - t) / (q2 - p2), 'p2', t, t2, p1, q1, p2, q2, p3, q3 FROM wl WHERE p2 * q2 < 0
  UNION ALL SELECT record_id, idx, t - p3 * (t2 - t) / (q3 - p3), 'p3', t, t2, p1, q1, p2, q2, p3, q3 FROM wl WHERE p3 * q3 < 0),
zrows AS (SELECT record_id, idx AS i0, 0 AS k, t, p1, p2, p3 FROM wide UNION ALL
  SELECT record_id, idx, row_number() OVER (PARTITION BY record_id, idx ORDER BY tz, own), tz,
    """ + ", ".join(map(_at_crossing, "123")) + """ FROM cross_),
z AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY i0, k) - 1 AS idx, t, p1, p2, p3 FROM zrows),
zn AS (SELECT *, lead(t) OVER w AS t2, lead(p1) OVER w AS q1, lead(p2) OVER w AS q2, lead(p3) OVER w AS q3, lead(idx, 2) OVER w IS NULL AS at_end FROM z
  WINDOW w AS (PARTITION BY record_id ORDER BY idx)),
ze AS (SELECT *, (p1 = 0 AND q1 <> 0) OR (p2 = 0 AND q2 <> 0) OR (p3 = 0 AND q3 <> 0) AS l, (p1 <> 0 AND q1 = 0) OR (p2 <> 0 AND q2 = 0) OR (p3 <> 0 AND q3 = 0) AS r
  FROM zn WHERE t2 IS NOT NULL),
zs AS (SELECT *, sum(CASE WHEN l AND NOT at_end THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY idx ROWS UNBOUNDED PRECEDING)
  + coalesce(sum(CASE WHEN r AND NOT at_end THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM ze),
cut AS (SELECT record_id, section::BIGINT AS section, idx, t, t2 - t AS dt, 'p1' AS sig_id, p1 AS v, q1 AS w FROM zs
  UNION ALL SELECT record_id, section::BIGINT, idx, t, t2 - t, 'p2', p2, q2 FROM zs UNION ALL SELECT record_id, section::BIGINT, idx, t, t2 - t, 'p3', p3, q3 FROM zs),
energy AS (SELECT record_id, section, sig_id, sum(dt) AS dt, sum(dt * (v + w) / 2) AS e FROM cut GROUP BY ALL)
"""

#: Flows on the edges a-b (p1 out, p2 in) and b-c (p2 out, p3 in) of a small topology, on top of SEG.
FLOW = SEG + """, edges AS (SELECT * FROM (VALUES ('a', 'b', 'p1', 'p2'), ('b', 'c', 'p2', 'p3')) AS x(n_from, n_to, sig_out, sig_in)),
flows AS (SELECT o.record_id, o.section, n_from, n_to, o.dt, o.e AS e_out, i.e AS e_in FROM edges
  JOIN energy o ON o.sig_id = sig_out JOIN energy i ON i.sig_id = sig_in AND i.record_id = o.record_id AND i.section = o.section),
orient AS (SELECT record_id, section, CASE WHEN e_out < 0 THEN n_to ELSE n_from END AS n_from, CASE WHEN e_out < 0 THEN n_from ELSE n_to END AS n_to,
  CASE WHEN e_out > 0 THEN 0 WHEN e_out < 0 THEN 2 ELSE 1 END AS dir, dt,
  CASE WHEN e_out > 0 THEN e_out WHEN e_out < 0 THEN -e_in END AS e_out, CASE WHEN e_out > 0 THEN e_in WHEN e_out < 0 THEN -e_out END AS e_in FROM flows),
keys AS (SELECT record_id, section, coalesce(string_agg(CASE WHEN dir <> 1 THEN n_from || '>' || n_to END, ',' ORDER BY n_from || '>' || n_to), '') AS state_key FROM orient GROUP BY ALL),
firsts AS (SELECT record_id, state_key, row_number() OVER (PARTITION BY record_id ORDER BY min(section)) - 1 AS state FROM keys GROUP BY record_id, state_key),
states AS (SELECT record_id, section, state_key, state FROM keys JOIN firsts USING (record_id, state_key)),
sums AS (SELECT record_id, section, node, sum(i) AS in_sum, sum(o) AS out_sum FROM (
  SELECT record_id, section, n_to AS node, e_in AS i, NULL::DOUBLE AS o FROM orient UNION ALL SELECT record_id, section, n_from, NULL, e_out FROM orient) GROUP BY ALL)
"""
NODES = {"a": "AlwaysSource", "b": "Storage", "c": "Sink"}
EDGES = [("a", "b", "p1", "p2"), ("b", "c", "p2", "p3")]


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NODES.items()), "node string, type string")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "n_from string, n_to string, sig_out string, sig_in string")
