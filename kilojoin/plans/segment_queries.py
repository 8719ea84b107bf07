"""Zero crossings, sections and their energies."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilojoin.operators import segment
from kilojoin.plans import fixtures as fx
from kilojoin.plans.fixtures import SEG, SIG
from kilojoin.plans.register import query, r


def cut(spark, d):
    return segment.intervals(segment.add_zero_crossings(fx.signals(spark, d)))


Z_LONG = "SELECT record_id, idx, t, 'p1' AS sig_id, p1 AS v FROM z UNION ALL SELECT record_id, idx, t, 'p2', p2 FROM z UNION ALL SELECT record_id, idx, t, 'p3', p3 FROM z"


@query(SEG + Z_LONG)
def zero_crossings(spark, d):
    return segment.add_zero_crossings(fx.signals(spark, d))


@query(SEG + "SELECT record_id, idx, CASE WHEN l AND r THEN 'Mixed' WHEN l THEN 'Left' WHEN r THEN 'Right' ELSE 'None' END AS event FROM ze")
def step_detect(spark, d):
    return segment.steps(segment.add_zero_crossings(fx.signals(spark, d))).select("record_id", "idx", "event")


@query(SEG + "SELECT record_id, section, min(idx) AS i_from, max(idx) + 1 AS i_to, min(t) AS t0, max(t + dt) AS t1 FROM cut GROUP BY ALL")
def segment_sections(spark, d):
    return segment.sections(cut(spark, d))


@query(SEG + "SELECT record_id, section, sig_id, round(dt, 3) + 0.0 AS dt, round(e, 3) + 0.0 AS e FROM energy")
def section_energy(spark, d):
    return segment.section_energy(cut(spark, d)).select("record_id", "section", "sig_id", r("dt"), r("e"))


@query(SEG + """, m AS (SELECT record_id, section FROM energy GROUP BY ALL HAVING NOT bool_and(abs(e) < 5000) AND max(dt) >= 3600)
SELECT record_id, section, sig_id, round(dt, 3) + 0.0 AS dt, round(e, 3) + 0.0 AS e FROM energy JOIN m USING (record_id, section)""")
def major_sections(spark, d):
    return segment.major(segment.section_energy(cut(spark, d)), 5000.0, 3600.0).select("record_id", "section", "sig_id", r("dt"), r("e"))


@query(SEG + "SELECT record_id, section, sig_id, round(e, 3) + 0.0 AS e FROM energy JOIN (SELECT record_id, section FROM energy GROUP BY ALL HAVING max(dt) > 1800) USING (record_id, section)")
def longer_sections(spark, d):
    return segment.longer(segment.section_energy(cut(spark, d)), 1800.0, strict=True).select("record_id", "section", "sig_id", r("e"))


@query(SEG + "SELECT record_id, section, bool_and(abs(e) < 1000) AS below FROM energy GROUP BY ALL")
def energy_below(spark, d):
    return segment.energy_below(segment.section_energy(cut(spark, d)), 1000.0)


@query(SEG + """, c AS (SELECT record_id, section, sig_id, min(least(v, w)) >= 0 OR max(greatest(v, w)) <= 0 AS c FROM cut GROUP BY ALL)
SELECT record_id, section, bool_and(c) AS consistent FROM c GROUP BY ALL""")
def consistent_sections(spark, d):
    return segment.consistent(cut(spark, d))


@query(SEG + "SELECT DISTINCT record_id, dense_rank() OVER (PARTITION BY record_id ORDER BY section) - 1 AS section, idx FROM cut")
def reindexed_sections(spark, d):
    return segment.reindexed(cut(spark, d)).select("record_id", "section", "idx").distinct()


@query(SEG + """, last AS (SELECT record_id, section, sig_id, max(idx) + 1 AS idx, max_by(t + dt, idx) AS t, max_by(w, idx) AS v FROM cut GROUP BY ALL)
SELECT record_id, section, idx, t, sig_id, v FROM cut UNION ALL SELECT record_id, section, idx, t, sig_id, v FROM last""")
def section_samples(spark, d):
    return segment.section_samples(cut(spark, d))


@query(SEG + f"SELECT record_id, idx, sig_id, v FROM ({Z_LONG})")
def concatenated_sections(spark, d):
    return segment.concatenated(segment.section_samples(cut(spark, d))).select("record_id", "idx", "sig_id", "v")


@query(SIG + "SELECT record_id, idx, t, t - v * (t2 - t) / (v2 - v) AS tz FROM nxt WHERE sig_id = 'p1' AND v * v2 < 0")
def zero_times(spark, d):
    from kilojoin.operators.signal import over

    w = over()
    rows = fx.one(spark, d).withColumns({"t2": F.lead("t").over(w), "v2": F.lead("v").over(w)}).where("v * v2 < 0")
    return rows.select("record_id", "idx", "t", segment.zero_time(F.col("t"), F.col("t2"), F.col("v"), F.col("v2")).alias("tz"))
