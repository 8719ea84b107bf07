"""Sequences of sections that come from data: each section has its own directions, and its own known quantities.

Sections are planned by group. What can be concluded depends on a section's active, directed edges and on which of its quantities are
known, so these make its plan; there is one plan for each distinct pair, however many records and sections share it. The
sections of a plan are one partition of a table and are solved side by side by one layered projection; nothing is solved row by row,
and no section is shuffled to be solved.

Storages join the sections of a record: contents follow from any known content forward and backward over known sums, and a section's unknown
sum from the contents on both sides of it. New sums go back into the sections (their plans then know more), until nothing is new.

Tables: flows (record_id, section, n_from, n_to, dir) as flow.oriented() gives them, inactive edges included; givens and results are
tidy (record_id, section, variable, value) with variables e_<at>_<to>, p_, eta_<from>_<to>, x_, insum_, outsum_<node>, dt, and
content_<storage> after a section. Before the first section the section is START. Carried energies have a second section, ``until``.

Defined results: equal givens count once, of different ones for one variable the largest is taken (use track.conflicts to find such rows); null
givens are unknown; givens of sections or edges that the flows don't have are ignored; a section without active edges has no variables but passes contents on.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.operators import flow, solver
from kilojoin.operators.topology import INACTIVE
from kilojoin.plans.storage import cut, shared_dir

START, END = flow.START_PART, flow.END_PART
PART = ["record_id", "section"]
TIDY = [*PART, "variable", "value"]
#: How variables name the part in the rules of one section.
_SELF = "s"


def _inside(variable: str) -> str:
    """e_a_b as the section's rules name it."""
    kind, _, rest = variable.partition("_")
    return "_".join([kind, _SELF, *([rest] if rest else [])])


def _outside(variable: str) -> str:
    kind, _, rest = variable.split("_", 2) if variable.count("_") > 1 else (*variable.split("_"), "")
    return f"{kind}_{rest}" if rest else kind


def rules_of(edges: Sequence[tuple[str, str]], storages: Sequence[str] = (), equal_sums: bool = True) -> list[solver.Rule]:
    """A section's rules; sums of a node are equal unless it is a storage or equal_sums is off."""
    rules = solver.section_rules(list(edges), _SELF, equal_sums=False)
    both = {f for f, _ in edges} & {t for _, t in edges} if equal_sums else set()
    return rules + [solver.equal(solver.name("insum", _SELF, n), solver.name("outsum", _SELF, n)) for n in sorted(both) if n not in storages]


def grouped(flows: DataFrame, known: DataFrame) -> DataFrame:
    """record_id, section, edges (active, sorted), given (map), plan: the sections with what is known of each."""
    edge = F.when(F.col("dir") != INACTIVE, F.struct("n_from", "n_to"))
    edges = flows.groupBy(*PART).agg(F.array_sort(F.collect_set(edge)).alias("edges")).where(F.size("edges") > 0)
    values = known.where("value is not null").groupBy(*PART, "variable").agg(F.max("value").alias("value"))
    given = values.groupBy(*PART).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", "value")))).alias("given"))
    rows = edges.join(given, PART, "left").withColumn("given", F.coalesce("given", F.create_map().cast("map<string,double>")))
    plan = F.to_json(F.struct("edges", F.map_keys("given").alias("known")))
    return rows.withColumn("plan", F.md5(plan))


def solve_sections(flows: DataFrame, known: DataFrame, storages: Sequence[str] = (), equal_sums: bool = True) -> tuple[DataFrame, bool]:
    """record_id, section, variable, value of all sections, and whether every variable of each is known.

    The driver holds one row for each distinct plan: directions times patterns of known variables, not sections.
    """
    spark = flows.sparkSession
    rows = grouped(flows, known)
    path = f"{shared_dir(spark)}/plans-{uuid.uuid4().hex}"
    rows.write.partitionBy("plan").parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    plans = table.groupBy("plan").agg(F.first("edges").alias("edges"), F.first(F.map_keys("given")).alias("known"), F.count(F.lit(1)).alias("n")).collect()
    out, wanted = None, 0
    for p in plans:
        rules = rules_of([tuple(e) for e in p["edges"]], storages, equal_sums)
        names = solver.variables(rules)
        own = [v for v in p["known"] if _inside(v) in names]
        wanted += p["n"] * len(names)
        part = table.where(F.col("plan") == p["plan"]).select(*PART, *[F.col("given")[v].alias(_inside(v)) for v in own])
        # a row carries its variables as one map, so that all plans' rows are alike
        solved = solver.solve(part, rules)
        pairs = F.array(*[F.struct(F.lit(_outside(v)).alias("variable"), F.col(v).cast("double").alias("value")) for v in names])
        tidy = solved.select(*PART, F.inline(pairs)).where("value is not null")
        out = tidy if out is None else out.unionByName(tidy)
    if out is None:
        return spark.createDataFrame([], flows.select(*PART).schema.add("variable", "string").add("value", "double")), True
    out = cut(out)
    return out, out.count() == wanted


def storage_rows(flows: DataFrame, known: DataFrame, storages: Sequence[str]) -> DataFrame:
    """record_id, section (START first), node, charges, discharges, in_sum, out_sum, content: what is known of each storage of a record at each section."""
    ends = F.array(F.struct(F.col("n_to").alias("node"), F.lit(True).alias("i"), F.lit(False).alias("o")), F.struct(F.col("n_from").alias("node"), F.lit(False).alias("i"), F.lit(True).alias("o")))
    at = flows.select(*PART, (F.col("dir") != INACTIVE).alias("on"), F.inline(ends)).where(F.col("node").isin(*storages))
    sides = at.groupBy(*PART, "node").agg(F.max(F.col("on") & F.col("i")).alias("charges"), F.max(F.col("on") & F.col("o")).alias("discharges"))
    all_ = flows.select(*PART).distinct().unionByName(flows.select("record_id", F.lit(START).cast("long").alias("section")).distinct())
    rows = all_.join(at.select("record_id", "node").distinct(), "record_id").join(sides, [*PART, "node"], "left")
    kind, node = F.split_part("variable", F.lit("_"), F.lit(1)), F.regexp_replace("variable", "^[a-z]+_", "")
    own = known.where("value is not null and (variable like 'insum\\_%' or variable like 'outsum\\_%' or variable like 'content\\_%')").withColumns({"kind": kind, "node": node})
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k)
    values = own.groupBy(*PART, "node").agg(one("insum"), one("outsum"), one("content"))
    rows = rows.join(values, [*PART, "node"], "left")
    side = lambda on, v: F.when(F.coalesce(on, F.lit(False)), F.col(v)).otherwise(F.lit(0.0))
    return rows.select(
        *PART, "node", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("charges", "discharges")],
        side(F.col("charges"), "insum").alias("in_sum"), side(F.col("discharges"), "outsum").alias("out_sum"), "content",
    )


def contents(rows: DataFrame) -> DataFrame:
    """storage_rows() with contents spread over known changes, changes between known contents, and the sums that follow from those.

    Sections with an unknown change begin a run; within a run every content follows from any known one. One window over the sections of a storage.
    """
    w = Window.partitionBy("record_id", "node").orderBy("section")
    change = F.when(F.col("section") != START, F.col("in_sum") - F.col("out_sum"))
    opens = (F.col("section") == START) | change.isNull()
    rows = rows.withColumns({"change": change, "run": F.sum(opens.cast("long")).over(w)})
    in_run = Window.partitionBy("record_id", "node", "run").orderBy("section")
    rows = rows.withColumn("since", F.sum(F.when(opens, 0.0).otherwise(F.col("change"))).over(in_run))
    base = F.max(F.col("content") - F.col("since")).over(Window.partitionBy("record_id", "node", "run"))
    rows = rows.withColumn("content", F.coalesce("content", base + F.col("since")))
    change = F.coalesce("change", F.when(F.col("section") != START, F.col("content") - F.lag("content").over(w)))
    rows = rows.withColumn("change", change)
    gain = F.when(F.col("charges"), F.coalesce("in_sum", F.col("change") + F.col("out_sum")))
    loss = F.when(F.col("discharges"), F.coalesce("out_sum", F.col("in_sum") - F.col("change")))
    return rows.select(*PART, "node", "charges", "discharges", gain.alias("in_sum"), loss.alias("out_sum"), "content")


def _tidy(rows: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.concat(F.lit(k), "node").alias("variable"), F.col(c).alias("value")) for k, c in (("insum_", "in_sum"), ("outsum_", "out_sum"), ("content_", "content"))])
    return rows.select(*PART, F.inline(pairs)).where("value is not null")


def carried(rows: DataFrame, ends: bool = True) -> DataFrame:
    """record_id, section, until, variable, value: energies (ste_) and largest energies (maxe_) that storages carry from one section to another.

    Only storages all of whose contents are known have them. ends: from the start, or to the end, of the record only, a number of rows in
    proportion to the sections; else from each charge to each later discharge.
    """
    start = rows.where(F.col("section") == START).select("record_id", "node", F.col("content").alias("_init"))
    lacking = rows.where("content is null").select("record_id", "node").distinct()
    own = rows.where(F.col("section") != START).join(lacking, ["record_id", "node"], "left_anti")
    pairs = flow.carry_edges(own, start, ends)
    values = F.array(*[F.struct(F.concat(F.lit(k), "node").alias("variable"), F.col(c).alias("value")) for k, c in (("ste_", "energy"), ("maxe_", "max_energy"))])
    return pairs.select("record_id", F.col("part_from").alias("section"), F.col("part_to").alias("until"), F.inline(values))


def solve(flows: DataFrame, givens: DataFrame, storages: Sequence[str], equal_sums: bool = True, ends: bool = True) -> DataFrame:
    """record_id, section, until (null but for carried energies), variable, value: all that follows from the givens of each record.

    Every pass solves all sections and then all storages; passes end when every variable is known or a pass finds nothing new.
    """
    flows, givens = cut(flows), cut(givens.select(*TIDY))
    known, before = givens, -1
    while True:
        solved, whole = solve_sections(flows, known.where(~F.col("variable").startswith("content_")), storages, equal_sums)
        anchors = givens.where(F.col("variable").startswith("content_"))
        rows = cut(contents(storage_rows(flows, solved.unionByName(anchors), storages))) if storages else None
        found = solved if rows is None else solved.unionByName(_tidy(rows)).distinct()
        n = found.count()
        if whole or n == before:
            break
        known, before = found.where("section <> %d" % START), n
    none = F.lit(None).cast("long")
    out = solved.select(*PART, none.alias("until"), "variable", "value")
    if rows is None:
        return out
    more = _tidy(rows).join(solved.select(*PART, "variable"), [*PART, "variable"], "left_anti").select(*PART, none.alias("until"), "variable", "value")
    return out.unionByName(more).unionByName(carried(rows, ends))


def edges_of(rows: DataFrame, sections: Sequence[Sequence[tuple[object, object]]], record: Column) -> DataFrame:
    """flows of given sections (lists of directed edges) for each of ``rows``: a sequence graph from states."""
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias("section"), F.lit(str(f)).alias("n_from"), F.lit(str(t)).alias("n_to"), F.lit(0).alias("dir")) for i, edges in enumerate(sections) for f, t in edges])
    return rows.select(record.alias("record_id"), F.inline(parts))
