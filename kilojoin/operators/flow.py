"""Energy flows of sections on a topology: orientation, states, sums, shares, efficiencies and storages.

flows: record_id, section, n_from, n_to, dt, e_out (at n_from), e_in (at n_to); signs as measured along the topology's edge.
Topologies are small tables and broadcast behind a check of their size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.functions import exprs
from kilojoin.operators import record
from kilojoin.operators.topology import BACKWARD, FORWARD, INACTIVE, SINKS, SOURCES

PART = ["record_id", "section"]
#: Rows of a topology that may be broadcast.
SMALL = 10_000


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def attach(energy: DataFrame, edges: DataFrame) -> DataFrame:
    """flows from section energies (record_id, section, sig_id, dt, e); edges: n_from, n_to, sig_out, sig_in name the signals at both ends.

    Both ends meet by one aggregation, which needs no exchange of its own where energies are dealt out by record.
    """
    ends = F.array(F.struct(F.col("sig_out").alias("sig_id"), F.lit(True).alias("_out")), F.struct(F.col("sig_in").alias("sig_id"), F.lit(False).alias("_out")))
    key = [*PART, "n_from", "n_to", "sig_out", "sig_in"]
    rows = energy.join(small(edges.select("n_from", "n_to", "sig_out", "sig_in", F.inline(ends))), "sig_id")
    at = lambda out, c: F.max(F.when(F.col("_out") if out else ~F.col("_out"), F.col(c)))
    both = rows.groupBy(*key).agg(at(True, "dt").alias("dt"), at(True, "e").alias("e_out"), at(False, "e").alias("e_in"), F.count_if("_out").alias("_o"), F.count(F.lit(1)).alias("_n"))
    return both.where("_o > 0 and _n > _o").select(*PART, "n_from", "n_to", "dt", "e_out", "e_in")


def oriented(flows: DataFrame) -> DataFrame:
    """flows with dir, edges turned so that energy is positive; inactive edges (zero sum) have null energies."""
    s = exprs.sign(F.col("e_out"))
    d = F.when(s > 0, FORWARD).when(s < 0, BACKWARD).otherwise(INACTIVE)
    back = F.col("dir") == BACKWARD
    rows = flows.withColumn("dir", d)
    active = F.col("dir") != INACTIVE
    return rows.select(
        *PART,
        F.when(back, F.col("n_to")).otherwise(F.col("n_from")).alias("n_from"),
        F.when(back, F.col("n_from")).otherwise(F.col("n_to")).alias("n_to"),
        "dir",
        "dt",
        F.when(active, F.when(back, -F.col("e_in")).otherwise(F.col("e_out"))).alias("e_out"),
        F.when(active, F.when(back, -F.col("e_out")).otherwise(F.col("e_in"))).alias("e_in"),
    )


def state_keys(flows: DataFrame) -> DataFrame:
    """record_id, section, state_key: the active edges of a section as one string."""
    edge = F.when(F.col("dir") != INACTIVE, F.concat_ws(">", "n_from", "n_to"))
    return flows.groupBy(*PART).agg(F.array_join(F.array_sort(F.collect_set(edge)), ",").alias("state_key"))


def states(flows: DataFrame) -> DataFrame:
    """record_id, section, state: sections with equal active edges share a state, numbered first come, first served."""
    keys = state_keys(flows)
    first = keys.groupBy("record_id", "state_key").agg(F.min("section").alias("_f"))
    number = first.withColumn("state", (F.row_number().over(Window.partitionBy("record_id").orderBy("_f")) - 1).cast("long"))
    return keys.join(number.select("record_id", "state_key", "state"), ["record_id", "state_key"]).select(*PART, "state_key", "state")


def cumulate_states(flows: DataFrame) -> DataFrame:
    """record_id, state, n_from, n_to, dt, e_out, e_in: sums over the sections of each state."""
    own = flows.join(states(flows).select(*PART, "state"), PART).where(F.col("dir") != INACTIVE)
    return own.groupBy("record_id", "state", "n_from", "n_to").agg(*[F.sum(c).alias(c) for c in ("dt", "e_out", "e_in")])


def cumulate(flows: DataFrame) -> DataFrame:
    """record_id, n_from, n_to, dt, e_out, e_in: sums over all sections; opposite directions stay apart."""
    return flows.where(F.col("dir") != INACTIVE).groupBy("record_id", "n_from", "n_to").agg(*[F.sum(c).alias(c) for c in ("dt", "e_out", "e_in")])


def node_sums(flows: DataFrame, part: list[str] | None = None) -> DataFrame:
    """part, node, in_sum, out_sum; a side without edges is null."""
    part = part or PART
    none = F.lit(None).cast("double")
    ends = F.array(
        F.struct(F.col("n_to").alias("node"), F.col("e_in").alias("i"), none.alias("o")),
        F.struct(F.col("n_from").alias("node"), none.alias("i"), F.col("e_out").alias("o")),
    )
    rows = flows.select(*part, F.explode(ends).alias("x"))
    return rows.groupBy(*part, F.col("x.node").alias("node")).agg(F.sum("x.i").alias("in_sum"), F.sum("x.o").alias("out_sum"))


def split_factors(flows: DataFrame, part: list[str] | None = None) -> DataFrame:
    """part, n_from, n_to, x_out, x_in: each edge's share of the sums at both ends."""
    part = part or PART
    sums = node_sums(flows, part)
    a = sums.select(*part, F.col("node").alias("n_from"), F.col("out_sum").alias("_o"))
    b = sums.select(*part, F.col("node").alias("n_to"), F.col("in_sum").alias("_i"))
    rows = flows.join(a, [*part, "n_from"]).join(b, [*part, "n_to"])
    return rows.select(*part, "n_from", "n_to", exprs.safe_div(F.col("e_out"), F.col("_o")).alias("x_out"), exprs.safe_div(F.col("e_in"), F.col("_i")).alias("x_in"))


def edge_etas(flows: DataFrame, part: list[str] | None = None) -> DataFrame:
    """part, n_from, n_to, eta, power."""
    return flows.select(*(part or PART), "n_from", "n_to", exprs.safe_div(F.col("e_in"), F.col("e_out")).alias("eta"), exprs.safe_div(F.col("e_out"), F.col("dt")).alias("power"))


def system_eta(flows: DataFrame, nodes: DataFrame, part: list[str] | None = None) -> DataFrame:
    """part, eta: what reaches sinks over what leaves sources."""
    part = part or PART
    types = small(nodes)
    rows = node_sums(flows, part).join(types, "node")
    sinks, sources = F.sum(F.when(F.col("type").isin(SINKS), F.col("in_sum"))), F.sum(F.when(F.col("type").isin(SOURCES), F.col("out_sum")))
    return rows.groupBy(*part).agg(exprs.safe_div(sinks, sources).alias("eta"))


def system_eta_with_storage(flows: DataFrame, nodes: DataFrame, content: DataFrame, weight: float = 20.0) -> DataFrame:
    """record_id, eta: as system_eta, with weight * (first - last content) of the storage (record_id, init, exit) added to what sources give."""
    types = small(nodes)
    rows = node_sums(flows, ["record_id"]).join(types, "node")
    sinks, sources = F.sum(F.when(F.col("type").isin(SINKS), F.col("in_sum"))), F.sum(F.when(F.col("type").isin(SOURCES), F.col("out_sum")))
    sums = rows.groupBy("record_id").agg(sinks.alias("_i"), sources.alias("_o")).join(content, "record_id")
    return sums.select("record_id", exprs.safe_div(F.col("_i"), F.col("_o") + weight * (F.col("init") - F.col("exit"))).alias("eta"))


def storage_sums(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """record_id, section, node, in_sum, out_sum of storages."""
    types = small(nodes.where("type = 'Storage'"))
    return node_sums(flows).join(types.select("node"), "node", "left_semi")


def storage_content(sums: DataFrame, initial: float = 0.0) -> DataFrame:
    """record_id, section, node, content: after each section, from the initial content on."""
    w = Window.partitionBy("record_id", "node").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    change = F.coalesce("in_sum", F.lit(0.0)) - F.coalesce("out_sum", F.lit(0.0))
    return sums.select(*PART, "node", (F.lit(initial) + F.sum(change).over(w)).alias("content"))


def balance(sums: DataFrame) -> DataFrame:
    """record_id, node, balance: last less first content."""
    change = F.coalesce("in_sum", F.lit(0.0)) - F.coalesce("out_sum", F.lit(0.0))
    return sums.groupBy("record_id", "node").agg(F.sum(change).alias("balance"))


#: The start and the end of a sequence as part numbers.
START_PART, END_PART = -1, 2**63 - 1


def carry_edges(sums: DataFrame, initial: float | DataFrame = 0.0, ends: bool = False) -> DataFrame:
    """record_id, node, part_from, part_to, max_energy, energy: what each later discharge, and the end, takes from the start and each charge.

    A discharge takes from what is left of each earlier charge in proportion, so a charge keeps the product of
    (1 - discharge / content) over the discharges since: a difference of running sums of logarithms. Pairs exist within one
    storage of one record only, and are the result. initial: a content, or a table (record_id, node, _init). ends: only what comes from
    the start or stays to the end.
    """
    own, all_ = _kept(sums if isinstance(initial, DataFrame) else sums.withColumn("_init", F.lit(float(initial))), initial)
    start = all_.select("record_id", "node", F.lit(START_PART).cast("long").alias("part_from"), F.col("_init").alias("_e"), F.lit(0.0).alias("_from"))
    charges = own.where("in_sum > 0").select("record_id", "node", F.col("section").alias("part_from"), F.col("in_sum").alias("_e"), F.col("_l1").alias("_from"))
    end = all_.select("record_id", "node", F.lit(END_PART).cast("long").alias("part_to"), F.col("_end").alias("_to"), F.lit(1.0).alias("_share"))
    discharges = own.where("out_sum > 0").select("record_id", "node", F.col("section").alias("part_to"), F.col("_l0").alias("_to"), "_share")
    if ends:
        pairs = start.join(record.stacked(discharges, end, "record_id", "node"), ["record_id", "node"]).unionByName(charges.join(end, ["record_id", "node"]))
    else:
        pairs = record.stacked(start, charges, "record_id", "node").join(record.stacked(discharges, end, "record_id", "node"), ["record_id", "node"]).where("part_from < part_to")
    most = F.col("_e") * F.exp(F.col("_to") - F.col("_from"))
    return pairs.select("record_id", "node", "part_from", "part_to", most.alias("max_energy"), (most * F.col("_share")).alias("energy"))


def _kept(sums: DataFrame, initial: float | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each section's share of what is left, and the running logarithms of what stays before (_l0) and after it (_l1); and the start and end of each storage."""
    if isinstance(initial, DataFrame):
        sums = sums.join(initial, ["record_id", "node"])
    w = Window.partitionBy("record_id", "node").orderBy("section")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    gain, loss = F.coalesce("in_sum", F.lit(0.0)), F.coalesce("out_sum", F.lit(0.0))
    rows = sums.withColumn("_after", F.col("_init") + F.sum(gain - loss).over(upto)).withColumn("_before", F.col("_after") + loss)
    share = F.when(loss > 0, exprs.safe_div(loss, F.col("_before"))).otherwise(0.0)
    rows = rows.withColumn("_share", share).withColumn("_log", F.log(F.greatest(1 - F.col("_share"), F.lit(1e-300))))
    rows = rows.withColumn("_l0", F.coalesce(F.sum("_log").over(before), F.lit(0.0))).withColumn("_l1", F.sum("_log").over(upto))
    own = rows.select("record_id", "node", "section", "in_sum", "out_sum", "_share", "_l0", "_l1", "_init")
    return own, own.groupBy("record_id", "node").agg(F.max_by("_l1", "section").alias("_end"), F.first("_init").alias("_init"))


def differences(before: DataFrame, after: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, before, delta, after; a side that is missing counts as unknown."""
    b, a = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    return b.join(a, keys, "full").select(*keys, "before", (F.col("after") - F.col("before")).alias("delta"), "after")


def checked_zip(a: DataFrame, b: DataFrame, keys: list[str], f: Callable[[Column, Column], Column], value: str = "value", name: str = "value") -> DataFrame:
    """keys, name: f of both tables' values; a key that only one of them has is an error."""
    both = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ia")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_ib")), keys, "full")
    both = record.checked(both, F.col("_ia").isNull() | F.col("_ib").isNull(), "a key is in one table only")
    return both.select(*keys, f(F.col("_a"), F.col("_b")).alias(name))


def fold_nodes(flows: DataFrame, part: list[str], out: Callable[[], Column], into: Callable[[], Column], f: Callable[[Column], Column] = F.sum) -> DataFrame:
    """part, node, value: f over what each edge gives to its start (out) and to its end (into); nulls give nothing."""
    ends = F.array(F.struct(F.col("n_from").alias("node"), out().cast("double").alias("v")), F.struct(F.col("n_to").alias("node"), into().cast("double").alias("v")))
    return flows.select(*part, F.inline(ends)).groupBy(*part, "node").agg(f(F.col("v")).alias("value"))


def cumulate_given_states(flows: DataFrame, numbers: DataFrame) -> DataFrame:
    """record_id, state, n_from, n_to, dt, e_out, e_in with prescribed numbers (state_key, state); sections of other states are dropped."""
    own = states(flows).select(*PART, "state_key").join(small(numbers.select("state_key", "state")), "state_key")
    own = flows.join(own.select(*PART, "state"), PART).where(F.col("dir") != INACTIVE)
    return own.groupBy("record_id", "state", "n_from", "n_to").agg(*[F.sum(c).alias(c) for c in ("dt", "e_out", "e_in")])


def accumulate(flows: DataFrame, part: list[str] | None = None) -> DataFrame:
    """part, n_from, n_to, dt, e_out, e_in, eta, power, x_out, x_in: energies and times of intervals summed, the rest solved again from the sums."""
    part = part or PART
    own = flows.groupBy(*part, "n_from", "n_to").agg(*[F.sum(c).alias(c) for c in ("dt", "e_out", "e_in")])
    whole = lambda c, node: F.sum(c).over(Window.partitionBy(*part, node))
    x_out, x_in = exprs.safe_div(F.col("e_out"), whole("e_out", "n_from")), exprs.safe_div(F.col("e_in"), whole("e_in", "n_to"))
    eta, power = exprs.safe_div(F.col("e_in"), F.col("e_out")), exprs.safe_div(F.col("e_out"), F.col("dt"))
    return own.select(*part, "n_from", "n_to", "dt", "e_out", "e_in", eta.alias("eta"), power.alias("power"), x_out.alias("x_out"), x_in.alias("x_in"))


def couple_sums(sums: DataFrame, scalars: DataFrame, mode: str, part: list[str] | None = None) -> DataFrame:
    """How a storage's sum over a section goes with its sums over intervals (part, node, idx, dt, sum).

    integral: part, node, sum from the intervals. equal: every interval has the section's sum (scalars: part, node, sum).
    spread: the section's sum is dealt out in proportion to time.
    """
    if mode not in ("integral", "equal", "spread"):
        raise ValueError(mode)
    part = part or PART
    key = [*part, "node"]
    if mode == "integral":
        return sums.groupBy(*key).agg(F.sum("sum").alias("sum"))
    own = sums.select(*key, "idx", "dt").join(scalars.select(*key, F.col("sum").alias("_all")), key)
    if mode == "equal":
        return own.select(*key, "idx", F.col("_all").alias("sum"))
    time = sums.groupBy(*key).agg(F.sum("dt").alias("_t"))
    return own.join(time, key).select(*key, "idx", exprs.safe_div(F.col("_all") * F.col("dt"), F.col("_t")).alias("sum"))
