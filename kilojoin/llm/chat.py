"""Logged conversations: snapshots that a longer one repeats are collapsed, the rest is rendered.

A conversation that is logged after every turn appears many times, each time a prefix of the next. Each turn has a
digest of its place, role and text; the digest of a prefix is rolled forward turn by turn by joining the next turn's in (exclusive
or of two 64-bit halves, in a window over the conversation), so two prefixes are equal if and only if their digests are, up to collisions of 120 bits. A
conversation stays if its whole digest is no proper prefix of another (anti-join against the distinct digests of proper
prefixes), and of equal conversations the one with the smallest conv_id stays. Prefix digests are made distinct before the
shuffle, so that a first turn in a third of all conversations is one row for each task.

The windows run over sorted rows, which may spill; a whole conversation meets in one row only where it is rendered, as
its text does. DataFrame operations only.

Defined results: turns are in ascending order (null first), equal ones by role and text; every repeated row is a
turn of its own. A null role is "unknown", a null text is empty. A row with a null conv_id is a conversation of its own, of one
turn; of equal ones one stays, and any equal logged conversation counts with them. A marker inside a role or a text is escaped with a
zero-width space, and a line break in a role is a blank, so rendered turns can't be forged. An empty table gives no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: How the markers look inside a role or a text (fixed values): with a zero-width space.
SAFE_START, SAFE_END = "<|​im_start|>", "<|​im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), _digest(role, text).alias("d"))


def _digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def _halves(place: Column, d: Column) -> list[Column]:
    """Two 64-bit numbers of a turn's place and digest."""
    both = F.md5(F.concat(place.cast("string"), F.lit(":"), d).cast("binary"))
    return [F.conv(F.substring(both, at, 15), 16, 10).cast("long") for at in (1, 17)]


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, k (turns), a, b (digest of the first k turns), last (whether these are all); null conv_ids come as one turn each."""
    turns = _turns(conversations).select("conv_id", "turn", "role", "d")
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "d")
    named = turns.where("conv_id is not null").withColumn("k", F.row_number().over(own)).withColumn("last", F.lead(F.lit(False), 1, True).over(own))
    a, b = _halves(F.col("k"), F.col("d"))
    rolled = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = named.withColumns({"a": a, "b": b}).select("conv_id", "k", F.bit_xor("a").over(rolled).alias("a"), F.bit_xor("b").over(rolled).alias("b"), "last")
    a, b = _halves(F.lit(1), F.col("d"))
    return named.unionByName(turns.where("conv_id is null").select("conv_id", F.lit(1).alias("k"), a.alias("a"), b.alias("b"), F.lit(True).alias("last")))


def maximal(conversations: DataFrame) -> DataFrame:
    """a, b, conv_id, n_turns, n_logged (equal conversations) of those that no longer one begins with."""
    own = prefixes(conversations)
    proper = own.where("not last").select("k", "a", "b").distinct()
    one = own.where("last").groupBy("k", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    return one.join(proper, ["k", "a", "b"], "left_anti").select("a", "b", "conv_id", F.col("k").alias("n_turns"), "n_logged")


def _safe(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(START), F.lit(SAFE_START)), F.lit(END), F.lit(SAFE_END))


def _line() -> Column:
    role = F.regexp_replace(_safe(F.col("role")), "[\\r\\n]", " ")
    return F.concat(F.lit(START), role, F.lit("\n"), _safe(F.col("text")), F.lit(END + "\n"))


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged, rendered of the maximal conversations."""
    kept, turns = maximal(conversations), _turns(conversations)
    named = turns.join(kept.where("conv_id is not null").select("conv_id"), "conv_id", "left_semi").select("conv_id", F.struct("turn", "role", "d", _line().alias("line")).alias("t"))
    named = named.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    named = named.select("conv_id", F.array_join(F.transform("ts", lambda t: t["line"]), "").alias("rendered"))
    out = kept.join(named, "conv_id").select("conv_id", "n_turns", "n_logged", "rendered")
    a, b = _halves(F.lit(1), F.col("d"))
    alone = turns.where("conv_id is null").select(a.alias("a"), b.alias("b"), _line().alias("rendered")).groupBy("a", "b").agg(F.min("rendered").alias("rendered"))
    return out.unionByName(kept.where("conv_id is null").join(alone, ["a", "b"]).select("conv_id", "n_turns", "n_logged", "rendered"))


_SQL_SAFE = f"replace(replace({{}}, '{START}', '<|' || chr(8203) || 'im_start|>'), '{END}', '<|' || chr(8203) || 'im_end|>')"
ORACLE = f"""
WITH turns AS (SELECT coalesce(conv_id::VARCHAR, 'row ' || row_number() OVER ()) AS c, conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
digests AS (SELECT *, md5(length(role) || ':' || role || text) AS d FROM turns),
chains AS (SELECT c, conv_id, string_agg(d, '') OVER w AS h, row_number() OVER w AS k, count(*) OVER (PARTITION BY c) AS n_turns
           FROM digests WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, d ROWS UNBOUNDED PRECEDING)),
proper AS (SELECT DISTINCT h FROM chains WHERE k < n_turns),
one AS (SELECT h, min(conv_id) AS conv_id, arg_min(c, coalesce(conv_id, 1e18)) AS c, max(n_turns)::INT AS n_turns, count(*) AS n_logged FROM chains WHERE k = n_turns GROUP BY h),
kept AS (SELECT * FROM one WHERE h NOT IN (SELECT h FROM proper)),
lines AS (SELECT c, string_agg('{START}' || regexp_replace({_SQL_SAFE.format("role")}, '[\\r\\n]', ' ', 'g') || chr(10) || {_SQL_SAFE.format("text")}
                 || '{END}' || chr(10), '' ORDER BY turn NULLS FIRST, role, d) AS rendered FROM digests GROUP BY c)
SELECT k.conv_id, k.n_turns, k.n_logged, l.rendered FROM kept k JOIN lines l ON k.c = l.c
"""
