"""Mixing sources to target weights by Poisson replication.

A source with c documents and share w of the mix has the repetition rate w * total / c. Each document draws its
number of copies from a Poisson distribution with that mean: a uniform number from the hash of seed, doc_id and text is
inverted through the cumulative distribution, so the same document gets the same number in every run and on
every executor. A rate over CHUNK is the sum of equal draws of CHUNK at most, each from a hash of its own, so that
distributions stay short. A document is then exploded by its number, in runs, and each copy gets a key from the hash of seed,
doc_id, text and copy; rows are dealt out and sorted by that key, which shuffles the whole corpus.

Only the counts of the sources are aggregated (one row for each source after partial aggregation). The cumulative
distributions go to the documents by a join on the source: a broadcast if the counted number of sources is within
bounds. Beyond that, documents and sources are joined on the source and a salt from the document's hash, so
that a source with a third of all rows is dealt out over SALTS tasks.

Defined results: a null source is a source of its own; rows with equal doc_id and text, nulls included, draw equal numbers,
and rows with a null doc_id draw by their text; null and empty texts are copied like any other; all columns are kept, whatever
their names (but for n_copies, copy and shuffle_key, which replicate() adds); an empty table gives no rows. Sources that
the given weights don't name get weight zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.llm.common import fits, materialise

#: Without given weights, a source's share goes with its number of documents to this power.
TEMPERATURE = 0.5
SEED = 42
SALTS = 64
#: The largest rate that one draw stands for, and copies that are exploded at a time.
CHUNK, RUN = 256, 1024


def uniform(*parts: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of seed and parts, which other engines can compute as well."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the rest is below 1e-12; sums of exp(log-probabilities), so that no rate underflows."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def add(x: Column, k: Column) -> Column:
        log = x["log"] + F.log(rate) - F.log(k.cast("double"))
        total = x["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(x["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), first, add)["all"]).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, source: str = "source") -> DataFrame:
    """source, n, rate of each source."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        wish = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        wish = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    counts = counts.withColumn("wish", wish)
    counts = materialise(counts, "sources")
    all_n, all_wish = counts.agg(F.sum("n").cast("double"), F.sum("wish")).first()  # two numbers
    rate = F.col("wish") / F.lit(all_wish) * F.lit(all_n) / F.col("n") if all_wish else F.lit(0.0)
    return counts.select("source", "n", rate.alias("rate"))


def drawn(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """row (all columns of docs as a struct), doc_id, text (its md5), n_copies of every document."""
    own = rates(docs, weights, temperature).withColumn("draws", F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int"))
    own = own.select(F.col("source").alias("s"), "draws", poisson_cdf(F.col("rate") / F.col("draws")).alias("cdf"))
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text")
    rows = docs.select(F.struct("*").alias("row"), "source", "doc_id", text)
    if fits(own):
        met = rows.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("s")))
    else:
        own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("mine", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        met = met.join(own, F.col("source").eqNullSafe(F.col("s")) & (F.col("mine") == F.col("salt")))
    below = lambda u: F.size(F.filter("cdf", lambda c: c < u))
    one = lambda j: uniform(F.col("doc_id"), F.col("text"), j, seed=seed)
    many = F.aggregate(F.sequence(F.lit(0), F.col("draws") - 1), F.lit(0), lambda n, j: n + below(one(j)))
    return met.select("row", "doc_id", "text", many.alias("n_copies"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """docs with n_copies, copy (from 1) and shuffle_key, every document as many times as it draws, in shuffled order.

    These three columns take the place of columns of the same names in docs.
    """
    own = drawn(docs, weights, temperature, seed).where("n_copies > 0")
    runs = own.select("*", F.explode(F.sequence(F.lit(1), F.col("n_copies"), F.lit(RUN))).alias("first"))
    copies = runs.select("*", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + (RUN - 1), F.col("n_copies")))).alias("copy"))
    copies = copies.withColumn("shuffle_key", uniform(F.col("doc_id"), F.col("text"), F.col("copy"), seed=seed))
    copies = copies.select("row", *ADDED).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return copies.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED], *ADDED)


ADDED = ["n_copies", "copy", "shuffle_key"]


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """docs replicated and shuffled, with its own columns only, whatever their names."""
    packed = docs.select("doc_id", "text", "source", F.struct("*").alias("whole"))
    return replicate(packed, weights, temperature, seed).select(*[F.col("whole")[c].alias(c) for c in docs.columns])


ORACLE = f"""
WITH counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS wish FROM documents GROUP BY source),
totals AS (SELECT sum(n)::DOUBLE AS all_n, sum(wish) AS all_wish FROM counts),
whole AS (SELECT source, wish / all_wish * all_n / n AS whole_rate FROM counts, totals),
rates AS (SELECT source, greatest(ceil(whole_rate / {CHUNK}), 1)::INT AS draws, whole_rate / greatest(ceil(whole_rate / {CHUNK}), 1) AS rate FROM whole),
terms AS (SELECT source, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(k * ln(rate) - rate - lgamma(k + 1.0)) END AS p
          FROM rates, range(0, {2 * CHUNK}) AS t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
own AS (SELECT row_number() OVER () AS r, doc_id, source, text, lang, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS name FROM documents),
draws AS (SELECT own.*, unnest(range(draws)) AS j FROM own JOIN rates ON rates.source IS NOT DISTINCT FROM own.source),
uniform AS (SELECT r, source, (('0x' || substr(md5('{SEED}:' || name || ':' || j), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM draws),
many AS (SELECT u.r, count(*) FILTER (c.c < u.u) AS n_copies FROM uniform u JOIN cdf c ON c.source IS NOT DISTINCT FROM u.source GROUP BY u.r),
copies AS (SELECT own.*, n_copies, unnest(range(1, n_copies + 1)) AS copy FROM own JOIN many USING (r) WHERE n_copies > 0)
SELECT doc_id, source, lang, text, n_copies::INT AS n_copies, copy::INT AS copy,
       (('0x' || substr(md5('{SEED}:' || name || ':' || copy), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS shuffle_key
FROM copies
"""
