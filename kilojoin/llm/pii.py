"""Personal data: patterns, and terms that give the found data away.

Patterns (fixed values of the contract) find mails, IP addresses, cards and phone numbers. What they find is protected, and so
are keys (long words of letters and digits): each single value that stands in different places (a holder), each kind,
and protected data of any kind. A term is a word, or the shape of a word with digits (letters or not, and length), so that numbers which occur once, such as
those of accounts, are judged by all words of their shape. A key is its own entity
and discloses all of it.

The corpus tells how strongly a term reveals a protected entity. Texts are covered by windows of 2 HALF words, each starting
HALF words after the one before. With p(e) the share of windows that hold entity e and p(e|t) that share among the
windows with term t, the term discloses log2(p(e|t) / p(e)) of the entity's log2(1 / p(e)) bits. Copies of one passage
are one piece of evidence: windows of one text are alike, and so are those of texts with a window of the same two least
hashes of words; n windows in alike groups of c1, c2, ... count as n^2 / (c1^2 + c2^2 + ...) windows, the effective number. p(e|t) is smoothed by PRIOR windows at p(e)
against that number. Terms in SUPPORT effective windows or more (PLACES for a holder) that disclose GENERALISE of the bits
of some entity are spans of kind "term" wherever they stand in any text; in sanitised texts they turn into their kind of
word, and from REMOVE on they are taken out.

DataFrame operations only. One scan gathers the windows with entities, a second counts the candidate terms over
all windows by partial aggregation, a third finds the texts with disclosing terms, and only these are searched for positions.
Positions are running sums within a row, in blocks, so that long texts with many matches take linear time; only
disclosing occurrences are shuffled.

Defined results: a null text is the empty text and has no spans; texts are searched whole; rows with equal text have equal spans,
whatever their doc_id, nulls included; copies of a text don't count as further evidence; an empty table gives no rows; columns
other than text (and n_chars, which follows it) are kept as they are, whatever their names.
Java's \\G and possessive repetition keep the patterns linear on long runs and free of deep recursion; the matches are
those of the plain patterns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.functions.exprs import let
from kilojoin.llm.common import discard, fits, materialise, maybe_broadcast

#: The patterns of the contract, in its order (fixed values), written for Java.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A key: letters and digits in one word of KEY characters or more. Keys are protected like what the patterns find, and are terms that disclose themselves.
KEY = 16
KEY_PATTERN = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{L}}*+\p{{N}})(?=\p{{N}}*+\p{{L}})[\p{{L}}\p{{N}}]{{{KEY},}}+"
PROTECTED = PATTERNS | {"key": KEY_PATTERN}
ANY = "any"
#: Half of a window, in words.
HALF = 128
#: Effective windows that a term must be in with an entity; windows of the corpus that a term's own are smoothed with.
SUPPORT, PRIOR = 5, 3.0
#: Effective windows of a value, and of a term with it, from which the value is a holder.
PLACES = 2.5
#: Shares of an entity's bits from which a term is generalised or removed.
GENERALISE, REMOVE = 0.75, 0.95

#: Stands for a code point of a span, and around an entity; the four after it stand for a span of each kind.
MARK = "\ue000"
LABELS = dict(zip(PATTERNS, "\ue001\ue002\ue003\ue004", strict=True))
_WORD = r"[\p{L}\p{N}]+"
_TOKEN = rf"{_WORD}|{MARK}[^{MARK}]*{MARK}"
_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
SPAN = "struct<kind:string,start:int,end:int,value:string>"
TERM = "struct<i:int,start:int,end:int,share:double>"
#: Terms that are looked for as literals of the plan at most; more are joined.
FEW = 2000
#: Items that a running sum takes at a time.
BLOCK = 32


# arrays within a row --------------------------------------------------------------------------------


def running(sizes: Column, depth: int = 2) -> Column:
    """The sum of all items up to each, of an array<int>: within blocks, then over the blocks' sums, so that time is linear."""

    def short(a: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, first, lambda x, v: F.struct((x["at"] + v).alias("at"), F.concat(x["out"], F.array(x["at"] + v)).alias("out")))["out"]

    if not depth:
        return short(sizes)

    def whole(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda s: short(F.slice(a, s, F.lit(BLOCK))))
        last = lambda b: F.coalesce(F.get(b, F.size(b) - 1), F.lit(0))
        shifted = lambda b, total: F.transform(b, lambda v: v + total - last(b))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, running(F.transform(bs, last), depth - 1), shifted)))

    return let(sizes, whole)


def located(text: Column, pattern: str) -> Column:
    """array<struct<value, start, end>> of the matches of a pattern, positions in code points.

    The parts between matches and the matches alternate, so their lengths add up to the positions.
    """

    def of(t: Column) -> Column:
        values, parts = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        sizes = F.zip_with(parts, values, lambda p, v: F.struct(F.length(p).alias("gap"), v.alias("value")))
        sizes = F.filter(sizes, lambda s: s["value"].isNotNull())
        place = lambda s, end: F.struct(s["value"].alias("value"), (end - F.length(s["value"])).alias("start"), end.alias("end"))
        return let(sizes, lambda ss: F.zip_with(ss, running(F.transform(ss, lambda s: s["gap"] + F.length(s["value"]))), place))

    return let(text, of)


# patterns -------------------------------------------------------------------------------------------


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit counts double, less 9 if that is over 9."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    if kind in ("email", "key"):
        return F.lit(True)
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(_digits(value))).otherwise(False)
    return n.between(8, 15)


def _may_hold(kind: str, text: Column) -> Column:
    return text.contains({"email": "@", "phone": "+"}[kind]) if kind in ("email", "phone") else text.rlike("[0-9]")


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of the patterns' valid matches, by kind as listed, then start."""
    none = F.array().cast(f"array<{SPAN}>")
    return F.concat(*[F.when(_may_hold(kind, text), _of_kind(kind, located(text, pattern))).otherwise(none) for kind, pattern in PATTERNS.items()])


def _of_kind(kind: str, found: Column) -> Column:
    own = F.filter(found, lambda s: _valid(kind, s["value"]))
    return F.transform(own, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")).cast(SPAN))


def _replaced(kind: str, put: Callable[[str, Column], Column], text: Column) -> Column:
    def piece(part: Column, value: Column) -> Column:
        return F.when(value.isNull(), part).when(_valid(kind, value), F.concat(part, put(kind, value))).otherwise(F.concat(part, value))

    parts = F.zip_with(F.split(text, PROTECTED[kind], -1), F.regexp_extract_all(text, F.lit(PROTECTED[kind]), F.lit(0)), piece)
    return F.when(_may_hold(kind, text), F.array_join(parts, "")).otherwise(text)


def masked(text: Column, put: Callable[[str, Column], Column], kinds: dict[str, str] = PATTERNS) -> Column:
    """A text with put(kind, value) in place of each valid match, kind after kind; a later kind looks at what the earlier ones left."""
    out = F.translate(text, MARK + "".join(LABELS.values()), "\ufffd" * (1 + len(LABELS)))
    for kind in kinds:
        out = let(out, partial(_replaced, kind, put))
    return out


def as_token(kind: str, value: Column) -> Column:
    """The entity of a value (a mail in lower case, the address, the digits) as one token of letters between marks."""
    own = {"email": F.lower, "card": _digits, "phone": _digits}.get(kind, lambda v: v)(value)
    return F.concat(F.lit(MARK + kind[0]), F.translate(F.lower(F.hex(F.xxhash64(own))), "0123456789", "ghijklmnop"), F.lit(MARK))


# windows --------------------------------------------------------------------------------------------


def has_digits(text: Column) -> Column:
    return text.rlike(r"\p{N}")


def shape(word: Column) -> Column:
    """# and the kinds of characters (a letters, 7 digits) and the length of a word with digits."""
    return F.concat(F.when(word.rlike(r"\p{L}"), "#a7-").otherwise("#7-"), F.length(word).cast("string"))


def features(words: Column, digits: Column) -> Column:
    """The different words of an array of words in lower case, and the shapes of those with digits; digits: whether there are any."""
    shapes = F.when(digits, F.transform(F.filter(words, has_digits), shape)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, shapes))


def windows(text: Column) -> Column:
    """array<struct<f: features, m: array of entities>>: the windows of a masked text."""
    digits = has_digits(text)

    def block(t: Column, s: Column) -> Column:
        own = F.slice(t, s + 1, F.lit(HALF))
        return F.struct(features(F.filter(own, lambda x: ~x.startswith(MARK)), digits).alias("f"), F.filter(own, lambda x: x.startswith(MARK)).alias("m"))

    def joined(b: Column) -> Column:
        def two(i: Column) -> Column:
            here, then = F.get(b, i - 1), F.get(b, i)
            return F.when(then.isNull(), here).otherwise(F.struct(F.array_union(here["f"], then["f"]).alias("f"), F.concat(here["m"], then["m"]).alias("m")))

        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(b) - 1, F.lit(1))), two)

    def of(t: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0)), F.lit(HALF)), lambda s: block(t, s)), joined)

    return let(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)), of)


def mentions(docs: DataFrame) -> DataFrame:
    """f, m, alike of every window that holds an entity; alike is one number for all of these windows in a text, the least over them of a hash of their two least hashes."""
    least = lambda f, seed: F.array_min(F.transform(f, lambda x: F.xxhash64(x, F.lit(seed))))

    def of(ws: Column) -> Column:
        alike = F.array_min(F.transform(ws, lambda w: F.xxhash64(least(w["f"], 1), least(w["f"], 2))))
        return let(alike, lambda a: F.transform(ws, lambda w: F.struct(w["f"].alias("f"), w["m"].alias("m"), a.alias("alike"))))

    own = let(masked(F.col("text"), as_token, PROTECTED), lambda t: F.when(t.contains(MARK), let(F.filter(windows(t), lambda w: F.size(w["m"]) > 0), of)))
    return docs.select(F.explode(own).alias("w")).select("w.*")


def effective(rows: DataFrame, *key: str) -> DataFrame:
    """key, raw (windows), eff (their effective number); rows: key, alike, n (alike windows)."""
    n = F.col("n").cast("double")
    return rows.groupBy(*key).agg(F.sum("n").alias("raw"), (F.sum(n) * F.sum(n) / F.sum(n * n)).alias("eff"))


def kinds_with_terms(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entity, feature, raw, eff; and entity, raw, eff of each kind and of any of them."""
    # one row for each kind in a window; the first also stands for any kind
    kinds = F.array_distinct(F.transform("m", lambda e: F.substring(e, 2, 1)))
    each = found.select("f", "alike", F.posexplode(kinds).alias("i", "kind"))

    def counted(rows: DataFrame, *key: str) -> DataFrame:
        one = rows.groupBy(*key, "kind", "alike").agg(F.count(F.lit(1)).alias("own"), F.sum((F.col("i") == 0).cast("int")).alias("all"))
        both = F.array(F.struct(F.col("kind").alias("entity"), F.col("own").alias("n")), F.struct(F.lit(ANY).alias("entity"), F.col("all").alias("n")))
        one = one.select(*key, "alike", F.explode(both).alias("x")).select(*key, "alike", "x.*").where(F.col("n") > 0)
        return effective(one.groupBy("entity", *key, "alike").agg(F.sum("n").alias("n")), "entity", *key)

    return counted(each.select("alike", "i", "kind", F.explode("f").alias("feature")), "feature"), counted(each)


def holders_with_terms(found: DataFrame, places: float) -> tuple[DataFrame, DataFrame]:
    """The same of every value in ``places`` effective windows or more."""
    each = found.select("f", "alike", F.explode(F.array_distinct("m")).alias("entity"))
    sizes = effective(each.groupBy("entity", "alike").agg(F.count(F.lit(1)).alias("n")), "entity")
    sizes = materialise(sizes.where(F.col("eff") >= places), "holders")
    own = each.join(maybe_broadcast(sizes.select("entity")), "entity", "left_semi").select("entity", "alike", F.explode("f").alias("feature"))
    return effective(own.groupBy("entity", "feature", "alike").agg(F.count(F.lit(1)).alias("n")), "entity", "feature"), sizes


def disclosing(docs: DataFrame, support: float = SUPPORT, places: float = PLACES, least: float = GENERALISE) -> DataFrame:
    """feature, share (of an entity's bits that the term discloses, the largest over entities) of the terms at or over the threshold."""
    found = materialise(mentions(docs), "mentions")
    (kinds, kind_sizes), (own, own_sizes) = kinds_with_terms(found), holders_with_terms(found, places)
    pairs = materialise(kinds.where(F.col("eff") >= support).unionByName(own.where(F.col("eff") >= places)), "pairs")
    sizes = kind_sizes.unionByName(own_sizes).select("entity", F.col("raw").alias("n_e"))
    terms = materialise(pairs.select("feature").distinct().union(docs.sparkSession.createDataFrame([("##",)], "feature string")), "candidates")
    every = docs.select(F.explode(let(masked(F.col("text"), as_token, PROTECTED), windows)).alias("w")).where((F.size("w.f") > 0) | (F.size("w.m") > 0))
    every = every.select(F.explode(F.concat(F.array(F.lit("##")), F.col("w.f"))).alias("feature"))
    if fits(terms):
        counts = every.join(F.broadcast(terms), "feature", "left_semi").groupBy("feature").agg(F.count(F.lit(1)).alias("n_t"))
    else:
        counts = every.groupBy("feature").agg(F.count(F.lit(1)).alias("n_t")).join(terms, "feature", "left_semi")
    counts = materialise(counts, "counts")
    total = counts.where("feature = '##'").first()  # one number
    p, q = F.col("n_e") / F.lit(float(total["n_t"] if total else 1)), F.col("raw") / F.col("n_t")
    rated = pairs.join(counts, "feature").join(sizes, "entity").select("feature", "raw", "eff", "n_t", p.alias("p"), q.alias("q")).where("p < 1")
    # raw of n_t windows hold the entity; the evidence is eff of eff / q windows
    given = F.col("q") * (F.col("eff") + PRIOR * F.col("p")) / (F.col("eff") + PRIOR * F.col("q"))
    rated = rated.select("feature", (F.log2(given / F.col("p")) / F.log2(1 / F.col("p"))).alias("share")).where(F.col("share") >= least)
    out = materialise(rated.groupBy("feature").agg(F.max("share").alias("share")), "terms")
    discard(found, pairs, terms, counts)
    return out


# spans ----------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """h, l (hash and length, which stand for the text) and text of every row."""
    return docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("h"), F.length("text").alias("l"), "text")


def _literals(terms: DataFrame) -> tuple[list[str], list[str]] | None:
    """Words and shapes among the terms, if they are few enough for literals of the plan."""
    few = [r[0] for r in terms.select("feature").limit(FEW + 1).collect()]
    return ([f for f in few if f[0] != "#"], [f for f in few if f[0] == "#"]) if len(few) <= FEW else None


def _is_term(word: Column, plain: list[str], shapes: list[str]) -> Column:
    """Whether a word in lower case is a term by itself or by its shape."""
    out = word.isin(plain) if plain else F.lit(False)
    return out | (has_digits(word) & shape(word).isin(shapes)) if shapes else out


def _holding(rows: DataFrame, terms: DataFrame, literals: tuple[list[str], list[str]] | None) -> DataFrame:
    """The rows (h, l, text) whose text holds a term or a key."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    if literals:
        plain, shapes = literals
        a_word = F.exists(words, lambda w: _is_term(w, plain, [])) if plain else F.lit(False)
        a_shape = has_digits(F.col("text")) & F.exists(words, lambda w: _is_term(w, [], shapes)) if shapes else F.lit(False)
        return rows.where(a_word | a_shape | F.col("text").rlike(KEY_PATTERN))
    own = let(words, lambda w: features(w, has_digits(F.col("text"))))
    keys = rows.select("h", "l", F.explode(own).alias("feature")).join(terms, "feature", "left_semi").select("h", "l")
    keys = keys.union(rows.where(F.col("text").rlike(KEY_PATTERN)).select("h", "l")).distinct()
    return rows.join(keys, ["h", "l"], "left_semi")


def everywhere(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """h, l, terms (array of i, start, end, share) of the texts with terms: every occurrence in no base span; i counts the words outside of base spans.

    Where the terms are literals of the plan, only the words that are terms or keys become rows.
    """
    literals, terms = _literals(terms), maybe_broadcast(terms)
    own = _holding(_keyed(docs), terms, literals)
    blank = masked(F.col("text"), lambda kind, v: F.repeat(F.lit(MARK), F.length(v)))
    words = F.transform(located(blank, _WORD), lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    if literals:
        words = F.filter(words, lambda s: _is_term(F.lower(s["value"]), *literals) | s["value"].rlike(KEY_PATTERN))
    rows = own.select("h", "l", F.explode(words).alias("s"))
    two = F.array_compact(F.array(F.lower("s.value"), F.when(has_digits(F.col("s.value")), shape(F.col("s.value")))))
    rows = rows.select("h", "l", "s.i", "s.start", "s.end", F.col("s.value").rlike(KEY_PATTERN).alias("key"), F.explode(two).alias("feature"))
    rows = rows.join(terms, "feature", "left").withColumn("share", F.when(F.col("key"), 1.0).otherwise(F.col("share"))).where("share is not null")
    rows = rows.groupBy("h", "l", "i", "start", "end").agg(F.max("share").alias("share"))
    return rows.groupBy("h", "l").agg(F.array_sort(F.collect_list(F.struct("i", "start", "end", "share"))).alias("terms"))


def find(docs: DataFrame, support: int = SUPPORT, places: int = PLACES, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, spans (array of kind, start, end, value), terms (array of i, start, end, share) of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    terms = everywhere(docs, disclosing(docs, support, places, generalise))
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("l"), base_spans(F.col("text")).alias("spans"))
    return base.join(terms, ["h", "l"], "left").select("doc_id", "spans", F.coalesce("terms", F.array().cast(f"array<{TERM}>")).alias("terms"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and span strings of the contract from find()'s rows."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    terms = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.concat(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), terms)
    n_term = F.size("terms").cast("long")
    return found.select(
        "doc_id", *map(count, PATTERNS), F.sha2(text("spans").cast("binary"), 256).alias("base_sha256"), text(every).alias("spans"),
        n_term.alias("n_term"), (F.size("spans") + n_term).cast("long").alias("n_spans"),
    )


def sanitised(docs: DataFrame, support: int = SUPPORT, places: int = PLACES, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with base spans replaced by their kind, disclosing terms by their kind of word or nothing; n_chars, if there, follows the text.

    Null texts stay null. In texts that change, the five private code points that mark spans (U+E000 to U+E004) turn into U+FFFD.
    """
    terms = everywhere(docs.select("text"), disclosing(docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")), support, places, generalise))
    own = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("text"), F.xxhash64(own).alias("h"), F.length(own).alias("l")).join(terms, ["h", "l"], "left")
    marked = masked(F.col("text"), lambda kind, v: F.lit(LABELS[kind]))

    def label(word: Column, share: Column) -> Column:
        kind = F.when(word.rlike(r"^\p{N}+$"), "[NUMBER]").when(word.rlike(r"^\p{Lu}"), "[NAME]").when(word.rlike(r"\p{N}"), "[CODE]").otherwise("[WORD]")
        return F.when(share >= remove, F.lit("")).otherwise(kind)

    def without_terms(t: Column) -> Column:
        pieces = F.arrays_zip(F.split(t, _WORD, -1).alias("gap"), F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)).alias("word"))

        def cut(ps: Column) -> Column:
            whole = F.transform(ps, lambda p: F.concat(p["gap"], F.coalesce(p["word"], F.lit(""))))
            at = lambda j: F.coalesce(F.get("terms", j)["i"], F.size(ps))
            # before each term the pieces since the last one, then its gap and label; at the end the rest
            step = lambda w: lambda j: F.concat(
                F.slice(w, F.when(j > 0, at(j - 1) + 2).otherwise(1), at(j) - F.when(j > 0, at(j - 1) + 1).otherwise(0)),
                F.when(j < F.size("terms"), F.array(F.concat(F.get(ps, at(j))["gap"], label(F.get(ps, at(j))["word"], F.get("terms", j)["share"])))).otherwise(F.array().cast("array<string>")),
            )
            return let(whole, lambda w: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("terms")), step(w))), ""))

        return F.when(F.col("terms").isNull(), t).otherwise(let(pieces, cut))

    def done(t: Column) -> Column:
        for kind, mark in LABELS.items():
            t = F.replace(t, F.lit(mark), F.lit(f"[{kind.upper()}]"))
        return t

    changed = let(marked, lambda t: F.when(F.col("terms").isNotNull() | t.rlike("[" + "".join(LABELS.values()) + "]"), done(without_terms(t))).otherwise(F.col("text")))
    rows = rows.select("row", changed.alias("text"))
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[(fresh[c] if c in fresh else F.col("row")[c]).alias(c) for c in docs.columns])
