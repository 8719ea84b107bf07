"""Toxic passages by maximum-scoring segments over token log-odds.

Learning, on a bounded sample of labelled documents (SAMPLE of each class, those with the smallest hashes of
their ids; of near copies, which share a least shingle hash under one of COPY_KEYS seeds, one): a feature is a word (a run of letters, lower case) or its first four or five letters, counted once
for each different text. Its weight is its log-odds between the classes under a Dirichlet prior that is
proportional to its frequency in both. A feature is used if the signed root of its likelihood ratio is beyond what
the largest of so many chance features would reach; first letters are used if no single word makes up most of
their toxic texts. A token takes the weight of its most specific feature; every token also pays DRIFT, so that
the expected score is negative.

Scoring: one linear scan finds all maximal segments of positive sum in a text (each is disjoint from the others
and can't be extended with gain). The sum of the best chance segment among n tokens follows an extreme-value
law, P(best >= s) = 1 - exp(-K n exp(-lambda s)); lambda solves sum p(s) exp(lambda s) = 1 over the tokens of
clean documents, K comes from the best segments of clean documents. A passage is significant if its expected
number by chance is small. The sums of the r best segments are judged together in the same way for each r, and
the document's score is exp(-E) of the smallest expectation E.

Defined results: every row is judged by its text alone, so null and repeated doc_ids and equal rows get their text's score, and
of columns only those named are read; null and empty texts and texts without a letter score 0; without labels of both classes every
score is 0; repeated labels of one id count as toxic if one of them is; labels other than 0 and 1 don't count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoin.llm.common import crc_class, materialise

#: Labelled documents of each class that are learned from at most.
SAMPLE = 10_000
#: Seeds of shingle hashes by which near copies in the sample are told, and words of a shingle.
COPY_KEYS, SHINGLE = 4, 5
#: Texts that a feature must be in.
SEEN = 5
#: The prior's weight as a share of all counts.
PRIOR = 0.1
#: What every token pays.
DRIFT = 0.5
#: Least K, for corpora whose clean documents have next to no positive token.
LEAST_K = 0.1
#: Words whose scores a worker remembers.
REMEMBERED = 150_000
#: exp(-E) of a document that counts as toxic.
THRESHOLD = 0.7
#: Expected number by chance below which a passage is significant.
PASSAGE_E = 0.05

_LETTERS = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def features_of(word: str) -> list[str]:
    """From the most specific on."""
    return ["w" + word, *(f"{k}{word[:k]}" for k in (5, 4) if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    k: float = LEAST_K
    _seen: dict[str, float] = field(default_factory=dict, repr=False)

    def score_of(self, word: str) -> float:
        for f in features_of(word):
            if (x := self.weights.get(f)) is not None:
                return x - DRIFT
        return -DRIFT

    def scores(self, words: list[str]) -> np.ndarray:
        seen = self._seen
        new = set(words).difference(seen)
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = set(words)
        for w in new:
            seen[w] = self.score_of(w)
        return np.fromiter(map(seen.__getitem__, words), np.float64, len(words))

    def expected(self, best: list[float], n: int) -> float:
        """The least expected number by chance of one, two, ... of the best segments together among n tokens."""
        base = math.log(max(self.k * n, 1e-9))
        sums = np.sort(np.asarray(best))[::-1]
        r = np.arange(1, len(sums) + 1)
        total = self.rate * np.cumsum(sums) - base * r
        logs = np.concatenate([[0.0], np.cumsum(np.log(r))])  # of r!
        use = (r == 1) | (total > r)
        r, total = r[use], total[use]
        e = (r - 1) * math.log(2) - total + (r - 1) * np.log(np.maximum(total, 1e-300)) - logs[r] - logs[r - 1]
        return math.exp(min(50.0, float(e.min())))

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]], int]:
        """exp(-E), the maximal segments (first token, end, sum) and the number of tokens."""
        words = tokens(text)
        if not words or not self.weights:
            return 0.0, [], len(words)
        found = segments(self.scores(words))
        return (math.exp(-self.expected([s for _, _, s in found], len(words))) if found else 0.0), found, len(words)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, sum) of positive sum, in order, in linear time.

    Runs of tokens that aren't positive only lower the running sum, so the scan visits the positive ones. Each
    candidate knows the nearest earlier candidate that began lower; a new one walks along these.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[float, float, int, int, int]] = []  # low, high, start, end, nearest earlier with a lower low
    for i in at.tolist():
        low, high, start = float(sums[i]), float(sums[i + 1]), i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= high:
                stack.append((low, high, start, i + 1, j))
                break
            low, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, h - low) for low, h, s, e, _ in stack]


# learning -------------------------------------------------------------------------------------------


def sample_of_labels(labels: DataFrame, held_out: int = 1, folds: int = 3, size: int = SAMPLE) -> DataFrame:
    """doc_id, toxic of a bounded sample of the labels that may be learned from; at most ``size`` of each class."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_class(F.col("doc_id"), folds) != held_out))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return own.where("toxic = 1").orderBy(*order).limit(size).union(own.where("toxic = 0").orderBy(*order).limit(size))


def single_copies(texts: DataFrame) -> DataFrame:
    """texts (h, toxic, text) without near copies of the same class: a bounded sample, so its keys are grouped as they are."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                w = tokens(text) or [""]
                grams = {" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}
                rows.append([min(xxhash.xxh32_intdigest(g, seed) for g in grams) for seed in range(COPY_KEYS)])
            out = pd.DataFrame(rows, columns=[f"k{i}" for i in range(COPY_KEYS)], dtype="int64")
            yield pd.concat([batch[["h", "toxic"]].reset_index(drop=True), out], axis=1)

    kept = texts.mapInPandas(keys, "h long, toxic int, " + ", ".join(f"k{i} long" for i in range(COPY_KEYS)))
    for i in range(COPY_KEYS):
        first = Window.partitionBy(f"k{i}", "toxic").orderBy("h")
        kept = kept.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return texts.join(kept.select("h"), "h", "left_semi")


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, size: int = SAMPLE) -> Model:
    """The model of docs (doc_id, text) with labels (doc_id, toxic). Only features of the bounded sample that are in SEEN texts and beyond chance reach the driver."""
    sample = sample_of_labels(labels.select("doc_id", "toxic"), held_out, folds, size)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("l")).agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    texts = materialise(single_copies(materialise(texts, "labelled")), "single")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pd.DataFrame:
            keys = list(set(sums[0]) | set(sums[1]))
            return pd.DataFrame({"f": keys, "clean": [sums[0][k] for k in keys], "toxic": [sums[1][k] for k in keys]})

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = set(tokens(text))
                sums[int(toxic)].update({f for w in words for f in features_of(w)})
                sums[int(toxic)]["#"] += 1
                if len(sums[0]) + len(sums[1]) > 300_000:
                    yield rows()
                    sums[0].clear()
                    sums[1].clear()
        if sums[0] or sums[1]:
            yield rows()

    counts = texts.select("text", "toxic").mapInPandas(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    often = counts.where(f"clean + toxic >= {SEEN}").select("f", "clean", "toxic", F.col("toxic").cast("double").alias("y"), F.col("clean").cast("double").alias("x")).cache()
    try:
        sums = often.where("f <> '#'").agg(F.sum("x"), F.sum("y")).first()
        clean_n, toxic_n = sums[0] or 0.0, sums[1] or 0.0
        if not (clean_n and toxic_n):
            return Model()
        prior = PRIOR * (clean_n + toxic_n)
        a = F.lit(PRIOR) * (F.col("x") + F.col("y"))
        weight = F.log((F.col("y") + a) / (toxic_n + prior - F.col("y") - a)) - F.log((F.col("x") + a) / (clean_n + prior - F.col("x") - a))
        n, share = F.col("x") + F.col("y"), toxic_n / (clean_n + toxic_n)
        part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * p))).otherwise(0.0)
        root = F.sqrt(F.greatest(2 * (part("y", share) + part("x", 1 - share)), F.lit(0.0))) * F.signum(F.col("y") - n * share)
        rated = often.where("f <> '#'").withColumns({"weight": weight, "z": root})
        single = often.where("f like 'w%'").select(F.explode(F.array(F.concat(F.lit("4"), F.substring("f", 2, 4)), F.concat(F.lit("5"), F.substring("f", 2, 5)))).alias("f"), "y")
        rated = rated.join(single.groupBy("f").agg(F.max("y").alias("top")), "f", "left")
        rated = rated.where("f like 'w%' or coalesce(top, 0) <= y / 2")
        chance = NormalDist().inv_cdf(1 - 1 / max(20, often.count()))
        strong = rated.where(F.abs("z") >= chance).collect()
    finally:
        often.unpersist()
    weights = {r["f"]: r["weight"] for r in strong if r["z"] > 0 or r["f"][0] == "w"}
    model = Model(weights)
    if not any(x > DRIFT for x in weights.values()):
        return Model()
    return calibrate(model, texts.where("toxic = 0").select("text"))


def calibrate(model: Model, clean: DataFrame) -> Model:
    """lambda and K from clean texts: the histogram of their token scores, and sums over their best segments (a few rows for each task)."""

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if words := tokens(text):
                    values, many = np.unique(np.round(model.scores(words), 1), return_counts=True)
                    bins.update(dict(zip(values.tolist(), many.tolist(), strict=True)))
        if bins:
            yield pd.DataFrame({"s": list(bins.keys()), "n": list(bins.values())})

    rows = clean.mapInPandas(histogram, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    own = {r["s"]: float(r["n"]) for r in rows}
    for x in model.weights.values():  # what could occur by chance but didn't
        if x > DRIFT:
            own[round(x - DRIFT, 1)] = own.get(round(x - DRIFT, 1), 0.0) + 0.5
    s, p = np.array(list(own)), np.array(list(own.values()))
    if not len(p):
        return model
    p /= p.sum()
    if float((s * p).sum()) >= 0:
        return Model(model.weights, rate=0.1)
    low, high = 0.0, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if float((p * np.exp(np.minimum(mid * s, 500))).sum()) < 1 else (low, mid)
    model.rate = max(low, 0.01)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, 0.0
        for batch in batches:
            for text in batch["text"]:
                _, found, size = model.judge(text)
                if size:
                    n, total = n + 1, total + size * math.exp(-model.rate * max((x for _, _, x in found), default=0.0))
        yield pd.DataFrame({"n": [n], "total": [total]})

    sums = clean.mapInPandas(best, "n long, total double").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    if sums["n"] and sums["total"]:
        model.k = max(LEAST_K, sums["n"] / sums["total"])
    return Model(model.weights, model.rate, model.k)


# scoring --------------------------------------------------------------------------------------------


def score_column(text: Column, model: Model) -> Column:
    """exp(-E) of a text column."""
    weights, rate, k = model.weights, model.rate, model.k

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(weights, rate, k)
        for batch in batches:
            yield pd.Series([own.judge(t)[0] for t in batch], dtype="float64")

    return score(text)


def passages(docs: DataFrame, model: Model, most: float = PASSAGE_E) -> DataFrame:
    """doc_id, first_token, end_token, score, expected of every significant passage; positions count runs of letters from 0."""
    weights, rate, k = model.weights, model.rate, model.k

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(weights, rate, k)
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                _, found, n = own.judge(text)
                rows += [(key, a, b, s, e) for a, b, s in found if (e := own.expected([s], n)) <= most]
            yield pd.DataFrame(rows, columns=["doc_id", "first_token", "end_token", "score", "expected"]).astype({"doc_id": "Int64", "first_token": "int64", "end_token": "int64", "score": "float64", "expected": "float64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(find, "doc_id long, first_token long, end_token long, score double, expected double")


def score_documents(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of the labels outside the held-out fold."""
    model = learn(docs, labels, held_out, folds)
    scored = docs.select("doc_id", (crc_class(F.col("doc_id"), folds) == held_out).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3) -> DataFrame:
    """docs without those that score as toxic."""
    return docs.where(score_column(F.col("text"), learn(docs, labels, held_out, folds)) < THRESHOLD)
