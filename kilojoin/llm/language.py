"""Language by nearest centroid: TF-IDF vectors of letter n-grams, several clustered centroids for each language.

A text turns into a vector of DIMS hashed counts of two and three neighbouring letters (lower case; whatever is no
letter is a border), weighted by inverse document frequency and scaled to length one. Document frequencies
are counted over every learning document (partial sums in each task, one row for each dimension after). Centroids come
from spherical k-means over a bounded sample of each language's different texts, drawn by the hash of the text, one task for each. A text takes the language
of the centroid of the largest cosine; it is rejected as too far from all if that is below the cosine of nearly all
of the centroid's own members.

Defined results: null texts and texts without a letter are "und" with score 0; without learned languages every text is; of
equal cosines the first language in order of the alphabet wins; rows with null or repeated doc_id are judged like
any other, and a null id learns like the empty text as an id; equal texts of a language are learned once; columns other than
doc_id, text and lang are not read, whatever their names; an empty table gives no rows. Rejection is a column of its own and doesn't change the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.llm.common import crc_class, maybe_broadcast

DIMS = 4096
#: Centroids of a language, learned documents of each that are clustered (expected).
CENTROIDS, SAMPLE = 3, 700
#: Share of a language's sample that a centroid stands for at least.
FEW = 0.03
#: Share of a centroid's members that lie closer than its limit.
INSIDE = 0.99
UNKNOWN = "und"

_BORDER = 0
_letters: np.ndarray | None = None


def _table() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None) -> np.ndarray | None:
    """The dimension of every n-gram of a text; None if it has no letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_table()[code], code, _BORDER)
    code = np.concatenate([[_BORDER], code, [_BORDER]]).astype(np.uint32)
    code = code[np.concatenate([[True], (code[1:] != _BORDER) | (code[:-1] != _BORDER)])]
    if len(code) < 3:
        return None
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    return np.concatenate([(two * np.uint32(0x165667B1)) >> shift, three >> shift])


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which texts have a letter."""
    out, there = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        g = grams(t)
        if g is not None:
            out[i], there[i] = np.bincount(g, minlength=DIMS), True
    out *= idf
    out /= np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)
    return out, there


def cluster(x: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one and the limit of each, by spherical k-means; it starts from members at even steps of nearness to the mean."""
    ranked = np.argsort(-(x @ x.mean(0)), kind="stable")
    start = ranked[(np.arange(min(k, len(x))) * 2 + 1) * len(x) // (2 * min(k, len(x)))]
    c = x[start]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        new = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    sizes = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    c = c[sizes >= min(sizes.max(), max(2, FEW * len(x)))]  # a few outliers are no variety of the language
    cosine = x @ c.T
    near, own = cosine.argmax(1), cosine.max(1)
    limit = np.array([np.quantile(own[near == i], 1 - INSIDE) if (near == i).any() else 0.0 for i in range(len(c))])
    return c, limit


class Model:
    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, limits: np.ndarray):
        self.idf, self.languages, self.centroids, self.limits = idf, languages, centroids, limits

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        parts = []
        for i in range(0, len(texts), 256):
            x, there = vectors(texts[i : i + 256], self.idf)
            if not self.languages:
                there[:] = False
                parts.append((np.array([UNKNOWN] * len(x), object), np.zeros(len(x)), ~there))
                continue
            cosine = x @ self.centroids.T
            best = cosine.argmax(1)
            score = np.clip(cosine.max(1), 0, 1).astype(float)
            names = np.array(self.languages, object)[best]
            parts.append((np.where(there, names, UNKNOWN), np.where(there, score, 0.0), ~there | (score < self.limits[best])))
        cols = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [[], [], []]
        return pd.DataFrame(dict(zip(["lang_pred", "score", "rejected"], cols, strict=True)))


def learn(docs: DataFrame, held_out: int = 2, folds: int = 4, k: int = CENTROIDS, size: int = SAMPLE) -> Model:
    """The model of docs (doc_id, text, lang) outside the held-out fold. DIMS document frequencies and k centroids of each language reach the driver."""
    own = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_class(F.col("doc_id"), folds) != held_out))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for g in map(grams, batch["text"]):
                if g is not None:
                    many += np.bincount(g, minlength=DIMS) > 0
                    n += 1
        there = np.flatnonzero(many)
        yield pd.DataFrame({"dim": np.append(there, -1), "n": np.append(many[there], n)})

    rows = own.select("text").mapInPandas(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    counts = {r["dim"]: r["n"] for r in rows}
    n = counts.pop(-1, 0)
    many = np.zeros(DIMS)
    many[list(counts)] = list(counts.values())
    idf = (np.log((1 + n) / (1 + many)) + 1).astype(np.float32)

    # different texts: a language may have one text or one id on most of its rows
    sizes = own.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n"))
    chance = (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    sample = own.join(maybe_broadcast(sizes), "lang").where(chance < size / F.col("n")).groupBy("lang", F.xxhash64("text").alias("h")).agg(F.max("text").alias("text"))

    def centroids(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, there = vectors(rows["text"].sort_values().tolist(), idf)
        c, limit = cluster(x[there], k) if there.any() else (np.zeros((0, DIMS)), np.zeros(0))
        return pd.DataFrame({"lang": key[0], "centroid": [v.astype(np.float32).tobytes() for v in c], "limit": limit})

    found = sample.select("lang", "text").groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, limit double").collect()
    found.sort(key=lambda r: r["lang"])
    c = np.stack([np.frombuffer(bytes(r["centroid"]), np.float32) for r in found]) if found else np.zeros((0, DIMS), np.float32)
    return Model(idf, [r["lang"] for r in found], c, np.array([r["limit"] for r in found]))


def language_column(text: Column, model: Model) -> Column:
    """struct<lang_pred, score, rejected> of a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model.predict(batch.tolist())

    return of(text)


def identify(docs: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    own = language_column(F.col("text"), learn(docs, held_out, folds))
    return docs.select("doc_id", (crc_class(F.col("doc_id"), folds) == held_out).alias("held_out"), own.alias("own")).select("doc_id", "held_out", "own.*")
