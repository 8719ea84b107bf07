"""Quality by line labelling: a linear-chain conditional random field marks each line as content or boilerplate.

Each line gives one value of each feature template (length, symbols, capitals, digits, ends, repeats). The field has
a weight for each value, for each change of label and for the first label; Viterbi's path marks the lines, and a
document stays if lines of content hold CONTENT of its word characters or more, and its base measures pass.

Learning, on a bounded sample of labelled documents (SAMPLE of each class by hash of the id, LINES lines in all;
whole documents): a document's label goes to its lines, a logistic model of single lines then turns the lines of bad
documents that look like content, and the field is fitted to these sequences by gradient steps over all
forward-backward sums at once.

Base measures follow the contract; words are runs of characters other than space and U+0009 to U+000D.

Defined results: null and empty texts have no word and fail (n_words < 10); without labels of both classes all lines are
content; of equally good paths the one with later changes from content wins, and a line whose labels are level is content;
every row is judged by its text alone, so null and repeated doc_ids and equal rows get their text's result; columns other than
doc_id, text and quality are not read, whatever their names; an empty table gives no rows; repeated labels of one id count as bad if one of them is; labels other than 0 and 1 don't count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.llm.common import crc_class

#: Labelled documents of each class, and lines of them, that are learned from at most.
SAMPLE, LINES = 3000, 150_000
#: Share of a kept document's word characters in lines of content.
CONTENT = 0.5
#: Base measures: words at least, per cent of words in repeated windows at most, words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: The contract's symbols (fixed values).
SYMBOLS = b"#*$%&|<>"

_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
#: Values of each template.
VALUES = [7, 5, 4, 4, 2, 2, 2, 5, 4, 3]
_NO_SPACE = dict.fromkeys([0x20, *range(0x09, 0x0E)])
_FIRST = np.cumsum([0, *VALUES[:-1]])
N_FEATURES = sum(VALUES)
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
RESULT = BASE + ", base_failed boolean, kept boolean, content_share double, n_lines long, n_boilerplate long"


def _step(x: float, *edges: float) -> int:
    return sum(x > e for e in edges)


def line_values(line: bytes, again: bool, place: int) -> tuple[int, ...]:
    """The value of each template for a line; again: an equal line came before; place: 0 first, 1 between, 2 last."""
    words = line.split()
    n, size = len(words), sum(map(len, words))
    if not n:
        return (0, 0, 0, 0, 0, 0, 0, 0, 0, place)
    drop = line.translate
    symbols, upper, digits = (len(line) - len(drop(None, s)) for s in (SYMBOLS, _UPPER, _DIGITS))
    letters = upper + len(line) - len(drop(None, _LOWER))
    return (
        1 + _step(n, 2, 5, 10, 20, 60),
        _step(symbols / size, 0, 0.02, 0.08, 0.2),
        _step(upper / letters if letters else 0.0, 0.05, 0.3, 0.7),
        _step(digits / size, 0, 0.1, 0.4),
        int(words[-1][-1:] in b".!?:;\"'"),
        int(again),
        int(b"!!" in line),
        _step(size / n, 2.5, 4, 7, 12),
        _step(1 - len(set(words)) / n, 0.1, 0.3, 0.6),
        place,
    )


def features(text: str | None) -> np.ndarray:
    """(lines, templates) feature numbers of a text."""
    lines = (text or "").encode().split(b"\n")
    seen: set[bytes] = set()
    rows, last = [], len(lines) - 1
    for i, line in enumerate(lines):
        rows.append(line_values(line, line in seen, 0 if i == 0 else 2 if i == last else 1))
        seen.add(line)
    return np.array(rows, np.int64) + _FIRST


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of ``size`` words that are found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + size - max(i, end)
            end = i + size
    return total


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    data = text.encode()
    words = data.split()
    seen: set[bytes] = set()
    again = 0
    for line in data.split(b"\n"):
        if line in seen:
            again += bool(line.split())
        else:
            seen.add(line)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), again, repeated_words(words)


# the field ------------------------------------------------------------------------------------------


class Field:
    """Two labels, 1 content and 0 boilerplate. weights: of content for each feature value; change[a, b]: from a to b."""

    def __init__(self, weights: np.ndarray | None = None, change: np.ndarray | None = None, first: np.ndarray | None = None):
        self.weights = np.zeros(N_FEATURES) if weights is None else weights
        self.change = np.zeros((2, 2)) if change is None else change
        self.first = np.zeros(2) if first is None else first
        self.trained = weights is not None

    def viterbi(self, rows: np.ndarray) -> list[int]:
        """The best labels of the lines with these features."""
        gains = self.weights[rows].sum(1).tolist()
        (t00, t01), (t10, t11) = self.change.tolist()
        a, b = float(self.first[0]), float(self.first[1]) + gains[0]
        back = []
        for g in gains[1:]:
            to0, to1 = b + t10 > a + t00, b + t11 >= a + t01
            back.append((to0, to1))
            a, b = (b + t10 if to0 else a + t00), (b + t11 if to1 else a + t01) + g
        label = int(b >= a)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]

    def fit(self, docs: list[np.ndarray], labels: list[np.ndarray], steps: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> Field:
        """Gradient steps (Adam) on the mean log-likelihood of the lines' labels."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        docs, labels = [docs[i] for i in order], [labels[i] for i in order]
        sizes = np.array([len(d) for d in docs])
        n, longest, many = int(sizes.sum()), int(sizes[0]), len(docs)
        live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]  # documents with more than t lines
        starts = np.cumsum(sizes) - sizes
        rows, y = np.concatenate(docs), np.concatenate(labels)
        want = np.zeros(N_FEATURES)
        np.add.at(want, rows[y == 1].ravel(), 1)
        want_change, want_first = np.zeros((2, 2)), np.zeros(2)
        for one in labels:
            want_first[one[0]] += 1
            np.add.at(want_change, (one[:-1], one[1:]), 1)
        p = np.zeros(N_FEATURES + 6)
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, steps + 1):
            weights, change, first = p[:N_FEATURES], p[N_FEATURES : N_FEATURES + 4].reshape(2, 2), p[N_FEATURES + 4 :]
            gain = np.zeros((n, 2))
            gain[:, 1] = weights[rows].sum(1)
            ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
            ahead[starts] = first + gain[starts]
            for t in range(1, longest):
                at = starts[: live[t]] + t
                ahead[at] = np.logaddexp(ahead[at - 1, :1] + change[0], ahead[at - 1, 1:] + change[1]) + gain[at]
            for t in range(longest - 1, 0, -1):
                at = starts[: live[t]] + t
                nxt = behind[at] + gain[at]
                behind[at - 1] = np.logaddexp(change[:, 0] + nxt[:, :1], change[:, 1] + nxt[:, 1:])
            whole = np.logaddexp(*ahead[starts + sizes - 1].T)
            of = np.repeat(np.arange(many), sizes)
            sure = np.exp(ahead + behind - whole[of, None])
            inner = np.ones(n, bool)
            inner[starts] = False
            at = np.flatnonzero(inner)
            pair = np.exp(ahead[at - 1][:, :, None] + change + (gain[at] + behind[at])[:, None, :] - whole[of[at]][:, None, None])
            have = np.bincount(rows.ravel(), np.repeat(sure[:, 1], rows.shape[1]), N_FEATURES)
            slope = np.concatenate([want - have, (want_change - pair.sum(0)).ravel(), want_first - sure[starts].sum(0)]) / n - ridge * p
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return Field(p[:N_FEATURES], p[N_FEATURES : N_FEATURES + 4].reshape(2, 2), p[N_FEATURES + 4 :])


def single_lines(rows: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.2, ridge: float = 1e-3) -> np.ndarray:
    """The chance of content of each line by a logistic model of its features, both classes weighing the same."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    p, m, v = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for step in range(1, steps + 1):
        rest = (y - 1 / (1 + np.exp(-p[rows].sum(1)))) * weight
        slope = np.bincount(rows.ravel(), np.repeat(rest, rows.shape[1]), N_FEATURES) - ridge * p
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return 1 / (1 + np.exp(-p[rows].sum(1)))


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, lines: int = LINES, held_out: int | None = None, folds: int = 3) -> Field:
    """The field of docs (doc_id, text) with labels (doc_id, quality), those of the fold ``held_out`` left out. The driver gets the feature numbers of a bounded number of lines."""
    own = labels if held_out is None else labels.where(crc_class(F.col("doc_id"), folds) != held_out)
    own = own.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = own.where("quality = 1").orderBy(*order).limit(size).union(own.where("quality = 0").orderBy(*order).limit(size))

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(t).astype(np.uint8).tobytes() for t in batch], dtype=object)

    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    n_lines = F.size(F.split("text", "\n", -1))
    # the same number of lines of either class: documents in the order of their hashes until these are full
    got: dict[int, list[np.ndarray]] = {0: [], 1: []}
    sizes = texts.select("quality", F.xxhash64("doc_id", "text").alias("h"), n_lines.alias("n")).orderBy("h").limit(4 * size).collect()
    chosen = []
    for quality in (0, 1):
        left = lines // 2
        for r in sizes:
            if r["quality"] == quality and r["n"] <= left:
                chosen.append((r["h"],))
                left -= r["n"]
    if not chosen:
        return Field()
    wanted = docs.sparkSession.createDataFrame(sorted(set(chosen)), "h long")
    rows = texts.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(wanted), "h").dropDuplicates(["h"]).select("h", "quality", packed("text").alias("x"))
    for r in sorted(rows.collect(), key=lambda r: r["h"]):
        got[r["quality"]].append(np.frombuffer(bytes(r["x"]), np.uint8).reshape(-1, len(VALUES)).astype(np.int64))
    if not (got[0] and got[1]):
        return Field()
    x = got[0] + got[1]
    y = np.concatenate([np.full(len(d), k) for k in (0, 1) for d in got[k]])
    chance = single_lines(np.concatenate(x), y)
    y = np.where((y == 0) & (chance >= 0.5), 1, y)
    return Field().fit(x, np.split(y, np.cumsum([len(d) for d in x])[:-1]))


def judge(text: str | None, field: Field) -> tuple:
    n_words, chars, symbols, again, repeated = base_measures(text)
    failed = n_words < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n_words
    lines = (text or "").split("\n")
    labels = field.viterbi(features(text)) if field.trained else [1] * len(lines)
    sizes = [len(line.translate(_NO_SPACE)) for line in lines]  # word characters
    share = sum(s for s, k in zip(sizes, labels, strict=True) if k) / max(1, sum(sizes))
    return n_words, chars, symbols, again, repeated, failed, not failed and share >= CONTENT, share, len(lines), labels.count(0)


def quality_column(text: Column, field: Field) -> Column:
    """struct of RESULT of a text column."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    @F.pandas_udf(RESULT)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([judge(t, field) for t in batch], columns=names)

    return of(text)


def rate_documents(docs: DataFrame, labels: DataFrame, held_out: int | None = None, folds: int = 3) -> DataFrame:
    """doc_id and RESULT of every document; labels of the fold ``held_out`` (of the id's crc32) are not learned."""
    own = quality_column(F.col("text"), learn(docs, labels, held_out=held_out, folds=folds))
    return docs.select("doc_id", own.alias("own")).select("doc_id", "own.*")


def line_labels(text: str, field: Field) -> list[tuple[str, bool]]:
    """Each line with whether it is content (for inspection)."""
    return [(line, bool(k)) for line, k in zip(text.split("\n"), field.viterbi(features(text)), strict=True)]
