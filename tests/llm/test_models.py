"""Language, quality and toxicity: parts against brute force, whole queries by held-out accuracy."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilojoin.llm import language, quality, toxicity

DATA = "/root/testdata/sf0.01"


def docs_of(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def labels_of(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


# toxicity


def plain_segments(x):
    """The definition: take the best segment, go on left and right of it."""
    best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, _, i, j = best
    left = plain_segments(x[:i])
    right = [(a + j, b + j, s) for a, b, s in plain_segments(x[j:])]
    return [*left, (i, j, best[0]), *right]


@pytest.mark.parametrize("seed", range(25))
def test_segments_equal_the_definition(seed):
    rng = random.Random(seed)
    x = [round(rng.uniform(-2, 1.7), 3) + 1e-7 * i for i in range(rng.randint(1, 40))]
    got = toxicity.segments(np.array(x))
    want = plain_segments(x)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_no_positive_token_no_segment():
    assert toxicity.segments(np.array([-1.0, 0.0, -2.0])) == [] and toxicity.segments(np.array([])) == []


def test_toxic_documents_are_found(spark):
    # sf0.01 has only 18 toxic labels in the held-out fold
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, labels).join(labels.where("toxic is not null"), "doc_id").where("held_out").collect()
    hits = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert hits[1, 1] >= 0.9 * (hits[1, 0] + hits[1, 1]) and hits[0, 1] <= 0.04 * (hits[0, 0] + hits[0, 1]), hits


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (None, "some words"), (5, "x " * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score_documents(docs, none).collect()] == [0.0] * 5
    model = toxicity.learn(docs_of(spark), labels_of(spark))
    assert model.weights and model.judge(None)[0] == model.judge("")[0] == model.judge("12 !")[0] == 0.0
    assert toxicity.passages(docs, model).where("doc_id = 5").count() == 0
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


def test_held_out_labels_are_not_learned(spark):
    labels = labels_of(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.crc_class(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.learn(docs_of(spark), x) for x in (labels, flipped))
    assert a.weights == b.weights and (a.rate, a.k) == (b.rate, b.k)


def plain_score(text, model):
    """exp(-E) by the formulas, segments by their definition."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    x = []
    for w in words:
        known = [model.weights[f] for f in ("w" + w, "5" + w[:5] if len(w) > 5 else "", "4" + w[:4] if len(w) > 4 else "") if f in model.weights]
        x.append((known[0] if known else 0.0) - toxicity.DRIFT)
    sums = sorted((s for *_, s in plain_segments(x)), reverse=True)
    least, total = math.inf, 0.0
    for r, s in enumerate(sums, 1):
        total += model.rate * s - math.log(max(model.k * len(words), 1e-9))
        if r == 1:
            least = math.exp(min(50, -total))
        elif total > r:
            least = min(least, 2.0 ** (r - 1) * math.exp(-total) * total ** (r - 1) / math.factorial(r) / math.factorial(r - 1))
    return math.exp(-least) if sums and model.weights else 0.0


def test_scores_equal_the_formulas(spark):
    model = toxicity.learn(docs_of(spark), labels_of(spark))
    docs = docs_of(spark).where("length(text) < 900")
    rows = toxicity.score_documents(docs_of(spark), labels_of(spark)).join(docs, "doc_id").select("text", "score", "predicted").collect()[:150]
    many = " ".join(list({f[1:] for f, w in model.weights.items() if w > 2 and f[0] == "w"})[:12] * 3)
    assert model.judge(many)[0] == pytest.approx(plain_score(many, model), rel=1e-9)
    for r in rows:
        assert r["score"] == pytest.approx(plain_score(r["text"], model), rel=1e-7, abs=1e-12) and r["predicted"] == (r["score"] >= 0.7)


def plain_weights(texts):
    """Log-odds under the prior of the words and beginnings of words, from (text, toxic) of single copies."""
    counts = {0: Counter(), 1: Counter()}
    for text, toxic in texts:
        for f in {f for w in set(toxicity.tokens(text)) for f in toxicity.features_of(w)}:
            counts[toxic][f] += 1
    often = {f for f in counts[0] | counts[1] if counts[0][f] + counts[1][f] >= toxicity.SEEN}
    sums = [sum(counts[k][f] for f in often) for k in (0, 1)]
    out = {}
    for f in often:
        a, prior = toxicity.PRIOR * (counts[0][f] + counts[1][f]), toxicity.PRIOR * sum(sums)
        odds = [math.log((counts[k][f] + a) / (sums[k] + prior - counts[k][f] - a)) for k in (0, 1)]
        out[f] = odds[1] - odds[0]
    return out


def test_weights_equal_the_formulas(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    vocabulary, bad = [word() for _ in range(120)], ["vilex", "nasty", "crudest"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=30) + (rng.choices(bad, k=4) if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    import zlib

    want = plain_weights([(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 3 != 1])
    assert model.weights == pytest.approx({f: want[f] for f in model.weights}) and {"wvilex", "wnasty", "wcrudest"} <= set(model.weights)
    lam = sum  # the rate solves the equation of the extreme-value law over the clean tokens
    scores = Counter(round(model.score_of(w), 1) for i, t, k in rows if k == 0 and zlib.crc32(str(i).encode()) % 3 != 1 for w in toxicity.tokens(t))
    for x in model.weights.values():
        if x > toxicity.DRIFT:
            scores[round(x - toxicity.DRIFT, 1)] += 0.5
    assert lam(n * math.exp(model.rate * s) for s, n in scores.items()) / sum(scores.values()) == pytest.approx(1, rel=1e-6)


# language


def test_held_out_languages(spark):
    rows = language.identify(docs_of(spark)).join(docs_of(spark).select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").collect()
    known = [r for r in rows if r["lang_pred"] != "und"]
    assert len(known) >= 0.95 * len(rows) and sum(r["lang"] == r["lang_pred"] for r in known) >= 0.97 * len(known)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34", None), (None, "words here", "en"), (4, "words here " * 20_000, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert got[1] == got[2] == got[3] == "und"
    assert [r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()] == ["und"] * 5
    assert language.identify(docs.limit(0)).count() == 0


def test_grams_do_not_cross_borders():
    a, b = language.grams("ab1cd"), language.grams("ab cd")
    assert a.tolist() == b.tolist() and language.grams("12 ") is None
    assert sorted(language.grams("ab").tolist()) != sorted(language.grams("ba").tolist())


def plain_language(rows):
    """doc_id -> (lang, cosine) with dictionaries of grams; the centroids are the operator's clustering of plain vectors."""
    import zlib

    learned = [(t, lang) for i, t, lang in rows if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {t: Counter(g.tolist()) for _, t, _ in rows if t is not None and (g := language.grams(t)) is not None}
    there = [t for t, _ in learned if t in counts]
    df = Counter(d for t in there for d in counts[t])
    idf = lambda d: math.log((1 + len(there)) / (1 + df[d])) + 1

    def vector(t):
        v = {d: n * idf(d) for d, n in counts[t].items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {d: x / size for d, x in v.items()}

    centroids = []
    for lang in sorted({x for _, x in learned}):
        own = [vector(t) for t in sorted({t for t, x in learned if x == lang}) if t in counts]
        x = np.zeros((len(own), language.DIMS), np.float32)
        for i, v in enumerate(own):
            x[i, list(v)] = list(v.values())
        centroids += [(lang, c) for c in language.cluster(x, language.CENTROIDS)[0]]
    out = {}
    for i, t, _ in rows:
        if t not in counts:
            out[i] = ("und", 0.0)
            continue
        v = vector(t)
        cosines = [(sum(x * float(c[d]) for d, x in v.items()), lang) for lang, c in centroids]
        best = max(c for c, _ in cosines)
        out[i] = (next(lang for c, lang in cosines if c >= best - 1e-9), min(1.0, max(0.0, best)))
    return out


def test_languages_equal_plain_vectors(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        lang = ["aa", "bb", "cc"][i % 3]
        letters = {"aa": "abcde", "bb": "cdefgh", "cc": "ghijk"}[lang]
        text = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 30)))
        rows.append((i, text, lang if i % 7 else None))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 3", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    want = plain_language(rows)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-5) for i in want)


def test_one_text_on_most_rows_of_a_language(spark):
    """A null or repeated id, or one text, on most rows: every language is learned, and equal texts once."""
    rows = [(None, f"der die das und {'xyz'[i % 3]}{i}", "de") for i in range(900)] + [(8, "the one text of all", "en")] * 900 + [(9, "una casa grande", "es")]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"de", "en", "es"} == set(model.languages)


def test_clusters_are_found():
    rng = np.random.default_rng(1)
    heads = np.eye(3, language.DIMS, dtype=np.float32)
    x = np.concatenate([h + 0.002 * rng.standard_normal((50, language.DIMS)).astype(np.float32) for h in heads])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, limit = language.cluster(x, 3)
    assert sorted((c @ heads.T).argmax(1).tolist()) == [0, 1, 2] and (limit > 0.9).all()


# quality


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words, lines, seen, again = WORD.findall(text), text.split("\n"), set(), 0
    for line in lines:
        again += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(marked)


@pytest.mark.parametrize("text", [None, "", "a", "x\nx\n \n \nx", "a b c d e a b c d e f", "the cat " * 40, "é ü |<>| ###\r\nb\x0bc\x0cd", "a b a b a b a b", "\x1c\x1d y\x85z"])
def test_base_measures(text):
    assert quality.base_measures(text) == plain_measures(text)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    field = quality.Field(rng.standard_normal(quality.N_FEATURES), rng.standard_normal((2, 2)), rng.standard_normal(2))
    for n in (1, 2, 5, 9):
        rows = np.stack([rng.integers(0, v, n) for v in quality.VALUES], 1) + quality._FIRST

        def value(path, rows=rows):
            total = field.first[path[0]] + sum(field.weights[rows[i]].sum() for i, k in enumerate(path) if k)
            return total + sum(field.change[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert value(field.viterbi(rows)) == pytest.approx(value(best))


def test_field_learns_runs():
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for _ in range(60):
        y = np.repeat(rng.integers(0, 2, 4), 5)
        rows = np.stack([rng.integers(0, v, len(y)) for v in quality.VALUES], 1)
        rows[:, 4] = np.where(rng.random(len(y)) < 0.85, y, 1 - y)
        docs.append(rows + quality._FIRST)
        labels.append(y)
    field = quality.Field().fit(docs[:40], labels[:40])
    right = [np.mean(np.array(field.viterbi(d)) == y) for d, y in zip(docs[40:], labels[40:], strict=True)]
    assert np.mean(right) > 0.9


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where((quality.crc_class(F.col("doc_id"), 3) == 1) & F.col("quality").isNotNull())
    rows = quality.rate_documents(docs, labels, held_out=1).join(held, "doc_id").collect()
    hits = Counter((r["quality"], r["kept"]) for r in rows)
    assert hits[1, True] >= 0.95 * (hits[1, True] + hits[1, False]), hits
    assert hits[0, False] >= 0.95 * (hits[0, True] + hits[0, False]), hits
    assert all(not r["kept"] for r in rows if r["base_failed"])
    print("held-out quality", dict(hits))


def plain_judge(text, field):
    """Verdict by trying every path over the lines."""
    words, chars, symbols, again, repeated = plain_measures(text)
    failed = words < 10 or 100 * repeated > 20 * words
    lines, rows = text.split("\n"), quality.features(text)

    def value(path):
        total = field.first[path[0]] + sum(field.weights[rows[i]].sum() for i, k in enumerate(path) if k)
        return total + sum(field.change[a, b] for a, b in itertools.pairwise(path))

    best = max(itertools.product((0, 1), repeat=len(lines)), key=value)
    sizes = [sum(map(len, WORD.findall(line))) for line in lines]
    share = sum(s for s, k in zip(sizes, best, strict=True) if k) / max(1, sum(sizes))
    return words, chars, symbols, again, repeated, failed, not failed and share >= quality.CONTENT


def test_verdicts_equal_all_paths(spark):
    rng = random.Random(6)
    good = ["The quick brown fox went over the old stone bridge.", "She said that it would rain before noon, and it did!"]
    bad = ["### SALE $$$ <<<>>>", "home | about | contact", "!! 12 34 %%", "click\there\tnow"]
    texts = ["\n".join(rng.choice(good + bad) + f" {rng.randrange(99)}" for _ in range(rng.randint(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(sum(g[:9] in t for g in good) > 0)) for i, t in enumerate(texts)], "doc_id long, quality int")
    field = quality.learn(docs, labels)
    assert field.trained
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality.rate_documents(docs, labels).collect()}
    assert got == {i: plain_judge(t, field) for i, t in enumerate(texts)}
    assert {g[-1] for g in got.values() if not g[-2]} == {True, False}


def with_names(df, *names):
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


def test_columns_of_any_name(spark):
    names = ["own", "h", "x", "n", "k0", "toxic_", "held_out", "score", "lang_pred", "predicted", "n_words", "kept", "n_lines", "n_tokens", "ids_sha256"]
    docs, labels = docs_of(spark), labels_of(spark)
    for query in (lambda d: quality.rate_documents(d, labels), lambda d: toxicity.score_documents(d, labels), language.identify):
        assert sorted(map(str, query(with_names(docs, *names)).collect())) == sorted(map(str, query(docs).collect()))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "one two three four five six seven eight nine ten"), (4, "line of ten words that goes on and on here\n" * 3000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.rate_documents(docs, none).collect()}
    assert got[1]["base_failed"] and got[2]["base_failed"] and got[4]["base_failed"] and got[None]["kept"]
    assert math.isclose(got[None]["content_share"], 1.0)
    assert quality.rate_documents(docs.limit(0), none).count() == 0


def test_every_language_has_centroids(spark):
    from kilojoin.llm import language

    rows = [(10 * i + j, " ".join(chr(0x4E00 + 20 * i + (j + k * k) % 20) * 2 for k in range(30)), f"l{i:03}") for i in range(305) for j in range(4)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2))
    assert sorted(set(model.languages)) == [f"l{i:03}" for i in range(305)]
