"""Near copies by shingle sets against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from kilojoin.llm import common, near


def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append(frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def plain_groups(texts, least=0.8):
    sets, group = plain_sets(texts), list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def copies(rng, n_groups, n_rows, changes):
    words = [f"w{i}" for i in range(800)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(n_groups)]
    out = []
    for i in range(n_rows):
        w = list(base[i % n_groups])
        for at in rng.sample(range(10, 190), changes[i % len(changes)]):
            w[at] = f"x{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("run, warm, salted", [(256, 1000, 1000), (8, 1000, 1000), (8, 3, 2)])
def test_groups_equal_brute_force(spark, monkeypatch, run, warm, salted):
    """Copies at a similarity of 0.8 to 0.9 are further apart than 4 bits; all of them must go, however hot keys and heads are dealt."""
    monkeypatch.setattr(near, "RUN", run)
    monkeypatch.setattr(near, "SALTED", salted)
    monkeypatch.setattr(common, "WARM", warm)
    texts = copies(random.Random(3), 12, 90, [0, 2, 4, 3, 1, 9]) + [None, "", " ", "one two", "One  TWO"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for i, g in enumerate(plain_groups(texts)):
        first.setdefault(g, i)
    assert sorted(r["doc_id"] for r in near.one_of_each(df).collect()) == sorted(first.values())


def test_pipeline_stage_drops_copies_between_08_and_09(spark):
    import corpus_pipeline

    words = [f"v{i}" for i in range(200)]
    other = list(words)
    for at in (40, 90, 150):  # 15 of 196 shingles differ: Jaccard 0.86
        other[at] = "new"
    far = list(words)
    for at in range(10, 190, 10):
        far[at] = "far"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [1, 3]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near.one_of_each(df).count() == 0 and near.one_of_each(df).columns == df.columns


def test_one_row_of_each_group_whatever_the_ids(spark):
    """Equal ids on different texts are different documents; copies with a null id go, unless all have none."""
    a, b, c = copies(random.Random(9), 3, 3, [0])
    near_b = b.replace(b.split()[100], "new", 1)
    rows = [(5, a), (5, b), (9, near_b), (None, a), (None, c), (None, c)]
    got = near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in got) == sorted([(5, a), (5, b), (0, c)])


def test_candidates_are_what_simhash_trees_link(spark):
    """Nearly all pairs at a similarity of 0.8 share a key that their fingerprints give them, and texts that aren't alike share none."""
    rng = random.Random(11)
    texts = []
    for _ in range(400):
        w = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(w)
        for at in (30, 70, 110, 150):  # 20 of 196 shingles differ
            other[at] = "new"
        texts += [" ".join(w), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    codes = df.select("id", near.sketch_column(F.col("text"), *near.shape(len(texts))).alias("own")).select("id", "own.*")
    keys = near.candidates(codes).join(codes.select("id", "code"), "code").groupBy("key").agg(F.collect_set("id").alias("ids"))
    met = {(a, b) for r in keys.collect() for a in r["ids"] for b in r["ids"] if a < b}
    assert sum((2 * i, 2 * i + 1) in met for i in range(400)) >= 398 and all(a // 2 == b // 2 for a, b in met)


def test_rows_of_a_group_of_texts_too_far_apart_grow_with_the_texts(spark, monkeypatch):
    """A group that its keys hold together but whose texts are too far apart makes no list of its pairs, and its similar pairs are found, however few meet at first."""
    monkeypatch.setattr(near, "RUN", 2)
    monkeypatch.setattr(near, "MEET", 1, raising=False)
    rng, met = random.Random(5), []
    texts = copies(rng, 1, 360, [6, 7, 9, 5])
    for i in range(40):
        w = texts[i].split()
        w[rng.randrange(195, 200)] = f"y{i}"
        texts.append(" ".join(w))
    kind = type(spark.range(0))
    of = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, *a, **b: met.append(self.count()) or of(self, *a, **b))
    first = {}
    for i, g in enumerate(plain_groups(texts)):
        first.setdefault(g, i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near.one_of_each(df).collect()) == sorted(first.values())
    assert 200 < len(first) < 361 and max(met) <= 100 * len(texts)


@pytest.mark.parametrize("bound", [10**6, 40])
def test_similar_sets_of_different_components_meet_at_a_rare_shingle(spark, monkeypatch, bound):
    """Also where only the most frequent shingles are known."""
    of = near.frequencies
    monkeypatch.setattr(near, "frequencies", lambda own: of(own, bound))
    rng = random.Random(8)
    sets = [sorted({t for t in range(60) if rng.random() < 0.9} | {rng.randrange(60, 10**6) for _ in range(i % 9)}) for i in range(80)]
    similar = {(i, j) for i in range(80) for j in range(i) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}
    own = spark.createDataFrame([(0, i, i, x) for i, x in enumerate(sets)], "group long, code long, component long, set array<long>")
    rows = near.prefixes(own, 0.8).join(own.select("code", "component"), "code")
    met = {(max(r["a"], r["b"]), min(r["a"], r["b"])) for r in near._meetings(rows, 0.8, 10**6).collect()}
    assert similar and similar <= met and len(met) < 80 * 79 / 2


def test_rows_of_components_grow_with_the_codes_of_a_group(spark, monkeypatch):
    """A large group whose codes share keys with many heads makes no edge for each code and head: components() gets few edges for a code."""
    given, of = [], near.components
    monkeypatch.setattr(near, "components", lambda edges, *a: given.append(edges.distinct().count()) or of(edges, *a))
    texts = copies(random.Random(5), 1, 400, [6, 7, 9, 5])
    first = {}
    for i, g in enumerate(plain_groups(texts)):
        first.setdefault(g, i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near.one_of_each(df).collect()) == sorted(first.values())
    assert sum(given) <= 4 * len(texts)


def test_sets_are_joined_once_for_the_pairs(spark, monkeypatch):
    """Hot codes are counted in the pairs, not in what the first join with the sets has made of them."""
    counted, kind = [], type(spark.range(0))
    of = kind.count
    monkeypatch.setattr(kind, "count", lambda self: counted.append(self.columns) or of(self))
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 4, 5]), (3, [8, 9])], "code long, set array<long>")
    got = near._alike(spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long"), sets, 0.8).collect()
    assert [tuple(r) for r in got] == [(1, 2)] and counted == [["a", "b"]]
