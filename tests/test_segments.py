"""Sections of random records against a plain walk over their samples."""

import random

import pytest

from kilojoin.operators import segment, signal


def walk(rows):
    """Section of each interval: events cut, the last interval never does."""
    out, section, pending = [], 0, 0
    n = len(rows)
    for i in range(n - 1):
        section += pending
        pending = 0
        if i < n - 2:
            left = any(a == 0 and b != 0 for a, b in zip(rows[i], rows[i + 1], strict=True))
            right = any(a != 0 and b == 0 for a, b in zip(rows[i], rows[i + 1], strict=True))
            section += left
            pending = int(right)
        out.append(section)
    return out


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(7)
    records = {f"r{k}": [[rng.choice([0.0, 1.0, 2.0]) for _ in range(2)] for _ in range(rng.randrange(3, 9))] for k in range(40)}
    rows = [(r, i, float(i), f"s{j}", v) for r, xs in records.items() for i, x in enumerate(xs) for j, v in enumerate(x)]
    return records, spark.createDataFrame(rows, "record_id string, idx long, t double, sig_id string, v double")


def test_sections_follow_the_walk(records):
    plain, df = records
    got = {}
    for r in segment.intervals(df).where("sig_id = 's0'").orderBy("idx").collect():
        got.setdefault(r["record_id"], []).append(r["section"])
    assert got == {k: walk(v) for k, v in plain.items()}


def test_neighbours_share_a_sample_and_join_again(records):
    _, df = records
    back = segment.concatenated(segment.section_samples(segment.intervals(df)))
    key = lambda d: sorted((r["record_id"], r["sig_id"], r["idx"], r["v"]) for r in d.collect())
    assert key(back) == key(df)


def test_crossings_are_zero_and_in_order(spark):
    df = signal.from_lists(spark, {"a": [1.0, -1.0, 2.0], "b": [-2.0, 2.0, 2.0]})
    rows = segment.add_zero_crossings(df).where("sig_id = 'a'").orderBy("idx").collect()
    assert [r["t"] for r in rows] == [0.0, 0.5, 0.5, 1.0, pytest.approx(4 / 3), 2.0]
    assert [r["v"] for r in rows] == [1.0, 0.0, 0.0, -1.0, 0.0, 2.0]


def test_missing_crossing_is_an_error(spark):
    with pytest.raises(Exception, match="crosses zero"):
        segment.steps(signal.from_lists(spark, {"a": [1.0, -1.0]})).collect()


def test_chopping_is_stable(spark):
    rng = random.Random(3)
    df = signal.from_lists(spark, {s: [rng.uniform(-1, 1) for _ in range(30)] for s in "ab"})
    once = segment.add_zero_crossings(df)
    again = segment.add_zero_crossings(once)
    assert once.count() == again.count()


def test_rounding_never_skips_a_zero(spark):
    import random

    rng, rows = random.Random(3), []
    for record in range(40):
        t = 1e7 * rng.random()
        for idx in range(12):
            t += rng.choice([0.0, 1e-6, 0.001, 3.7])
            x = rng.choice([-1, 1]) * rng.random()
            rows += [(str(record), idx, t, "a", x), (str(record), idx, t, "b", -x / 3), (str(record), idx, t, "c", x * 0.7 + rng.choice([0, 1e-9]))]
    cut = segment.intervals(segment.add_zero_crossings(spark.createDataFrame(rows, "record_id string, idx long, t double, sig_id string, v double")))
    assert cut.where("v * w < 0").count() == 0 and cut.count() > len(rows)
