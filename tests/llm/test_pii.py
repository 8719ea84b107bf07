"""Patterns against Python's, disclosure against a plain count."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from kilojoin.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    text, out = text or "", []
    for kind, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "nothing here", "mail a.b+c@x-y.org, then@ and @no and a@b.c.d..e",
    "a@b a@b.co@c.de x@y.zz.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 0000000255.1.1.1 1.2.3 9.9.9.9.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5 and 1 2 3 4", "+49 (0) 171 1234567 and +1-2 +12345678901234567 ++1 555 0100 99-",
    "日本 😀 x@y.jp 10.0.0.1 😀 +81 90 1234 5678", "9" * 3000 + " 4539 1488 0343 6467", "a." * 4000 + "@x.y", "%" * 5000 + "@", "+1" + " 2" * 3000,
    "1." * 3000, "ünï@ex.com a@é.com b@ex.comé", "１２.3.4.5 6.7.8.9",
]


def test_base_spans_equal_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    for i, t in enumerate(TEXTS):
        want = plain_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[i]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")], t
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"].startswith(joined)


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed & (2**64 - 1))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def least_hash(feats, seed):
    return min(signed(xx(seed.to_bytes(4, "little"), xx(f.encode()))) for f in feats)


KEY = re.compile(rf"(?<![^\W_])(?=[^\W\d_]*\d)(?=\d*[^\W\d_])[^\W_]{{{pii.KEY},}}")


def plain_terms(docs):
    """term -> share by the definition, on texts whose spans don't overlap and whose words are of Latin letters and digits."""
    every, held = Counter(), []
    for _, text in docs:
        text = text or ""
        found = [(a, b, k, text[a:b]) for k, a, b in plain_spans(text)]
        found += [(m.start(), m.end(), "key", m[0]) for m in KEY.finditer(text)]
        items = [(a, "e", f"{k}:{v.lower() if k == 'email' else v if k in ('ip', 'key') else re.sub('[^0-9]', '', v)}") for a, _, k, v in found]
        items += [(m.start(), "w", m[0]) for m in re.finditer(r"[^\W_]+", text) if not any(a <= m.start() < b for a, b, _, _ in found)]
        items = [i[1:] for i in sorted(items)]
        blocks = [items[i : i + pii.HALF] for i in range(0, max(1, len(items)), pii.HALF)]
        own = []
        for w in [a + b for a, b in itertools.pairwise(blocks)] or blocks:
            words = [x for kind, x in w if kind == "w"]
            feats = {x.lower() for x in words} | {shape(x) for x in words} - {None}
            entities = {x for kind, x in w if kind == "e"}
            if feats or entities:
                every.update(feats | {"##"})
            if entities:
                own.append((feats, entities))
        if own:
            alike = min((least_hash(f, 1), least_hash(f, 2)) for f, _ in own)
            held += [(f, e | {x.split(":")[0] for x in e} | {"any"}, alike) for f, e in own]
    groups = defaultdict(Counter)
    for feats, entities, alike in held:
        for e in entities:
            groups[e, None][alike] += 1
            for f in feats:
                groups[e, f][alike] += 1
    eff = {k: sum(c.values()) ** 2 / sum(n * n for n in c.values()) for k, c in groups.items()}
    out = {}
    for (e, f), c in groups.items():
        holder = ":" in e
        if f is None or holder and eff[e, None] < pii.PLACES or eff[e, f] < (pii.PLACES if holder else pii.SUPPORT):
            continue
        p, q = sum(groups[e, None].values()) / every["##"], sum(c.values()) / every[f]
        if p < 1:
            given = (eff[e, f] + pii.PRIOR * p) / (eff[e, f] / q + pii.PRIOR)
            out[f] = max(out.get(f, -9), math.log(given / p) / math.log(1 / p))
    return {f: x for f, x in out.items() if x >= pii.GENERALISE}


def shape(w):
    return ("#a7-" if any(c.isalpha() for c in w) else "#7-") + str(len(w)) if any(c.isdigit() for c in w) else None


def corpus(n=60, seed=1):
    """Karla Brandt's mail in a few texts of different words, phone numbers and keys in others, and the rest without."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    docs = []
    for i in range(n):
        text = prose(rng.choice([30, 200, 400]))
        if i % 6 == 0:
            text = f"{text} Karla Brandt wrote from kb@mail.org and {prose(20)}"
        elif i % 6 == 1:
            text = f"{prose(10)} extension call +49 171 {1000000 + 7 * i} {text}"
        elif i % 6 == 2:
            text = f"{text} secret = {rng.randrange(16**24):024x}a1 {prose(9)}"
        docs.append((i, text))
    return docs + [(500, "then Karla left"), (501, None), (502, ""), (503, "no name"), (504, docs[6][1]), (505, docs[6][1])]


def test_terms_equal_counts(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["feature"]: r["share"] for r in pii.disclosing(df).collect()}
    assert got == pytest.approx(plain_terms(docs)) and {"karla", "brandt", "secret", "extension"} <= set(got)


def test_terms_are_marked_in_every_text(spark):
    docs = corpus()
    terms = plain_terms(docs)
    want = {}
    for d, text in docs:
        base = plain_spans(text)
        words = [m for m in re.finditer(r"[^\W_]+", text or "") if not any(a <= m.start() < b for _, a, b in base)]
        want[d] = [(m.start(), m.end()) for m in words if KEY.fullmatch(m[0]) or m[0].lower() in terms or shape(m[0]) in terms]
    got = {r["doc_id"]: [(t["start"], t["end"]) for t in r["terms"]] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and got[500] == [(5, 10)] and not got[503] and not got[501]


def test_copies_are_no_further_evidence(spark):
    """One passage with a mail, copied with small changes: its own words are no names."""
    rng = random.Random(2)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}x"[::-1] for i in range(120)]
    docs = []
    for i in range(40):
        w = list(words)
        w[rng.randrange(120)] = f"changed{i}"
        docs.append((i, " ".join([*w[:60], "from", "kb@mail.org", *w[60:]])))
    docs += [(100 + i, " ".join(rng.choices(["some", "other", "text", "that", "goes", "on"], k=30))) for i in range(200)]
    assert pii.disclosing(spark.createDataFrame(docs, "doc_id long, text string")).count() == 0


def test_many_candidates_take_the_other_way(spark, monkeypatch):
    from kilojoin.llm import common

    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    one = sorted(map(str, pii.find(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pii, "FEW", 0)
    assert sorted(map(str, pii.find(df).collect())) == one


NAMES = ["_id", "_h", "_spans", "_new", "_every", "h", "l", "row", "terms", "spans", "i", "start", "share"]


def test_sanitised_texts(spark):
    docs = [*corpus(), (90, "to q@w.org now"), (None, "to q@w.org now"), (91, "q@w.org 10.0.0.1"), (91, "q@w.org 10.0.0.1"), (92, "as it is \ue000\ue003")]
    df = spark.createDataFrame([(*r, *[f"own {n}" for n in NAMES], len(r[1] or "")) for r in docs], ", ".join(["doc_id long, text string", *[f"{n} string" for n in NAMES], "n_chars long"]))
    out = pii.sanitised(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(docs) and all(r[n] == f"own {n}" for r in got for n in NAMES)
    texts = [r["text"] for r in got if r["text"] is not None]
    assert not any("@" in t or "Karla" in t or "Brandt" in t or KEY.search(t) for t in texts)
    assert texts.count("[EMAIL] [IP]") == 2 and texts.count("to [EMAIL] now") == 2 and "as it is \ue000\ue003" in texts and "no name" in texts
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None) and sum(r["text"] is None for r in got) == 1
    found = {r["doc_id"]: r for r in pii.find(df).collect()}
    for r in got:  # what is in no span stays
        if r["doc_id"] in (3, 4, 5, 0, 12):
            text, cuts = dict(docs)[r["doc_id"]], sorted([(s["start"], s["end"]) for s in found[r["doc_id"]]["spans"]] + [(t["start"], t["end"]) for t in found[r["doc_id"]]["terms"]])
            parts, at = [], 0
            for a, b in cuts:
                parts.append(text[at:a])
                at = b
            want = "".join([*parts, text[at:]])
            assert re.sub(r"\[[A-Z]+\]", "", r["text"]) == want


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1023, 1024, 1025, 40_000])
def test_running_sums(spark, n):
    df = spark.createDataFrame([([i % 7 for i in range(n)],)], "a array<int>")
    assert df.select(pii.running(F.col("a"))).first()[0] == list(itertools.accumulate(i % 7 for i in range(n)))


def test_a_long_text_of_mails_takes_linear_time(spark):
    """With quadratic steps, 20,000 mails in one text would take minutes."""
    import time

    df = spark.createDataFrame([(1, "".join(f"some words of m{i}@x.org " for i in range(20_000))), (2, "x")], "doc_id long, text string")
    began = time.time()
    r = pii.digest(pii.find(df)).where("doc_id = 1").first()
    assert r["n_email"] == 20_000 and time.time() - began < 60


def test_empty_table(spark):
    assert pii.digest(pii.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@pytest.mark.parametrize("digits, want", [("4111111111111111", True), ("4111111111111112", False), ("0000000000000000", True)])
def test_luhn(spark, digits, want):
    df = spark.createDataFrame([(digits,)], "d string")
    assert df.select(pii.luhn(df["d"])).first()[0] is want


def test_only_terms_and_keys_become_rows(spark):
    """A text with one term makes one row, however long it is."""
    text = "open sesame " + "word " * 500 + "a1b2c3d4e5f6a7b8c9"
    terms = spark.createDataFrame([("sesame", 0.9), ("#a7-4", 0.8)], "feature string, share double")
    out = pii.everywhere(spark.createDataFrame([(text,), ("nothing here",), ("CD77 Sesame",)], "text string"), terms)
    generated = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode(" in x]
    assert any("sesame" in x for x in generated)
    got = sorted([(s["i"], s["start"], s["share"]) for s in r["terms"]] for r in out.collect())
    assert got == [[(0, 0, 0.8), (1, 5, 0.9)], [(1, 5, 0.9), (502, 2512, 1.0)]]
