"""Queries with SQL give the rows that DuckDB gives; all queries return every row of their tables."""

import glob
import math
import os

import duckdb
import pytest

import corpus_pipeline
from kilojoin.llm import queries

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cur = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(norm, r)) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op7", "op10")])
def test_a_row_for_each_document(spark, name):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in queries.QUERIES[name](spark, DATA).select("doc_id").collect()) == ids


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    clean = corpus_pipeline.drop_toxic(spark, docs, DATA).cache()
    toxic = queries.QUERIES["op10_toxic_segments"](spark, DATA).where("predicted = 1").select("doc_id")
    assert {r[0] for r in docs.join(toxic, "doc_id", "left_anti").select("doc_id").collect()} == {r[0] for r in clean.select("doc_id").collect()}
    single = corpus_pipeline.drop_near_copies(spark, clean, DATA).cache()
    assert single.columns == docs.columns and 0 < single.count() < clean.count()
    safe = corpus_pipeline.sanitise(spark, single, DATA).cache()
    assert safe.columns == docs.columns and safe.count() == single.count()
    assert safe.where("text like '%[EMAIL]%'").count() > 0
    mixed = corpus_pipeline.mix_sources(spark, safe, DATA)
    assert mixed.columns == docs.columns
    assert {r[0] for r in mixed.select("doc_id").collect()} <= {r[0] for r in safe.select("doc_id").collect()}
    out = corpus_pipeline.encode(spark, mixed, DATA)
    assert out.count() == mixed.count() and out.where("size(ids) <> n_tokens").count() == 0


def test_stages_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


NAMES = ["_id", "_h", "_spans", "_new", "_every", "_u", "_source", "_cdf", "_nth", "_own", "_uid", "_hash", "row", "h", "copy", "n_copies", "hash", "code"]


def awkward(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows and ids, and columns named like the stages' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
    texts = [None, "", " ", "write to a.b@c.org or 10.1.2.3", "write to a.b@c.org or 10.1.2.3", "word " * 30_000, " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(41))]
    rows = [(i if i % 3 else None, t, "en", ["a", None][i % 2], None if t is None else len(t), *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[7], (4, "another text of id 4", None, None, 20, *[None] * len(NAMES))], schema)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_tables(spark, name, stage):
    docs = awkward(spark)
    own = [tuple(r) for r in docs.collect()]
    out = stage(spark, docs, DATA)
    got = [tuple(r) for r in out.collect()]
    empty = stage(spark, docs.limit(0), DATA)
    assert empty.columns == out.columns and empty.count() == 0
    if name == "bpe":
        assert len(got) == len(own)
        return
    assert out.columns == docs.columns
    if name == "toxicity":
        assert sorted(map(str, got)) == sorted(map(str, own))
    elif name == "simhash":  # the wordless, the mails, the long one, w0 to w40 and w0 to w39 (0.97 alike), and the other text
        assert len(got) == 5 and set(got) <= set(own)
    elif name == "pii":
        kept = lambda rows: sorted(str((r[0], r[2], r[3], *r[5:])) for r in rows)
        assert kept(got) == kept(own) and not any("@" in (r[1] or "") for r in got)
        assert all(r[4] == (None if r[1] is None else len(r[1])) for r in got)
    else:
        assert set(got) <= set(own)
        n = {r: got.count(r) for r in own}
        assert all(n[r] % own.count(r) == 0 for r in own)


def plain_pipeline(rows, toxic, terms_of):
    """What the stages keep, by brute force: verdicts given, near copies by comparing all pairs, spans by plain patterns, copies by plain draws."""
    from test_near import plain_groups
    from test_pii import plain_spans
    from test_tables import plain_copies

    docs = [r for r in rows if not toxic[r["doc_id"]]]
    group, first = plain_groups([r["text"] for r in docs]), {}
    for r, g in sorted(zip(docs, group, strict=True), key=lambda x: x[0]["doc_id"]):
        first.setdefault(g, r)
    docs = list(first.values())
    texts = []
    for r in docs:
        cuts = plain_spans(r["text"])
        texts.append(r["text"] if not cuts and not terms_of.get(r["doc_id"]) else None)
    n, sources = len(docs), {}
    for r in docs:
        sources[r["source"]] = sources.get(r["source"], 0) + 1
    wish = {s: c**0.5 for s, c in sources.items()}
    rate = {s: wish[s] / sum(wish.values()) * n / c for s, c in sources.items()}
    return docs, texts, lambda r, text: plain_copies(r["doc_id"], text, rate[r["source"]])


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The whole pipeline on a small table, stage by stage against plain code."""
    import base64

    import public_tokenizers
    import tiktoken
    from kilojoin.llm import pii

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    out = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        out.setdefault(r["doc_id"], []).append(r)
    rows = docs.collect()
    toxic = {r["doc_id"]: r["predicted"] == 1 for r in queries.QUERIES["op10_toxic_segments"](spark, DATA).collect()}
    kept_docs, plain_texts, copies = plain_pipeline(rows, toxic, {})
    single = spark.createDataFrame([(r["doc_id"], r["text"]) for r in kept_docs], "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in pii.sanitised(single).collect()}
    marked = {r["doc_id"]: r["terms"] for r in pii.find(single).collect()}
    with open(public_tokenizers.path(queries.BYTE_RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r, plain in zip(kept_docs, plain_texts, strict=True):
        text = new[r["doc_id"]]
        assert plain is None or marked[r["doc_id"]] or text == r["text"]
        if n := copies(r, text):
            want[r["doc_id"]] = (n, library.encode_ordinary(text or ""))
    assert {d: (len(rs), list(rs[0]["ids"])) for d, rs in out.items()} == want
