"""Byte-level BPE against tiktoken, token files against the tokenizers library and plain arrays."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kilojoin.llm import bpe, token_store
from kilojoin.llm.queries import BYTE_RANKS, WORD_TOKENIZER

TEXTS = [None, "", " ", "a", "Hello, world! It's 2024.", "naïve ÄÖÜ straße 北京 🙂🙂", "a" * 5000, "ab" * 3000, "\n\n\t  x  \r\n", "<|endoftext|> x", "zz" * 200 + " q", "1234567890" * 40]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(BYTE_RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(codec, text):
    return np.frombuffer(codec.encode([text])[0], "<u4").tolist()


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_ids_equal_the_library(codec, library, text):
    assert ids_of(codec, text) == library.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
def test_any_text_equals_the_library_and_comes_back(codec, library, text):
    ids = codec.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_both_merges_agree(codec):
    rng = random.Random(1)
    for _ in range(60):
        piece = bytes(rng.choice(b"abcdeinrst ") for _ in range(rng.randint(2, 200)))
        assert codec.merge_long(piece) == codec.merge_side_by_side([piece], 256)[0]


def test_query_rows(spark, codec, library):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    from pyspark.sql import functions as F

    own = bpe.round_trip_column(F.col("text"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    for r in df.select("doc_id", "text", own.alias("o")).select("doc_id", "text", "o.*").collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (5, 3), (1000, 49_408), (70_000, 300), (3000, 1 << 20)])
def test_wavelet_matrix_equals_the_array(n, top, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BITS", 1 << 12)
    rng = np.random.default_rng(n)
    x = rng.integers(0, top, n).astype(np.uint32)
    docs = [None, 7, -3][: 3 if n else 0]
    own = token_store.WaveletMatrix.read(token_store.WaveletMatrix.write(x, docs, [5, 0, n][: len(docs)]))
    assert own.documents()[0] == docs and own.documents()[1].tolist() == [5, 0, n][: len(docs)]
    assert own.all().tolist() == x.tolist()
    for at in rng.integers(0, n, 20).tolist() if n else []:
        t = int(x[at])
        where = np.flatnonzero(x == t)
        assert own.access(at) == t and own.count(t) == len(where) and own.count(t, at) == int((where < at).sum())
        k = int((where < at).sum())
        assert own.select(t, np.array([k])).tolist() == [at] and own.select(t, np.arange(len(where))).tolist() == where.tolist()
    assert own.count(1 << 30) == 0
    with pytest.raises(IndexError):
        own.access(n)


def test_bad_file():
    with pytest.raises(ValueError):
        token_store.WaveletMatrix.read(b"nope")


def test_files_hold_what_the_library_says(spark, tmp_path):
    texts = [*TEXTS, "Mixed CASE words, (and) marks!! don't 3.14 x²", "É è ﬁ ß İ"]
    df = spark.createDataFrame([(i * 7 % 100, t, "x", "x", "x") for i, t in enumerate(texts)], "doc_id long, text string, h string, start string, part string")
    path = f"file://{tmp_path}/shards"
    token_store.write_shards(df, public_tokenizers.path(WORD_TOKENIZER), path, shard_tokens=50)
    shards = token_store.read_shards(spark, path)
    assert shards.count() > 2
    got = {r["doc_id"]: r for r in token_store.documents_of(shards).collect()}
    library, start, every = Tokenizer.from_file(public_tokenizers.path(WORD_TOKENIZER)), 0, []
    library.encode_special_tokens = False
    for i, t in sorted((i * 7 % 100, t) for i, t in enumerate(texts)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        every += ids
    token = every[3]
    assert sorted(r["position"] for r in token_store.occurrences(shards, token).collect()) == [i for i, x in enumerate(every) if x == token]


def test_empty_table_has_no_shards(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.store_documents(df, public_tokenizers.path(WORD_TOKENIZER)).count() == 0


def test_repeated_and_null_ids_are_kept(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    rows = token_store.store_documents(df, public_tokenizers.path(WORD_TOKENIZER)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 1), (False, 1), (False, 2), (True, 0)]
    assert sorted(r["start"] for r in rows)[0] == 0


def test_many_rows_of_one_id_are_dealt_out(spark, tmp_path):
    df = spark.createDataFrame([(None if i % 2 else 4, f"word {i}") for i in range(400)], "doc_id long, text string")
    path = f"file://{tmp_path}/one"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write_shards(df, public_tokenizers.path(WORD_TOKENIZER), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = token_store.read_shards(spark, path)
    assert shards.select("part").distinct().count() > 2
    rows = token_store.documents_of(shards).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] * 200 + [4] * 200 and len({r["ids_crc32"] for r in rows}) == 400


def test_a_frequent_id_is_found_quickly():
    import time

    x = np.random.default_rng(1).integers(0, 3, 2_000_000).astype(np.uint32)
    own = token_store.WaveletMatrix.read(token_store.WaveletMatrix.write(x))
    began = time.time()
    assert (own.select(1, np.arange(own.count(1))) == np.flatnonzero(x == 1)).all() and time.time() - began < 20
