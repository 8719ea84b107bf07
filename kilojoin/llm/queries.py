"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilojoin.llm import bpe, chat, language, mixing, pii, quality, sharding, simhash, token_store, topk, toxicity, trie, yinyang
from kilojoin.llm.common import table, texts

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(texts(spark, sf_dir), held_out=2, folds=4)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    own = bpe.round_trip_column(F.col("text"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    return docs.select("doc_id", own.alias("own")).select("doc_id", "own.*")


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(texts(spark, sf_dir).select("doc_id", "text")))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), end=2)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(texts(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_column(F.col("code")).alias("fingerprint"), "component_id")


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mixing.replicate(docs)


def op9_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(texts(spark, sf_dir), table(spark, sf_dir, "labels"), held_out=1, folds=3)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.spliced_trie(table(spark, sf_dir, "conversations"))


def op12_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.summary(sharding.assign(texts(spark, sf_dir)))


def op13_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.clusters(texts(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_crf": op1_line_crf,
    "op2_centroid_language": op2_centroid_language,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_disclosure": op4_disclosure,
    "op5_token_shards": op5_token_shards,
    "op6_chat_snapshots": op6_chat_snapshots,
    "op7_simhash": op7_simhash,
    "op8_poisson_mixing": op8_poisson_mixing,
    "op9_bit_sliced": op9_bit_sliced,
    "op10_toxic_segments": op10_toxic_segments,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_byte_shards": op12_byte_shards,
    "op13_yinyang": op13_yinyang,
}

ORACLES: dict[str, str] = {"op6_chat_snapshots": chat.ORACLE, "op8_poisson_mixing": mixing.ORACLE, "op9_bit_sliced": topk.ORACLE, "op11_prefix_trie": trie.ORACLE, "op12_byte_shards": sharding.ORACLE, "op13_yinyang": yinyang.ORACLE}
