"""The corpus pipeline: toxic documents go, near copies go, personal data is sanitised, sources are mixed, the rest is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.

Defined results of all stages: a null text counts as the empty text and stays null where it is kept; null and repeated doc_ids
and sources are rows like any other; texts are never cut; further columns are kept as they are, whatever their names (encode
returns its own columns only); an empty table gives an empty table. Each stage says what ties and repeated rows give.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilojoin.llm import bpe, mixing, near, pii, toxicity
from kilojoin.llm.common import materialise, table, texts
from kilojoin.llm.queries import BYTE_RANKS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with significant toxic passages go; the model learns from the labels that it may see.

    Rows of equal text go or stay together; null, empty and wordless texts score 0 and stay; a score of exactly the threshold goes.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), held_out=1, folds=3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a similarity of 0.8 or more) stays, the one with the smallest doc_id.

    A null doc_id comes last; of equal ids and of repeated rows one row stays. Null, empty and wordless texts are copies of each other.
    """
    return near.one_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts; n_chars follows the text.

    No row goes; rows of equal text get equal new texts, and count once as evidence. Texts without such spans stay as they are.
    """
    return pii.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the sources' target weights and shuffled.

    Rows of equal doc_id and text are drawn alike, each with its own columns; a null source is a source of its own.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document, with the digests of ids and decoded bytes.

    One row for each row; a null or empty text has no ids.
    """
    path, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    return docs.select("doc_id", bpe.round_trip_column(F.col("text"), path, pattern, with_ids=True).alias("own")).select("doc_id", "own.*")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The learned and statistical stages can't be stated in SQL; tests/llm holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = texts(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
