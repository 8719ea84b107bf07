"""Contiguous shards of near equal size in bytes: prefix sums over the whole table, cut at equal targets.

Documents are in the order of their ids. Sizes are summed in ranges of that order, each range's total goes to the ranges after
it (one row for each range), and a document belongs to the shard in whose equal part of the whole sum the middle of the document
lies. A cut is therefore at most half a document away from its target, whatever the sizes are, and every shard is a
contiguous run of the order.

Only ids, sizes and checksums are sorted. The texts are read once into a table whose rows are numbered, and move once more, to
their shard.

Defined results: a null text has no bytes (size 1, checksum 0) and an empty one neither; null ids come first; equal ids
are ordered by size and checksum, and rows equal in all three may change places (shard, slot and size don't depend on that); a document larger than a
shard's target takes the place of several shards, which then are empty; an empty table gives no rows. All other columns are
kept, whatever their names (but for size, text_crc32, shard and slot, which assign() adds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.llm.common import materialise
from kilojoin.llm.prefix import running

ADDED = ["size", "text_crc32", "shard", "slot"]


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one for the end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shard_of(total: int, shards: int) -> Column:
    """The shard of a document of ``size`` that ends at the prefix sum ``until``: where its middle lies among equal parts of the total."""
    return F.expr(f"least((2 * until - size) * {shards}L div {2 * total}L, {shards - 1}L)").cast("int")


def assign(docs: DataFrame, shards: int = 8, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of docs, and size, text_crc32, shard and slot (place in the shard, from 0)."""
    own = docs.select(F.struct("*").alias("doc"), F.col(id_).cast("long").alias("id"), text_size(F.col(text)).alias("size"), text_crc32(F.col(text)).alias("text_crc32"))
    own = materialise(own.withColumn("row", F.monotonically_increasing_id()), "documents")  # rows keep their numbers from here
    placed = places(own.select("id", "size", "text_crc32", "row"), shards)
    return own.select("doc", "row").join(placed.drop("id"), "row").select("doc.*", *ADDED)


def places(sizes: DataFrame, shards: int) -> DataFrame:
    """id, size, text_crc32, row of each document, with its shard and slot."""
    order = [F.asc_nulls_first("id"), "size", "text_crc32", "row"]
    summed = running(sizes.withColumn("one", F.lit(1).cast("long")), [], order, sums={"until": "size", "nth": "one"})
    total = sizes.agg(F.sum("size")).first()[0] or 1
    summed = summed.withColumn("shard", shard_of(total, shards))
    first = summed.groupBy("shard").agg(F.min("nth").alias("first"))  # a row for each shard
    return summed.join(F.broadcast(first), "shard").select("id", "size", "text_crc32", "row", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int = 16, id_: str = "doc_id", text: str = "text") -> None:
    """Writes docs as Parquet below path/shard=N, each shard as up to ``files`` files of consecutive slots."""
    placed = assign(docs, shards, id_, text)
    placed.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def summary(placed: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return placed.select(
        "doc_id", text_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


ORACLE = """
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), n) ORDER BY n) AS of FROM range(256) t(n)),
own AS (SELECT doc_id, row_number() OVER () AS row, coalesce(strlen(text), 0) + 1 AS size,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
summed AS (SELECT doc_id, row, size, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, crc.of[(xor(c, b) & 255) + 1]), 4294967295))::BIGINT AS text_crc32 FROM own, crc),
ends AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32, row) AS until, sum(size) OVER () AS whole FROM summed),
placed AS (SELECT *, least(((2 * until - size) * 8) // (2 * whole), 7)::INT AS shard FROM ends)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY until) - 1 AS slot, NULL::INT AS grown_shard FROM placed
"""
