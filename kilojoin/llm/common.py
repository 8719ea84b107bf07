"""Helpers that several operators share: tables, shared storage, text groups, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table may be broadcast if it has at most this many rows, and its texts so many characters; beyond, it is joined by shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 8_000_000
#: A key is hot if more than one row in HOT has it (there can't be as many such keys), and more than WARM rows.
HOT, WARM = 1000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows take long: one that comes in fewer splits than there are cores (a single small file) is dealt out over them."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset and everything runs in one process (tests), a temporary folder takes its place; on a cluster it is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="kilojoin-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise() wrote and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc_class(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fits(df: DataFrame) -> bool:
    """Whether a table's counted rows, and the characters of its text columns, are within the bounds of a broadcast."""
    chars = [F.length(c).cast("long") for c, kind in df.dtypes if kind == "string"]
    size = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"c{i}") for i, x in enumerate(chars)]).first()
    return size[0] <= BROADCAST_ROWS and sum(x or 0 for x in size[1:]) <= BROADCAST_CHARS


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted size is within the bounds; df as it is otherwise, so that a join on it shuffles."""
    return F.broadcast(df) if fits(df) else df


def is_hot(total: int) -> Column:
    """Whether a key is hot; n says how many of all ``total`` rows have it."""
    return F.col("n") > max(WARM, total / HOT)


def owner_join(rows: DataFrame, owners: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with owners, which has one row for each key, and in n the number of rows (of ``total``) that have it.

    Owners of hot keys (less than HOT) go to the rows by a broadcast, all others by a shuffle, so that no task gets a hot key's rows.
    """
    if total <= WARM:
        return rows.join(owners, key)
    hot = owners.where(is_hot(total))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(owners.where(~is_hot(total)), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def groups(texts: Iterable[str], chars: int) -> Iterator[list[str]]:
    """Consecutive texts in lists of about so many characters, one text at least."""
    out: list[str] = []
    size = 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out
