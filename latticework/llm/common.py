"""Shared plumbing of the training-data operators: tables, staging, size-checked broadcasts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the contracts' white-space class ``[\x20\x09-\x0D]``.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where neither the session nor the context has one, and driver and executors are one machine (local tests), is a
    temporary folder set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="latticework-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


#: Rows and bytes of an Arrow batch: with texts of some kilobytes, larger ones cost executors memory and win nothing.
BATCH_ROWS, BATCH_BYTES = 1_000, 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, unless it has smaller ones already."""
    units = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(key).lower())
        if not now or not 0 < int(now[1]) * units.get(now[2], 1 << 40) <= most:
            spark.conf.set(key, str(most))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what is done: its cleaner waits for the driver to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()


def new_area(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    small_batches(spark)
    return f"{shared_root(spark)}/latticework/{tag}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Writes ``df`` as Parquet and returns it reread: lineage ends in a table all executors can read."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, tag: str) -> DataFrame:
    return write_table(df, new_area(df.sparkSession, tag))


def held(df: DataFrame) -> DataFrame:
    """``df`` kept in memory, or on the executors' disks; what a lost executor held is computed again.  For what is read several times and soon freed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a staged table through Hadoop's file system, wherever it lives."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def set_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(``docs`` with the columns called like one of ``names``, which an operator adds, renamed; what gives a result the columns of ``docs``)."""
    taken = {c.lower() for c in docs.columns} | {n.lower() for n in names}
    renamed: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in {n.lower() for n in names}:
            other = f"{c}_0"
            while other.lower() in taken:
                other += "0"
            taken.add(other.lower())
            renamed[c] = other

    def back(result: DataFrame) -> DataFrame:
        return result.select([F.col(f"`{renamed.get(c, c)}`").alias(c) for c in docs.columns])

    return docs.withColumnsRenamed(renamed), back


#: Rows up to which a narrow table (a few numbers a row) may be broadcast: some 50 MB.
BROADCAST_ROWS = 1_000_000


def broadcast_if(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint only where its counted ``rows`` are within ``limit``; else a shuffle join is left to Spark."""
    return F.broadcast(df) if rows <= limit else df


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null identifier counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return (F.crc32(text) % modulus).cast("int")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
