"""A content-addressed cache of tables: a hit is read, anything else is computed again."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ENVELOPE = "cache-1"


def cache_key(*parts: str) -> str:
    """SHA-256 over the envelope's version and the length-prefixed parts (inputs, their digests, options)."""
    h = hashlib.sha256()
    for p in (ENVELOPE, *parts):
        raw = p.encode()
        h.update(len(raw).to_bytes(4, "big") + raw)
    return h.hexdigest()


def load_or_compute(spark: SparkSession, root: str, key: str, compute: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """(table, HIT or COMPUTED).  A table that is missing or unreadable, or has no success mark, is computed and written anew."""
    path = f"{root}/{key}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        try:
            found = spark.read.parquet(path)
            found.limit(1).count()
            return found, "HIT"
        except Exception:  # a damaged entry heals itself below
            pass
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), "COMPUTED"
