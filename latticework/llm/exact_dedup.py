"""Exact dedup by a log-structured merge index.

Memtables (one per task, flushed when full) turn texts into runs sorted by a 64-bit digest.  A merge
step brings a batch of runs into the compacted level: the level keeps one row a digest with the
smallest identifier (longest original text first), and each shard of the level has a Bloom filter,
so digests of a later batch that the filter has not seen skip the lookup.  Digests held by several
rows are hits; their normalised texts are compared byte by byte with the keeper's, and a digest
whose texts differ is split by the full SHA-256.

Defined edge cases: null text counts as empty; empty texts are equal to each other; a null doc_id
loses every tie; repeated rows (same identifier and text) are separate rows of which one stays;
columns beside doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import WS, broadcast_if, new_area, table, write_table

_DELETE = WS.encode()
ENTRY = "doc_id long, row long, run int, digest long, sha binary, n_chars long"
_BEST = pa.struct([("less", pa.int64()), ("no_id", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64())])
LEVEL = "digest long, best struct<less:long,no_id:boolean,doc_id:long,row:long>, n long"


def _memtables(digest_bits: int, memtable_rows: int):
    """Arrow batches of (doc_id, text) -> rows of runs; a run is sorted by digest."""

    def flush(rows: list, run: int) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[2])
        doc, row, digest, sha, n = zip(*rows, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
        columns = (doc, row, [run] * len(rows), digest, sha, n)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "row", "run", "digest", "sha", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, runs, rows = TaskContext.get().partitionId() << 40, 0, []
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for doc, text, n in zip(batch.column(0).to_pylist(), batch.column(1), lengths, strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                sha = hashlib.sha256(raw.translate(None, _DELETE)).digest()
                rows.append((doc, at, int.from_bytes(sha[:8], "big", signed=True) >> (64 - digest_bits), sha, n))
                at += 1
                if len(rows) >= memtable_rows:
                    yield flush(rows, runs)
                    rows, runs = [], runs + 1
        if rows:
            yield flush(rows, runs)

    return run


def digest_runs(docs: DataFrame, *, digest_bits: int = 64, memtable_rows: int = 20_000) -> DataFrame:
    """One row a document, in runs sorted by digest."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_memtables(digest_bits, memtable_rows), ENTRY)


def digested(docs: DataFrame, *, digest_bits: int = 64) -> DataFrame:
    """(digest, doc_id, n_chars, text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [text.as_buffer().to_pybytes() if text.is_valid else b"" for text in batch.column(1)]
            found = [int.from_bytes(hashlib.sha256(x.translate(None, _DELETE)).digest()[:8], "big", signed=True) >> (64 - digest_bits) for x in raw]
            n = pc.cast(pc.fill_null(pc.utf8_length(batch.column(1)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(0), n, batch.column(1)], names=["digest", "doc_id", "n_chars", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "digest long, doc_id long, n_chars long, text string")


def _bloom_positions(digests: np.ndarray, bits: int) -> np.ndarray:
    h = digests.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(4, dtype=np.uint64)) % np.uint64(bits)


def bloom(digests: np.ndarray) -> bytes:
    """A Bloom filter of 10 bits a digest, four probes."""
    bits = max(64, 10 * len(digests))
    bits += -bits % 8
    flags = np.zeros(bits, np.uint8)
    flags[_bloom_positions(digests, bits).ravel().astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def bloom_has(filter_bytes: bytes, digests: np.ndarray) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(filter_bytes, np.uint8))
    return flags[_bloom_positions(digests, len(flags)).astype(np.int64)].all(axis=1)


class LsmIndex:
    """The compacted level, its shard filters, and the merge of further batches of runs."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None, digests_per_shard: int = 200_000) -> None:
        self.spark, self.path = spark, path or new_area(spark, "lsm")
        self.shards, self.digests_per_shard, self.generation = shards, digests_per_shard, 0
        self.level: DataFrame | None = None
        self.filters: DataFrame | None = None

    @staticmethod
    def memtable_level(entries: DataFrame) -> DataFrame:
        """Entries combined by digest: count and best identifier.  Partial aggregation keeps one hot digest to a row a task."""
        best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
        return entries.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))

    def _shard(self):
        return F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int")

    def merge(self, entries: DataFrame) -> None:
        """Brings a batch in and compacts: of each digest the smallest identifier stays."""
        batch = self.memtable_level(entries)
        if self.shards is None:
            self.shards = max(8, -(-entries.count() // self.digests_per_shard))
        if self.level is not None:
            probed = self._probed(batch)
            old = self.level
            met = probed.where("maybe").select("digest", F.col("best").alias("new_best"), F.col("n").alias("new_n"))
            merged = old.join(met, "digest", "full").select(
                "digest",
                F.least("best", "new_best").alias("best"),
                (F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n"),
            )
            batch = merged.unionByName(probed.where(~F.col("maybe")).select("digest", "best", "n"))
        self.generation += 1
        self.level = write_table(batch.sortWithinPartitions("digest"), f"{self.path}/level-{self.generation}")
        self.filters = None

    def build_filters(self) -> DataFrame:
        def build(t: pa.Table) -> pa.Table:
            digests = t.column("digest").to_numpy()
            return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([bloom(digests)], pa.binary())})

        if self.filters is None:
            kept = self.level.select("digest", self._shard().alias("shard"))
            self.filters = write_table(kept.groupBy("shard").applyInArrow(build, "shard int, filter binary"), f"{self.path}/filters-{self.generation}")
        return self.filters

    def _probed(self, batch: DataFrame) -> DataFrame:
        """``batch`` with ``maybe``: false only for digests that the level certainly lacks."""

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            digests = left.column("digest").to_numpy()
            maybe = bloom_has(right.column("filter")[0].as_py(), digests) if len(right) and len(digests) else np.zeros(len(digests), bool)
            return pa.table({"digest": left.column("digest"), "best": left.column("best").cast(_BEST), "n": left.column("n"), "maybe": pa.array(maybe)})

        left = batch.withColumn("shard", self._shard()).groupBy("shard")
        return left.cogroup(self.build_filters().groupBy("shard")).applyInArrow(probe, f"{LEVEL}, maybe boolean")

    def hits(self) -> DataFrame:
        """Digests that several rows share."""
        return self.level.where("n > 1")


#: Rows of a digest from which its texts are dealt over so many salts.
HOT_ROWS, SALTS = 1_000, 32


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, text, keeper's text) whose normalised bytes differ."""
    for batch in batches:
        wrong = [
            d
            for d, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True)
            if (a.as_buffer().to_pybytes() if a.is_valid else b"").translate(None, _DELETE) != (b.as_buffer().to_pybytes() if b.is_valid else b"").translate(None, _DELETE)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.int64())], names=["digest"])


def exact_dedup(docs: DataFrame, *, digest_bits: int = 64, batches: int = 2, memtable_rows: int = 20_000) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256 (see the module for edge cases)."""
    spark = docs.sparkSession
    area = new_area(spark, "exact")
    runs = write_table(digest_runs(docs, digest_bits=digest_bits, memtable_rows=memtable_rows), f"{area}/runs")
    index = LsmIndex(spark, f"{area}/index")
    for k in range(batches):
        index.merge(runs.where(F.pmod(F.shiftright("row", 40) + F.col("run"), F.lit(batches)) == k))
    hits = index.hits().select("digest", "best", "n")
    n_hits = hits.count()
    members = runs.join(broadcast_if(hits, n_hits), "digest")
    n_members = members.count() if n_hits else 0
    # Byte verification of the hits: only their texts move, by their digest, to one text of a row that equals their keeper.
    split = spark.createDataFrame([], "digest long")
    if n_members:
        # A digest of many rows is dealt over salts, its keeper's text to each of them, so that no task gets all its texts.
        hot = F.col("n") > HOT_ROWS
        named = broadcast_if(hits.select("digest", F.col("best.doc_id").alias("keeper"), (-F.col("best.less")).alias("keeper_chars"), hot.alias("hot")), n_hits)
        texts = digested(docs, digest_bits=digest_bits).join(named, "digest").withColumn("salt", F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int"))
        keepers = texts.where(F.col("doc_id").eqNullSafe(F.col("keeper")) & (F.col("n_chars") == F.col("keeper_chars")))
        keepers = keepers.select("digest", "hot", F.col("text").alias("kept_text")).dropDuplicates(["digest"])
        salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        keepers = keepers.select("digest", "kept_text", F.explode(salts).alias("salt"))
        split = write_table(texts.select("digest", "salt", "text").join(keepers, ["digest", "salt"]).select("digest", "text", "kept_text").mapInArrow(_verify, "digest long").distinct(), f"{area}/split")
    n_split = split.count()
    group = F.when(F.lit(False), F.lit(b""))
    keyed = runs
    if n_split:  # different texts under one digest: the full SHA-256 tells them apart
        keyed = runs.join(broadcast_if(split.withColumn("wide", F.lit(True)), n_split), "digest", "left")
        group = F.when(F.col("wide"), F.col("sha"))
        keyed = keyed.withColumn("part", group)
        best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
        hits = keyed.groupBy("digest", "part").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
        n_hits = hits.count()
        hits = broadcast_if(hits.withColumnsRenamed({"digest": "hit", "part": "hit_part"}), n_hits)
        joined = keyed.join(hits, (F.col("digest") == F.col("hit")) & F.col("part").eqNullSafe(F.col("hit_part")), "left")
    else:
        joined = runs.join(broadcast_if(hits.withColumnRenamed("digest", "hit"), n_hits), F.col("digest") == F.col("hit"), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))



QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLE_SQL = {
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
}
