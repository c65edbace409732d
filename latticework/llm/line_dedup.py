"""Line dedup with sharded cuckoo filters over exact reference counts.

The index keeps three tables in the shared folder, one generation after another: a signed log of
postings (line key, document), the exact reference counts (documents and largest document of each
key), and one cuckoo filter a shard holding the keys whose count has reached ``min_docs``.  Inserting
or deleting documents changes counts of the touched keys only; a key that crosses the bound enters or
leaves its shard's filter, so a deletion undoes an insertion exactly.  Deduplicating probes the
filters first and asks the exact counts only about hits.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased, held as a
128-bit digest.  Edge cases: null or empty text is one empty line; a repeated doc_id counts once as a
document; a null doc_id is one document that sorts below all others; ties cannot occur, since the
largest doc_id keeps its lines (all of them, if it repeats the line); other columns pass unchanged,
save that ``n_lines`` and ``n_dropped`` are the operator's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import WS, new_area, table, write_table

_STRIP = WS.encode()
KEY = ["hi", "lo"]
#: Filters and counts of keys at the bound are broadcast up to these sizes, and met by a shuffle beyond.
BROADCAST_BYTES = 32_000_000
BROADCAST_KEYS = 500_000


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """The digest of a line's key, or None where the key is shorter than ``min_chars`` code points."""
    key = line.strip(_STRIP)
    n = len(key)
    if n < min_chars or n < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    raw = hashlib.blake2b(key.lower(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _raw(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; keys are pairs of 64-bit integers that the exact tables vouch for."""

    def __init__(self, buckets: np.ndarray) -> None:
        self.buckets, self.mask = buckets, len(buckets) - 1

    @classmethod
    def for_items(cls, n: int) -> CuckooFilter:
        size = 1 << max(4, int(np.ceil(np.log2(max(n, 1) / 4 / 0.6))))
        return cls(np.zeros((size, 4), np.uint16))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, 4).copy())

    def to_bytes(self) -> bytes:
        return self.buckets.tobytes()

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = ((hi.view(np.uint64) >> np.uint64(48)).astype(np.uint16)) | np.uint16(1)
        one = (lo.view(np.uint64) & np.uint64(self.mask)).astype(np.int64)
        return fp, one, one ^ self._jump(fp)

    def _jump(self, fp: np.ndarray) -> np.ndarray:
        return ((fp.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(20)).astype(np.int64) & self.mask

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp, one, two = self.places(hi, lo)
        return (self.buckets[one] == fp[:, None]).any(axis=1) | (self.buckets[two] == fp[:, None]).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False where a fingerprint finds no place: the filter must be rebuilt larger."""
        rng = np.random.default_rng(1)
        for fp, one, two in zip(*self.places(hi, lo), strict=True):
            at = one
            for bucket in (one, two):
                free = np.flatnonzero(self.buckets[bucket] == 0)
                if len(free):
                    self.buckets[bucket, free[0]] = fp
                    break
            else:
                for _ in range(500):
                    slot = int(rng.integers(4))
                    fp, self.buckets[at, slot] = self.buckets[at, slot], fp
                    at = int(at ^ self._jump(np.array([fp]))[0])
                    free = np.flatnonzero(self.buckets[at] == 0)
                    if len(free):
                        self.buckets[at, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Only for keys that were inserted."""
        for fp, one, two in zip(*self.places(hi, lo), strict=True):
            for bucket in (one, two):
                held = np.flatnonzero(self.buckets[bucket] == fp)
                if len(held):
                    self.buckets[bucket, held[0]] = 0
                    break


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, hi, lo): each document's distinct line keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, hi, lo = [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for a, b in {line_key(x, min_chars) for x in _raw(text).split(b"\n")} - {None}:
                    doc.append(d)
                    hi.append(a)
                    lo.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, hi, lo)], names=["doc_id", *KEY])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, hi long, lo long")


def _change_filter(left: pa.Table, right: pa.Table, room: int = 2) -> pa.Table:
    """Keys that crossed the bound (shard, hi, lo, up) and the shard's filter -> its filter afterwards; a fresh one has room for ``room`` times its keys."""
    shard = (left if len(left) else right).column("shard")[0].as_py()
    hi, lo = (left.column(k).to_numpy() for k in KEY)
    up = left.column("up").to_numpy(zero_copy_only=False).astype(bool)
    kept = CuckooFilter.from_bytes(right.column("filter")[0].as_py()) if len(right) else CuckooFilter.for_items(room * int(up.sum()))
    kept.delete(hi[~up], lo[~up])
    whole = kept.insert(hi[up], lo[up])
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([kept.to_bytes()], pa.binary()), "whole": pa.array([whole])})


class LineIndex:
    """Reversible line index; see the module's description."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, min_chars: int = 40, min_docs: int = 5, keys_per_shard: int = 20_000) -> None:
        self.spark, self.path = spark, path or new_area(spark, "lines")
        self.min_chars, self.min_docs, self.keys_per_shard = min_chars, min_docs, keys_per_shard
        self.generation, self.shards = 0, 0
        self.log: DataFrame | None = None
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None

    def postings(self) -> DataFrame:
        """The documents' line keys that hold now."""
        return self.log.groupBy("doc_id", *KEY).agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")

    def insert(self, docs: DataFrame) -> None:
        """Adds documents; keys already held for the same doc_id are not counted again."""
        new = line_keys(docs, self.min_chars)
        if self.log is not None:
            held = self.postings().withColumnsRenamed({"doc_id": "held_id", "hi": "held_hi", "lo": "held_lo"})
            on = F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("hi") == F.col("held_hi")) & (F.col("lo") == F.col("held_lo"))
            new = new.join(held, on, "left_anti")
        self._apply(new.distinct().withColumn("sign", F.lit(1)))

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes the documents of column ``doc_id`` out again."""
        gone = doc_ids.select(F.col("doc_id").alias("gone_id")).distinct()
        self._apply(self.postings().join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_semi").withColumn("sign", F.lit(-1)))

    def _apply(self, change: DataFrame) -> None:
        self.generation += 1
        at = f"{self.path}/{self.generation}"
        change = write_table(change.select("doc_id", *KEY, "sign"), f"{at}/log")
        first = self.log is None
        self.log = change if first else self.log.unionByName(change)
        count = (F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_doc"))
        if first:
            counts = change.groupBy(*KEY).agg(*count)
            old = None
        else:
            touched = change.select(*KEY).distinct()
            counts = self.postings().join(touched, KEY, "left_semi").groupBy(*KEY).agg(*count)
            counts = self.counts.join(touched, KEY, "left_anti").unionByName(counts)
            old = self.counts.where(F.col("n") >= self.min_docs).select(*KEY, F.lit(True).alias("was"))
        self.counts = write_table(counts, f"{at}/counts")
        now = self.counts.where(F.col("n") >= self.min_docs).select(*KEY, F.lit(True).alias("is"))
        if first or not self.shards:
            self._rebuild(now, at)
            return
        crossed = now.join(old, KEY, "full").where("is IS NULL OR was IS NULL").select(*KEY, F.col("is").isNotNull().alias("up"))
        filters = self._changed(crossed, self.filters)
        self.filters = write_table(filters, f"{at}/filters")
        if self.filters.where("NOT whole").limit(1).count():
            self._rebuild(now, f"{at}/again")

    def _shard(self):
        return F.pmod(F.xxhash64("hi", "lo"), F.lit(self.shards)).cast("int")

    def _changed(self, crossed: DataFrame, filters: DataFrame, room: int = 2) -> DataFrame:
        def change(left: pa.Table, right: pa.Table) -> pa.Table:
            return _change_filter(left, right, room)

        left = crossed.select(self._shard().alias("shard"), *KEY, "up").groupBy("shard")
        return left.cogroup(filters.groupBy("shard")).applyInArrow(change, "shard int, filter binary, whole boolean")

    def _rebuild(self, now: DataFrame, at: str) -> None:
        """Fresh filters of all keys at the bound, made again at twice the room until every shard holds its keys."""
        self.shards = max(1, -(-now.count() // self.keys_per_shard))
        empty = self.spark.createDataFrame([], "shard int, filter binary, whole boolean")
        up, room = now.select(*KEY, F.lit(True).alias("up")), 2
        while True:
            self.filters = write_table(self._changed(up, empty, room), f"{at}/filters-{room}")
            if not self.filters.where("NOT whole").limit(1).count():
                return
            room *= 2

    def frequent(self) -> DataFrame:
        """The exact counts of the keys at the bound."""
        return self.counts.where(F.col("n") >= self.min_docs)

    def dedup(self, docs: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
        """``docs`` with the frequent keys' lines dropped outside the largest document, and ``n_lines``, ``n_dropped``."""
        size = self.filters.agg(F.sum(F.length("filter")), F.count(F.lit(1))).first()
        n_keys = self.frequent().count()
        docs = docs.drop("n_lines", "n_dropped").withColumn("doc_id", F.col("doc_id").cast("long"))
        if n_keys <= broadcast_keys and (size[0] or 0) <= broadcast_bytes:
            return self._dedup_here(docs)
        return self._dedup_apart(docs)

    def _dedup_here(self, docs: DataFrame) -> DataFrame:
        """Filters and exact counts, both of checked size, go to the tasks: one pass, no shuffle."""
        filters = {r["shard"]: r["filter"] for r in self.filters.select("shard", "filter").collect()}
        exact = self.frequent().select(*KEY, "last_doc").toArrow()
        rows = {(a, b): c for a, b, c in zip(*(exact.column(k).to_pylist() for k in (*KEY, "last_doc")), strict=True)}
        shared = self.spark.sparkContext.broadcast((filters, rows))

        def rule() -> tuple[CuckooShards, dict]:
            return CuckooShards(shared.value[0]), shared.value[1]

        return _rewrite(docs, self.min_chars, rule, None)

    def _dedup_apart(self, docs: DataFrame) -> DataFrame:
        """Beyond those sizes: keys meet their shard's filter, then the exact counts, and documents their dropped keys, by shuffles."""

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            hi, lo = (left.column(k).to_numpy() for k in KEY)
            hit = CuckooFilter.from_bytes(right.column("filter")[0].as_py()).contains(hi, lo) if len(right) and len(hi) else np.zeros(len(hi), bool)
            return left.select(KEY).filter(pa.array(hit))

        mine = write_table(line_keys(docs, self.min_chars), new_area(self.spark, "line-keys"))
        distinct = mine.select(*KEY).distinct().withColumn("shard", self._shard())
        maybe = distinct.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(probe, "hi long, lo long")
        dropped = maybe.join(self.frequent(), KEY).select(*KEY, "last_doc")
        drops = mine.join(dropped, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        # Working columns with names that the table hasn't.
        drop_id, drop_keys = (name + "_" * (1 + max((len(c) for c in docs.columns if c.lower().startswith(name)), default=0)) for name in ("drop_id", "drop_keys"))
        packed = drops.groupBy(F.col("doc_id").alias(drop_id)).agg(F.collect_set(F.struct(*KEY)).alias(drop_keys))
        joined = docs.join(packed, F.col("doc_id").eqNullSafe(F.col(drop_id)), "left").drop(drop_id)
        return _rewrite(joined, self.min_chars, None, drop_keys)


class CuckooShards:
    """All shards' filters in one task; a key probes the shard that it belongs to."""

    def __init__(self, filters: dict[int, bytes]) -> None:
        self.filters = [CuckooFilter.from_bytes(raw) for raw in filters.values()]

    def contains(self, keys: list[tuple[int, int]]) -> np.ndarray:
        pairs = np.array(keys, np.int64).reshape(-1, 2)
        hi, lo = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
        found = np.zeros(len(hi), bool)
        for f in self.filters:  # few: their total size is checked before they are sent here
            found |= f.contains(hi, lo)
        return found


def _rewrite(docs: DataFrame, min_chars: int, rule, drop_column: str | None) -> DataFrame:
    names = [c for c in docs.columns if c != drop_column]
    schema = docs.select(names).schema
    fields = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, exact = rule() if rule else (None, {})
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            texts = batch.column(batch.schema.get_field_index("text"))
            split = [_raw(t).split(b"\n") for t in texts]
            keyed = [[line_key(x, min_chars) for x in lines] for lines in split]
            if shards is None:
                drops = [{(k["hi"], k["lo"]) for k in keys or ()} for keys in batch.column(batch.schema.get_field_index(drop_column)).to_pylist()]
            else:
                flat = sorted({k for keys in keyed for k in keys if k is not None})
                held = {k for k, maybe in zip(flat, shards.contains(flat), strict=True) if maybe and k in exact}
                drops = [{k for k in keys if k in held and exact[k] != doc} for doc, keys in zip(ids, keyed, strict=True)]
            out, n_lines, n_dropped = [], [], []
            for lines, keys, drop in zip(split, keyed, drops, strict=True):
                kept = [x for x, k in zip(lines, keys, strict=True) if k not in drop] if drop else lines
                out.append(b"\n".join(kept).decode("utf-8", "replace"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [pa.array(out, pa.string()) if name == "text" else batch.column(batch.schema.get_field_index(name)) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return docs.mapInArrow(run, f"{fields}, n_lines long, n_dropped long")


def line_dedup(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Indexes ``docs`` and returns them without their repeated lines (see :class:`LineIndex`)."""
    index = LineIndex(docs.sparkSession, min_chars=min_chars, min_docs=min_docs)
    index.insert(docs)
    return index.dedup(docs)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id <> f.last_doc AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
}
