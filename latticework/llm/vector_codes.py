"""Product codes of vectors by delta-maintained Lloyd rounds.

A vector's components become integers, ``floor(scale * x)``, and the vector is cut into equal parts; each part position has a
codebook, and a vector's code names the nearest entry of each.  Codebooks are trained by Lloyd's rounds that
keep state: the assignments of the last round lie in a table beside the vectors, and so do the running integer sums and
counts of every entry.  A round assigns anew, and only parts whose entry changed send anything: minus their components from the
entry they leave, plus to the one they join, summed in each task before the shuffle.  All of it is integer
arithmetic, so the sums are those of a full recount, whatever the order of tasks.  ``append`` takes further vectors into the
state the same way, by their plus alone.

What passes through the driver has a fixed size: the first vectors, one for each entry, and the sums of all entries.

Edge cases: vectors that are null or empty or hold null or non-finite components are left out, and so are those of another
length than the first vector's (the one with the least vec_id); a length that isn't a multiple of ``parts``, and components beyond
2**24 after scaling, raise ValueError; null vec_ids come last, rows that repeat one are ordered by their components and
coded each by itself; with fewer vectors than entries a codebook has one entry a vector; null labels are one label; further
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import broadcast_if, delete_path, new_area, table, write_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components up to which squared distances, and sums over 2**38 vectors, are exact.
LARGEST = 1 << 24


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has components, all of them finite numbers."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & fine)


def integers(values: np.ndarray, scale: int, largest: int = LARGEST) -> np.ndarray:
    """floor(scale * x), as 32-bit integers."""
    out = np.floor(scale * values.astype(np.float64))
    if out.size and np.abs(out).max() > largest:
        raise ValueError(f"a component is beyond {largest} after scaling")
    return out.astype("<i4")


def matrix(column: pa.Array, scale: int, largest: int = LARGEST) -> np.ndarray:
    """A column of vectors of one length as a matrix of integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat, scale, largest).reshape(len(column), -1)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each part as bytes, squared distance summed over parts) of vectors ``x`` (n, dimension) for ``books`` (parts, entries, width)."""
    n, (parts, _, width) = len(x), books.shape
    cut = x.reshape(n, parts, width).astype(np.float64)
    codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
    for k in range(parts):
        entries = books[k].astype(np.float64)
        far = (entries * entries).sum(axis=1) - 2 * (cut[:, k] @ entries.T)  # whole numbers below 2**53: exact
        codes[:, k] = far.argmin(axis=1)  # the first of equal ones
        error += (far[np.arange(n), codes[:, k]] + (cut[:, k] * cut[:, k]).sum(axis=1)).astype(np.int64)
    return codes, error


@dataclass
class Codes:
    """Trained codebooks (parts, entries, width) with what the next round starts from.

    ``table``: vec_id, label, vector (32-bit integers), code, was (the code before); ``sums``: part, entry, position (-1: the
    count), total.  Both lie below ``area``.
    """

    books: np.ndarray
    table: DataFrame
    sums: DataFrame
    area: str
    scale: int = SCALE
    rounds: int = 0

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _rows(vectors: DataFrame, dimension: int, scale: int) -> DataFrame:
    """(vec_id, label, vector) of the usable vectors of one length; vectors as 32-bit integers."""
    kept = usable(vectors).where(F.size("embedding") == dimension)
    kind = kept.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "label", "vector"])

    return kept.select(F.col("vec_id").cast("long"), "label", "embedding").mapInArrow(run, f"vec_id long, label {kind}, vector binary")


def _assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with ``code`` by ``books``, and their code till now, if any, as ``was``."""
    again = "code" in rows.columns
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(n, -1)
            code = pa.array([c.tobytes() for c in nearest(x, books)[0]], pa.binary())
            was = batch.column(3) if again else pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], code, was], names=["vec_id", "label", "vector", "code", "was"])

    return rows.select("vec_id", "label", "vector", *(["code"] if again else [])).mapInArrow(run, f"vec_id long, label {kind}, vector binary, code binary, was binary")


def _changes(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(part, entry, position, total): what parts whose entry changed add to its sums, and take from those of the entry they leave."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(n, parts, width)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, parts)
            old = [w is not None for w in batch.column(2).to_pylist()]
            was = np.full((n, parts), -1, np.int64)
            was[old] = np.frombuffer(b"".join(w for w in batch.column(2).to_pylist() if w is not None), np.uint8).reshape(-1, parts)
            rows_, places = np.nonzero(code != was)
            moved = np.concatenate([np.ones((len(rows_), 1), np.int64), x[rows_, places]], axis=1)
            np.add.at(sums, (places, code[rows_, places]), moved)
            left = was[rows_, places] >= 0
            np.subtract.at(sums, (places[left], was[rows_, places][left]), moved[left])
        p, e, k = np.nonzero(sums)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(k - 1, pa.int32()), pa.array(sums[p, e, k], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "total"])

    changed = rows.where(~F.col("code").eqNullSafe(F.col("was"))).select("vector", "code", "was")
    return changed.mapInArrow(run, "part int, entry int, position int, total long")


def _added(sums: DataFrame | None, changes: DataFrame, path: str) -> DataFrame:
    both = changes if sums is None else sums.unionByName(changes)
    return write_table(both.groupBy("part", "entry", "position").agg(F.sum("total").alias("total")), path)


def _means(sums: DataFrame, books: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every entry; those without a part stay as in ``books``."""
    parts, entries, width = books.shape
    totals = np.zeros((parts, entries, width + 1), np.int64)
    for r in sums.collect():  # parts * entries * (width + 1) numbers, whatever the number of vectors
        totals[r["part"], r["entry"], r["position"] + 1] = r["total"]
    count = totals[:, :, :1]
    return np.where(count > 0, totals[:, :, 1:] // np.maximum(count, 1), books)


def train(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes | None:
    """Codebooks of ``vectors`` (vec_id, embedding, label) after ``rounds`` rounds; None where no vector is usable.

    Codebooks start as the parts of the vectors with the least vec_ids.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    area = new_area(spark, "codes")
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    leading = usable(vectors).select("vec_id", "embedding").orderBy(*order).first()
    if leading is None:
        return None
    dimension = len(leading["embedding"])
    if dimension % parts:
        raise ValueError(f"{dimension} components cannot be cut into {parts} equal parts")
    first = usable(vectors).where(F.size("embedding") == dimension).select("vec_id", "embedding").orderBy(*order).limit(entries).collect()
    start = integers(np.array([r["embedding"] for r in first], np.float64), scale)
    books = start.reshape(len(first), parts, dimension // parts).transpose(1, 0, 2).astype(np.int64)
    rows = write_table(_rows(vectors, dimension, scale), f"{area}/vectors")
    codes = Codes(books, rows, None, area, scale)
    for _ in range(rounds):
        codes = improve(codes)
    return codes


def improve(codes: Codes) -> Codes:
    """One more round: assign, move the sums by what changed, take the means."""
    spark, k = codes.table.sparkSession, codes.rounds + 1
    rows = write_table(_assigned(codes.table, codes.books), f"{codes.area}/assigned-{k}")
    sums = _added(codes.sums, _changes(rows, codes.books.shape), f"{codes.area}/sums-{k}")
    books = _means(sums, codes.books)
    delete_path(spark, f"{codes.area}/assigned-{k - 1}" if k > 1 else f"{codes.area}/vectors")
    delete_path(spark, f"{codes.area}/sums-{k - 1}")
    return Codes(books, rows, sums, codes.area, codes.scale, k)


def append(codes: Codes, vectors: DataFrame) -> Codes:
    """The state with further ``vectors``, assigned by the codebooks as they are; only their plus is summed.  Call it after a round."""
    parts, _, width = codes.books.shape
    more = write_table(_assigned(_rows(vectors, parts * width, codes.scale), codes.books), f"{codes.area}/more-{codes.rounds}")
    sums = _added(codes.sums, _changes(more, codes.books.shape), f"{codes.area}/sums-more-{codes.rounds}")
    return Codes(codes.books, codes.table.unionByName(more), sums, codes.area, codes.scale, codes.rounds)


def encoded(codes: Codes) -> DataFrame:
    """(vec_id, label, code, error) by the codebooks as they are: ``code`` in hexadecimal digits, two a part."""
    books, kind = codes.books, codes.table.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(batch.num_rows, -1)
            code, error = nearest(x, books)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return codes.table.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decoded(rows: DataFrame, codes: Codes) -> DataFrame:
    """``rows`` (code, ...) with ``vector``: the components that a code stands for, scaled back."""
    books, scale = codes.books, codes.scale
    parts = books.shape[0]

    @F.pandas_udf("array<float>")
    def values(code):
        at = np.array([list(bytes.fromhex(c)) for c in code], np.int64).reshape(-1, parts)
        found = books[np.arange(parts), at].reshape(len(at), -1) / scale
        return type(code)(list(found.astype(np.float32)))

    return rows.withColumn("vector", values("code"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    codes = train(vectors)
    if codes is None:
        return vectors.limit(0).selectExpr("cast(vec_id AS long) AS vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    found = write_table(encoded(codes), f"{codes.area}/codes")
    delete_path(spark, f"{codes.area}/assigned-{codes.rounds}")
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = found.join(broadcast_if(by_label, by_label.count()), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def _assign_sql(name: str, books: str) -> str:
    return f"""{name} AS (SELECT id, vec_id, label, part, v, arg_min(entry, far * 1000 + entry) AS entry, min(far) AS far FROM (
  SELECT p.*, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM p JOIN {books} c ON p.part = c.part) GROUP BY ALL)"""


def _means_sql(name: str, assigned: str, books: str) -> str:
    return f"""{name} AS (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM {books} c LEFT JOIN (SELECT part, entry, list(mean ORDER BY pos) AS v FROM (
  SELECT part, entry, pos, floor(sum(x) / count(*))::BIGINT AS mean FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {assigned}) GROUP BY part, entry, pos) GROUP BY part, entry) m ON m.part = c.part AND m.entry = c.entry)"""


ORACLE_SQL = {
    "op11_vector_codes": f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT id, vec_id, label, part, q[len(q) // 16 * part + 1 : len(q) // 16 * (part + 1)] AS v FROM k, (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, id - 1 AS entry, v FROM p WHERE id <= 64),
{_assign_sql("a0", "c0")}, {_means_sql("c1", "a0", "c0")}, {_assign_sql("a1", "c1")}, {_means_sql("c2", "a1", "c1")}, {_assign_sql("a2", "c2")},
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS digest FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM c2)),
e AS (SELECT id, vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a2 GROUP BY id, vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM e, h"""
}
QUERIES = {"op11_vector_codes": op11_vector_codes}
