"""Packing by non-negative least squares over the histogram of piece lengths.

Every document is tokenized once and cut into windows of ``size`` tokens and one shorter rest.  The
rests' histogram has fewer than ``size`` bins however large the corpus is; only it and the plan pass
through the driver.  Strategies are the shallow combinations (one to three lengths) that fill a window;
their repeat counts solve a non-negative least-squares problem against the histogram, are rounded
down, and what is left is packed greedily, most room first, still by whole multiples.  Each length's pieces
are numbered without gaps from per-task counts, and a piece's number finds its sequence and place in the
plan, so no rows of one length ever meet in one task.

Edge cases: null or empty text is the closing id alone; texts of any length are cut; repeated rows
are packed as separate documents; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import new_area, table, write_table

SIZE = 1024
END_ID = 0
_SPECIAL = "<|endoftext|>"
_encoders: dict[str, object] = {}


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as ``tokenizers`` gives them for the vocabulary file.

    Where the same vocabulary is at hand as ranks, tiktoken computes the same ids several times faster;
    texts that hold a special token's string, or that it refuses, go to ``tokenizers``.
    """

    def __init__(self, path: str, ranks_path: str | None = None) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self):
        """The tokenizers library's own, some 27 MB; read when a text first needs it, for a worker holds it till its end."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _SPECIAL not in text:
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as e:  # its pattern engine gives up on some texts with an exception of its own
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str, ranks_path: str | None) -> Encoder:
    """One per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, ranks_path)
    return _encoders[path]


PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, task int, nth long"


def pieces(docs: DataFrame, *, size: int = SIZE, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Each document's windows of ``size`` tokens and its rest; ``nth`` numbers a task's pieces of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        enc = encoder(public_file(tokenizer), public_file(ranks) if ranks else None)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py() or "") if text.is_valid else np.zeros(0, np.uint32), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    rows.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids), task, int(nth[len(part)])))
                    nth[len(part)] += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def strategies(size: int) -> np.ndarray:
    """All combinations a >= b >= c with a + b + c = size and b, c possibly 0, as rows."""
    found = [(size, 0, 0)]
    found += [(size - b, b, 0) for b in range(1, size // 2 + 1)]
    for c in range(1, size // 3 + 1):
        b = np.arange(c, (size - c) // 2 + 1)
        found += list(zip((size - c - b).tolist(), b.tolist(), [c] * len(b), strict=True))
    return np.array(found, np.int64)


def solve_counts(histogram: np.ndarray, combos: np.ndarray, *, steps: int = 400) -> np.ndarray:
    """min ||A x - histogram||, x >= 0, by accelerated projected gradient; A holds how often a combination uses a length."""
    size = len(histogram) - 1
    goal = histogram.astype(float)
    flat = combos.ravel()

    def apply(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, 3), size + 1)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[combos].sum(axis=1)

    # The largest eigenvalue of A'A, by a few power steps, bounds the step.
    v = np.ones(len(combos))
    top = 1.0
    for _ in range(20):
        w = back(apply(v))
        top = float(np.linalg.norm(w))
        v = w / top
    step = 1 / (1.05 * top)
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(apply(y) - goal))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass
class Plan:
    """For every length, intervals of piece numbers: from ``first`` on, number r lies in sequence ``sequence + (r - first) // times`` at ``offset + (r - first) % times * length``."""

    intervals: dict[int, list[tuple[int, int, int, int]]]
    sequences: int
    padding: int


def make_plan(histogram: np.ndarray) -> Plan:
    """Packs counts of lengths (index = length) into windows of ``len(histogram) - 1``."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    used = np.zeros(size + 1, np.int64)
    intervals: dict[int, list[tuple[int, int, int, int]]] = {}
    sequences = padding = 0

    def take(lengths: dict[int, int], repeat: int) -> None:
        """``repeat`` windows, each with lengths[n] pieces of length n."""
        nonlocal sequences, padding
        offset = 0
        for n, times in lengths.items():
            intervals.setdefault(n, []).append((int(used[n]), sequences, offset, times))
            used[n] += times * repeat
            left[n] -= times * repeat
            offset += n * times
        sequences += repeat
        if offset & (offset - 1):  # a sequence that ends at a power of two needs no padding
            padding += repeat * (size - offset)

    def counted(parts) -> dict[int, int]:
        out: dict[int, int] = {}
        for n in parts:
            out[int(n)] = out.get(int(n), 0) + 1
        return out

    if left[size]:
        take({size: 1}, int(left[size]))
    if left.any():
        combos = strategies(size)[1:]
        combos = combos[((left[combos] > 0) | (combos == 0)).all(axis=1)]
        repeats = np.floor(solve_counts(left, combos) + 1e-9).astype(np.int64) if len(combos) else []
        for parts, repeat in zip(combos, repeats, strict=True):
            lengths = counted(n for n in parts if n)
            repeat = min([int(repeat), *(int(left[n]) // times for n, times in lengths.items())])
            if repeat > 0:
                take(lengths, repeat)
    # What rounding and the least squares left over: the longest piece with the longest that still fit beside it.
    while (there := np.flatnonzero(left)).size:
        lengths, room, stock = {}, size, left.copy()
        while room:
            k = int(np.searchsorted(there, room, "right")) - 1
            while k >= 0 and not stock[there[k]]:
                k -= 1
            if k < 0:
                break
            n = int(there[k])
            times = min(room // n, int(stock[n]))
            lengths[n] = lengths.get(n, 0) + times
            stock[n] -= times
            room -= times * n
        take(lengths, min(int(left[n]) // times for n, times in lengths.items()))
    return Plan(intervals, sequences, padding)


def pack(docs: DataFrame, *, size: int = SIZE, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    area = new_area(spark, "pack")
    cut = write_table(pieces(docs, size=size, tokenizer=tokenizer, ranks=ranks), f"{area}/pieces")
    # Numbers of a length across tasks: what the tasks before hold of it.  A few numbers a task and length, computed by length.
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))

    def first_numbers(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("task").to_numpy())
        n = t.column("n").to_numpy()[order]
        return pa.table({"length": t.column("length"), "task": t.column("task").take(pa.array(order)), "before": pa.array(np.cumsum(n) - n), "n": pa.array(n)})

    before = write_table(by_task.groupBy("length").applyInArrow(first_numbers, "length int, task int, before long, n long"), f"{area}/before")
    histogram = np.zeros(size + 1, np.int64)
    for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(make_plan(histogram).intervals)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {n: [x[0] for x in v] for n, v in plan.value.items()}
        for batch in batches:
            sequence, offset = [], []
            for n, r in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
                first, base, at, times = plan.value[n][bisect_right(firsts[n], r) - 1]
                sequence.append(base + (r - first) // times)
                offset.append(at + (r - first) % times * n)
            columns = [*batch.columns[:2], batch.column(2).cast(pa.int64()), *batch.columns[3:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    numbered = cut.join(before.select("length", "task", "before"), ["length", "task"])
    numbered = numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("r"))
    return numbered.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
