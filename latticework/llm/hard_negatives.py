"""Hard negatives by inner product, found over one-dimensional distance keys.

Vectors become integers, ``floor(scale * x)``, and an inner-product search becomes a search by distance: every vector gets one
more component that brings all of them to the largest norm M, and a query gets a zero there, so that
``distance**2 = |q|**2 + M**2 - 2 * score``.  The augmented vectors are stored sorted by (nearest pivot, distance to it), in
blocks of at most ``BLOCK_ROWS`` that know their interval of distances.  By the triangle inequality a block whose
interval is [lo, hi] around pivot p holds nothing nearer to q than ``max(0, lo - d(q, p), d(q, p) - hi)`` and nothing farther than
``d(q, p) + hi``: q searches an annulus.

Anchors go out in tiles.  In each round a tile scans the blocks that are next by their bound, ``WIDTH`` times as many as in the round
before; then the k-th best score of every anchor so far closes its annulus, and the search ends when no block that is left
could hold a better row, or one as good with a smaller vec_id.  What has been found is exact at every size.  Where
distances concentrate (vectors without clusters, in many dimensions) the bounds exclude little, and the search comes to one pass of the
anchors over all blocks.

The pivots are means of a sample of at most ``SAMPLE`` rows, chosen by hash; they decide what is scanned, not what is found.  A
block goes to a tile's tasks by (tile, salt), so neither a tile nor a block is a hot key.

Edge cases: rows without label, and vectors that are null, empty or hold null or non-finite components, take no part, nor do those of
another length than that of the row with the least vec_id; components beyond 2**20 after scaling raise ValueError; rows that
repeat a vec_id are rows of their own, and other rows to each other; a null vec_id is never an anchor and comes last among ties;
a positive with a negative score has no negatives; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.common import delete_path, new_area, table, write_table
from latticework.llm.vector_codes import integers, matrix, usable

SCALE, LARGEST = 256, 1 << 20
#: Rows of a block, anchors of a tile, anchors multiplied at a time.
BLOCK_ROWS, TILE_ROWS, CHUNK = 4_096, 4_096, 256
PIVOTS, SAMPLE = 16, 4_000
#: Blocks a tile scans first, and how many times more in each round that follows.
FIRST, WIDTH = 4, 16
#: Keys over which the blocks of one tile are dealt.
SALTS = 24
_NO_ID = (1 << 63) - 1
_LOW, _HIGH = -(1 << 62), 1 << 62


@dataclass
class Index:
    """Blocks and tiles below ``area``; ``squared`` is M**2."""

    area: str
    blocks: DataFrame
    tiles: DataFrame
    squared: int
    pivots: np.ndarray


def _quantised(rows: DataFrame, dimension: int, scale: int) -> DataFrame:
    """(vec_id, label, anchor, vector, squared): vectors as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(3), scale, LARGEST).reshape(batch.num_rows, dimension)
            squared = (x.astype(np.int64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(squared)], names=["vec_id", "label", "anchor", "vector", "squared"])

    return rows.mapInArrow(run, "vec_id long, label long, anchor boolean, vector binary, squared long")


def choose_pivots(sample: np.ndarray, squared: int, count: int, rounds: int = 8) -> np.ndarray:
    """Means of a sample of augmented vectors: farthest-first seeds, then a few Lloyd rounds."""
    x = np.concatenate([sample, np.sqrt(np.maximum(0, squared - (sample**2).sum(axis=1)))[:, None]], axis=1)
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    pivots = x[chosen]
    for _ in range(rounds):
        near = _distances(x[:, :-1], x[:, -1], pivots).argmin(axis=1)
        for k in range(len(pivots)):
            if (near == k).any():
                pivots[k] = x[near == k].mean(axis=0)
    return pivots


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors, whose further component is ``extra``, to all pivots."""
    square = (x * x).sum(axis=1)[:, None] + (extra * extra)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1])
    return np.sqrt(np.maximum(0, square))


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(n, -1)


def _keyed(rows: DataFrame, squared: int, pivots: np.ndarray) -> DataFrame:
    """``rows`` with their one-dimensional key: nearest pivot and distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(3), batch.num_rows).astype(np.float64)
            far = _distances(x, np.sqrt(np.maximum(0, squared - (x * x).sum(axis=1))), pivots)
            near = far.argmin(axis=1)
            columns = [pa.array(near, pa.int32()), pa.array(far[np.arange(len(x)), near]), *batch.columns[:4]]
            yield pa.RecordBatch.from_arrays(columns, names=["pivot", "distance", "vec_id", "label", "anchor", "vector"])

    return rows.select("vec_id", "label", "anchor", "vector").mapInArrow(run, "pivot int, distance double, vec_id long, label long, anchor boolean, vector binary")


_BLOCK = "block long, pivot int, nearest double, farthest double, n int, ids binary, labels binary, anchors binary, vectors binary"


def _blocks(keyed: DataFrame) -> DataFrame:
    """One row a block: neighbours in the order of (pivot, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        for row in (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if held and (held[0][0] != row[0] or len(held) == BLOCK_ROWS):
                yield _as_block(number, held)
                number, held = number + 1, []
            held.append(row)
        if held:
            yield _as_block(number, held)

    keys = ["pivot", "distance", "vec_id", "place"]
    placed = keyed.withColumn("place", F.monotonically_increasing_id())  # many equal rows are no hot range either
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("place").mapInArrow(run, _BLOCK)


def _as_block(number: int, rows: list[tuple]) -> pa.RecordBatch:
    pivot, distance, ids, labels, anchor, vectors = zip(*rows, strict=True)
    values = [
        number, pivot[0], distance[0], distance[-1], len(rows), np.array([_NO_ID if i is None else i for i in ids], "<i8").tobytes(), np.array(labels, "<i8").tobytes(),
        np.array(anchor, np.uint8).tobytes(), b"".join(vectors),
    ]
    kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])


_TILE = "tile long, n int, blocks binary, places binary, ids binary, labels binary, vectors binary, reach binary, by_pivot array<struct<pivot:int,least:double,most:double>>"


def _tiles(blocks: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The anchors, in tiles: ``reach`` holds their distances to all pivots, ``by_pivot`` the range of these."""

    def tile(number: int, held: list[tuple]) -> pa.RecordBatch:
        blocks_, places, ids, labels, vectors = (np.concatenate(c) for c in zip(*held, strict=True))
        reach = _distances(vectors.astype(np.float64), np.zeros(len(vectors)), pivots)
        ranges = [{"pivot": k, "least": float(reach[:, k].min()), "most": float(reach[:, k].max())} for k in range(len(pivots))]
        values = [number, len(ids), blocks_.tobytes(), places.tobytes(), ids.tobytes(), labels.tobytes(), vectors.tobytes(), reach.tobytes(), ranges]
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.struct([("pivot", pa.int32()), ("least", pa.float64()), ("most", pa.float64())])))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["tile", "n", "blocks", "places", "ids", "labels", "vectors", "reach", "by_pivot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        n = 0
        for block, size, ids, labels, anchors, vectors in (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            at = np.flatnonzero(np.frombuffer(anchors, np.uint8))
            if n and n + len(at) > TILE_ROWS:
                yield tile(number, held)
                number, held, n = number + 1, [], 0
            if len(at):
                held.append((np.full(len(at), block, "<i8"), at.astype("<i4"), np.frombuffer(ids, "<i8")[at], np.frombuffer(labels, "<i8")[at], np.frombuffer(vectors, "<i4").reshape(size, -1)[at]))
                n += len(at)
        if n:
            yield tile(number, held)

    return blocks.select("block", "n", "ids", "labels", "anchors", "vectors").mapInArrow(run, _TILE)


def build(rows: DataFrame, anchors: Column, *, scale: int = SCALE, pivots: int = PIVOTS) -> Index | None:
    """The index over ``rows`` (vec_id, embedding, label); None where no row takes part."""
    spark = rows.sparkSession
    fit = usable(rows).where("label IS NOT NULL")
    leading = fit.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").first()
    if leading is None:
        return None
    dimension = len(leading["embedding"])
    fit = fit.where(F.size("embedding") == dimension).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.coalesce(anchors, F.lit(False)).alias("anchor"), "embedding")
    area = new_area(spark, "negatives")
    plain = write_table(_quantised(fit, dimension, scale), f"{area}/rows")
    squared = plain.agg(F.max("squared")).first()[0]
    sample = plain.select("vector", F.xxhash64("vec_id", "vector").alias("h")).orderBy("h", "vector").limit(SAMPLE).collect()
    centres = choose_pivots(np.array([np.frombuffer(r["vector"], "<i4") for r in sample], np.float64), squared, pivots)
    blocks = write_table(_blocks(_keyed(plain, squared, centres)), f"{area}/blocks")
    tiles = write_table(_tiles(blocks, centres), f"{area}/tiles")
    delete_path(spark, f"{area}/rows")
    return Index(area, blocks, tiles, squared, centres)


def best_of(window: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each window's k highest scores, ties by smaller id, ordered by window."""
    order = np.lexsort((ids, -score, window))
    ranked = window[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
    place = np.arange(len(ranked)) - np.repeat(first, np.diff(np.r_[first, len(ranked)]))
    return order[place < k]


class _Scan:
    """One tile in one task: what its windows have found in the blocks that came by."""

    def __init__(self, index_squared: int, tile: dict, needs: np.ndarray, k: int, same: bool) -> None:
        n = tile["n"]
        read = lambda name, kind: np.frombuffer(tile[name], kind)
        self.blocks, self.places, self.labels = read("blocks", "<i8"), read("places", "<i4"), read("labels", "<i8")
        self.x = read("vectors", "<i4").reshape(n, -1).astype(np.float64)
        self.reach = read("reach", "<f8").reshape(n, -1)
        self.total = (self.x * self.x).sum(axis=1) + index_squared
        self.slack = 1e-9 * self.total + 1e-3
        self.needs, self.k, self.same = needs, k, same
        self.anchor, self.low, self.high = needs[:, 0], needs[:, 4].copy(), needs[:, 3]
        self.window, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def block(self, number: int, pivot: int, nearest: float, farthest: float, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        near = np.maximum(0, np.maximum(nearest - self.reach[:, pivot], self.reach[:, pivot] - farthest))
        most = (self.total - near * near) / 2 + self.slack  # no row of the block scores more, nor less than ``least``
        least = (self.total - (self.reach[:, pivot] + farthest) ** 2) / 2 - self.slack
        open_ = np.flatnonzero((most[self.anchor] >= self.low) & (least[self.anchor] <= self.high))
        x = rows.astype(np.float64).T
        for anchors in np.array_split(np.unique(self.anchor[open_]), max(1, len(open_) // CHUNK)):
            if not len(anchors):
                continue
            scores = (self.x[anchors] @ x).astype(np.int64)  # whole numbers below 2**53: exact
            fits = (self.labels[anchors][:, None] == labels) == self.same
            here = np.flatnonzero(self.blocks[anchors] == number)
            fits[here, self.places[anchors[here]]] = False  # a row isn't its own partner
            mine = open_[np.isin(self.anchor[open_], anchors)]
            for w in np.unique(self.needs[mine, 1]):
                of = mine[self.needs[mine, 1] == w]
                at = np.searchsorted(anchors, self.anchor[of])
                s = scores[at]
                ok = fits[at] & (s >= self.low[of][:, None]) & (s <= self.high[of][:, None])
                if ok.sum() > 8 * self.k * len(of) and s.shape[1] > self.k:
                    s_ok = np.where(ok, s, _LOW)
                    ok &= s >= np.partition(s_ok, -self.k, axis=1)[:, -self.k][:, None]
                row, col = np.nonzero(ok)
                self._take(of[row], s[row, col], ids[col])

    def _take(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(window):
            return
        window, score, ids = np.r_[self.window, window], np.r_[self.score, score], np.r_[self.ids, ids]
        best = best_of(window, score, ids, self.k)
        self.window, self.score, self.ids = window[best], score[best], ids[best]
        full, count = np.unique(self.window, return_counts=True)
        last = np.cumsum(count) - 1
        self.low[full[count == self.k]] = np.maximum(self.low[full[count == self.k]], self.score[last[count == self.k]])

    def rows(self) -> tuple[np.ndarray, ...]:
        return self.anchor[self.window], self.needs[self.window, 1], self.score, self.ids


_FOUND = "tile long, a int, w int, score long, id long"


def _scanned(index: Index, pairs: DataFrame, needs: DataFrame, k: int, same: bool) -> DataFrame:
    """What the pairs' blocks (tile, block, salt) hold for their tiles' windows: at most k rows a window and run of one tile."""
    squared = index.squared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, now = None, None

        def said() -> pa.RecordBatch:
            a, w, score, ids = scan.rows()
            columns = [pa.array(np.full(len(a), now), pa.int64()), pa.array(a, pa.int32()), pa.array(w, pa.int32()), pa.array(score), pa.array(ids)]
            return pa.RecordBatch.from_arrays(columns, names=["tile", "a", "w", "score", "id"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                if row["tile"].as_py() != now:
                    if scan is not None:
                        yield said()
                    now = row["tile"].as_py()
                    tile = {name: row[name].as_py() for name in ("n", "blocks", "places", "labels", "vectors", "reach")}
                    scan = _Scan(squared, tile, np.frombuffer(row["needs"].as_py(), "<i8").reshape(-1, 5), k, same)
                n = row["rows"].as_py()
                scan.block(row["block"].as_py(), row["pivot"].as_py(), row["nearest"].as_py(), row["farthest"].as_py(), np.frombuffer(row["of_ids"].as_py(), "<i8"), np.frombuffer(row["of_labels"].as_py(), "<i8"), np.frombuffer(row["of_vectors"].as_py(), "<i4").reshape(n, -1))
        if scan is not None:
            yield said()

    blocks = index.blocks.select("block", "pivot", "nearest", "farthest", F.col("n").alias("rows"), F.col("ids").alias("of_ids"), F.col("labels").alias("of_labels"), F.col("vectors").alias("of_vectors"))
    tiles = index.tiles.select("tile", "n", "blocks", "places", "labels", "vectors", "reach").join(needs, "tile")
    tiles = tiles.join(pairs.select("tile", "salt").distinct(), "tile")
    return pairs.join(blocks, "block").join(tiles, ["tile", "salt"]).drop("salt").mapInArrow(run, _FOUND)


def _packed_needs(windows: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
    """(tile, a, w, lo, hi, kth): ``kth`` is the least score that still counts."""
    if best is None:
        return windows.withColumn("kth", F.col("lo"))
    full = best.groupBy("tile", "a", "w").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).where(F.col("c") == k).drop("c")
    return windows.join(full, ["tile", "a", "w"], "left").select("tile", "a", "w", "lo", "hi", F.greatest("lo", F.coalesce("s", "lo")).alias("kth"))


def _as_bytes(needs: DataFrame) -> DataFrame:
    """(tile, needs): a tile's windows (a, w, lo, hi, kth) as one matrix of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array([[x["a"], x["w"], x["lo"], x["hi"], x["kth"]] for x in rows], "<i8").tobytes() for rows in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["tile", "needs"])

    listed = needs.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("a", "w", "lo", "hi", "kth"))).alias("rows"))  # at most TILE_ROWS anchors' windows
    return listed.mapInArrow(run, "tile long, needs binary")


def search(index: Index, windows: DataFrame, k: int, *, same: bool, tag: str) -> tuple[DataFrame, int]:
    """((tile, a, w, score, id), pairs scanned): the k best rows of each window (tile, a, w, lo, hi), lo <= score <= hi, of the anchor's label or (``same`` false) of others.

    Round by round: the next blocks by their bound, then windows close up to their k-th best.
    """
    spark = index.blocks.sparkSession
    norms = index.tiles.select("tile", F.posexplode(_norms(F.col("vectors"), F.col("n"))).alias("a", "norm"))
    windows = write_table(windows.join(norms, ["tile", "a"]), f"{index.area}/{tag}-windows")
    catalog = index.blocks.select("block", "pivot", "nearest", "farthest")
    ranges = index.tiles.select("tile", F.explode("by_pivot").alias("r")).select("tile", "r.*")
    best, done, width, scanned = None, None, FIRST, 0
    for number in range(64):
        needs = write_table(_packed_needs(windows.drop("norm"), best, k), f"{index.area}/{tag}-needs-{number}")
        total = F.col("norm") + F.lit(float(index.squared))
        edge = lambda c: F.sqrt(F.greatest(F.lit(0.0), total - 2.0 * F.col(c).cast("double")))
        reach = needs.join(windows.select("tile", "a", "w", "norm"), ["tile", "a", "w"]).groupBy("tile").agg(F.max(edge("kth")).alias("outer"), F.min(edge("hi")).alias("inner"))
        near = F.greatest(F.lit(0.0), F.col("nearest") - F.col("most"), F.col("least") - F.col("farthest"))
        pairs = ranges.join(reach, "tile").join(catalog, "pivot").withColumn("bound", near)
        pairs = pairs.where((F.col("bound") <= F.col("outer") * (1 + 1e-9) + 1e-3) & ((F.col("most") + F.col("farthest")) * (1 + 1e-9) + 1e-3 >= F.col("inner"))).select("tile", "block", "bound")
        if done is not None:
            pairs = pairs.join(done, ["tile", "block"], "left_anti")
        pairs = pairs.withColumn("place", F.row_number().over(Window.partitionBy("tile").orderBy("bound", "block"))).where(F.col("place") <= width)
        pairs = write_table(pairs.select("tile", "block", F.pmod("place", F.lit(SALTS)).alias("salt")), f"{index.area}/{tag}-pairs-{number}")
        count = pairs.count()
        if not count:
            break
        scanned += count
        found = _scanned(index, pairs, _as_bytes(needs), k, same)
        found = found if best is None else best.unionByName(found)
        place = F.row_number().over(Window.partitionBy("tile", "a", "w").orderBy(F.desc("score"), "id"))
        new = write_table(found.withColumn("place", place).where(F.col("place") <= k).drop("place"), f"{index.area}/{tag}-best-{number}")
        if best is not None:
            delete_path(spark, f"{index.area}/{tag}-best-{number - 1}")
        best, width = new, width * WIDTH
        done = pairs.select("tile", "block") if done is None else done.unionByName(pairs.select("tile", "block"))
    return (best if best is not None else spark.createDataFrame([], _FOUND)), scanned


def _norms(vectors: Column, n: Column) -> Column:
    """The squared norms of a tile's vectors."""

    @F.pandas_udf("array<double>")
    def norms(raw, count):
        import pandas as pd

        return pd.Series([(np.frombuffer(r, "<i4").reshape(c, -1).astype(np.float64) ** 2).sum(axis=1) for r, c in zip(raw, count, strict=True)])

    return norms(vectors, n)


def _anchors(index: Index) -> DataFrame:
    """(tile, a, anchor_id)."""

    @F.pandas_udf("array<long>")
    def numbers(raw):
        import pandas as pd

        return pd.Series([np.frombuffer(r, "<i8") for r in raw])

    return index.tiles.select("tile", F.posexplode(numbers("ids")).alias("a", "anchor_id"))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE) -> DataFrame:
    """Hard negatives of the rows (vec_id, embedding, label) that ``anchors`` selects.

    For each anchor's ``positives`` best rows of its label: the ``negatives`` best rows of another label whose score is ``low`` to
    ``high`` percent of the positive's.
    """
    if not 0 <= low <= high:
        raise ValueError("low and high are percentages, low no larger than high")
    spark = rows.sparkSession
    index = build(rows, anchors, scale=scale)
    if index is None:
        return spark.createDataFrame([], RESULT)
    who = write_table(_anchors(index), f"{index.area}/anchors")
    every = who.select("tile", "a", F.lit(0).alias("w"), F.lit(_LOW).alias("lo"), F.lit(_HIGH).alias("hi"))
    near, _ = search(index, every, positives, same=True, tag="positives")
    place = F.row_number().over(Window.partitionBy("tile", "a").orderBy(F.desc("score"), "id"))
    near = write_table(near.select("tile", "a", (place - 1).alias("w"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), f"{index.area}/positives")
    p = F.col("positive_score")
    windows = near.where(p >= 0).select("tile", "a", "w", F.expr(f"({low} * positive_score + 99) div 100").alias("lo"), F.expr(f"({high} * positive_score) div 100").alias("hi")).where("lo <= hi")
    hard, _ = search(index, windows, negatives, same=False, tag="negatives")
    rank = F.row_number().over(Window.partitionBy("tile", "a", "w").orderBy(F.desc("score"), "id"))
    hard = hard.select("tile", "a", "w", rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    out = hard.join(near, ["tile", "a", "w"]).join(who, ["tile", "a"])
    found = write_table(out.select("anchor_id", named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score"), new_area(spark, "hard-negatives"))
    delete_path(spark, index.area)
    return found


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


ORACLE_SQL = {
    "op12_hard_negatives": """WITH k AS (SELECT row_number() OVER () AS id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM k a JOIN k b ON a.id <> b.id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
}
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
