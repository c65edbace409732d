"""Strong components and reach counts of graphs that no single task can hold.

Components come by forward and backward reach from one pivot a region: what both reach is a component, and what is left falls apart
into regions that no component crosses.  Reach counts run over the acyclic graph of components, level by level from the sinks: a
node's reach is a row of a matrix, kept in blocks of ``COLUMNS`` columns, and only blocks with a column set are rows of a
table.  Everything is joins and unions of sorted rows; a round, or a level, ends in a written table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import algorithms
from latticework.operators.algorithms import broadcast_few, by_size, cut, dense, shared_folder, strong_of_rows, strong_parts

#: Columns of a block, and its bytes with one bit a column; it has two bytes for each column that is set where these are fewer.
COLUMNS = 65_536
DENSE = COLUMNS // 8
#: Columns that one pass over the levels carries: at most 33 kB a node.
PASS_COLUMNS = 262_144
#: Rows of edges that one task unites, and bytes of them at a time.
TASK_EDGES, SLICE = 200_000, 4_000_000
#: How often nodes without an edge in or out are stripped before each choice of pivots.
TRIMS = 3


class Area:
    """Tables of one computation below the shared folder; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_folder(spark)}/latticework/{name}-{uuid.uuid4().hex}"
        self._held: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str, *, by: str | None = None) -> DataFrame:
        path = f"{self.path}/{name}-{len(self._held)}-{uuid.uuid4().hex[:6]}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._held[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if id(df) in self._held:
                self.delete(self._held[id(df)][1])

    def delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _ends(edges: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """``edges`` (origin, target) with ``columns`` of both ends from ``of`` (id, ...), named with 1 and 2; edges without both ends go."""
    for k, end in enumerate(("origin", "target"), 1):
        edges = edges.join(of.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}{k}") for c in columns)), end)
    return edges


def strong_by_pivots(edges: DataFrame, ids: DataFrame, *, rounds: int = 64, area: Area | None = None) -> DataFrame:
    """(id, component) of the strong components over ``edges`` (origin, target): a component's name is its least id.

    A region's pivot is the node with most edges in times out, so a giant component goes in the first round; its forward and
    backward reach go together, breadth first.  After ``rounds`` rounds the rest goes by colouring.
    """
    area = area or Area(edges.sparkSession, "pivots")
    left = area.write(ids.select("id", F.lit(0).cast("long").alias("region")).distinct(), "left")
    live = area.write(edges.select("origin", "target").where("origin <> target").distinct(), "live")
    done: list[DataFrame] = []
    for _ in range(rounds):
        for _ in range(TRIMS):
            inner = live.select(F.col("origin").alias("id")).intersect(live.select(F.col("target").alias("id")))
            single = area.write(left.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")), "single")
            if not single.limit(1).count():
                break
            done.append(single)
            old = left, live
            left = area.write(left.join(single, "id", "left_anti"), "left")
            live = area.write(_ends(live, left).select("origin", "target"), "live")
            area.drop(*old)
        if not left.limit(1).count():
            break
        marks = _marked(area, live, left)
        both = F.col("f") & F.col("b")
        found = marks.where(both)
        least = found.groupBy("region").agg(F.min("id").alias("component"))
        done.append(area.write(found.join(least, "region").select("id", "component"), "found"))
        old = left, live
        left = area.write(marks.where(~both).select("id", F.xxhash64("region", "f", "b").alias("region")), "left")
        live = area.write(_ends(live, left, "region").where("region1 = region2").select("origin", "target"), "live")
        area.drop(*old, marks)
    else:
        from latticework.operators.algorithms import _coloured

        done.append(_coloured(live, left.select("id")))
    return reduce(DataFrame.unionByName, done) if done else left.select("id", F.col("id").alias("component"))


def _marked(area: Area, live: DataFrame, left: DataFrame) -> DataFrame:
    """``left`` (id, region) with ``f`` and ``b``: whether the region's pivot reaches a node, and whether it is reached."""
    degree = lambda end, name: live.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(name))
    weight = F.coalesce("outs", F.lit(0)) * F.coalesce("ins", F.lit(0))
    ranked = left.join(degree("origin", "outs"), "id", "left").join(degree("target", "ins"), "id", "left").select("id", "region", weight.alias("weight"))
    pivots = ranked.groupBy("region").agg(F.min(F.struct(-F.col("weight"), "id")).alias("first")).select("first.id")
    ways = area.write(live.select(F.lit("f").alias("way"), F.col("origin").alias("at"), F.col("target").alias("id")).unionByName(live.select(F.lit("b").alias("way"), F.col("target").alias("at"), F.col("origin").alias("id"))), "ways")
    seen = frontier = area.write(pivots.select(F.explode(F.array(F.lit("f"), F.lit("b"))).alias("way"), "id"), "seen")
    steps = [seen]
    while True:
        step = frontier.withColumnRenamed("id", "at").join(ways, ["way", "at"]).select("way", "id").distinct()
        frontier = area.write(step.join(seen, ["way", "id"], "left_anti"), "seen")
        steps.append(frontier)
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    said = seen.groupBy("id").agg(F.bool_or(F.col("way") == "f").alias("f"), F.bool_or(F.col("way") == "b").alias("b"))
    no = F.lit(False)
    marks = area.write(left.join(said, "id", "left").select("id", "region", F.coalesce("f", no).alias("f"), F.coalesce("b", no).alias("b")), "marks")
    area.drop(ways, *steps)
    return marks


def strong_by_contraction(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, component) over ``edges`` of numbers (origin, target): a component's name is its least id.

    Nodes are cut into ranges of ids whose inner edges one task holds; what is strong within a range becomes one node, and what
    has no edge in or none out goes.  Ranges grow wider as nodes go, till one task solves the rest; where they find nothing more, what is left goes by
    pivots.
    """
    area = Area(edges.sparkSession, "contracted")
    live = area.write(edges.select("origin", "target").where("origin <> target").distinct(), "live")
    named = area.write(ids.select("id", F.col("id").alias("component")).distinct(), "named")
    while True:
        old = live
        live = live.join(live.select(F.col("target").alias("origin")).distinct(), "origin", "left_semi").join(live.select(F.col("origin").alias("target")).distinct(), "target", "left_semi")
        live = area.write(live.select("origin", "target"), "live")
        area.drop(old)
        n_edges = live.count()
        if not n_edges:
            break
        parts = -(-n_edges * 2 // algorithms.PART_EDGES) if n_edges > algorithms.PART_EDGES else 1
        within = live.withColumn("range", F.lit(0).cast("long"))
        if parts > 1:
            places = dense(live.select(F.explode(F.array("origin", "target")).alias("name")).distinct(), "name")
            n_nodes = places.count()
            place = places.select(F.col("name").alias("id"), F.expr(f"id div {-(-n_nodes // parts)}").alias("range"))
            inner = area.write(_ends(live, place, "range").where("range1 = range2").select("origin", "target", F.col("range1").alias("range")), "inner")
            fits = inner.groupBy("range").count().where(F.col("count") <= algorithms.PART_EDGES).select("range")
            within = inner.join(F.broadcast(fits), "range", "left_semi")  # a row a range
        found = within.groupBy("range").applyInPandas(strong_of_rows, "id long, component long").where("id <> component")
        found = area.write(found.withColumnRenamed("component", "into"), "found")
        n_found = found.count()
        if n_found:
            named, old = area.write(named.join(found.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("into", "component").alias("component")), "named"), named
            area.drop(old)
        if parts == 1:
            break
        if n_found:
            old = live
            for end in ("origin", "target"):
                live = live.join(found.select(F.col("id").alias(end), F.col("into").alias(f"{end}_into")), end, "left").withColumn(end, F.coalesce(f"{end}_into", end)).drop(f"{end}_into")
            live = area.write(live.where("origin <> target").select("origin", "target").distinct(), "live")
            area.drop(old)
        if n_found * 20 < n_nodes:
            rest = live.select(F.explode(F.array("origin", "target")).alias("id")).distinct()
            last = strong_by_pivots(live, rest, area=area).select(F.col("id").alias("component"), F.col("component").alias("into"))
            named = area.write(named.join(last, "component", "left").select("id", F.coalesce("into", "component").alias("component")), "named")
            break
    return named


def topological_levels(edges: DataFrame, ids: DataFrame, *, area: Area | None = None, most: int | None = None) -> tuple[DataFrame, int] | None:
    """((id, level), number of levels) of an acyclic graph: sinks have level 0, all others one more than the highest they lead to.

    With ``most``: None where there are more levels, or a cycle.
    """
    area = area or Area(edges.sparkSession, "levels")
    left = area.write(ids.select("id").distinct(), "left")
    live = edges.select("origin", "target")
    found: list[DataFrame] = []
    while left.limit(1).count():
        if len(found) == most:
            return None
        sinks = area.write(left.join(live.select(F.col("origin").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(len(found))), "level")
        if not sinks.limit(1).count():
            if most is not None:
                return None
            raise ValueError("the graph has a cycle")
        found.append(sinks)
        old = left, live
        left = area.write(left.join(sinks, "id", "left_anti"), "left")
        live = area.write(live.join(sinks.select(F.col("id").alias("target")), "target", "left_anti").select("origin", "target"), "live")
        area.drop(*old)
    return (reduce(DataFrame.unionByName, found) if found else left.withColumn("level", F.lit(0))), len(found)


def _grouped(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each (id, block), group of each row, offsets and bytes of ``bits``) of sorted rows."""
    new = np.ones(batch.num_rows, dtype=bool)
    for c in ("id", "block"):
        values = batch.column(c)
        differs = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
        new[1:] = differs if c == "id" else new[1:] | differs
    bits = batch.column("bits")
    offsets = np.frombuffer(bits.buffers()[1], dtype=np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
    data = np.frombuffer(bits.buffers()[2], dtype=np.uint8) if bits.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
    return np.flatnonzero(new), np.cumsum(new) - 1, offsets, data


def _united_groups(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row (id, block, n, bits) for each (id, block) of sorted rows: the union of their columns, and how many they are."""
    starts, group, offsets, data = _grouped(batch)
    lengths = np.diff(offsets)
    dense = lengths == DENSE
    held = np.repeat(~dense, lengths)
    values = data[offsets[0] : offsets[-1]][held].view("<u2")
    keys = np.repeat(group << 16, np.where(dense, 0, lengths // 2)) | values
    keys.sort()
    keys = keys[np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]))]
    counts = np.bincount(keys >> 16, minlength=len(starts)).astype(np.int64)
    ends = np.cumsum(counts)
    values = (keys & (COLUMNS - 1)).astype("<u2")
    whole = set(group[dense].tolist()) | set(np.flatnonzero(counts * 2 >= DENSE).tolist())
    if whole:
        shown = [values[end - n : end].tobytes() for end, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        for g in whole:
            flags = np.zeros(COLUMNS, dtype=np.uint8)
            flags[values[ends[g] - counts[g] : ends[g]]] = 1
            packed = np.packbits(flags, bitorder="little")
            last = starts[g + 1] if g + 1 < len(starts) else len(group)
            for row in np.flatnonzero(dense[starts[g] : last]) + starts[g]:
                packed |= data[offsets[row] : offsets[row + 1]]
            counts[g] = np.bitwise_count(packed).sum()
            shown[g] = packed.tobytes()
        bits = pa.array(shown, pa.binary())
    else:
        places = np.concatenate((np.zeros(1, dtype=np.int32), (2 * ends).astype(np.int32)))
        bits = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(values.tobytes())])
    first = pa.array(starts)
    return pa.RecordBatch.from_arrays([batch.column("id").take(first), batch.column("block").take(first), pa.array(counts), bits], ["id", "block", "n", "bits"])


def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, block, n, bits): the union of the columns of each (id, block), from rows (id, block, bits) sorted by both.

    Rows are taken SLICE bytes at a time; what the last group has come to goes on as one row.
    """
    rest: pa.RecordBatch | None = None
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("block"), batch.column("bits").cast(pa.binary())], ["id", "block", "bits"])
        size = pc.binary_length(batch.column("bits")).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if low == high:
                continue
            piece = batch.slice(low, high - low)
            if rest is not None:
                piece = pa.concat_batches([rest.select(["id", "block", "bits"]), piece])
            found = _united_groups(piece)
            if found.num_rows > 1:
                yield found.slice(0, found.num_rows - 1)
            rest = found.slice(found.num_rows - 1)
    if rest is not None:
        yield rest


def _without_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in unite(batches):
        yield batch.select(["id", "block", "n"])


def _united(rows: DataFrame, n_edges: int, *, bits: bool = True) -> DataFrame:
    """``unite`` over rows (id, block, bits), in tasks of some TASK_EDGES rows."""
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.select("id", "block", "bits").repartition(-(-n_edges // TASK_EDGES) or 1, "id").sortWithinPartitions("id", "block")
    return dealt.mapInArrow(unite if bits else _without_bits, f"id {kind}, block long, n long" + (", bits binary" if bits else ""))


#: The weight of a row's columns: its block's plane lies above 32 bits.
_WEIGHT = "shiftleft(n, cast(shiftright(block, 32) AS int))"


def reach_by_blocks(edges: DataFrame, sizes: DataFrame, *, pass_columns: int = PASS_COLUMNS, most_levels: int | None = None, most_bytes: int | None = None) -> DataFrame | None:
    """(id, reached): the summed size of what each node (id, size) of an acyclic graph reaches, itself included.

    What a node reaches below itself is a row of a matrix: a union of the columns and the rows of what it leads to, which lie in lower levels.  Its blocks of
    ``COLUMNS`` columns are rows of a table where a column is set: two bytes a column, or a bit for each where that is
    shorter.  ``pass_columns`` of them are carried at a time.  What is shuffled grows with edges times what their targets reach.

    Nodes that nothing leads to come last, all at once, and leave counts only.  What only they lead to needs no column: its size is counted an
    edge.  Sizes are counted by planes: a node has a column for each bit of its size, and a block holds columns of one bit.

    None where the nodes that are led to have more than ``most_levels`` levels, or a cycle, or where rows of theirs come to more
    than ``most_bytes`` an edge.  Edges may come repeatedly.
    """
    spark = edges.sparkSession
    area = Area(spark, "reach")
    edges = edges.select("origin", "target").where("origin <> target")
    led = area.write(edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("ins")), "led")
    inner = F.col("led").isNotNull().alias("inner")
    # A stated number of partitions, which adaptive execution doesn't join to larger ones.
    dealt = edges.repartition(-(-edges.count() // TASK_EDGES) or 1, "origin").join(led.select(F.col("id").alias("origin"), F.lit(True).alias("led")), "origin", "left").select("origin", "target", inner).distinct()
    dealt = area.write(dealt, "dealt", by="inner")
    outer, inner = dealt.where("NOT inner").select("origin", "target"), dealt.where("inner").select("origin", "target")
    levels = topological_levels(inner, led, area=area, most=most_levels)
    if levels is None:
        area.delete(area.path)
        return None
    level, n_levels = levels
    n_edges = dealt.count()
    steps = area.write(inner.join(level.withColumnRenamed("id", "origin"), "origin"), "steps", by="level")
    # Columns are numbered along the levels, so what is reached together shares blocks.
    columns = area.write(inner.select(F.col("target").alias("id")).distinct().join(sizes, "id").join(level, "id"), "columns")
    planes = columns.select(F.col("id").alias("name"), "level", F.explode(F.expr("filter(sequence(0, 62), k -> shiftright(size, k) & 1 = 1)")).alias("plane"))
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    bits = F.unhex(F.concat(two(F.expr("id % 256")), two(F.expr(f"id % {COLUMNS} div 256"))))
    own = dense(planes, "plane", "level", "name").select(F.col("name").alias("target"), F.expr(f"shiftleft(cast(plane AS long), 32) + id div {COLUMNS}").alias("block"), bits.alias("bits"))
    own = area.write(own, "own")
    passes = max(1, -(-columns.count() // pass_columns))
    of_level = dict(steps.groupBy("level").count().collect())  # a row a level
    # What has no column is led to by nodes that nothing leads to.
    plain = outer.join(broadcast_few(columns.select(F.col("id").alias("target"))), "target", "left_anti")
    heavy = area.write(sizes.where("size <> 1").select(F.col("id").alias("target"), "size"), "heavy")
    plain = plain.join(broadcast_few(heavy), "target", "left").groupBy(F.col("origin").alias("id")).agg(F.sum(F.coalesce("size", F.lit(1))).alias("reached"))
    counts: list[DataFrame] = [area.write(plain, "counts")]
    bottom = broadcast_few(level.where("level = 0").select(F.col("id").alias("target")))  # nodes without a row
    weight = 0
    for number in range(passes):
        mine = broadcast_few(own.where(F.pmod("block", F.lit(passes)) == number))
        below: list[DataFrame] = []

        def reached(step: DataFrame, mine: DataFrame = mine, below: list[DataFrame] = below) -> DataFrame:
            rows = step.join(mine, "target")
            if below:
                lower = reduce(DataFrame.unionByName, below).select(F.col("id").alias("target"), "block", "bits")
                rows = rows.unionByName(step.join(bottom, "target", "left_anti").join(lower, "target"))
            return rows.select(F.col("origin").alias("id"), "block", "bits")

        for k in range(1, n_levels):
            step = steps.where(F.col("level") == k).select("origin", "target")
            rows = area.write(_united(reached(step), of_level[k]), "rows")
            below.append(rows)
            if most_bytes is not None:
                weight += rows.join(led, "id").agg(F.coalesce(F.sum(F.col("ins") * F.length("bits")), F.lit(0))).first()[0]
                if weight > most_bytes * n_edges:
                    area.delete(area.path)
                    return None
        last = _united(reached(outer), n_edges - sum(of_level.values()), bits=False)
        last = reduce(DataFrame.unionByName, [last, *(rows.select("id", "block", "n") for rows in below)])
        counts.append(area.write(last.groupBy("id").agg(F.sum(F.expr(_WEIGHT)).alias("reached")), "counts"))
        area.drop(*below)
    total = reduce(DataFrame.unionByName, counts).groupBy("id").agg(F.sum("reached").alias("below"))
    found = cut(sizes.join(total, "id", "left").select("id", (F.col("size") + F.coalesce("below", F.lit(0))).alias("reached")), "reached")
    area.delete(area.path)
    return found


def _reach_of_range(rows: pd.DataFrame) -> pd.DataFrame:
    """(id, reached) within one range of columns of an acyclic graph (origin, target, size, first, width): nodes are edges to themselves, with their size."""
    codes, names = pd.factorize(pd.concat([rows["origin"], rows["target"]], ignore_index=True))
    origins, targets = codes[: len(rows)].tolist(), codes[len(rows) :].tolist()
    successors: list[list[int]] = [[] for _ in names]
    size = [0] * len(names)
    for o, t, s in zip(origins, targets, rows["size"].tolist(), strict=True):
        if o == t:
            size[o] = s
        else:
            successors[o].append(t)
    first, width = int(rows["first"].iloc[0]), int(rows["width"].iloc[0])
    order = [v for part in strong_parts(successors) for v in part]  # each after all that it leads to
    planes: dict[int, int] = {}
    for k, v in enumerate(order[first : first + width]):
        for bit in range(size[v].bit_length()):
            if size[v] >> bit & 1:
                planes[bit] = planes.get(bit, 0) | 1 << k
    reach = [0] * len(names)
    out: list[tuple[int, int]] = []
    ids = names.tolist()
    for k, v in enumerate(order[first:]):
        bits = 1 << k if k < width else 0
        for w in successors[v]:
            bits |= reach[w]
        reach[v] = bits
        if bits:
            out.append((ids[v], sum((bits & plane).bit_count() << bit for bit, plane in planes.items())))
    return pd.DataFrame(out, columns=["id", "reached"])


def reach_by_ranges(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, reached) as ``reach_by_blocks`` gives it, of a graph of numbers: weak components that one task holds are counted a range of columns at a time.

    A task holds one component's edges and at most TASK_BITS bits; what is larger goes by blocks.
    """
    area = Area(edges.sparkSession, "ranges")
    small, rest = by_size(edges.select("origin", "target").distinct(), sizes.select("id"), algorithms.PART_NODES)
    nodes = small.where("origin = target").groupBy("part").agg(F.count(F.lit(1)).alias("nodes"))
    nodes = nodes.withColumn("width", F.greatest(F.lit(64), F.expr(f"{algorithms.TASK_BITS} div nodes")))
    ranges = area.write(nodes.withColumn("first", F.explode(F.expr("sequence(0L, nodes - 1, width)"))).drop("nodes"), "ranges")
    rows = small.join(sizes.select(F.col("id").alias("origin"), "size"), "origin").select("part", "origin", "target", "size")
    rows = rows.join(broadcast_few(ranges), "part")
    found = rows.groupBy("part", "first").applyInPandas(_reach_of_range, "id long, reached long")
    found = area.write(found.groupBy("id").agg(F.sum("reached").alias("reached")), "found")
    if rest.limit(1).count():
        large = sizes.join(rest.where("origin = target").select(F.col("origin").alias("id")), "id", "left_semi")
        found = found.unionByName(reach_by_blocks(rest.where("origin <> target").select("origin", "target"), large))
    return found


def reach_in_large(edges: DataFrame, ids: DataFrame, *, by: str = "ranges") -> DataFrame:
    """(id, reached): how many nodes each one reaches, itself included, whatever the graph: components first, then ranges of columns or blocks over levels."""
    area = Area(edges.sparkSession, "large")
    part = area.write(strong_by_pivots(edges, ids, area=area) if by == "blocks" else strong_by_contraction(edges, ids), "strong")
    sizes = area.write(part.groupBy(F.col("component").alias("id")).agg(F.count(F.lit(1)).alias("size")), "sizes")
    if part.where("id <> component").limit(1).count():
        short = _ends(edges.select("origin", "target"), part, "component").where("component1 <> component2")
        short = short.select(F.col("component1").alias("origin"), F.col("component2").alias("target"))
    else:
        short = edges.select("origin", "target").where("origin <> target")
    short = area.write(short.distinct(), "short")
    reach = (reach_by_blocks if by == "blocks" else reach_by_ranges)(short, sizes)
    found = cut(part.join(reach.withColumnRenamed("id", "component"), "component").select("id", "reached"), "reached")
    area.delete(area.path)
    return found
