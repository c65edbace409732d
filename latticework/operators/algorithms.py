"""Graph algorithms as iterative DataFrame programs; every round ends in a written table or a checkpoint."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where the session has none and driver and executors are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="latticework-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def cut(df: DataFrame, name: str = "round") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/latticework/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, entries: DataFrame, *, max_rounds: int | None = None) -> DataFrame:
    """(id, depth): what the entries (id) reach over ``edges`` (origin, target), themselves included; breadth first."""
    edges = cut(edges.select("origin", "target").where("origin <> target").distinct(), "edges")
    seen = cut(entries.select("id").distinct().withColumn("depth", F.lit(0)), "seen")
    frontier, depth = seen, 0
    while max_rounds is None or depth < max_rounds:
        depth += 1
        step = frontier.join(edges, frontier["id"] == edges["origin"]).select(F.col("target").alias("id")).distinct()
        step = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if not step.limit(1).count():
            break
        seen, frontier = seen.unionByName(step), step
    return seen


def closure(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(origin, target) of the reflexive transitive closure, by path doubling over what the last round found: rounds grow with the logarithm of the diameter."""
    ids = edges.select(F.col("origin").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    ids = (ids if nodes is None else ids.unionByName(nodes.select("id"))).distinct()
    now = new = cut(edges.select("origin", "target").where("origin <> target").distinct(), "closure")
    while new.limit(1).count():
        # A shortest path of more than k edges begins with one of exactly k, and those are among the last round's.
        right = now.select(F.col("origin").alias("middle"), F.col("target").alias("end"))
        step = new.join(right, new["target"] == right["middle"]).select("origin", F.col("end").alias("target")).where("origin <> target").distinct()
        new = cut(step.join(now, ["origin", "target"], "left_anti"), "closure")
        now = now.unionByName(new)
    return now.unionByName(ids.select(F.col("id").alias("origin"), F.col("id").alias("target")))


def weak_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) of undirected components: every node learns the least id it is joined to.

    Alternating star contraction: in each round a node's larger neighbours, then its smaller ones, are hung on its least
    neighbour.  Every step aggregates minima before a join with one row an id, so a giant component is no hot key.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("big"), F.least(x, y).alias("small"))
    now = cut(edges.where("origin <> target").select(*pair("origin", "target")).distinct(), "stars")
    seen = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        sides = now.select(F.col("big").alias("at"), F.col("small").alias("near")).unionByName(now.select(F.col("small").alias("at"), F.col("big").alias("near")))
        least = sides.groupBy("at").agg(F.min("near").alias("low")).select("at", F.least("at", "low").alias("low"))
        hung = sides.join(least, "at").where("near > at").select(F.col("near").alias("at"), F.col("low").alias("near")).distinct()
        least = hung.groupBy("at").agg(F.min("near").alias("low"))
        moved = hung.join(least, "at").where("near <> low").select(*pair("near", "low")).unionByName(least.select(*pair("at", "low")))
        now = cut(moved.where("big <> small").distinct(), "stars")
    found = now.groupBy(F.col("big").alias("id")).agg(F.min("small").alias("component"))
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: Edges and nodes up to which one task solves a part: some hundred MB, in numbers and not in names.  Larger ones are solved by joins.
PART_EDGES, PART_NODES = 2_000_000, 1_000_000
#: Bits of reach that one task holds (200 MB), and edges of small parts that share a task.
TASK_BITS, SHARED_EDGES = 1_600_000_000, 100_000


def strong_parts(successors: list[list[int]]) -> list[list[int]]:
    """The strongly connected components of nodes 0, 1, ..; each comes after all that it leads to."""
    order, low, state = [-1] * len(successors), [0] * len(successors), [0] * len(successors)  # state 1: on the stack, 2: done
    parts: list[list[int]] = []
    pile: list[int] = []
    clock = 0
    for root in range(len(successors)):
        todo = [(root, 0)] if order[root] < 0 else []
        while todo:
            v, k = todo.pop()
            if not k:
                order[v] = low[v] = clock
                clock += 1
                pile.append(v)
                state[v] = 1
            else:
                low[v] = min(low[v], low[successors[v][k - 1]]) if state[successors[v][k - 1]] == 1 else low[v]
            while k < len(successors[v]):
                w = successors[v][k]
                k += 1
                if order[w] < 0:
                    todo += [(v, k), (w, 0)]
                    break
                if state[w] == 1:
                    low[v] = min(low[v], order[w])
            else:
                if low[v] == order[v]:
                    cut_at = len(pile) - 1
                    while pile[cut_at] != v:
                        cut_at -= 1
                    parts.append(pile[cut_at:])
                    del pile[cut_at:]
                    for w in parts[-1]:
                        state[w] = 2
    return parts


def _part_graph(rows: pd.DataFrame) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """(ids, successors, strong parts) of edges (origin, target); an edge to itself only names its node."""
    codes, names = pd.factorize(pd.concat([rows["origin"], rows["target"]], ignore_index=True))
    successors: list[list[int]] = [[] for _ in names]
    for o, t in zip(codes[: len(rows)].tolist(), codes[len(rows) :].tolist(), strict=True):
        if o != t:
            successors[o].append(t)
    return names.tolist(), successors, strong_parts(successors)


def strong_of_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """(id, component) of the strong components over edges (origin, target): a component's name is its least id."""
    names, _, parts = _part_graph(rows)
    out = [(names[v], least) for part in parts for least in [min(names[v] for v in part)] for v in part]
    return pd.DataFrame(out, columns=["id", "component"])


def _reach_of_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """How many nodes each one reaches: bit sets over the strong parts of one weak component after another."""
    out: list[tuple[int, int]] = []
    for _, part in rows.groupby("part", sort=False):
        names, successors, strong = _part_graph(part)
        of = {v: k for k, members in enumerate(strong) for v in members}
        planes: dict[int, int] = {}  # the strong parts whose size has a bit set, by bit
        for k, members in enumerate(strong):
            for bit in range(len(members).bit_length()):
                if len(members) >> bit & 1:
                    planes[bit] = planes.get(bit, 0) | 1 << k
        reach: list[int] = []
        for k, members in enumerate(strong):
            bits = 1 << k
            for j in {of[w] for v in members for w in successors[v]} - {k}:
                bits |= reach[j]
            reach.append(bits)
            n = sum((bits & plane).bit_count() << bit for bit, plane in planes.items())
            out += [(names[v], n) for v in members]
    return pd.DataFrame(out, columns=["id", "reached"])


def _numbered(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct edges of numbers, (id) of all numbers, (name, id)): numbers 0, 1, .. in the order of the names.

    What edges are made from may be costly, so it is read once.  All that follows moves numbers, and the least number of a
    component is its least name.
    """
    edges = cut(edges.select("origin", "target").distinct(), "edges")
    names = edges.select(F.explode(F.array("origin", "target")).alias("name")).unionByName(nodes.select(F.col("id").alias("name"))).distinct()
    names = dense(names, "name")
    for end in ("origin", "target"):
        edges = edges.join(names.select(F.col("name").alias(end), F.col("id").alias(f"{end}_id")), end).drop(end)
    return cut(edges.select(F.col("origin_id").alias("origin"), F.col("target_id").alias("target")), "edges"), names.select("id"), names


def dense(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` in a table, with ``id``: their places 0, 1, .. in the order of ``by``."""
    rows = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "places")
    part = F.shiftright("at", 33).alias("part")
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy(part).count().collect())  # a row a partition
    before = [(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes]
    starts = rows.sparkSession.createDataFrame(before, "part long, start long")
    rows = rows.withColumn("part", part).join(F.broadcast(starts), "part")
    return cut(rows.withColumn("id", F.expr("start + (at & 8589934591)")).drop("part", "start", "at"), "numbers")


def by_size(edges: DataFrame, ids: DataFrame, most_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(rows of weak components for one task each with ``bucket``, (part, n, nodes) of the larger ones with ``rows`` of theirs).

    A node comes as an edge to itself, so every node has a row (part, origin, target).
    """
    weak = cut(weak_components(edges, ids), "weak")
    rows = edges.where("origin <> target").unionByName(ids.select(F.col("id").alias("origin"), F.col("id").alias("target")))
    rows = cut(rows.join(weak.select(F.col("id").alias("origin"), F.col("component").alias("part")), "origin"), "parts")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("origin") == F.col("target")).alias("nodes"))
    big = cut(sizes.where(F.col("n") > min(SHARED_EDGES, PART_EDGES)).withColumn("large", (F.col("n") > PART_EDGES) | (F.col("nodes") > most_nodes)), "big")
    buckets = max(32, rows.count() // SHARED_EDGES)
    # Small ones share a task; each of the others has one of its own.
    shared = -1 - F.pmod(F.xxhash64("part"), F.lit(buckets))
    rows = rows.join(broadcast_few(big.select("part", "large")), "part", "left").withColumn("bucket", F.when(F.col("large").isNull(), shared).otherwise(F.col("part")))
    return rows.where("NOT coalesce(large, false)").drop("large"), rows.where("large").drop("large", "bucket")


def broadcast_few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows are few; else a shuffle join is left to Spark."""
    return F.broadcast(df) if df.count() <= most else df


def _strong(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, component) by weak components of a bounded size, one task each; the larger ones are contracted first."""
    from latticework.operators.condense import strong_by_contraction

    small, rest = by_size(edges, ids, PART_NODES)
    found = small.groupBy("bucket").applyInPandas(strong_of_rows, "id long, component long")
    if rest.limit(1).count():
        found = found.unionByName(strong_by_contraction(rest.select("origin", "target"), rest.where("origin = target").select(F.col("origin").alias("id"))))
    return cut(found, "strong")


def strongly_connected(edges: DataFrame, nodes: DataFrame, *, by: str = "parts") -> DataFrame:
    """(id, component, size, cyclic): a component's name is its least id; cyclic means larger than one, or a self edge.

    by="parts": weak components of a bounded size are solved in one task each, larger ones by contracting what ranges of nodes
    hold, then by pivots.  by="pivots": forward and
    backward reach from a pivot a region, trimmed (``condense``).  by="colouring": trimmed, then the least label spreads forwards and each colour's root is followed backwards within its colour, so memory
    stays in proportion to the edges.  by="closure": nodes that reach each other, off the closure; for small graphs.
    """
    from latticework.operators.condense import strong_by_pivots

    edges, ids, names = _numbered(edges, nodes)
    if by == "closure":
        reach = closure(edges, ids)
        back = reach.select(F.col("target").alias("origin"), F.col("origin").alias("target"))
        found = reach.join(back, ["origin", "target"], "left_semi").groupBy(F.col("origin").alias("id")).agg(F.min("target").alias("component"))
    elif by == "colouring":
        found = _coloured(edges, ids)
    elif by == "pivots":
        found = cut(strong_by_pivots(edges, ids), "strong")
    else:
        found = _strong(edges, ids)
    loops = edges.where("origin = target").select(F.col("origin").alias("id")).distinct().withColumn("loop", F.lit(True))
    sizes = found.join(loops, "id", "left").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.bool_or(F.coalesce("loop", F.lit(False))).alias("loop"))
    sizes = sizes.join(names.select(F.col("id").alias("component"), F.col("name").alias("least")), "component")
    rows = found.join(sizes, "component").join(names, "id")
    return rows.select(F.col("name").alias("id"), F.col("least").alias("component"), "size", (F.col("loop") | (F.col("size") > 1)).alias("cyclic"))


def reach_sizes(edges: DataFrame, nodes: DataFrame, *, by: str = "parts") -> DataFrame:
    """(id, reached): how many nodes each one reaches, itself included; ``by`` as in ``reach_of_numbers``."""
    edges, ids, names = _numbered(edges, nodes)
    return reach_of_numbers(edges, ids, by=by).join(names, "id").select(F.col("name").alias("id"), "reached")


#: Levels up to which an acyclic graph needs no components, and bytes an edge that rows of reach may then come to.
SHALLOW, ROW_BYTES = 8, 1_000


def reach_of_numbers(edges: DataFrame, ids: DataFrame, *, by: str = "parts") -> DataFrame:
    """(id, reached) of a graph of numbers in tables, whose edges may come repeatedly.

    An acyclic graph of few levels is counted over its levels, by blocks of columns.  Else, by="parts": weak components of a
    bounded size are counted in one task each; larger ones over the graph of their strong components, by ranges of its columns in a task
    each where one holds its edges, else by blocks over its levels.  by="blocks": all of them the last way.
    """
    from latticework.operators.condense import reach_by_blocks, reach_in_large

    found = reach_by_blocks(edges, ids.select("id", F.lit(1).cast("long").alias("size")), most_levels=SHALLOW, most_bytes=ROW_BYTES if by == "parts" else None)
    if found is not None:
        return found
    edges = cut(edges.select("origin", "target").distinct(), "edges")
    if by == "blocks":
        return reach_in_large(edges, ids, by="blocks")
    small, rest = by_size(edges, ids, int(TASK_BITS**0.5))
    found = small.groupBy("bucket").applyInPandas(_reach_of_bucket, "id long, reached long")
    if rest.limit(1).count():
        found = found.unionByName(reach_in_large(rest.select("origin", "target"), rest.where("origin = target").select(F.col("origin").alias("id"))))
    return found


def _coloured(edges: DataFrame, ids: DataFrame) -> DataFrame:
    left = cut(ids, "left")
    live = cut(edges.select("origin", "target").where("origin <> target").distinct(), "live")
    done: DataFrame | None = None
    while left.limit(1).count():
        # Trim: a node without an edge in, or without one out, is a component of its own.
        core = live.select(F.col("origin").alias("id")).distinct().intersect(live.select(F.col("target").alias("id")).distinct())
        single = cut(left.join(core, "id", "left_anti").withColumn("component", F.col("id")), "single")
        if single.limit(1).count():
            done = single if done is None else done.unionByName(single)
            left = cut(left.join(single, "id", "left_anti"), "left")
            live = cut(live.join(single.select(F.col("id").alias("origin")), "origin", "left_anti").join(single.select(F.col("id").alias("target")), "target", "left_anti").select("origin", "target"), "live")
            continue
        colours = cut(left.withColumn("colour", F.col("id")), "colours")
        while True:
            sent = live.join(colours, live["origin"] == colours["id"]).groupBy(F.col("target").alias("to")).agg(F.min("colour").alias("sent"))
            step = cut(colours.join(sent, colours["id"] == sent["to"], "left").select("id", F.least("colour", F.coalesce("sent", "colour")).alias("colour")), "colours")
            same = not step.join(colours.withColumnRenamed("colour", "was"), "id").where("colour <> was").limit(1).count()
            colours = step
            if same:
                break
        inner = live.join(colours.select(F.col("id").alias("origin"), F.col("colour").alias("c1")), "origin").join(colours.select(F.col("id").alias("target"), F.col("colour").alias("c2")), "target").where("c1 = c2")
        backwards = inner.select(F.col("target").alias("origin"), F.col("origin").alias("target"))
        roots = colours.where("id = colour").select("id")
        hit = reachable(backwards, roots).select("id").join(colours, "id").select("id", F.col("colour").alias("component"))
        hit = cut(hit, "hit")
        done = hit if done is None else done.unionByName(hit)
        left = cut(left.join(hit, "id", "left_anti"), "left")
        live = cut(live.join(hit.select(F.col("id").alias("origin")), "origin", "left_anti").join(hit.select(F.col("id").alias("target")), "target", "left_anti").select("origin", "target"), "live")
    return done if done is not None else ids.withColumn("component", F.col("id"))


@dataclass(frozen=True)
class CycleLimits:
    """Budgets of the enumeration: cycles, their length, and edges walked."""

    cycles: int = 100
    length: int = 100
    edges: int = 100_000


def elementary_cycles(adjacency: dict[str, list[str]], limits: CycleLimits) -> tuple[list[tuple[int, list[str]]], bool, int]:
    """(cycles, truncated, edges walked) of one component.

    Each cycle starts at its least node and is found once, by an iterative walk; it comes with the edges walked till then.  A
    walk ends before the edge, or the cycle, that would go beyond its budget.
    """
    found: list[tuple[int, list[str]]] = []
    walked, truncated = 0, False
    for start in sorted(adjacency):
        path, on_path = [start], {start}
        ahead = lambda node: iter([x for x in adjacency.get(node, []) if x >= start])  # noqa: B023, E731
        stack = [ahead(start)]
        while stack:
            nxt = next(stack[-1], None)
            if nxt is None:
                stack.pop()
                on_path.discard(path.pop())
                continue
            if walked >= limits.edges:
                return found, True, walked
            walked += 1
            if nxt == start:
                if len(found) >= limits.cycles:
                    return found, True, walked
                found.append((walked, list(path)))
            elif nxt not in on_path:
                if len(path) >= limits.length:
                    truncated = True
                    continue
                path.append(nxt)
                on_path.add(nxt)
                stack.append(ahead(nxt))
    return found, truncated, walked


def first_cycle(adjacency: dict[str, list[str]], limits: CycleLimits | None = None) -> list[str] | None:
    """The first cycle that ``elementary_cycles`` finds in a component; its walk goes into no dead end.

    Where a short walk has not found it, each step takes the least node that still leads back to the start around the path.  Only
    where that path grows beyond its limit, all ways are walked.
    """
    limits = limits or CycleLimits()
    found = elementary_cycles(adjacency, CycleLimits(1, limits.length, min(1_000, limits.edges)))[0]
    if found:
        return found[0][1]
    into: dict[str, list[str]] = {}
    for o, targets in adjacency.items():
        for t in targets:
            into.setdefault(t, []).append(o)
    for start in sorted(adjacency):
        path, on_path = [start], {start}
        while len(path) <= limits.length:
            back, todo = {start}, [start]
            while todo:
                for x in into.get(todo.pop(), []):
                    if x >= start and x not in on_path and x not in back:
                        back.add(x)
                        todo.append(x)
            nxt = next((x for x in adjacency.get(path[-1], []) if x in back), None)
            if nxt == start:
                return path
            if nxt is None:
                break  # no cycle begins here
            path.append(nxt)
            on_path.add(nxt)
        else:
            found = elementary_cycles(adjacency, CycleLimits(1, limits.length, limits.edges))[0]
            return found[0][1] if found else None
    return None


def _inner(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(component, origin, target): the distinct edges within each component (id, component)."""
    inner = edges.select("origin", "target").distinct()
    inner = inner.join(part.select(F.col("id").alias("origin"), F.col("component").alias("c1")), "origin").join(part.select(F.col("id").alias("target"), F.col("component").alias("c2")), "target")
    return inner.where("c1 = c2").select(F.col("c1").alias("component"), "origin", "target")


def _walks(edges: DataFrame, part: DataFrame, limits: CycleLimits) -> DataFrame:
    """(component, cycle, at, truncated, walked): each component (id, component) walked with a budget of its own; one row without a cycle where none is found.

    The order in which a budget runs out is part of the result, so one task walks one component.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        adjacency: dict[str, list[str]] = {}
        for o, t in sorted(zip(rows["origin"], rows["target"], strict=True)):
            adjacency.setdefault(o, []).append(t)
        found, truncated, walked = elementary_cycles(adjacency, limits)
        name = rows["component"].iloc[0]
        out = [(name, c, at, truncated, walked) for at, c in found] or [(name, None, None, truncated, walked)]
        return pd.DataFrame(out, columns=["component", "cycle", "at", "truncated", "walked"])

    return _inner(edges, part).groupBy("component").applyInPandas(walk, "component string, cycle array<string>, at long, truncated boolean, walked long")


def representative_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, closed_path): the first cycle of every cyclic component.  A task walks its components in one sorted stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for batch in batches for r in zip(batch["component"], batch["origin"], batch["target"], strict=True))
        out: list[tuple[str, list[str]]] = []
        for name, part in groupby(rows, key=itemgetter(0)):
            adjacency: dict[str, list[str]] = {}
            for _, o, t in part:
                adjacency.setdefault(o, []).append(t)
            cycle = first_cycle(adjacency)
            if cycle:
                out.append((name, [*cycle, cycle[0]]))
            if len(out) >= 1_000:
                yield pd.DataFrame(out, columns=["component", "closed_path"])
                out = []
        yield pd.DataFrame(out, columns=["component", "closed_path"])

    inner = _inner(edges, components.where("cyclic")).repartition("component").sortWithinPartitions("component", "origin", "target")
    return inner.mapInPandas(run, "component string, closed_path array<string>")


def cycles(edges: DataFrame, components: DataFrame, limits: CycleLimits | None = None) -> DataFrame:
    """(component, cycle, closed_path, length, truncated, walked): the cycles of all components within one budget.

    Components are walked in the order of their names; when the budget of cycles or edges is spent, the walk ends for all that
    follow.  ``truncated`` and ``walked`` are those of the whole enumeration, on every row.  Each component is walked by
    itself; what the ones before it have spent is a running sum over at most as many components as the budget can pay for: one
    that yields no cycle walks more edges than a cycle may be long.
    """
    limits = limits or CycleLimits()
    cyclic = components.where("cyclic")
    most = limits.cycles + limits.edges // max(1, limits.length) + 2
    first = cyclic.select("component").distinct().orderBy("component").limit(most)
    walked = cut(_walks(edges, cyclic.join(F.broadcast(first), "component", "left_semi"), limits), "walks")
    each = walked.groupBy("component").agg(F.count("cycle").alias("n"), F.max("walked").alias("w"), F.bool_or("truncated").alias("cut_short"))
    before = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("component", "n", "w", "cut_short", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "nw"))
    spent = (F.col("n0") + F.col("n") > limits.cycles) | (F.col("w0") + F.col("w") > limits.edges)
    place = F.row_number().over(Window.partitionBy("component").orderBy("at"))
    rows = walked.where("cycle IS NOT NULL").select("component", "cycle", "at", place.alias("k")).join(each.select("component", "n0", "w0"), "component")
    # Where the walk ended: at the first cycle too many, or with the last component.
    stop = rows.where(F.col("n0") + F.col("k") == limits.cycles + 1).select((F.col("w0") + F.col("at")).alias("w"))
    stop = stop.unionByName(each.where((F.col("n0") + F.col("n") == limits.cycles) & (F.col("n") == limits.cycles) & F.col("cut_short")).select((F.col("w0") + F.col("w")).alias("w")))
    total = each.agg(F.max(spent | F.col("cut_short")).alias("truncated"), F.sum("w").alias("all")).join(stop.agg(F.min("w").alias("stop")))  # one row by one row
    total = total.select("truncated", F.least(F.coalesce("stop", "all"), F.lit(limits.edges)).alias("walked"))
    rows = rows.where((F.col("n0") + F.col("k") <= limits.cycles) & (F.col("w0") + F.col("at") <= limits.edges)).join(F.broadcast(total))
    return rows.select("component", "cycle", F.concat("cycle", F.slice("cycle", F.lit(1), F.lit(1))).alias("closed_path"), F.size("cycle").cast("long").alias("length"), "truncated", "walked")


def canonical(cycle):
    """A cycle rotated to begin at its least node."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.when(F.size(cycle) > 0, F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, F.lit(1), at - 1))).otherwise(cycle)


