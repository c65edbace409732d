import datetime
import random

import pytest
from pyspark.sql import functions as F

from latticework.operators import algorithms as a
from latticework.operators import baseline, condense
from latticework.operators import metrics as m
from latticework.operators.rules.dependencies import DependencySpec, dependency_rule, layer_rule
from latticework.operators.rules.outcome import FAILED, INCOMPLETE, PASSED, RuleMetadata, top_evidence
from latticework.plans import projection
from latticework.plans.graph import GraphError, build, graph_from, nodes_of

E = "origin string, target string, kind string, location string, bytecode_offset long"


def edges(spark, pairs):
    return spark.createDataFrame([(f"type:{a}", f"type:{b}", "METHOD_CALL", "location:x", i) for i, (a, b) in enumerate(pairs)], E)


def graph(spark, pairs, isolated=()):
    return graph_from(edges(spark, pairs), spark.createDataFrame([(f"type:{x}",) for x in isolated], "stable_key string"))


def test_kernel_merges_evidence_and_keeps_isolated_nodes(spark):
    rows = [("type:a.Api", "type:a.Service", "METHOD_CALL", "location:Z.class", 8), ("type:a.Api", "type:a.Service", "METHOD_CALL", "location:A.class", 3)] * 2
    rows += [("type:a.Api", "type:a.Service", "FIELD_TYPE", "location:Z.class", 8)]
    for order in (rows, rows[::-1]):
        g = graph_from(spark.createDataFrame(order, E), spark.createDataFrame([("type:a.Isolated",)], "stable_key string"))
        found = {r["kind"]: [e["location"] for e in r["evidence"]] for r in g.edges().collect()}
        assert found == {"METHOD_CALL": ["location:A.class", "location:Z.class"], "FIELD_TYPE": ["location:Z.class"]}
        assert sorted(r["stable_key"] for r in g.nodes.collect()) == ["type:a.Api", "type:a.Isolated", "type:a.Service"]


def test_kernel_rejects_unknown_endpoints(spark):
    nodes = nodes_of(spark.createDataFrame([("type:A",)], "stable_key string"))
    with pytest.raises(GraphError):
        build(nodes, edges(spark, [("A", "B")]), check=True)


def test_projection_without_kinds_keeps_nodes_only(spark):
    g, dropped = projection.packages().including_only().apply(graph(spark, [("p.A", "q.B")], ["r.C"]))
    assert g.evidence.count() == 0 and g.nodes.count() == 3
    assert [r["drop_reason"] for r in dropped.collect()] == ["FILTERED_KIND"]


@pytest.mark.parametrize("by", ["closure", "colouring"])
def test_components_and_cycles(spark, by):
    g = graph(spark, [("A", "B"), ("B", "A"), ("B", "C"), ("C", "A"), ("D", "D")], ["I"])
    parts = a.strongly_connected(g.connections(), g.nodes.selectExpr("stable_key AS id"), by=by)
    got = {}
    for r in parts.collect():
        got.setdefault((r["component"], r["cyclic"]), set()).add(r["id"][5:])
    assert got == {("type:A", True): {"A", "B", "C"}, ("type:D", True): {"D"}, ("type:I", False): {"I"}}
    found = sorted(tuple(x[5:] for x in r["closed_path"]) for r in a.cycles(g.connections(), parts).collect())
    assert found == [("A", "B", "A"), ("A", "B", "C", "A"), ("D", "D")]


def test_cycle_budget():
    names = [str(i) for i in range(7)]
    found, truncated, walked = a.elementary_cycles({n: names for n in names}, a.CycleLimits(2, 7, 100))
    assert len(found) == 2 and truncated and walked <= 100


@pytest.mark.parametrize("pairs, isolated, depends, ccd, acd, racd, nccd", [
    ([("A", "B"), ("B", "C"), ("A", "D")], [], {"A": 4, "B": 2, "C": 1, "D": 1}, 8, 2.0, 0.5, 1.0),
    ([("A", "B"), ("B", "A")], ["C"], {"A": 2, "B": 2, "C": 1}, 5, 5 / 3, 5 / 9, 1.0),
])
def test_cumulative(spark, pairs, isolated, depends, ccd, acd, racd, nccd):
    g = graph(spark, pairs, isolated)
    counts = m.reach_counts(g.connections(), g.nodes.selectExpr("stable_key AS subject"))
    assert {r["subject"][5:]: r["depends_on"] for r in counts.collect()} == depends
    r = m.cumulative(counts).first()
    assert (r["ccd"], r["acd"], r["racd"], r["nccd"]) == pytest.approx((ccd, acd, racd, nccd))


def test_cumulative_of_nothing_is_zero(spark):
    assert tuple(m.cumulative(spark.createDataFrame([], "subject string, depends_on long")).first()) == (0, 0, 0.0, 0.0, 0.0)


def test_martin(spark):
    g = graph(spark, [("A", "B"), ("B", "C"), ("D", "B")], ["I"])
    composition = spark.createDataFrame([("type:B", 3, 1)], "subject string, n_types long, n_abstract long")
    rows = {r["subject"][5:]: r for r in m.martin(g.connections(), g.nodes.selectExpr("stable_key AS subject"), composition).collect()}
    b, i = rows["B"], rows["I"]
    assert (b["ca"], b["ce"]) == (2, 1) and (b["instability"], b["abstractness"], b["distance"]) == pytest.approx((1 / 3, 1 / 3, 1 / 3))
    assert (i["ca"], i["ce"], i["instability"], i["abstractness"], i["distance"]) == (0, 0, 0.0, 0.0, 1.0)


def test_cohesion(spark):
    methods = spark.createDataFrame([("T", x) for x in "abcd"], "type string, method string")
    uses = spark.createDataFrame([("T", "a", "x"), ("T", "b", "x"), ("T", "c", "y")], "type string, method string, field string")
    calls = spark.createDataFrame([("T", "c", "d")], "type string, method string, callee string")
    assert m.lcom1(uses, methods).first()["lcom1"] == 4
    assert m.lcom4(uses, methods, calls).first()["lcom4"] == 2
    assert m.lcom_hs(uses, methods, uses).first()["lcom_hs"] == pytest.approx((4 - 1.5) / 3)


def test_source_lines():
    text = 'int a; // x\n\n/* one\n two */ int b;\n/* all */\nString s = """\n  // no comment\n""";\n'
    assert m.line_kinds(text) == (8, 1, 2, 5)
    assert m.line_kinds("") == (0, 0, 0, 0)


def rule(spark, g, mode, origins, targets, known=None, external="IGNORE"):
    ids = lambda names: spark.createDataFrame([(f"type:{n}",) for n in names], "id string")
    k = ids(known) if known is not None else g.nodes.selectExpr("stable_key AS id")
    return dependency_rule(RuleMetadata("r"), g, k, ids(origins), ids(targets), DependencySpec(mode, external=external))


def test_dependency_modes(spark):
    g = graph(spark, [("A", "B"), ("A", "C"), ("A", "A"), ("D", "C")])
    assert rule(spark, g, "NO", ["A"], ["B"]).status() == FAILED
    assert rule(spark, g, "NO", ["D"], ["B"]).status() == PASSED
    assert [r["target"] for r in rule(spark, g, "ONLY", ["A"], ["B"]).violations.collect()] == ["type:C"]
    assert rule(spark, g, "ANY", ["A", "D"], ["B"]).status() == PASSED
    assert [r["origin"] for r in rule(spark, g, "ANY", ["D", "E"], ["B"]).violations.collect()] == ["type:D"]
    assert [r["origin"] for r in rule(spark, g, "REQUIRED", ["A", "D"], ["B"]).violations.collect()] == ["type:D"]


def test_empty_selection_and_external_targets_are_incomplete(spark):
    g = graph(spark, [("A", "X")])
    assert rule(spark, g, "NO", [], ["X"]).status() == INCOMPLETE
    assert rule(spark, g, "NO", ["A"], ["X"], known=["A"]).status() == PASSED
    outcome = rule(spark, g, "NO", ["A"], ["X"], known=["A"], external="FAIL")
    assert outcome.status() == INCOMPLETE and outcome.violations.count() == 1


def test_layers_and_the_unassigned(spark):
    g = graph(spark, [("A", "B"), ("A", "U"), ("U", "V"), ("A", "A2")])
    membership = spark.createDataFrame([("type:A", "web"), ("type:A2", "web"), ("type:B", "db")], "type_key string, group_id string")
    get = lambda *x: sorted((r["origin"], r["target"]) for r in layer_rule(RuleMetadata("r"), g, membership, *x).violations.collect())
    assert get("MAY_ONLY_ACCESS", ["web"], ["db"]) == [("web", "<unassigned>")]
    assert get("MAY_ONLY_ACCESS", ["web"], []) == [("web", "<unassigned>"), ("web", "db")]
    assert get("ISOLATED", ["db"]) == [("web", "db")]


def test_reachability(spark):
    g = graph(spark, [("A", "B"), ("B", "C"), ("D", "A")])
    found = a.reachable(g.connections(), spark.createDataFrame([("type:A",)], "id string"))
    assert {r["id"]: r["depth"] for r in found.collect()} == {"type:A": 0, "type:B": 1, "type:C": 2}


# ---- large and odd graphs ------------------------------------------------------------------------


def random_graph(seed, n=30, m=45):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)} | {("x1", "x2"), ("x2", "x1"), ("y", "y"), ("z1", "z2")})


def reach_by_hand(pairs):
    ids = {x for p in pairs for x in p}
    out = {}
    for start in ids:
        seen, todo = {start}, [start]
        while todo:
            at = todo.pop()
            for o, t in pairs:
                if o == at and t not in seen:
                    seen.add(t)
                    todo.append(t)
        out[start] = seen
    return out


@pytest.mark.parametrize("seed, by, most", [(1, "parts", 200_000), (2, "parts", 8), (3, "colouring", 0), (4, "closure", 0)])
def test_components_and_reach_equal_brute_force(spark, monkeypatch, seed, by, most):
    monkeypatch.setattr(a, "PART_EDGES", most)
    pairs = random_graph(seed)
    frame = spark.createDataFrame(pairs, "origin string, target string")
    nodes = spark.createDataFrame([("alone",)], "id string")
    reach = reach_by_hand(pairs) | {"alone": {"alone"}}
    got = {r["id"]: (r["component"], r["size"], r["cyclic"]) for r in a.strongly_connected(frame, nodes, by=by).collect()}
    want = {}
    for x, seen in reach.items():
        part = [y for y in seen if x in reach[y]]
        want[x] = (min(part), len(part), len(part) > 1 or (x, x) in pairs)
    assert got == want
    if by == "parts":
        assert {r["id"]: r["reached"] for r in a.reach_sizes(frame, nodes).collect()} == {x: len(s) for x, s in reach.items()}
    if by == "closure":
        assert {(r["origin"], r["target"]) for r in a.closure(frame, nodes).collect()} == {(x, y) for x, s in reach.items() for y in s}


def test_strong_parts_of_a_long_cycle():
    n = 5000
    parts = a.strong_parts([[(i + 1) % n] for i in range(n)] + [[0], []])
    assert [len(p) for p in parts] == [n, 1, 1]


def walk_by_hand(components, pairs, limits):
    """The enumeration in one go over all components, within one budget."""
    found, walked, truncated = [], 0, False

    class Spent(Exception):
        pass

    def search(start, at, path, inside):
        nonlocal walked, truncated
        for o, t in pairs:
            if o != at or t not in inside or t < start:
                continue
            if walked == limits.edges:
                raise Spent
            walked += 1
            if t == start:
                if len(found) == limits.cycles:
                    raise Spent
                found.append(list(path))
            elif t not in path:
                if len(path) >= limits.length:
                    truncated = True
                else:
                    search(start, t, [*path, t], inside)

    try:
        for inside in components:
            for start in sorted(inside):
                search(start, start, [start], inside)
    except Spent:
        truncated = True
    return found, walked, truncated


@pytest.mark.parametrize("limits", [a.CycleLimits(), a.CycleLimits(4, 100, 10_000), a.CycleLimits(100, 100, 17), a.CycleLimits(100, 2, 1000), a.CycleLimits(3, 2, 9), a.CycleLimits(1, 5, 40)])
def test_cycles_share_one_budget(spark, limits):
    pairs = sorted({(f"{c}{i}", f"{c}{j}") for c, k in (("a", 3), ("b", 1), ("c", 4), ("d", 2)) for i in range(k) for j in range(k)})
    frame = spark.createDataFrame(pairs, "origin string, target string")
    parts = a.strongly_connected(frame, frame.select(F.col("origin").alias("id")))
    inside = [{f"{c}{i}" for i in range(k)} for c, k in (("a", 3), ("b", 1), ("c", 4), ("d", 2))]
    found, walked, truncated = walk_by_hand(inside, pairs, limits)
    rows = a.cycles(frame, parts, limits).collect()
    assert sorted(r["cycle"] for r in rows) == sorted(found)
    assert {(r["walked"], r["truncated"]) for r in rows} <= {(walked, truncated)}
    shown = {r["component"]: r["closed_path"] for r in a.representative_cycles(frame, parts).collect()}
    assert set(shown) == {"a0", "b0", "c0", "d0"} and all(x[0] == x[-1] for x in shown.values())


# ---- metrics, baselines --------------------------------------------------------------------------


@pytest.mark.parametrize("text, counts", [
    ("", (0, 0, 0, 0)), ("\n", (1, 1, 0, 0)), ("a\n\n/* x\n\n*/ \n// c\nint b; // d\n", (7, 1, 4, 2)), ("/*", (1, 0, 1, 0)), ("/*/\n*/ x", (2, 0, 1, 1)),
    ('s = """\n a \\\\"""\n\n// c\nx', (5, 1, 1, 3)), ('s = """\n a \\"""\n\n// c\n', (4, 0, 0, 4)), ('s = """\n a \\\\\\"""\n// c', (3, 0, 0, 3)), ("'\"' // c\n\"// no\"\n/ * 2\n", (3, 0, 0, 3)),
    ('"a\\\n// c', (2, 0, 1, 1)), ("a\r\rb\r\n", (3, 1, 0, 2)), ("\x1c\n\u2003\n\xa0\n", (3, 2, 0, 1)), ('"/*" /* "\n" */ "', (2, 0, 0, 2)), ("'\\'' // '\n'", (2, 0, 0, 2)),
])
def test_line_kinds_of_odd_texts(text, counts):
    assert m.line_kinds(text) == counts


def test_lines_of_plain_text_equal_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        lines = ["".join(rng.choices(["a ", " ", "// n", "x;"], k=rng.randint(0, 3))) for _ in range(rng.randint(1, 8))]
        kinds = ["blank" if not x.strip() else "comment" if x.strip().startswith("//") else "code" for x in lines]
        assert m.line_kinds("\n".join(lines) + "\n") == (len(lines), *(kinds.count(k) for k in ("blank", "comment", "code")))


def test_baseline_comparison_equals_brute_force(spark):
    rng = random.Random(6)
    rows = {side: [(f"i{rng.randrange(6)}", f"e{rng.randrange(5)}") for _ in range(60)] for side in ("old", "new")}
    want = []
    for i in {i for side in rows.values() for i, _ in side}:
        old = sorted(e for x, e in rows["old"] if x == i)
        for e in sorted(e for x, e in rows["new"] if x == i):
            state = "UNCHANGED" if e in old else "MOVED" if old else "NEW"
            if old:
                old.remove(e if e in old else old[0])
            want.append((i, e, state))
        want += [(i, e, "RESOLVED") for e in old]
    frames = [spark.createDataFrame(x, "identity_fp string, evidence_fp string").withColumn("exact_fp", F.concat("identity_fp", "evidence_fp")) for x in rows.values()]
    assert sorted(map(tuple, baseline.compare(*frames).collect())) == sorted(want)


def test_suppressions_of_every_kind(spark):
    changes = spark.createDataFrame([("r", "s", None, "NEW"), ("r", "t", "l", "NEW"), ("q", "s", "l", "MOVED"), ("q", "u", "m", "NEW"), ("r", "s", "l", "RESOLVED"), ("r", "s", None, "NEW")], "rule_id string, subject_id string, location string, state string")
    day = datetime.date
    rules = spark.createDataFrame([("r", "s", None, day(2024, 1, 5)), ("r", "s", None, day(2024, 1, 1)), ("r", "t", "l", day(2024, 1, 1)), (None, None, "l", None)], "rule_id string, subject_id string, location string, expires_on date")
    got = sorted((r["rule_id"], r["subject_id"], r["state"]) for r in baseline.suppress(changes, rules, day(2024, 1, 5)).collect())
    assert got == [("q", "s", "SUPPRESSED"), ("q", "u", "NEW"), ("r", "s", "RESOLVED"), ("r", "s", "SUPPRESSED"), ("r", "s", "SUPPRESSED"), ("r", "t", "SUPPRESSED")]
    every = spark.createDataFrame([(None, None, None, day(2023, 1, 1))], rules.schema)
    assert {r["state"] for r in baseline.suppress(changes, every, day(2024, 1, 5)).collect()} == {"EXPIRED", "RESOLVED"}
    assert baseline.suppress(changes, rules.limit(0), day(2024, 1, 5)).exceptAll(changes).count() == 0


def test_top_evidence_is_bounded(spark):
    rows = spark.createDataFrame([("a", None, f"l{i:02}") for i in range(30)] * 2 + [("b", "k", "l")], "origin string, kind string, location string").withColumns({c: F.lit(None).cast("string") for c in ("owner_member", "bytecode_offset", "source_file", "line_number")})
    got = {r["origin"]: r for r in top_evidence(rows, ["origin", "kind"], 3).collect()}
    assert [e["location"] for e in got["a"]["evidence"]] == ["l00", "l01", "l02"] and (got["a"]["matched"], got["a"]["omitted"]) == (30, 27) and got["b"]["omitted"] == 0
    assert {(r["matched"], len(r["evidence"])) for r in top_evidence(rows, ["kind"], 0).collect()} == {(30, 0), (1, 0)}


def closed(pairs, names):
    """What each name reaches, itself included."""
    out = {n: {n} for n in names}
    for _ in names:
        for x, y in pairs:
            out[x] |= out[y]
    return out


def graph_with_rings(seed, n, m):
    rng = random.Random(seed)
    pairs = {(f"{rng.randrange(n):02d}", f"{rng.randrange(n):02d}") for _ in range(m)}
    return sorted(pairs | {("90", "91"), ("91", "92"), ("92", "90"), ("93", "93")}), [f"{k:02d}" for k in range(n)] + ["90", "91", "92", "93", "94"]


@pytest.mark.parametrize("seed, n, m, rounds", [(1, 30, 35, 64), (2, 25, 60, 64), (3, 40, 30, 1)])
def test_components_by_pivots(spark, seed, n, m, rounds):
    pairs, names = graph_with_rings(seed, n, m)
    reach = closed(pairs, names)
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in names}
    found = condense.strong_by_pivots(spark.createDataFrame(pairs, "origin string, target string"), spark.createDataFrame([(x,) for x in names], "id string"), rounds=rounds)
    assert {r["id"]: r["component"] for r in found.collect()} == want


@pytest.mark.parametrize("seed, n, m", [(4, 30, 40), (5, 20, 45)])
def test_reach_by_blocks(spark, seed, n, m):
    pairs, names = graph_with_rings(seed, n, m)
    reach = closed(pairs, names)
    found = a.reach_sizes(spark.createDataFrame(pairs, "origin string, target string"), spark.createDataFrame([(x,) for x in names], "id string"), by="blocks")
    assert {r["id"]: r["reached"] for r in found.collect()} == {x: len(y) for x, y in reach.items()}


@pytest.mark.parametrize("pass_columns", [16, 262_144])
def test_reach_of_an_acyclic_graph_in_blocks_and_passes(spark, pass_columns):
    rng = random.Random(6)
    n = 700  # more than one block of columns
    pairs = {(f"{x:03d}", f"{rng.randrange(x):03d}") for x in range(1, n) for _ in range(2) if x % 50}
    sizes = {f"{x:03d}": rng.choice([1, 1, 1, 6, 1_000_000_007]) for x in range(n)}
    reach = {}
    for x in sorted(sizes):
        reach[x] = {x}.union(*(reach[y] for z, y in pairs if z == x))
    keep = pairs if pass_columns > 16 else {(x, y) for x, y in pairs if x < "060"}
    names = sorted(sizes) if pass_columns > 16 else sorted(sizes)[:60]
    found = condense.reach_by_blocks(spark.createDataFrame(sorted(keep), "origin string, target string"), spark.createDataFrame([(x, sizes[x]) for x in names], "id string, size long"), pass_columns=pass_columns)
    assert {r["id"]: r["reached"] for r in found.collect()} == {x: sum(sizes[y] for y in reach[x]) for x in names}


def test_levels_refuse_a_cycle(spark):
    ids = spark.createDataFrame([("A",), ("B",)], "id string")
    with pytest.raises(ValueError):
        condense.topological_levels(spark.createDataFrame([("A", "B"), ("B", "A")], "origin string, target string"), ids)
    assert condense.reach_by_blocks(spark.createDataFrame([], "origin string, target string"), spark.createDataFrame([], "id string, size long")).count() == 0


@pytest.mark.parametrize("seed, most", [(11, 6), (12, 25), (13, 1000)])
def test_contraction_equals_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(a, "PART_EDGES", most)
    pairs = sorted(random_graph(seed))
    names = sorted({x for p in pairs for x in p} | {"alone"})
    at = {x: k for k, x in enumerate(names)}
    reach = reach_by_hand(pairs) | {"alone": {"alone"}}
    found = condense.strong_by_contraction(spark.createDataFrame([(at[o], at[t]) for o, t in pairs], "origin long, target long"), spark.createDataFrame([(k,) for k in at.values()], "id long"))
    assert {r["id"]: r["component"] for r in found.collect()} == {at[x]: min(at[y] for y in seen if x in reach[y]) for x, seen in reach.items()}


def test_a_long_ring_of_ranges_is_contracted_in_few_jobs(spark, monkeypatch):
    """Breadth-first reach took a job a step; ranges of nodes take the ring together."""
    monkeypatch.setattr(a, "PART_EDGES", 500)
    n = 2_000
    calls = []
    real = condense.Area.write
    monkeypatch.setattr(condense.Area, "write", lambda self, *args, **kw: calls.append(1) or real(self, *args, **kw))
    edges = spark.createDataFrame([(k, (k + 1) % n) for k in range(n)] + [(k + 1, k) for k in range(n - 1)], "origin long, target long")
    found = condense.strong_by_contraction(edges, spark.range(n).select("id"))
    assert [tuple(r) for r in found.groupBy("component").count().collect()] == [(0, n)]
    assert len(calls) < 60


@pytest.mark.parametrize("bits", [64 * 30, 100 * 30, 1 << 20])
def test_reach_by_ranges_of_columns(spark, monkeypatch, bits):
    monkeypatch.setattr(a, "TASK_BITS", bits)
    n, rng = 150, random.Random(bits)
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(220)})
    sizes = {k: rng.randint(1, 5) for k in range(n)}
    reach = reach_by_hand(pairs)
    found = condense.reach_by_ranges(spark.createDataFrame(pairs, "origin long, target long"), spark.createDataFrame(sorted(sizes.items()), "id long, size long"))
    assert {r["id"]: r["reached"] for r in found.collect()} == {k: sum(sizes[x] for x in reach.get(k, {k})) for k in sizes}


@pytest.mark.parametrize("slice_bytes, batch", [(4_000_000, 1_000), (64, 7), (20_000, 3)])
def test_rows_of_reach_are_united(monkeypatch, slice_bytes, batch):
    """Rows of one (id, block) in several batches and slices, in two bytes a column or a bit each, give their union."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(condense, "SLICE", slice_bytes)
    rng = np.random.default_rng(batch)
    want, rows = {}, []
    for key in (("a", 0), ("a", 1), ("b", 0), ("c", 5), ("d", 1 << 33), ("e", 0)):
        for k in range(rng.integers(1, 9)):
            most = 5_000 if key[0] in "cd" and k % 2 else 40
            columns = np.unique(rng.integers(0, condense.COLUMNS, most)).astype("<u2")
            flags = np.zeros(condense.COLUMNS, dtype=np.uint8)
            flags[columns] = 1
            rows.append((*key, columns.tobytes() if len(columns) * 2 < condense.DENSE else np.packbits(flags, bitorder="little").tobytes()))
            want[key] = want.get(key, set()) | set(columns.tolist())
    names = ["id", "block", "bits"]
    frames = [pa.RecordBatch.from_pydict({c: [r[k] for r in rows[at : at + batch]] for k, c in enumerate(names)}) for at in range(0, len(rows), batch)]
    found = {}
    for r in pa.Table.from_batches(condense.unite(iter(frames))).to_pylist():
        flat = np.frombuffer(r["bits"], dtype="<u2") if len(r["bits"]) < condense.DENSE else np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), bitorder="little"))
        found[r["id"], r["block"]] = set(flat.tolist())
        assert r["n"] == len(flat) and (len(flat) * 2 >= condense.DENSE) == (len(r["bits"]) == condense.DENSE)
    assert found == want and list(condense.unite(iter([]))) == []


@pytest.mark.parametrize("pass_columns", [8, 1_000])
def test_reach_of_layers_in_blocks_and_passes(spark, monkeypatch, pass_columns):
    """Edges come repeatedly; some nodes are led to by nodes only that nothing leads to, and some by nothing."""
    monkeypatch.setattr(condense, "COLUMNS", 4)
    rng = random.Random(pass_columns)
    layers = [[10 * k + j for j in range(10)] for k in range(4)]
    pairs = sorted({(rng.choice(layers[k]), rng.choice(layers[rng.randrange(k)])) for k in (1, 2, 3) for _ in range(14)})
    sizes = {x: rng.choice([1, 1, 6]) for layer in layers for x in layer}
    reach = reach_by_hand(pairs)
    frame = spark.createDataFrame(pairs + pairs[::3] + [(7, 7)], "origin long, target long")
    nodes = spark.createDataFrame(sorted(sizes.items()), "id long, size long")
    found = condense.reach_by_blocks(frame, nodes, pass_columns=pass_columns)
    assert {r["id"]: r["reached"] for r in found.collect()} == {x: sum(sizes[y] for y in reach.get(x, {x})) for x in sizes}


def test_reach_over_levels_says_when_they_are_too_many_or_rows_too_large(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(5)], "origin long, target long")
    sizes = spark.range(6).selectExpr("id", "1L AS size")
    assert condense.reach_by_blocks(chain, sizes, most_levels=4) is None
    assert condense.reach_by_blocks(chain, sizes, most_levels=5, most_bytes=0) is None
    assert sorted(r["reached"] for r in condense.reach_by_blocks(chain, sizes, most_levels=5, most_bytes=100).collect()) == [1, 2, 3, 4, 5, 6]
    ring = chain.unionByName(spark.createDataFrame([(5, 0)], "origin long, target long"))
    assert condense.reach_by_blocks(ring, sizes, most_levels=50) is None


@pytest.mark.parametrize("by", ["parts", "blocks"])
def test_an_acyclic_graph_of_few_levels_needs_no_components(spark, monkeypatch, by):
    """At 60 times sf0.1 the rounds over all edges of weak and strong components took all the time there was."""

    def refuse(*args, **kw):
        raise AssertionError("components were asked for")

    for module, name in ((a, "weak_components"), (condense, "strong_by_pivots"), (condense, "strong_by_contraction")):
        monkeypatch.setattr(module, name, refuse)
    pairs = [(f"c{k}", f"p{(k + j) % 7}") for k in range(9) for j in range(3)] + [(f"p{k}", f"s{(k * j) % 5}") for k in range(7) for j in (1, 2)] + [("c0", "s4"), ("c1", "t")]
    names = sorted({x for p in pairs for x in p} | {"alone"})
    reach = closed(pairs, names)
    found = m.reach_counts(spark.createDataFrame(pairs, "origin string, target string"), spark.createDataFrame([(x,) for x in names], "subject string"), by=by)
    assert {r["subject"]: r["depends_on"] for r in found.collect()} == {x: len(y) for x, y in reach.items()}


@pytest.mark.parametrize("seed", range(40))
def test_first_cycle_is_that_of_the_full_walk(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 9)
    edges = sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randint(2, 16))})
    adjacency = {}
    for o, t in edges:
        adjacency.setdefault(o, []).append(t)
    for length in (2, 4, 100):
        whole = a.elementary_cycles(adjacency, a.CycleLimits(1, length, 100_000))[0]
        want = whole[0][1] if whole else None
        assert a.first_cycle(adjacency, a.CycleLimits(1, length, 100_000)) == want


def test_first_cycle_leaves_dead_ends():
    """The least node leads into a tangle that comes back through one late node only: the walk ran out of its 100,000 edges there."""
    tangle = [f"b{k:02}" for k in range(40)]
    adjacency = {"a": ["b00", "z"], "z": ["a"]} | {x: [y for y in tangle if y != x] for x in tangle}
    adjacency["b39"] = [*adjacency["b39"], "z"]
    adjacency["b38"] = [x for x in adjacency["b38"] if x != "b39"]
    assert not a.elementary_cycles({**adjacency, "b39": tangle[:39]}, a.CycleLimits(1))[0]
    assert a.first_cycle({**adjacency, "b39": tangle[:39]}) == ["a", "z"]
