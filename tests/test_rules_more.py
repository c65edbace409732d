"""Access, modules, hierarchies, nests, scopes, lookups and presets on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from latticework import config
from latticework.functions import patterns
from latticework.functions.identity import check_identifier
from latticework.operators import hierarchy, lookup
from latticework.operators.rules import access, modules, structure
from latticework.operators.rules.outcome import FAILED, PASSED, RuleMetadata
from latticework.plans.graph import graph_from
from latticework.sources import model
from latticework.streaming import evidence as streaming

R = RuleMetadata("r")
SITE = "caller string, target_owner string, target_name string, target_desc string, kind string, offset long, compiler_created boolean"


def test_member_access_gives_one_violation_a_caller_and_target(spark):
    rows = [("A", "T", "m", "()V", "METHOD_CALL", k, False) for k in (0, 9, 9, 4)] + [("A", "U", "m", "()V", "METHOD_CALL", 2, False), ("A", "T", "m", "()V", "METHOD_CALL", 7, True), ("B", "[T", "m", "()V", "METHOD_CALL", 1, False)]
    callers = spark.createDataFrame([("A",), ("B",)], "id string")
    targets = spark.createDataFrame([("T", "m", "()V"), ("[T", "m", "()V")], "owner string, name string, descriptor string")
    found = structure.member_access(R, spark.createDataFrame(rows, SITE), callers, targets, "NO").violations.collect()
    assert [(r["origin"], r["target"], r["n_evidence"]) for r in found] == [("A", "T#m()V", 3)]
    only = structure.member_access(R, spark.createDataFrame(rows, SITE), callers, targets, "ONLY").violations.collect()
    assert sorted((r["origin"], r["target"], r["n_evidence"]) for r in only) == [("A", "U#m()V", 1), ("B", "[T#m()V", 1)]
    assert len({r["violation_id"] for r in only}) == 2


def test_cycles_without_synthetic_evidence(spark):
    rows = [("type:A", "type:B", "METHOD_CALL", "x", False), ("type:B", "type:A", "METHOD_CALL", "x", True), ("type:B", "type:A", "METHOD_CALL", "y", True)]
    g = graph_from(spark.createDataFrame(rows, "origin string, target string, kind string, location string, synthetic boolean"))
    keys = g.nodes.select("stable_key")
    assert structure.acyclic(R, g, keys).status() == FAILED and structure.acyclic(R, g, keys, keep_synthetic=False).status() == PASSED


def test_types_within_hidden_types_are_hidden(spark):
    rows = [("A", True, None), ("A$B", True, "A"), ("A$B$C", True, "A$B"), ("H", False, None), ("H$X", True, "H"), ("L", True, "gone"), ("P", True, "Q"), ("Q", True, "P")]
    found = access.visible_from_outside(spark.createDataFrame(rows, "type string, public boolean, owner string"))
    assert {r["type"] for r in found.collect()} == {"A", "A$B", "A$B$C"}


def test_unknown_ends_have_no_state(spark):
    s = spark.createDataFrame
    found = access.access_states(
        s([("A", "B", "B#m"), ("A", "B", "B#m"), ("A", "B", "B#gone"), ("A", "Z", "Z#m")], "origin string, target_owner string, target_member string"),
        s([("A", "p", "m1", None), ("B", "q", "m2", None)], "type string, package string, module string, nest_host string"), s([("B", "B#m", "PUBLIC")], "type string, member string, visibility string"),
        s([("m1", "EXPLICIT"), ("m2", "EXPLICIT")], "module string, kind string"), s([("m2", "q", ["m3"]), ("m2", "q", ["m1"])], "module string, package string, targets array<string>"), s([], "origin string, target string, missing boolean"),
    )
    got = {r["target_member"]: (r["n"], r["visibility"], r["export"], r["accessible"]) for r in found.collect()}
    assert got == {"B#m": (2, "PUBLIC", "QUALIFIED_EXPORT_TO_CALLER", "YES"), "B#gone": (1, None, None, None), "Z#m": (1, None, None, None)}


@pytest.mark.parametrize("options, bad", [
    ({"transitive": "REQUIRED"}, {"java.sql"}), ({"transitive": "FORBIDDEN"}, {"java.base", "java.xml"}), ({"static": "REQUIRED"}, {"java.xml"}), ({"qualification": "QUALIFIED"}, {"java.sql"}),
    ({"targets": patterns.exact("m.b")}, {"java.sql"}), ({"qualification": "UNQUALIFIED"}, {"java.base", "java.xml"}),
])
def test_directive_flags(spark, options, bad):
    kinds = spark.createDataFrame([("m", "EXPLICIT"), ("auto", "AUTOMATIC")], "name string, kind string")
    rows = [("m", "java.base", False, False, []), ("m", "java.sql", True, False, ["m.a", "m.b"]), ("m", "java.xml", False, True, None), ("auto", "java.sql", True, False, None)]
    declared = spark.createDataFrame(rows, "name string, value string, transitive boolean, static boolean, targets array<string>")
    found = modules.declaration_rule(R, kinds, declared, patterns.glob("java.**"), "NO", **options)
    assert {r["target"] for r in found.violations.collect()} == bad
    with pytest.raises(ValueError):
        modules.declaration_rule(R, kinds, declared, patterns.glob("**"), "NO", transitive="SOMETIMES")


def test_limits_of_meta_annotations(spark):
    rows = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("x", "A"), ("A", "S"), ("S", "D"), ("L", "M"), ("M", "L"), ("K", "L"), ("y", "K")]
    got = {r["annotation"]: (r["n_meta"], r["limit"], r["cycle"]) for r in hierarchy.meta_annotation_states(spark.createDataFrame(rows, "subject string, annotation string"), max_depth=2).collect()}
    assert got["A"] == (4, True, False) and got["B"] == (2, True, False) and got["C"] == (2, False, False) and got["E"] == (0, False, False)
    assert got["K"] == (2, False, True) and got["L"] == (1, False, True)


def test_sealed_types_with_open_hierarchies(spark):
    T = "binary_name string, sealed boolean, permitted array<string>, superclass string, interfaces array<string>, modifiers array<string>, package string"  # noqa: N806
    rows = [("S", True, ["A", "B", "C"], "java.lang.Object", [], [], "p"), ("A", False, [], "S", [], ["FINAL"], "p"), ("B", False, [], "gone.Base", [], ["FINAL"], "p"), ("C", False, [], "java.lang.Object", [], ["FINAL"], "p")]
    got = {(r["sealed"], r["subtype"], r["code"]) for r in hierarchy.sealed_check(spark.createDataFrame(rows, T), spark.createDataFrame([("S",), ("Q",)], "binary_name string")).collect()}
    assert got == {("S", "B", "RELATIONSHIP_UNKNOWN"), ("S", "C", "PERMITTED_NOT_SUBTYPE"), ("Q", None, "QUERY_TYPE_MISSING")}


def test_nests(spark):
    hosts = spark.createDataFrame([("H$A", "H"), ("H$B", "H"), ("H$B", "G"), ("X", "X"), ("N", "H")], "type string, host string")
    members = spark.createDataFrame([("H", "H$A"), ("H", "H$A"), ("H", "H$B"), ("H", "H$C"), ("H$A", "Y")], "type string, member string")
    got = {tuple(r) for r in hierarchy.nest_problems(hosts, members).collect()}
    assert got == {("H$B", "CONFLICTING_HOSTS", None), ("X", "OWN_HOST", "X"), ("H", "REPEATED_MEMBER", "H$A"), ("H$A", "HOST_AND_MEMBERS", None), ("N", "NOT_LISTED", "H"), ("H$B", "NOT_LISTED", "G"), ("H", "HOST_NOT_NAMED", "H$C"), ("H$A", "HOST_NOT_NAMED", "Y")}


@pytest.mark.parametrize("seed", [1, 2])
def test_as_of_over_ranges_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    entries = [(rng.choice(["k", "k", "k", None, "j"]), rng.randrange(80), rng.choice([None, *range(50)])) for _ in range(120)]
    probes = [(rng.choice(["k", "k", None, "z"]), rng.randrange(90), i) for i in range(200)] + [("k", 40, 1000 + i) for i in range(60)]
    found = lookup.as_of_ranges(spark.createDataFrame(probes, "by string, at long, id long").repartition(3), spark.createDataFrame(entries, "by string, at long, v long"), ["by"], ["at"], "v")
    want = []
    for by, at, i in probes:
        before = [(t, v) for b, t, v in entries if b == by and t <= at and v is not None]
        want.append((i, max(before)[1] if before else None))
    assert sorted((r["id"], r["v"]) for r in found.collect()) == sorted(want)
    bare = lookup.as_of_ranges(spark.createDataFrame([("k", 100)], "by string, at long"), spark.createDataFrame(entries, "by string, at long, v long"), ["by"], ["at"], "v")
    assert bare.columns == ["by", "at", "v"] and bare.count() == 1


def test_lines_of_accesses(spark):
    table = spark.createDataFrame([("m", 0, 10), ("m", 5, 12), ("n", 3, 30)], "member string, pc long, line long")
    found = lookup.line_of(spark.createDataFrame([("m", 4), ("m", 5), ("n", 2)], "member string, offset long"), table)
    assert sorted((r["member"], r["offset"], r["line"]) for r in found.collect()) == [("m", 4, 10), ("m", 5, 12), ("n", 2, None)]


def test_manifest_tables_expand_within_bounds(spark):
    named = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "path string, entry string")
    start = spark.createDataFrame([("a",)], "path string")
    assert {(r["path"], r["depth"]) for r in lookup.expand_manifest(start, named).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert lookup.expand_manifest(start, named, max_depth=1).count() == 2
    with pytest.raises(ValueError):
        lookup.expand_manifest(start, named, max_entries=3)


def test_own_scope_first_then_what_it_reads(spark):
    s = spark.createDataFrame
    types = s([("m1", "T"), ("m2", "T"), ("m3", "T"), ("m3", "U"), ("m2", "V"), ("m3", "V")], "scope string, name string")
    reads = s([("m1", "m3", 0), ("m1", "m2", 1), ("m2", "m2", 0)], "scope string, reads string, place int")
    asked = s([("m1", "T"), ("m1", "U"), ("m1", "V"), ("m2", "U"), ("m2", "T"), ("m1", "W"), ("m1", "T")], "scope string, name string")
    assert sorted(map(str, map(tuple, lookup.resolve_in_scopes(asked, types, reads).select("scope", "name", "found").collect()))) == sorted(map(str, [("m1", "T", "m1"), ("m1", "T", "m1"), ("m1", "U", "m3"), ("m1", "V", "m3"), ("m2", "U", None), ("m2", "T", "m2"), ("m1", "W", None)]))


def test_references_count_what_they_leave_out(spark):
    rows = [("A", "I", "F", "a"), ("A", "[J", "F", "b"), ("A", "LB;", "F", "c"), ("A", "LB;", "F", "c"), ("A", "[LB;", "F", "d"), ("A", "LA;", "F", "e"), ("A", "LX;", "F", "f"), ("C", "LX;", "M", "g")]
    found = model.References(spark.createDataFrame(rows, "origin string, descriptor string, kind string, source string"), spark.createDataFrame([("A",), ("B",)], "name string"))
    got = {(r["origin"], r["target"]): (r["n_sources"], r["self"], r["external"]) for r in found.rows.collect()}
    assert got == {("A", "B"): (2, False, False), ("A", "A"): (1, True, False), ("A", "X"): (1, False, True), ("C", "X"): (1, False, True)}
    assert found.counters() == {"primitives": 2, "duplicates": 1, "self": 1, "external": 2}


@pytest.mark.parametrize("preset, good, bad", [
    (modules.clean(), ("adapters", "usecases"), ("entities", "adapters")), (modules.onion(), ("adapter", "domain_model"), ("domain_model", "application")),
    (modules.hexagonal(), ("adapters", "ports"), ("domain", "ports")), (modules.provider_sdk(), ("implementation", "spi"), ("api", "implementation")),
])
def test_named_presets(spark, preset, good, bad):
    rows = [(f"type:{a}.A", f"type:{b}.B", "METHOD_CALL", "x") for a, b in (good, bad)]
    g = graph_from(spark.createDataFrame(rows, "origin string, target string, kind string, location string"))
    types = spark.createDataFrame([(f"type:{x}.{y}", x) for x in preset.layers for y in "AB"], "type_key string, package string")
    found = [tuple(r) for o in preset.check(g, types, {x: F.col("package") == x for x in preset.layers}) for r in o.violations.select("origin", "target").collect()]
    assert len(found) == 1 and bad[0] in found[0][0] and bad[1] in found[0][1]


def test_edges_by_window(spark, tmp_path):
    rows = [("type:A", "type:B", "CALL", f"2024-01-01 0{h}:10:00") for h in (1, 1, 2)]
    spark.createDataFrame(rows, "origin string, target string, kind string, at string").selectExpr("origin", "target", "kind", "timestamp(at) AS ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("origin string, target string, kind string, ts timestamp").parquet(f"{tmp_path}/in")
    q = streaming.edge_counts_by_window(stream).writeStream.format("memory").queryName("by_window").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("by_window").collect()) == [1, 2]


def test_identifiers_and_import_options(tmp_path):
    assert check_identifier("a1") and not check_identifier("1a") and not check_identifier("class")
    (tmp_path / "x.jar").write_bytes(b"")
    (tmp_path / "skip").write_text("a/**\n")
    (tmp_path / "c.properties").write_text("input.1=x.jar\nrelease=17\nmode=module-path\nmanifests=true\nignore=skip\n")
    c = config.load(str(tmp_path / "c.properties"))
    assert (c.release, c.mode, c.manifests, c.ignore.name) == (17, "MODULE_PATH", True, "skip")
    for wrong in ("release=7", "mode=other", "manifests=yes", "ignore=../x", "ignore=none"):
        (tmp_path / "c.properties").write_text(f"input.1=x.jar\n{wrong}\n")
        with pytest.raises(config.ConfigError):
            config.load(str(tmp_path / "c.properties"))


def test_first_paths_by_breadth_first_walks(spark):
    rng = random.Random(8)
    names = [f"n{k:02}" for k in range(24)]
    pairs = sorted({(*rng.sample(names, 2), rng.choice(("EXTENDS", "IMPLEMENTS"))) for _ in range(110)})
    subjects, targets = names[:10], {"n03", "n15", "n20", "absent"}
    want = {}
    for subject in subjects:
        paths, queue = {subject: [subject]}, [subject]
        for at in queue:  # grows as it is walked
            for _, target, _ in sorted((p for p in pairs if p[0] == at), key=lambda p: p[1:]):
                if target not in paths:
                    paths[target] = [*paths[at], target]
                    queue.append(target)
        want |= {(subject, t): p for t, p in paths.items() if t in targets and t != subject}
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    found = hierarchy.first_paths(spark.createDataFrame(pairs, "origin string, target string, kind string"), ids(subjects), ids(sorted(targets))).collect()
    assert len(found) == len(want) > 10 and {(r["subject"], r["target"]): r["path"] for r in found} == want
