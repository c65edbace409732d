"""Releases, manifests, scopes, class-file attributes and renderers over real archives."""

import json
import zipfile
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from latticework.functions import patterns
from latticework.operators.rules.outcome import RuleMetadata, RuleOutcome, violations
from latticework.plans.graph import build, nodes_of
from latticework.plans.snapshot import SnapshotQuery
from latticework.sinks import render
from latticework.sources import classfile as c
from latticework.sources import model as m

JARS = Path(pyspark.__file__).parent / "jars"


@pytest.fixture(scope="module")
def classes():
    with zipfile.ZipFile(next(JARS.glob("py4j-*.jar"))) as z:
        return {n: z.read(n) for n in z.namelist() if n.endswith(".class")}


def jar(path, entries, manifest="Manifest-Version: 1.0\r\n"):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(c.MANIFEST, manifest)
        for name, raw in entries.items():
            z.writestr(name, raw)
    return str(path)


def test_releases(spark, classes, tmp_path):
    one, two = "py4j/Gateway.class", "py4j/Base64.class"
    versions = {"META-INF/versions/9/" + one: classes[one], "META-INF/versions/17/" + one: classes[one], "META-INF/versions/99/" + one: classes[one]}
    odd = {"META-INF/versions/8/" + two: classes[two], "META-INF/versions/x/" + two: classes[two], "META-INF/versions/99999999999/" + two: classes[two]}
    jar(tmp_path / "multi.jar", {one: classes[one], two: classes[two]} | versions | odd, "Manifest-Version: 1.0\r\nMulti-Rel\r\n ease: true\r\n")
    jar(tmp_path / "plain.jar", {one: classes[one]} | versions)
    for name, releases in (("multi.jar", {8: one, 11: "META-INF/versions/9/" + one, 21: "META-INF/versions/17/" + one}), ("plain.jar", {21: one})):
        decoded = c.decode_entries(c.read_inputs(spark, [("JAR", str(tmp_path / name))])).persist()
        for release, entry in releases.items():
            found, _, said = m.resolve(decoded, release=release)
            assert {r["entry"] for r in found.where("binary_name = 'py4j.Gateway'").collect()} == {entry}
        assert not [r for r in found.columns if r in ("release", "scope")]
        reasons = {r["diagnostic"] for r in said.collect()}
        assert reasons == ({"VERSION_OUT_OF_RANGE", "VERSIONED_NAME_INVALID"} if name == "multi.jar" else {"VERSIONS_NOT_ENABLED"})


@pytest.mark.parametrize("entry, multi, target, said", [
    ("a/B.class", False, 17, None), ("META-INF/versions/9/a/B.class", True, 17, None), ("META-INF/versions/17/a/B.class", True, 17, None), ("META-INF/versions/9/a/B.class", False, 17, "VERSIONS_NOT_ENABLED"),
    ("META-INF/versions/18/a/B.class", True, 17, "VERSION_OUT_OF_RANGE"), ("META-INF/versions/8/a/B.class", True, 17, "VERSION_OUT_OF_RANGE"), ("META-INF/versions/99999999999/B.class", True, 17, "VERSION_OUT_OF_RANGE"),
    ("META-INF/versions/09/B.class", True, 17, "VERSIONED_NAME_INVALID"), ("META-INF/versions/9/", True, 17, "VERSIONED_NAME_INVALID"), ("META-INF/versions/9", True, 17, "VERSIONED_NAME_INVALID"),
    ("META-INF/versions/11/META-INF/B.class", True, 17, "VERSIONED_NAME_INVALID"), ("META-INF/versions/x/B.class", None, 17, "VERSIONS_NOT_ENABLED"),
])
def test_versioned_entries(spark, entry, multi, target, said):
    rows = spark.createDataFrame([(entry, multi)], "entry string, multi boolean")
    assert rows.select(m.versioned_problem(F.col("entry"), F.col("multi"), target)).first()[0] == said


def test_archives_leave_diagnostics(spark, classes, tmp_path):
    one = "py4j/Gateway.class"
    with zipfile.ZipFile(tmp_path / "odd.jar", "w") as z:
        for name in ("lib/inner.jar", one, one, "app.WAR", "py4j/Base64.class"):
            z.writestr(name, classes.get(name, b""))
    rows = c.read_inputs(spark, [("JAR", str(tmp_path / "odd.jar")), ("JAR", str(tmp_path / "none.jar"))]).collect()
    assert sorted((r["diagnostic"], r["entry"]) for r in rows if r["diagnostic"] and r["entry"]) == [("NESTED_ARCHIVE", "app.WAR"), ("NESTED_ARCHIVE", "lib/inner.jar"), ("REPEATED_ENTRY", one)]
    assert [r["container"] for r in rows if r["diagnostic"] == "INPUT_ABSENT"] == [str(tmp_path / "none.jar")]
    assert sorted(r["entry"] for r in rows if r["content"]) == ["py4j/Base64.class", one]
    assert c.read_inputs(spark, [("JAR", str(tmp_path / "none.jar"))]).count() == 1


def test_entries_leave_a_task_in_bounded_batches():
    rows = [("j", str(k), "JAR", b"x" * 3_000_000 if k < 6 else b"", None, False) for k in range(700)]
    found = list(c._in_batches(iter(rows)))
    assert [r for batch in found for r in batch] == rows and max(map(len, found)) <= c.BATCH_ENTRIES and len(found[0]) == 3


def test_scopes_include_and_ignore(spark, classes, tmp_path):
    names = ["py4j/Gateway.class", "py4j/Base64.class", "py4j/reflection/MethodInvoker.class"]
    inputs = [("JAR", jar(tmp_path / f"{x}.jar", {n: classes[n] for n in names})) for x in "ab"]
    decoded = c.decode_entries(c.read_inputs(spark, [*inputs, inputs[0]])).persist()
    assert [r["diagnostic"] for r in decoded.where("diagnostic IS NOT NULL").collect()] == ["DUPLICATE_INPUT"]
    path, shadows, _ = m.resolve(decoded)
    module, none, _ = m.resolve(decoded, mode="MODULE_PATH")
    assert (path.count(), shadows.count(), module.count(), none.count()) == (3, 3, 6, 0) and "scope" in module.columns
    some, _, _ = m.resolve(decoded, include=[patterns.glob("py4j.reflection.**")])
    assert [r["binary_name"] for r in some.collect()] == ["py4j.reflection.MethodInvoker"]
    rules = patterns.parse_ignore("py4j/**\n!py4j/reflection/**")
    kept = c.read_inputs(spark, inputs[:1], ignore=rules)
    assert [r["entry"] for r in kept.collect()] == [names[2]]
    with zipfile.ZipFile(inputs[0][1]) as z:
        z.extractall(tmp_path / "classes")
    assert c.read_inputs(spark, [("DIRECTORY", str(tmp_path / "classes"))], ignore=rules).count() == 1


def test_scopes_keep_equal_names_apart(spark, classes, tmp_path):
    names = ["py4j/Gateway.class", "py4j/Base64.class", "py4j/StringUtil.class", "py4j/Protocol.class"]
    a = jar(tmp_path / "a.jar", {n: classes[n] for n in names})
    b = jar(tmp_path / "b.jar", {n: classes[n] for n in names[1:]})
    decoded = c.decode_entries(c.read_inputs(spark, [("JAR", a), ("JAR", b)])).persist()
    path, module = m.resolve(decoded)[0], m.resolve(decoded, mode="MODULE_PATH")[0]
    keys = lambda g: {r["stable_key"] for r in g.nodes.collect()}
    assert "type:py4j.Protocol" in keys(m.type_graph(path)) and not [k for k in keys(m.type_graph(path)) if "!" in k]
    g = m.type_graph(module)
    apart = [k for k in keys(g) if k.endswith("!py4j.Protocol")]
    assert len(apart) == 2 and "type:java.lang.Object" in keys(g) and not [k for k in keys(g) if k == "type:py4j.Protocol"]
    # A type's own scope comes first; what it lacks is found in the other.
    scope = lambda k: k.rpartition("!")[0]
    edges = {(r["origin"], r["target"]) for r in g.connections().collect() if "!" in r["target"]}
    assert edges and all(scope(o) == scope(t) or t.endswith("!py4j.Gateway") for o, t in edges)


def test_manifests_are_followed_within_bounds(spark, classes, tmp_path):
    (tmp_path / "lib").mkdir()
    one = {"py4j/Gateway.class": classes["py4j/Gateway.class"]}
    first = jar(tmp_path / "first.jar", one, "Class-Path: lib/second.jar ../out.jar\r\n  http://x/y.jar lib/none.jar\r\n")
    jar(tmp_path / "lib/second.jar", one, "Class-Path: third.jar ../first.jar\r\n")
    jar(tmp_path / "lib/third.jar", one)
    found, said = c.follow_manifests(spark, [("AUTO", first)])
    assert [Path(p).name for _, p in found] == ["first.jar", "second.jar", "third.jar", "first.jar"]
    assert sorted(t.split()[0] for _, t in said) == ["CLASS_PATH_ABSENT", "CLASS_PATH_LEADS_OUT", "CLASS_PATH_LEADS_OUT"]
    assert [t for _, t in c.follow_manifests(spark, [("AUTO", first)], max_depth=1)[1] if "TOO" in t] == ["CLASS_PATH_TOO_DEEP 1"]
    assert [t for _, t in c.follow_manifests(spark, [("AUTO", first)], max_entries=2)[1] if "TOO" in t] == ["CLASS_PATH_TOO_LONG 2"]
    entries = c.read_inputs(spark, [("AUTO", first)], manifests=True)
    assert entries.where("content IS NOT NULL").groupBy("precedence").count().count() == 3


def test_attributes_of_real_classes():
    """Every class of some archives is read, with what is known of a few of them."""
    found = {}
    for pattern in ("jackson-annotations-*.jar", "jackson-databind-*.jar", "py4j-*.jar"):
        with zipfile.ZipFile(next(JARS.glob(pattern))) as z:
            for n in z.namelist():
                if n.endswith(".class"):
                    x = c.decode(z.read(n))
                    found[x.module or x.binary_name] = x
    top = "com.fasterxml.jackson"
    auto = found[f"{top}.annotation.JsonAutoDetect"]
    values = {t: {e["name"]: e["value"] for e in elements} for _, t, _, _, elements in auto.annotations}
    assert values["java.lang.annotation.Retention"] == {"value": "java.lang.annotation.RetentionPolicy.RUNTIME"}
    assert values["java.lang.annotation.Target"]["value"].startswith("[java.lang.annotation.ElementType.")
    assert (f"{top}.annotation.JsonAutoDetect#fieldVisibility()L{top.replace('.', '/')}/annotation/JsonAutoDetect$Visibility;", f"{top}.annotation.JsonAutoDetect$Visibility.DEFAULT") in auto.defaults
    assert (f"{top}.annotation.JsonAutoDetect$Visibility", f"{top}.annotation.JsonAutoDetect", "Visibility") in {n[:3] for n in auto.nesting}
    module = found[f"{top}.databind"]
    assert f"{top}.annotation" in module.requires and module.uses and module.provides and module.exports
    assert any(x.enclosing_class for x in found.values()) and any(v for x in found.values() for _, v in x.constants)


def test_nesting_and_components(spark):
    decoded = c.decode_entries(c.read_jars(spark, str(next(JARS.glob("jackson-databind-*.jar")))).withColumn("precedence", F.lit(0)))
    classes, _, _ = m.resolve(decoded)
    rows = {r["binary_name"]: r for r in m.nesting_table(classes.persist()).collect()}
    kinds = {r["nesting"] for r in rows.values()}
    assert {"TOP_LEVEL", "MEMBER", "ANONYMOUS"} <= kinds and not {r["problem"] for r in rows.values()} - {None, "REPEATED_ENTRY"}
    assert rows["com.fasterxml.jackson.databind.ObjectMapper"]["nesting"] == "TOP_LEVEL"
    member = rows["com.fasterxml.jackson.databind.ObjectMapper$DefaultTyping"]
    assert (member["nesting"], member["outer"]) == ("MEMBER", "com.fasterxml.jackson.databind.ObjectMapper")
    assert m.modules_table(decoded).select("name").first()["name"] == "com.fasterxml.jackson.databind"
    assert m.annotations_table(classes).where("size(elements) > 0").count() > 0
    assert m.record_components(classes).count() == 0


def test_snapshot_documents(spark, tmp_path):
    rows = [("type:p.A", "type:q.B", k, f"location:{i}", i) for i, k in enumerate(["METHOD_CALL", "THROWS", "THROWS"])]
    evidence = spark.createDataFrame(rows, "origin string, target string, kind string, location string, bytecode_offset long")
    g = build(nodes_of(spark.createDataFrame([("type:p.A",), ("type:q.B",), ("type:p.C",)], "stable_key string")), evidence)
    query = SnapshotQuery("PACKAGE").limited_by(10, 10, 2)
    doc = json.loads(render.snapshot_json(query, g))
    assert doc["query"]["domain"] == "PACKAGE" and doc["query"]["truncated"] and doc["query"]["limits"]["max_evidence_per_edge"] == 2
    assert doc["nodes"][0] == {"id": "package:p", "label": "p", "source_node_count": 2, "source_node_ids": ["type:p.A", "type:p.C"]}
    edge = doc["edges"][0]
    assert (edge["dependency_kinds"], edge["evidence_count"], edge["omitted_evidence_count"], len(edge["evidence"])) == (["METHOD_CALL", "THROWS"], 3, 1, 2)
    render.write_snapshot_csv(query, g, f"{tmp_path}/csv")
    records = spark.read.option("header", True).csv(f"{tmp_path}/csv").groupBy("record").count().collect()
    assert {r["record"]: r["count"] for r in records if r["record"] != "metadata"} == {"node": 2, "node-source": 3, "edge": 1, "evidence": 2}
    nodes, edges, _ = query.snapshot(g)
    for limits in (render.HtmlLimits(1), render.HtmlLimits(edges=0), render.HtmlLimits(characters=5)):
        for form in (render.graph_html, render.graph_html):
            with pytest.raises(render.RenderError):
                form(nodes, edges, limits)
    assert "location:1" in render.graph_html(nodes, edges, evidence=query.evidence(g, edges))
    with pytest.raises(render.RenderError):
        render.graph_html(nodes, edges, render.HtmlLimits(evidence=1), query.evidence(g, edges))


def test_results_show_bounded_evidence(spark):
    rule = RuleMetadata("r")
    ends = spark.createDataFrame([("a", "b", "K")], "origin string, target string, kind string")
    proof = spark.createDataFrame([("a", "b", "K", f"l{i}", i) for i in range(5)] + [("x", "b", "K", "l", 0)], "origin string, target string, kind string, location string, line_number int").withColumns({c: F.lit(None).cast("string") for c in ("owner_member", "bytecode_offset", "source_file")})
    result = render.collect(RuleOutcome(rule, violations(rule, ends, "X")), render.ResultLimits(evidence=2), proof)
    assert [e["location"] for e in result.violations[0]["evidence"]] == ["l0", "l1"] and result.violations[0]["omitted_evidence"] == 3
    assert "    at l0:0\n    at l1:1\n    ... 3 more\n" in render.console([result])


def test_rules_are_collected_as_tests(spark, classes, tmp_path):
    from latticework import pytest_plugin

    folder = tmp_path / "classes/py4j/reflection"
    folder.mkdir(parents=True)
    for name, raw in classes.items():
        if name.startswith("py4j/reflection/"):
            (tmp_path / "classes" / name).write_bytes(raw)
    rule = "rule.{0}.type=no\nrule.{0}.origin=glob:py4j.reflection.**\nrule.{0}.target=glob:{1}\nrule.{0}.external=non-matching\n"
    (tmp_path / "some.rules.properties").write_text("schema=1\ninput.1=classes\n" + rule.format("net", "java.net.**") + rule.format("self", "py4j.reflection.**"))

    class Seen:
        def __init__(self):
            self.outcomes = {}

        def pytest_runtest_logreport(self, report):
            if report.when == "call":
                self.outcomes[report.nodeid.rpartition("::")[2]] = report.outcome

    seen = Seen()
    pytest.main([str(tmp_path), "-p", "no:cacheprovider", "-p", "no:terminal"], plugins=[seen, pytest_plugin])
    assert seen.outcomes == {"net": "passed", "self": "failed"}
