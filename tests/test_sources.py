import io
import json
import zipfile
from pathlib import Path

import pyspark
import pytest

from latticework import cli, config
from latticework.operators.rules.outcome import FAILED, RuleMetadata, define
from latticework.sources import classfile as c
from latticework.sources import discovery
from latticework.sources.cache import cache_key, load_or_compute
from latticework.sources.model import ImportFailure, bounded_diagnostics, external_types, members_table, resolve, type_graph, types_table


@pytest.fixture(scope="module")
def jar():
    return next((Path(pyspark.__file__).parent / "jars").glob("py4j-*.jar"))


@pytest.fixture(scope="module")
def project(jar, tmp_path_factory):
    """Some real class files in a folder, one of them damaged, and a configuration."""
    root = tmp_path_factory.mktemp("project")
    with zipfile.ZipFile(jar) as z:
        for name in z.namelist():
            if name.startswith("py4j/reflection/") and name.endswith(".class"):
                z.extract(name, root / "classes")
    (root / "rules.properties").write_text("schema=1\ninput.1=classes\nrule.no-net.type=no\nrule.no-net.origin=glob:py4j.reflection.**\nrule.no-net.target=glob:java.lang.reflect.**\nrule.no-net.external=non-matching\nrule.only.type=only\nrule.only.origin=glob:py4j.**\nrule.only.target=glob:py4j.**\n")
    return root


def test_decoder_reads_real_classes(jar):
    with zipfile.ZipFile(jar) as z:
        decoded = [c.decode(z.read(n)) for n in z.namelist() if n.endswith(".class")]
    assert len(decoded) > 60
    gateway = next(x for x in decoded if x.binary_name == "py4j.Gateway")
    assert gateway.superclass == "java.lang.Object" and any(m[0] == "<init>" for m in gateway.members)
    assert any(a[1] == "java.lang.Object" and a[4] == "CONSTRUCTOR_CALL" and a[7] for a in gateway.accesses)


@pytest.mark.parametrize("raw", [b"", b"\xca\xfe\xba\xbe", b"PK\x03\x04", b"\xca\xfe\xba\xbe\x00\x00\x00\xff\x00\x01"])
def test_decoder_refuses(raw):
    with pytest.raises(c.ClassFileError):
        c.decode(raw)


def test_archive_bounds():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/A.class", b"x")
        z.writestr("b/../../B.class", b"x")
        z.writestr("c/Bomb.class", b"\0" * 1_000_000)
    found = {e: d for _, e, _, _, d, _ in c.archive_entries("j", buffer.getvalue(), c.ArchiveLimits())}
    assert found == {"a/A.class": None, "b/../../B.class": "ENTRY_PATH", "c/Bomb.class": "ENTRY_SIZE"}
    assert list(c.archive_entries("j", b"no zip", c.ArchiveLimits()))[0][4].startswith("ARCHIVE_DAMAGED")


def test_import_resolves_and_builds_a_graph(spark, project, tmp_path):
    (tmp_path / "Broken.class").write_bytes(b"\xca\xfe\xba\xbe\x00")
    inputs = [("DIRECTORY", str(project / "classes")), ("DIRECTORY", str(project / "classes" / "py4j")), ("DIRECTORY", str(tmp_path))]
    decoded = c.decode_entries(c.read_inputs(spark, inputs)).persist()
    classes, shadows, diagnostics = resolve(decoded)
    types = types_table(classes)
    assert types.count() == shadows.count() == types.select("binary_name").distinct().count()
    assert [r["diagnostic"].startswith("CLASS_DAMAGED") for r in diagnostics.collect()] == [True]
    assert bounded_diagnostics(diagnostics, 0).collect()[0]["diagnostic"] == "LIMIT 1"
    with pytest.raises(ImportFailure):
        resolve(decoded, policy="STRICT")
    graph = type_graph(classes)
    edges = {(r["origin"], r["target"], r["kind"]) for r in graph.edge_counts().collect()}
    assert ("type:py4j.reflection.MethodInvoker", "type:java.lang.reflect.Method", "METHOD_CALL") in edges
    assert ("type:py4j.reflection.MethodInvoker", "type:java.lang.Object", "EXTENDS") in edges
    assert external_types(graph, types).where("binary_name = 'java.lang.Object'").count() == 1
    assert members_table(classes).where("kind = 'CONSTRUCTOR'").count() > 0


def test_command_line(spark, project):
    out = io.StringIO()
    path = str(project / "rules.properties")
    assert cli.run(["validate-config", path], spark, out) == cli.OK
    assert cli.run(["check", path], spark, out) == cli.OK
    assert cli.run(["check", path, "--format", "sarif"], spark, out) == cli.OK
    assert cli.run(["graph", path, "--format", "mermaid", "--domain", "PACKAGE"], spark, out) == cli.OK
    assert cli.run(["explain", path, "--rule", "only"], spark, out) == cli.OK
    assert cli.run(["check", str(project / "missing")], spark, out) == cli.USAGE
    assert "[PASS] only" in out.getvalue() and "flowchart LR" in out.getvalue()


@pytest.mark.parametrize("line", ["unknown=1", "input.1=../x", "rule.a.type=maybe", "rule.a.type=no\nrule.a.type=no", "rule.a.type=no\nrule.a.origin=glob:a", "rule.a.type=acyclic\nrule.a.origin=x:a", "nonsense"])
def test_configuration_is_strict(tmp_path, line):
    (tmp_path / "c.properties").write_text(("" if line.startswith("input") else "input.1=x\n") + line + "\n")
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "c.properties"))


def test_renderers(spark):
    from latticework.operators.rules.outcome import RuleOutcome, violations
    from latticework.sinks import render

    nodes = spark.createDataFrame([("b",), ('a"<x>',)], "id string")
    edges = spark.createDataFrame([('a"<x>', "b", "=K")], "origin string, target string, kinds string")
    assert render.graph_dot(nodes, edges) == 'digraph dependencies {\n  n000001 [label="a\\"<x>"];\n  n000002 [label="b"];\n  n000001 -> n000002 [label="=K"];\n}\n'
    assert "#34;#60;x#62;" in render.graph_mermaid(nodes, edges)
    assert json.loads(render.graph_json(nodes, edges))["nodes"][1]["id"] == "b"
    assert "&lt;x&gt;" in render.graph_html(nodes, edges) and 'n000002: "b"' in render.graph_d2(nodes, edges)
    with pytest.raises(render.RenderError):
        render.graph_html(nodes, edges, render.HtmlLimits(1, 1))
    assert [r["alias"] for r in render.aliases(nodes).orderBy("id").collect()] == ["n000001", "n000002"]
    assert render.plantuml(["b", "a"], [("a", "b")]) == "@startuml\n[a] as c0001\n[b] as c0002\nc0001 --> c0002\n@enduml\n"
    metadata = RuleMetadata("r<1>").explained("why").tagged("x").with_severity("WARNING")
    rows = edges.withColumnRenamed("kinds", "kind")
    outcome = define(metadata, lambda s, m: RuleOutcome(m, violations(m, rows, "BAD")))(spark)
    result = render.collect(outcome, render.ResultLimits(1))
    assert result.status == FAILED and "[FAIL:POLICY] r<1>" in render.console([result])
    assert json.loads(render.sarif([result]))["runs"][0]["results"][0]["level"] == "warning"
    assert "r&lt;1&gt;" in render.junit_xml([result]) and json.loads(render.results_json([result]))[0]["omitted"] == 0


def test_csv_is_neutral(spark, tmp_path):
    from latticework.sinks import render

    edges = spark.createDataFrame([("=a", "b")], "origin string, target string")
    render.write_csv(edges, str(tmp_path / "n"))
    render.write_csv(edges, str(tmp_path / "l"), lossless=True)
    text = lambda d: "".join(p.read_text() for p in (tmp_path / d).glob("*.csv"))
    assert "\"'=a\"" in text("n") and '"=a"' in text("l")


def test_cache_and_discovery(spark, tmp_path):
    made = []

    def compute():
        made.append(1)
        return spark.range(3)

    key = cache_key("a", "b")
    assert [load_or_compute(spark, str(tmp_path / "c"), key, compute)[1] for _ in range(2)] == ["COMPUTED", "HIT"]
    assert len(made) == 1 and key != cache_key("ab")
    (tmp_path / "p/m/target/classes").mkdir(parents=True)
    (tmp_path / "p/pom.xml").write_text("<project><modules><module>m</module><!--<module>x</module>--></modules></project>")
    (tmp_path / "p/m/pom.xml").write_text("<project/>")
    (tmp_path / "g/sub/build/classes/java/main").mkdir(parents=True)
    (tmp_path / "g/settings.gradle").write_text("include ':sub'\n")
    (tmp_path / "g/sub/build.gradle").write_text("")
    assert [len(m.classes) for m in discovery.discover(str(tmp_path / "p"))] == [0, 1]
    assert [m.tool for m in discovery.discover(str(tmp_path / "g"))] == ["GRADLE", "GRADLE"]
    (tmp_path / "p/m/pom.xml").write_text("<module>../../g</module>")
    with pytest.raises(discovery.DiscoveryError):
        discovery.discover(str(tmp_path / "p"))


def test_stream_replay_leaves_the_same_graph(spark, tmp_path):
    from latticework.plans.graph import conform
    from latticework.streaming.evidence import append, evidence_stream, graph_at

    rows = conform(spark.createDataFrame([("type:A", "type:B", "METHOD_CALL", "location:x")], "origin string, target string, kind string, location string"))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k in (1, 2):  # the second time everything is replayed from a new checkpoint
        rows.write.mode("append").parquet(source)
        append(evidence_stream(spark, source), target, str(tmp_path / f"check{k}")).awaitTermination()
        assert graph_at(spark, target).evidence.count() == 1


def test_baseline_greedy_pairing(spark, tmp_path):
    from latticework.operators import baseline as b

    found = lambda *places: b.fingerprints(spark.createDataFrame([("r", "c", "s", x) for x in places], "rule_id string, code string, subject_id string, location string"))
    name = {r["evidence_fp"]: r["location"] for r in found("1", "2", "3").collect()}
    first, second = sorted(name, key=lambda fp: fp)[:2]
    state = lambda old, new: {name[r["evidence_fp"]]: r["state"] for r in b.compare(found(*old), found(*new)).collect()}
    # The first current finding takes the only one there is, although a later one equals it.
    assert state([name[second]], [name[first], name[second]]) == {name[first]: "MOVED", name[second]: "NEW"}
    assert state(["1", "2"], ["1"]) == {"1": "UNCHANGED", "2": "RESOLVED"}
    b.write_baseline(found("1", "2"), str(tmp_path / "base"))
    back = b.read_baseline(spark, str(tmp_path / "base"))
    assert {r["state"] for r in b.compare(back, found("1", "2")).collect()} == {"UNCHANGED"}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"schema_version":"baseline-1","other":1}\n')
    with pytest.raises(ValueError):
        b.read_baseline(spark, str(tmp_path / "bad"))
