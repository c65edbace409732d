"""Text renderers of bounded snapshots and rule results.  Only these collect, and only what limits allow."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import escapes
from latticework.functions.classify import SARIF_LEVELS
from latticework.operators.rules.outcome import FAILED, INCOMPLETE, PASSED, SKIPPED, RuleOutcome, top_evidence
from latticework.plans.graph import DETAIL, Graph
from latticework.plans.snapshot import SnapshotQuery

SCHEMA_VERSION = "graph-1"


class RenderError(ValueError):
    """A hard limit is exceeded; nothing is cut off silently."""


@dataclass(frozen=True)
class ResultLimits:
    """Violations a rule, evidence a violation, diagnostics a rule."""

    violations: int = 100
    evidence: int = 20
    diagnostics: int = 100


@dataclass(frozen=True)
class HtmlLimits:
    """Nodes, edges, evidence items and characters of identifiers that a page, or any text form of a graph, shows at most."""

    nodes: int = 2_000
    edges: int = 10_000
    evidence: int = 50_000
    characters: int = 5_000_000


def aliases(nodes: DataFrame) -> DataFrame:
    """(id, alias): n000001 and on, by order of id; for node tables that a snapshot has limited."""
    order = Window.orderBy("id")
    return nodes.select("id", F.format_string("n%06d", F.row_number().over(order)).alias("alias"))


def _rows(nodes: DataFrame, edges: DataFrame, limits: HtmlLimits | None = None) -> tuple[list[str], list]:
    """All nodes and edges in order; a RenderError where there are more than the limits say, before they are collected."""
    limits = limits or HtmlLimits()
    ids = sorted(r["id"] for r in nodes.select("id").limit(limits.nodes + 1).collect())
    rows = sorted(edges.limit(limits.edges + 1).collect(), key=lambda r: (r["origin"], r["target"]))
    if len(ids) > limits.nodes or len(rows) > limits.edges:
        raise RenderError(f"{limits.nodes} nodes and {limits.edges} edges are shown at most")
    if sum(map(len, ids)) + sum(len(str(x)) for r in rows for x in r) > limits.characters:
        raise RenderError(f"{limits.characters} characters of identifiers are shown at most")
    return ids, rows


def _alias_map(ids: list[str]) -> dict[str, str]:
    return {x: f"n{i:06d}" for i, x in enumerate(ids, 1)}


def graph_json(nodes: DataFrame, edges: DataFrame, metadata: dict | None = None) -> str:
    ids, rows = _rows(nodes, edges)
    body = {"schema_version": SCHEMA_VERSION, "nodes": [{"id": x} for x in ids], "edges": [r.asDict() for r in rows], "metadata": metadata or {}}
    return json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def graph_dot(nodes: DataFrame, edges: DataFrame) -> str:
    ids, rows = _rows(nodes, edges)
    alias = _alias_map(ids)
    lines = ["digraph dependencies {", *(f"  {alias[x]} [label={escapes.dot(x)}];" for x in ids)]
    lines += [f"  {alias[r['origin']]} -> {alias[r['target']]} [label={escapes.dot(r['kinds'])}];" for r in rows]
    return "\n".join([*lines, "}"]) + "\n"


def graph_mermaid(nodes: DataFrame, edges: DataFrame) -> str:
    ids, rows = _rows(nodes, edges)
    alias = _alias_map(ids)
    lines = ["flowchart LR", *(f"  {alias[x]}[{escapes.mermaid(x)}]" for x in ids)]
    return "\n".join([*lines, *(f"  {alias[r['origin']]} -->|{escapes.mermaid(r['kinds'])}| {alias[r['target']]}" for r in rows)]) + "\n"


def graph_d2(nodes: DataFrame, edges: DataFrame) -> str:
    ids, rows = _rows(nodes, edges)
    alias = _alias_map(ids)
    lines = [f"{alias[x]}: {escapes.d2(x)}" for x in ids]
    return "\n".join([*lines, *(f"{alias[r['origin']]} -> {alias[r['target']]}: {escapes.d2(r['kinds'])}" for r in rows)]) + "\n"


def graph_html(nodes: DataFrame, edges: DataFrame, limits: HtmlLimits | None = None, evidence: DataFrame | None = None) -> str:
    """A page of nodes and edges and, where given, each edge's evidence (origin, target, kind, location, ...)."""
    limits = limits or HtmlLimits()
    ids, rows = _rows(nodes, edges, limits)
    h = escapes.html_text
    body = "".join(f"<li>{h(x)}</li>" for x in ids)
    table = "".join(f"<tr><td>{h(r['origin'])}</td><td>{h(r['target'])}</td><td>{h(r['kinds'])}</td></tr>" for r in rows)
    proof = ""
    if evidence is not None:
        items = evidence.select("origin", "target", "kind", *DETAIL).limit(limits.evidence + 1).collect()
        if len(items) > limits.evidence:
            raise RenderError(f"{limits.evidence} evidence items are shown at most")
        if sum(len(x) for r in items for x in (r["location"], r["owner_member"], r["source_file"]) if x) > limits.characters:
            raise RenderError(f"{limits.characters} characters of identifiers are shown at most")
        cells = sorted([str(x) if x is not None else "" for x in r] for r in items)
        proof = "<table>" + "".join("<tr>" + "".join(f"<td>{h(c)}</td>" for c in row) + "</tr>" for row in cells) + "</table>"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Dependencies</title></head><body><ul>{body}</ul><table>{table}</table>{proof}</body></html>\n'


def snapshot_parts(query: SnapshotQuery, graph: Graph) -> tuple[dict, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(query block, nodes, their sources, edges, evidence) of a snapshot; each table is as large as the query's limits allow.

    Of each node the first ``max_evidence`` source keys are given, beside their number.
    """
    nodes, edges, metadata = query.snapshot(graph)
    counts = metadata.first().asDict()
    block = {
        "domain": query.domain, "included_kinds": list(query.kinds or ()), "retain_self_edges": query.self_edges,
        "included_nodes": query.include is not None, "excluded_nodes": query.exclude is not None, "mapping": query.mapping is not None,
        "truncated": any(counts[k] for k in ("omitted_nodes", "omitted_edges", "omitted_evidence")),
        "limits": {"max_nodes": query.max_nodes, "max_edges": query.max_edges, "max_evidence_per_edge": query.max_evidence},
    } | counts
    order = Window.partitionBy("id").orderBy("source")
    sources = query.collapsed(graph).join(F.broadcast(nodes.select("id")), "id", "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= query.max_evidence)
    return block, nodes, sources.drop("place"), edges, query.evidence(graph, edges).drop("rank")


def snapshot_json(query: SnapshotQuery, graph: Graph) -> str:
    """A snapshot with its query block, labels, sources, evidence and what was left out, as canonical JSON."""
    block, nodes, sources, edges, evidence = snapshot_parts(query, graph)
    of: dict[str, list[str]] = {}
    for r in sources.collect():
        of.setdefault(r["id"], []).append(r["source"])
    proofs: dict[tuple[str, str], list[dict]] = {}
    for r in evidence.collect():
        proofs.setdefault((r["origin"], r["target"]), []).append({c: r[c] for c in ("kind", *DETAIL)})
    rank = lambda e: [(e[c] is not None, e[c] if e[c] is not None else "") for c in ("kind", *DETAIL)]
    label = lambda key: key.partition(":")[2] or key
    body = {
        "schema_version": SCHEMA_VERSION, "query": block,
        "nodes": [{"id": r["id"], "label": label(r["id"]), "source_node_count": r["n_sources"], "source_node_ids": sorted(of.get(r["id"], []))} for r in sorted(nodes.collect(), key=lambda r: r["id"])],
        "edges": [
            {"id": r["edge_id"], "origin_id": r["origin"], "target_id": r["target"], "dependency_kinds": r["kinds"].split(","), "source_edge_count": r["n_source_edges"], "evidence_count": r["n_evidence"],
             "omitted_evidence_count": r["omitted_evidence"], "evidence": sorted(proofs.get((r["origin"], r["target"]), []), key=rank)}
            for r in sorted(edges.collect(), key=lambda r: (r["origin"], r["target"]))
        ],
    }
    return json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":")) + "\n"


#: Columns of a snapshot's CSV: what a row is of does not use stays empty.
CSV_COLUMNS = ("record", "id", "origin", "target", "label", "kinds", "n_sources", "n_evidence", "omitted_evidence", *DETAIL)


def write_snapshot_csv(query: SnapshotQuery, graph: Graph, path: str, *, lossless: bool = False) -> None:
    """One CSV table of metadata, node, node-source, edge and evidence rows, by Spark's writer."""
    block, nodes, sources, edges, evidence = snapshot_parts(query, graph)
    flat = {k: v for k, v in block.items() if k != "limits"} | block["limits"]
    meta = graph.nodes.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in sorted(flat.items())], "id string, label string")
    parts = {
        "metadata": meta, "node": nodes.select("id", F.regexp_replace("id", "^[^:]*:", "").alias("label"), "n_sources"), "node-source": sources.select(F.col("source").alias("id"), F.col("id").alias("origin")),
        "edge": edges.select(F.col("edge_id").alias("id"), "origin", "target", "kinds", F.col("n_source_edges").alias("n_sources"), "n_evidence", "omitted_evidence"),
        "evidence": evidence.withColumnRenamed("kind", "kinds"),
    }
    out = None
    for record, rows in parts.items():
        rows = rows.select(*((F.lit(record) if c == "record" else F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in CSV_COLUMNS))
        out = rows if out is None else out.unionByName(rows)
    write_csv(out.fillna(""), path, lossless=lossless)


def write_csv(edges: DataFrame, path: str, *, lossless: bool = False) -> None:
    """Edges as quoted CSV by Spark's writer; unless ``lossless``, cells that would start a formula are neutralised."""
    columns = [F.col(c).cast("string") if lossless else escapes.neutral_csv(F.col(c).cast("string")).alias(c) for c in edges.columns]
    edges.select(columns).write.option("header", True).option("quoteAll", True).csv(path)


def plantuml(groups: list[str], arrows: list[tuple[str, str]]) -> str:
    """Groups as components c0001 and on by name, arrows always ``-->``."""
    alias = {g: f"c{i:04d}" for i, g in enumerate(sorted(groups), 1)}
    lines = ["@startuml", *(f"[{g}] as {alias[g]}" for g in sorted(groups)), *(f"{alias[a]} --> {alias[b]}" for a, b in sorted(set(arrows)))]
    return "\n".join([*lines, "@enduml"]) + "\n"


# ---- rule results ----------------------------------------------------------------------------------

#: How a console line begins, by status.
_MARKS = {PASSED: "[PASS]", FAILED: "[FAIL:POLICY]", SKIPPED: "[SKIP]", INCOMPLETE: "[ERROR:ANALYSIS]"}


@dataclass(frozen=True)
class Result:
    """One rule's bounded result."""

    rule_id: str
    description: str
    status: str
    violations: list[dict]
    omitted: int
    diagnostics: list[dict]


def collect(outcome: RuleOutcome, limits: ResultLimits | None = None, evidence: DataFrame | None = None) -> Result:
    """The first violations and diagnostics in order, and how many are left out.

    ``evidence`` (origin, target, kind, ...) gives each violation shown its first rows, up to ``limits.evidence``, and their number.
    """
    limits = limits or ResultLimits()
    first = outcome.violations.orderBy("origin", "target", "kind", "violation_id").limit(limits.violations)
    shown = [r.asDict() for r in first.collect()]
    if evidence is not None and shown:
        ends = ["origin", "target", "kind"]
        rows = evidence.join(F.broadcast(first.select(*ends).distinct()), ends, "left_semi")  # limits.violations rows at most
        found = {tuple(r[c] for c in ends): r for r in top_evidence(rows, ends, limits.evidence).collect()}
        for v in shown:
            r = found.get(tuple(v[c] for c in ends))
            v["evidence"] = [e.asDict() for e in r["evidence"]] if r else []
            v["omitted_evidence"] = r["omitted"] if r else 0
    total = outcome.violations.count() if len(shown) == limits.violations else len(shown)
    notes = [] if outcome.diagnostics is None else [r.asDict() for r in outcome.diagnostics.orderBy("code", "subject").limit(limits.diagnostics).collect()]
    return Result(outcome.metadata.rule_id, outcome.metadata.description, outcome.status(), shown, total - len(shown), notes)


def _line(v: dict) -> str:
    return " ".join(str(v[k]) for k in ("code", "origin", "target", "kind") if v[k] is not None)


def console(results: list[Result]) -> str:
    out = []
    for r in results:
        out.append(f"{_MARKS[r.status]} {r.rule_id} {r.description}".rstrip())
        for v in r.violations:
            out.append(f"  {_line(v)}")
            out += [f"    at {e['location'] or '?'}" + (f":{e['line_number']}" if e["line_number"] is not None else "") for e in v.get("evidence", ())]
            out += [f"    ... {v['omitted_evidence']} more"] if v.get("omitted_evidence") else []
        out += [f"  ... {r.omitted} more"] if r.omitted else []
        out += [f"  ! {d['code']} {d['subject']} ({d['n']})" for d in r.diagnostics]
    return "\n".join(out) + "\n"


def results_json(results: list[Result]) -> str:
    return json.dumps([vars(r) for r in results], sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def sarif(results: list[Result]) -> str:
    rules = [{"id": r.rule_id, "shortDescription": {"text": r.description or r.rule_id}} for r in results]
    found = [
        {"ruleId": r.rule_id, "level": SARIF_LEVELS[v["severity"]], "message": {"text": _line(v)}, "partialFingerprints": {"violation/v1": v["violation_id"]}, "locations": [{"logicalLocations": [{"fullyQualifiedName": v["origin"]}]}]}
        for r in results
        for v in r.violations
    ]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "latticework", "rules": rules}}, "results": found}]}, sort_keys=True)


def junit_xml(results: list[Result]) -> str:
    h = escapes.html_text
    cases = []
    for r in results:
        inner = {FAILED: f'<failure message="{len(r.violations) + r.omitted} violations">{h(chr(10).join(map(_line, r.violations)))}</failure>', INCOMPLETE: '<error message="incomplete"/>', SKIPPED: "<skipped/>"}.get(r.status, "")
        cases.append(f'<testcase name="{h(r.rule_id)}">{inner}</testcase>')
    count = lambda s: sum(r.status == s for r in results)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="architecture" tests="{len(results)}" failures="{count(FAILED)}" errors="{count(INCOMPLETE)}" skipped="{count(SKIPPED)}">{"".join(cases)}</testsuite>\n'
