"""Command line: check, graph, explain and validate-config over class files."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework import config
from latticework.functions.patterns import parse_ignore
from latticework.operators.rules.dependencies import DependencySpec, dependency_rule
from latticework.operators.rules.outcome import FAILED, INCOMPLETE, SKIPPED, RuleMetadata, RuleOutcome
from latticework.operators.rules.structure import acyclic
from latticework.plans.graph import Graph
from latticework.plans.selectors import named
from latticework.plans.snapshot import SnapshotQuery
from latticework.session import ship
from latticework.sinks import render
from latticework.sources.classfile import decode_entries, read_inputs
from latticework.sources.model import TARGET_RELEASE, resolve, type_graph, types_table

#: Exit codes.
OK, USAGE, TECHNICAL, NOT_DECIDED, VIOLATED = 0, 2, 3, 4, 5
EXTERNAL = {"ignore": "IGNORE", "non-matching": "TREAT_AS_NON_MATCHING", "fail": "FAIL"}
FORMATS: dict[str, Callable[..., str]] = {"console": render.console, "json": render.results_json, "sarif": render.sarif, "junit": render.junit_xml}
GRAPHS: dict[str, Callable[..., str]] = {"json": render.graph_json, "dot": render.graph_dot, "mermaid": render.graph_mermaid, "d2": render.graph_d2, "html": render.graph_html}


class Analysis:
    """The inputs of a configuration, imported once."""

    def __init__(self, spark: SparkSession, c: config.Configuration) -> None:
        ship(spark)
        ignore = parse_ignore(c.ignore.read_text("utf-8")) if c.ignore else None
        entries = read_inputs(spark, [("AUTO", str(p)) for p in c.inputs], manifests=c.manifests, ignore=ignore)
        classes, self.shadows, self.diagnostics = resolve(decode_entries(entries).persist(), release=c.release or TARGET_RELEASE, mode=c.mode)
        self.types, self.graph = types_table(classes), type_graph(classes)

    def rule(self, r: config.RuleConfig) -> RuleOutcome:
        metadata = RuleMetadata(r.rule_id, because=r.because, severity=r.severity.upper())
        pick: Callable[[object], DataFrame] = lambda p: named("binary_name", p).select(self.types).select(F.col("type_key").alias("id"))
        if r.kind == "acyclic":
            return acyclic(metadata, self.graph, pick(r.origin).withColumnRenamed("id", "stable_key"))
        known = self.types.select(F.col("type_key").alias("id"))
        nodes = self.graph.nodes.select(F.regexp_replace("stable_key", "^type:", "").alias("binary_name"), F.col("stable_key").alias("id"))
        targets = named("binary_name", r.target).select(nodes).select("id")
        return dependency_rule(metadata, self.graph, known, pick(r.origin), targets, DependencySpec(r.kind.upper(), external=EXTERNAL[r.external]), r.selection.upper())


def exit_code(statuses: list[str]) -> int:
    """What is not decided outweighs what is violated."""
    if any(s in (INCOMPLETE, SKIPPED) for s in statuses):
        return NOT_DECIDED
    return VIOLATED if FAILED in statuses else OK


def graph_view(graph: Graph, domain: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges, _ = SnapshotQuery(domain).snapshot(graph)
    return nodes, edges


def run(argv: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="latticework")
    parser.add_argument("command", choices=["check", "graph", "explain", "validate-config"])
    parser.add_argument("config")
    parser.add_argument("--format", default=None)
    parser.add_argument("--domain", default="PACKAGE", choices=["PACKAGE", "TYPE"])
    parser.add_argument("--rule", default=None)
    try:
        args = parser.parse_args(argv)
        c = config.load(args.config)
    except (SystemExit, config.ConfigError, OSError) as e:
        print(f"error: {e}", file=out)
        return USAGE
    if args.command == "validate-config":
        print(f"{len(c.inputs)} inputs, {len(c.rules)} rules", file=out)
        return OK
    formats = GRAPHS if args.command == "graph" else FORMATS
    name = args.format or ("dot" if args.command == "graph" else c.output_format)
    rules = [r for r in c.rules if args.rule in (None, r.rule_id)]
    if name not in formats or args.command == "explain" and len(rules) != 1:
        print("error: no such format, or no single rule to explain", file=out)
        return USAGE
    try:
        analysis = Analysis(spark or SparkSession.builder.appName("latticework").getOrCreate(), c)
        damaged = analysis.diagnostics.limit(1).count() > 0
        if args.command == "graph":
            if damaged and not c.allow_incomplete:
                print("error: the import is incomplete", file=out)
                return NOT_DECIDED
            print(GRAPHS[name](*graph_view(analysis.graph, args.domain)), end="", file=out)
            return OK
        results = [render.collect(analysis.rule(r)) for r in rules]
        print(FORMATS[name](results), end="", file=out)
        if args.command == "explain":
            print(f"because: {rules[0].because}\norigin {rules[0].origin.describe()}" + (f"\ntarget {rules[0].target.describe()}" if rules[0].target else ""), file=out)
        statuses = [r.status for r in results]
        return exit_code([*statuses, INCOMPLETE] if damaged and not c.allow_incomplete else statuses)
    except Exception as e:  # the user sees one line; the stack is Spark's log's
        print(f"technical error: {type(e).__name__}: {str(e)[:200]}", file=out)
        return TECHNICAL


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
