"""Module descriptors, diagrams and presets."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.patterns import NamePattern
from latticework.operators.algorithms import cut
from latticework.operators.grouping import Layer, group_edges, grouped, layer_membership
from latticework.operators.rules.dependencies import layer_counts, layer_rule
from latticework.operators.rules.outcome import RuleMetadata, RuleOutcome, diagnostics, violations
from latticework.plans.graph import Graph

DIRECTIVES = ("requires", "exports", "opens", "uses", "provides")


def module_directives(metadata: RuleMetadata, modules: DataFrame, directive: str, pattern: NamePattern, mode: str, *, non_explicit: str = "SKIP") -> RuleOutcome:
    """NO, ONLY or REQUIRED over a directive's names (an array column of that name) of the EXPLICIT modules.

    Modules that are not explicit have no descriptor: SKIP leaves them out (and skips the rule where nothing
    else is selected), FAIL makes it INCOMPLETE.
    """
    if directive not in DIRECTIVES:
        raise ValueError(f"a directive is one of {DIRECTIVES}")
    explicit = modules.where("kind = 'EXPLICIT'")
    other = modules.where("kind <> 'EXPLICIT'")
    names = explicit.select("name", F.explode(directive).alias("value"))
    fits = pattern.matches(F.col("value"))
    if mode == "REQUIRED":
        bad = explicit.select("name").join(names.where(fits).select("name").distinct(), "name", "left_anti").withColumn("value", F.lit(None).cast("string"))
    else:
        bad = names.where(fits if mode == "NO" else ~fits)
    incomplete = diagnostics(metadata, other, "NO_DESCRIPTOR", "name") if non_explicit == "FAIL" else None
    counts = modules.agg(F.count_if(F.col("kind") == "EXPLICIT"), F.count(F.lit(1))).first()
    skipped = "no explicit module" if non_explicit == "SKIP" and not counts[0] and counts[1] else None
    return RuleOutcome(metadata, violations(metadata, bad, f"MODULE_{directive.upper()}_{mode}", origin="name", target="value", kind=None), incomplete, modules.agg(F.count(F.lit(1)).alias("n")), skipped=skipped, incomplete=incomplete)


def compare_modules(declared: DataFrame, connections: DataFrame, membership: DataFrame) -> DataFrame:
    """(origin, target, state): module pairs DECLARED_ONLY, OBSERVED_ONLY or BOTH; observed pairs come from type connections."""
    seen = group_edges(connections, membership.withColumnRenamed("module", "group_id")).where("group_origin <> group_target")
    seen = seen.select(F.col("group_origin").alias("origin"), F.col("group_target").alias("target")).distinct().withColumn("seen", F.lit(True))
    both = declared.select("origin", "target").distinct().withColumn("said", F.lit(True)).join(seen, ["origin", "target"], "full")
    state = F.when(F.col("said").isNull(), "OBSERVED_ONLY").when(F.col("seen").isNull(), "DECLARED_ONLY").otherwise("BOTH")
    return both.select("origin", "target", state.alias("state"))


def unmapped_connections(connections: DataFrame, membership: DataFrame) -> DataFrame:
    """(unmapped, n): how many connections ``compare_modules`` cannot place, by which of their ends has no module (ORIGIN, TARGET, BOTH)."""
    end = lambda k: membership.select(F.col("type_key").alias(k), F.lit(True).alias(f"{k}_there")).distinct()
    rows = connections.join(end("origin"), "origin", "left").join(end("target"), "target", "left")
    o, t = F.col("origin_there").isNull(), F.col("target_there").isNull()
    side = F.when(o & t, "BOTH").when(o, "ORIGIN").when(t, "TARGET")
    return rows.select(side.alias("unmapped")).where("unmapped IS NOT NULL").groupBy("unmapped").agg(F.count(F.lit(1)).alias("n"))


FLAG_POLICIES = ("ANY", "REQUIRED", "FORBIDDEN")
QUALIFICATIONS = ("ANY", "UNQUALIFIED", "QUALIFIED")


def _flag(c: Column, policy: str) -> Column:
    if policy not in FLAG_POLICIES:
        raise ValueError(f"a policy is one of {FLAG_POLICIES}")
    there = F.coalesce(c, F.lit(False))
    return {"ANY": F.lit(True), "REQUIRED": there, "FORBIDDEN": ~there}[policy]


def declaration_rule(
    metadata: RuleMetadata, modules: DataFrame, declarations: DataFrame, pattern: NamePattern, mode: str, *, transitive: str = "ANY", static: str = "ANY",
    qualification: str = "ANY", targets: NamePattern | None = None, non_explicit: str = "SKIP",
) -> RuleOutcome:
    """NO, ONLY or REQUIRED over one kind of directive: a declaration (name, value, transitive, static, targets) fits by its value's pattern, flags and targets.

    transitive and static are those of ``requires``.  ``targets`` are the modules of a qualified export or opening, or the
    providers of a service: all must fit under ONLY, one under NO and REQUIRED; no target fits where a pattern asks for one.
    """
    if qualification not in QUALIFICATIONS:
        raise ValueError(f"a qualification is one of {QUALIFICATIONS}")
    explicit = modules.where("kind = 'EXPLICIT'").select("name").distinct()
    rows = declarations.join(explicit, "name", "left_semi")
    fits = pattern.matches(F.col("value")) & _flag(F.col("transitive"), transitive) & _flag(F.col("static"), static)
    qualified = F.coalesce(F.size("targets") > 0, F.lit(False))
    if qualification != "ANY":
        fits = fits & (qualified if qualification == "QUALIFIED" else ~qualified)
    if targets is not None:
        fits = fits & qualified & (F.forall if mode == "ONLY" else F.exists)(F.coalesce("targets", F.array().cast("array<string>")), targets.matches)
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False)))
    if mode == "REQUIRED":
        bad = explicit.join(rows.where("fits").select("name").distinct(), "name", "left_anti").withColumn("value", F.lit(None).cast("string"))
    elif mode in ("NO", "ONLY"):
        bad = rows.where(F.col("fits") if mode == "NO" else ~F.col("fits")).select("name", "value").distinct()
    else:
        raise ValueError("a mode is NO, ONLY or REQUIRED")
    other = modules.where("kind <> 'EXPLICIT'")
    incomplete = diagnostics(metadata, other, "NO_DESCRIPTOR", "name") if non_explicit == "FAIL" else None
    return RuleOutcome(metadata, violations(metadata, bad, f"MODULE_DIRECTIVE_{mode}", origin="name", target="value", kind=None), incomplete, modules.agg(F.count(F.lit(1)).alias("n")), incomplete=incomplete)


_ALIAS = re.compile(r"^\[([^\]\n]+)\](?:\s+as\s+(\w+))?(?:\s+<<([^<>\n]+)>>)?$")
_ARROW = re.compile(r"^(\[[^\]\n]+\]|\w+)\s+(-+>|<-+)\s+(\[[^\]\n]+\]|\w+)(?:\s*:.*)?$")
MAX_DIAGRAM = 65_536


class DiagramError(ValueError):
    """A line is outside the allowed grammar."""


def parse_diagram(text: str) -> tuple[list[tuple[str, str | None]], list[tuple[str, str]]]:
    """(components with stereotype, arrows) of a component diagram: ``[Name] as x <<pattern>>`` and ``x --> y`` lines only."""
    if len(text) > MAX_DIAGRAM:
        raise DiagramError("the diagram is too long")
    components: dict[str, str | None] = {}
    alias: dict[str, str] = {}
    arrows: list[tuple[str, str]] = []

    def name(token: str) -> str:
        if token.startswith("["):
            components.setdefault(token[1:-1], None)
            return token[1:-1]
        if token not in alias:
            raise DiagramError(f"{token} isn't declared")
        return alias[token]

    lines = [x.strip() for x in text.strip().splitlines()]
    if len(lines) < 2 or lines[0] != "@startuml" or lines[-1] != "@enduml":
        raise DiagramError("a diagram begins with @startuml and ends with @enduml")
    for line in lines[1:-1]:
        if not line or line.startswith("'"):
            continue
        if m := _ALIAS.match(line):
            if components.get(m[1]) is not None or m[2] in alias:
                raise DiagramError(f"{m[1]} is declared twice")
            components[m[1]] = m[3]
            alias[m[2] or m[1]] = m[1]
        elif m := _ARROW.match(line):
            a, b = name(m[1]), name(m[3])
            arrows.append((b, a) if m[2].startswith("<") else (a, b))
        else:
            raise DiagramError(f"{line!r} isn't allowed")
    return sorted(components.items()), sorted(set(arrows))


def diagram_rule(metadata: RuleMetadata, graph: Graph, membership: DataFrame, arrows: list[tuple[str, str]], *, require_declared: bool = False, unmapped: str = "IGNORE") -> RuleOutcome:
    """Group dependencies that the diagram lacks, and (require_declared) arrows that nothing observes.

    Edges with neither end in a group never count; one end alone is unmapped: IGNORE, VIOLATE or FAIL (incomplete).
    """
    spark = graph.nodes.sparkSession
    drawn = spark.createDataFrame(arrows, "group_origin string, group_target string")
    nowhere = "<unmapped>"
    rows = grouped(graph, membership, nowhere).select("origin", "target", "group_origin", "group_target").where("group_origin <> group_target").distinct()
    seen = rows.where(f"group_origin <> group_target AND group_origin <> '{nowhere}' AND group_target <> '{nowhere}'").groupBy("group_origin", "group_target").agg(F.count(F.lit(1)).alias("n"))
    bad = seen.join(drawn, ["group_origin", "group_target"], "left_anti").withColumn("code", F.lit("NOT_IN_DIAGRAM"))
    if require_declared:
        bad = bad.unionByName(drawn.join(seen, ["group_origin", "group_target"], "left_anti").select("*", F.lit(0).cast("long").alias("n"), F.lit("NOT_OBSERVED").alias("code")))
    half = rows.where(f"(group_origin = '{nowhere}') <> (group_target = '{nowhere}')").groupBy("group_origin", "group_target").agg(F.count(F.lit(1)).alias("n"))
    incomplete = None
    if unmapped == "VIOLATE":
        bad = bad.unionByName(half.withColumn("code", F.lit("UNMAPPED")))
    elif unmapped == "FAIL":
        incomplete = diagnostics(metadata, half, "UNMAPPED", "group_origin", F.col("n"))
    return RuleOutcome(metadata, violations(metadata, bad, F.col("code"), origin="group_origin", target="group_target", kind=None, n="n"), incomplete, incomplete=incomplete)


@dataclass(frozen=True)
class Preset:
    """A named bundle of layers and the layers each may access; editable, then checked as layer rules."""

    name: str
    layers: tuple[str, ...]
    allowed: tuple[tuple[str, tuple[str, ...]], ...]

    def allowing(self, layer: str, *others: str) -> Preset:
        table = dict(self.allowed)
        table[layer] = tuple(sorted({*table.get(layer, ()), *others}))
        return replace(self, allowed=tuple(sorted(table.items())))

    def without(self, layer: str) -> Preset:
        return replace(self, layers=tuple(x for x in self.layers if x != layer), allowed=tuple((k, tuple(x for x in v if x != layer)) for k, v in self.allowed if k != layer))

    def check(self, graph: Graph, types: DataFrame, predicates: dict[str, Column], *, severity: str = "ERROR") -> list[RuleOutcome]:
        """One MAY_ONLY_ACCESS rule a layer; optional layers may be empty."""
        membership = layer_membership(types, [Layer(x, predicates[x], required=False) for x in self.layers if x in predicates])
        counted = cut(layer_counts(graph, membership), "layers")  # the graph is read once for all rules
        return [layer_rule(RuleMetadata(f"{self.name}.{k}", severity=severity), graph, membership, "MAY_ONLY_ACCESS", [k], list(v), counted=counted) for k, v in self.allowed if k in predicates]


def clean() -> Preset:
    return Preset("clean", ("entities", "usecases", "adapters", "frameworks"), (("adapters", ("entities", "usecases")), ("entities", ()), ("frameworks", ("adapters", "entities", "usecases")), ("usecases", ("entities",))))


def onion() -> Preset:
    return Preset("onion", ("domain_model", "domain_service", "application", "adapter"), (("adapter", ("application", "domain_model", "domain_service")), ("application", ("domain_model", "domain_service")), ("domain_model", ()), ("domain_service", ("domain_model",))))


def hexagonal() -> Preset:
    return Preset("hexagonal", ("domain", "ports", "application", "adapters"), (("adapters", ("application", "domain", "ports")), ("application", ("domain", "ports")), ("domain", ()), ("ports", ("domain",))))


def provider_sdk() -> Preset:
    return Preset("provider_sdk", ("api", "spi", "implementation"), (("api", ()), ("implementation", ("api", "spi")), ("spi", ("api",))))
