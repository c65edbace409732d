"""Dependency rules NO, ONLY, ANY and REQUIRED, and the rules over slices and layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.identity import UNASSIGNED
from latticework.operators.grouping import grouped
from latticework.operators.rules.outcome import RuleMetadata, RuleOutcome, diagnostics, violations
from latticework.plans.graph import EDGE, Graph


@dataclass(frozen=True)
class DependencySpec:
    """mode NO, ONLY, ANY or REQUIRED; external IGNORE, TREAT_AS_NON_MATCHING or FAIL."""

    mode: str
    ignore_self: bool = True
    external: str = "IGNORE"


def _edges(graph: Graph) -> DataFrame:
    return graph.evidence.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("n"))


def dependency_rule(metadata: RuleMetadata, graph: Graph, known: DataFrame, origins: DataFrame, targets: DataFrame, spec: DependencySpec, on_empty: str = "FAIL") -> RuleOutcome:
    """known, origins and targets: one column ``id``.

    NO: no edge to a selected target.  ONLY: no edge to another.  ANY: some origin has a matching edge, else one
    violation at the first.  REQUIRED: every origin has one.  An external target (not known) is left out,
    judged as not selected, or, under FAIL, diagnosed and judged like any other.
    """
    rows = _edges(graph).join(origins.select(F.col("id").alias("origin")).distinct(), "origin", "left_semi")
    if spec.ignore_self:
        rows = rows.where("origin <> target")
    here = known.select(F.col("id").alias("target")).distinct().withColumn("here", F.lit(True))
    chosen = targets.select(F.col("id").alias("target")).distinct().withColumn("chosen", F.lit(True))
    rows = rows.join(here, "target", "left").join(chosen, "target", "left").select(*EDGE, "n", F.col("here").isNull().alias("external"), F.coalesce("chosen", F.lit(False)).alias("matches"))
    incomplete = None
    if spec.external == "IGNORE":
        rows = rows.where("NOT external")
    elif spec.external == "TREAT_AS_NON_MATCHING":
        rows = rows.withColumn("matches", F.col("matches") & ~F.col("external"))
    else:
        incomplete = diagnostics(metadata, rows.where("external").groupBy("target").agg(F.count(F.lit(1)).alias("k")), "EXTERNAL_DEPENDENCY", "target", F.col("k"))
    matched = rows.where("matches").select("origin").distinct()
    if spec.mode == "NO":
        found = violations(metadata, rows.where("matches"), "FORBIDDEN_DEPENDENCY", n="n")
    elif spec.mode == "ONLY":
        found = violations(metadata, rows.where("NOT matches"), "DEPENDENCY_OUTSIDE", n="n")
    elif spec.mode == "REQUIRED":
        missing = origins.select(F.col("id").alias("origin")).distinct().join(matched, "origin", "left_anti")
        found = violations(metadata, missing, "MISSING_DEPENDENCY", target=None, kind=None)
    elif spec.mode == "ANY":
        first = origins.agg(F.min("id").alias("origin")).where("origin IS NOT NULL")
        any_ = matched.agg(F.count(F.lit(1)).alias("k")).where("k = 0")
        found = violations(metadata, first.join(any_), "NO_MATCHING_DEPENDENCY", target=None, kind=None)  # one row by one row
    else:
        raise ValueError(f"mode {spec.mode!r} isn't known")
    return RuleOutcome(metadata, found, incomplete, origins.agg(F.count(F.lit(1)).alias("n")), on_empty, incomplete=incomplete)


def _grouped(graph: Graph, membership: DataFrame, kinds: list[str] | None, unassigned: str | None) -> DataFrame:
    """(group_origin, group_target, n_evidence) of edges between unlike groups."""
    rows = grouped(graph, membership, unassigned).where("group_origin <> group_target")
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(kinds) if kinds else F.lit(False))
    rows = rows if graph.unique else rows.distinct()
    return rows.groupBy("group_origin", "group_target").agg(F.count(F.lit(1)).alias("n_evidence"))


def slice_rule(metadata: RuleMetadata, graph: Graph, membership: DataFrame, origins: list[str], targets: list[str], kinds: list[str] | None = None) -> RuleOutcome:
    """No dependency from an origin slice to a target slice; types of no slice are left out."""
    rows = _grouped(graph, membership, kinds, None).where(F.col("group_origin").isin(origins) & F.col("group_target").isin(targets))
    return RuleOutcome(metadata, violations(metadata, rows, "SLICE_DEPENDENCY", origin="group_origin", target="group_target", kind=None, n="n_evidence"))


def slices_independent(metadata: RuleMetadata, graph: Graph, membership: DataFrame, kinds: list[str] | None = None) -> RuleOutcome:
    """No dependency between two slices either way: one violation an unordered pair."""
    rows = _grouped(graph, membership, kinds, None)
    pairs = rows.groupBy(F.least("group_origin", "group_target").alias("a"), F.greatest("group_origin", "group_target").alias("b")).agg(F.sum("n_evidence").alias("n_evidence"))
    return RuleOutcome(metadata, violations(metadata, pairs, "SLICES_DEPEND", origin="a", target="b", kind=None, n="n_evidence"))


def layer_counts(graph: Graph, membership: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(group_origin, group_target, n_evidence) between unlike layers."""
    return _grouped(graph, membership, kinds, UNASSIGNED.removeprefix("layer:"))


def layer_rule(metadata: RuleMetadata, graph: Graph, membership: DataFrame, mode: str, subject: list[str], others: list[str] = (), kinds: list[str] | None = None, *, counted: DataFrame | None = None) -> RuleOutcome:
    """NO_ACCESS, MAY_ONLY_ACCESS, ONLY_ACCESSED_BY or ISOLATED; types of no layer are the layer ``<unassigned>``.

    Edges within a layer never count.  An empty ``others`` is an intentional empty allow-list.  ``counted`` is what
    ``layer_counts`` gives, for several rules over one graph.
    """
    a, b = F.col("group_origin"), F.col("group_target")
    bad = {
        "NO_ACCESS": a.isin(subject) & b.isin(list(others)),
        "MAY_ONLY_ACCESS": a.isin(subject) & ~b.isin(list(others)) & ~b.isin(subject),
        "ONLY_ACCESSED_BY": b.isin(subject) & ~a.isin(list(others)) & ~a.isin(subject),
        "ISOLATED": a.isin(subject) | b.isin(subject),
    }[mode]
    rows = (layer_counts(graph, membership, kinds) if counted is None else counted).where(bad)
    return RuleOutcome(metadata, violations(metadata, rows, f"LAYER_{mode}", origin="group_origin", target="group_target", kind=None, n="n_evidence"))
