"""Cycles, coverage, naming, inheritance, annotations, member access, reachability and public interfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.patterns import NamePattern
from latticework.operators.algorithms import cut, reachable, representative_cycles, strongly_connected
from latticework.operators.hierarchy import first_paths, supertypes
from latticework.operators.rules.outcome import RuleMetadata, RuleOutcome, diagnostics, violations
from latticework.plans.graph import Graph


def acyclic(metadata: RuleMetadata, graph: Graph, selected: DataFrame, *, kinds: list[str] | None = None, keep_synthetic: bool = True, by: str = "parts") -> RuleOutcome:
    """No cyclic component among the selected nodes (stable_key): one violation a component, with a representative cycle.

    Evidence whose owner is compiler-made (column ``synthetic``) can be left out first; then the graph is induced, so a cycle through an unselected node does not count.
    """
    g = graph
    if not keep_synthetic:
        g = g.without_evidence(F.col("synthetic"))
    if kinds is not None:
        g = Graph(g.nodes, g.rows.where(F.col("kind").isin(kinds) if kinds else F.lit(False)))
    # What evidence is made from may be costly: connections and nodes are tables before anything is read twice.
    selected = cut(selected.select("stable_key"), "selected")
    g = Graph(g.nodes, cut(g.connections(), "connections"), True).induced(selected)
    edges = g.connections()
    parts = strongly_connected(edges, g.nodes.select(F.col("stable_key").alias("id")), by=by)
    parts = cut(parts, "strong")
    shown = representative_cycles(edges, parts).select("component", F.array_join("closed_path", " -> ").alias("path"))
    rows = parts.where("cyclic").select("component", "size").distinct().join(shown, "component", "left")
    found = violations(metadata, rows, "CYCLE", origin="component", target="path", kind=None, n="size")
    return RuleOutcome(metadata, found, selected=selected.agg(F.count(F.lit(1)).alias("n")))


def coverage(metadata: RuleMetadata, subjects: DataFrame, policies: DataFrame, exclusions: DataFrame | None = None) -> RuleOutcome:
    """Every subject (id) not excluded has exactly one policy (id, policy)."""
    if exclusions is not None:
        subjects = subjects.join(exclusions.select("id"), "id", "left_anti")
    counted = policies.select("id", "policy").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    rows = subjects.select("id").distinct().join(counted, "id", "left").withColumn("k", F.coalesce("k", F.lit(0))).where("k <> 1")
    code = F.when(F.col("k") == 0, "UNASSIGNED").otherwise("MULTIPLY_ASSIGNED")
    return RuleOutcome(metadata, violations(metadata, rows, code, origin="id", target=None, kind=None, n="k"), selected=subjects.agg(F.count(F.lit(1)).alias("n")))


def naming(metadata: RuleMetadata, values: DataFrame, pattern: NamePattern, *, must_match: bool = True) -> RuleOutcome:
    """Each (id, value) matches, or must not; a missing value violates MUST_MATCH and passes MUST_NOT_MATCH."""
    fits = F.coalesce(pattern.matches(F.col("value")), F.lit(False))
    rows = values.where(~fits if must_match else fits)
    code = F.when(F.col("value").isNull(), "NAME_MISSING").otherwise("NAME_DOES_NOT_MATCH" if must_match else "NAME_MATCHES")
    return RuleOutcome(metadata, violations(metadata, rows, code, origin="id", target="value", kind=None), selected=values.agg(F.count(F.lit(1)).alias("n")))


def inheritance(metadata: RuleMetadata, relations: DataFrame, known: DataFrame, subjects: DataFrame, targets: DataFrame, *, must: bool = True, transitive: bool = True, kinds: tuple[str, ...] = ("EXTENDS", "IMPLEMENTS"), unknown: str = "FAIL", allow_incomplete: bool = False) -> RuleOutcome:
    """Subjects (id) must, or must not, have a target (id) among their supertypes.

    A subject whose hierarchy is incomplete and without a match is unresolved: it is left out and, under FAIL,
    makes the rule INCOMPLETE, unless incomplete analysis is allowed; then it counts as missing.
    """
    relations = relations.where(F.col("kind").isin(*kinds))
    if transitive:
        up = supertypes(relations.join(relations.select("origin").distinct(), "origin", "left_semi"), known)
        paths = first_paths(relations, subjects, targets).select("subject", "target", F.array_join("path", " -> ").alias("path"))
    else:
        up = relations.select("origin", "target").distinct().join(known.select(F.col("id").alias("target"), F.lit(True).alias("here")), "target", "left").withColumn("missing", F.col("here").isNull())
        paths = relations.join(subjects.select(F.col("id").alias("origin")), "origin", "left_semi").join(targets.select(F.col("id").alias("target")), "target", "left_semi")
        paths = paths.select(F.col("origin").alias("subject"), "target", F.concat_ws(" -> ", "origin", "target").alias("path"))
    matched = paths.select("subject").distinct()
    unresolved = subjects.select(F.col("id").alias("subject")).join(matched, "subject", "left_anti").join(up.where("missing").select(F.col("origin").alias("subject")).distinct(), "subject", "left_semi")
    incomplete = diagnostics(metadata, unresolved, "HIERARCHY_INCOMPLETE", "subject") if unknown == "FAIL" and not allow_incomplete else None
    if not must:
        return RuleOutcome(metadata, violations(metadata, paths, "INHERITS_FORBIDDEN", origin="subject", target="target", kind="path"), incomplete, subjects.agg(F.count(F.lit(1)).alias("n")), incomplete=incomplete)
    missing = subjects.select(F.col("id").alias("subject")).distinct().join(matched, "subject", "left_anti")
    if not allow_incomplete:
        missing = missing.join(unresolved, "subject", "left_anti")
    return RuleOutcome(metadata, violations(metadata, missing, "INHERITANCE_MISSING", origin="subject", target=None, kind=None), incomplete, subjects.agg(F.count(F.lit(1)).alias("n")), incomplete=incomplete)


def value_condition(elements: Column, name: str, condition: str, value: str | None = None) -> Column:
    """PRESENT, ABSENT, EQUALS or NOT_EQUALS over array<struct<name,value>>; NOT_EQUALS asks for the element with another value."""
    there = F.exists(elements, lambda e: e["name"] == name)
    if condition == "PRESENT":
        return there
    if condition == "ABSENT":
        return ~there
    same = F.exists(elements, lambda e: (e["name"] == name) & (e["value"] == value))
    return same if condition == "EQUALS" else there & ~same


def annotation_rule(metadata: RuleMetadata, subjects: DataFrame, annotated: DataFrame, *, require: bool = True) -> RuleOutcome:
    """Subjects (id) must, or must not, be among the annotated (subject): types, members, parameters or packages."""
    found = annotated.select(F.col("subject").alias("id")).distinct()
    rows = subjects.select("id").distinct().join(found, "id", "left_anti" if require else "left_semi")
    return RuleOutcome(metadata, violations(metadata, rows, "ANNOTATION_MISSING" if require else "ANNOTATION_FORBIDDEN", origin="id", target=None, kind=None), selected=subjects.agg(F.count(F.lit(1)).alias("n")))


def member_access(metadata: RuleMetadata, accesses: DataFrame, callers: DataFrame, targets: DataFrame, mode: str, *, kinds: list[str] | None = None, show_compiler_made: bool = False) -> RuleOutcome:
    """NO, ONLY, ANY or REQUIRED over call sites (caller, target_owner, target_name, target_desc, kind, offset, compiler_created).

    Targets are symbolic (owner, name, descriptor): never dispatched, and array owners match nothing.  NO and ONLY give one
    violation a caller, target and kind, with the number of its call sites (distinct offsets) as evidence.
    """
    rows = accesses.join(callers.select(F.col("id").alias("caller")).distinct(), "caller", "left_semi")
    if not show_compiler_made:
        rows = rows.where("NOT compiler_created")
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(kinds) if kinds else F.lit(False))
    on = ["target_owner", "target_name", "target_desc"]
    flagged = rows.join(targets.select(F.col("owner").alias("target_owner"), F.col("name").alias("target_name"), F.col("descriptor").alias("target_desc")).distinct().withColumn("chosen", F.lit(True)), on, "left")
    flagged = flagged.withColumn("matches", F.coalesce("chosen", F.lit(False)) & ~F.col("target_owner").startswith("[")).withColumn("target", F.concat("target_owner", F.lit("#"), "target_name", "target_desc"))
    if mode in ("NO", "ONLY"):
        bad = flagged.where(F.col("matches") if mode == "NO" else ~F.col("matches")).groupBy("caller", "target", "kind").agg(F.count_distinct("offset").alias("sites"))
        return RuleOutcome(metadata, violations(metadata, bad, f"ACCESS_{mode}", origin="caller", n="sites"), selected=callers.agg(F.count(F.lit(1)).alias("n")))
    matched = flagged.where("matches").select("caller").distinct()
    if mode == "REQUIRED":
        bad = callers.select(F.col("id").alias("caller")).distinct().join(matched, "caller", "left_anti")
    else:
        bad = callers.agg(F.min("id").alias("caller")).where("caller IS NOT NULL").join(matched.agg(F.count(F.lit(1)).alias("k")).where("k = 0"))
    return RuleOutcome(metadata, violations(metadata, bad, f"ACCESS_{mode}", origin="caller", target=None, kind=None), selected=callers.agg(F.count(F.lit(1)).alias("n")))


def unreachable(metadata: RuleMetadata, graph: Graph, subjects: DataFrame, roots: DataFrame, *, external: DataFrame | None = None, reflective: DataFrame | None = None, ignored: DataFrame | None = None, by: str = "parts") -> RuleOutcome:
    """Subjects (id) that no entry reaches, one violation a strongly connected region of them.

    Entries are roots and what is used from outside or by reflection; ignored nodes leave entries, graph and subjects.
    """
    entries = roots.select("id")
    for more in (external, reflective):
        if more is not None:
            entries = entries.unionByName(more.select("id"))
    edges = graph.connections()
    if ignored is not None:
        gone = ignored.select("id").distinct()
        entries, subjects = entries.join(gone, "id", "left_anti"), subjects.join(gone, "id", "left_anti")
        edges = edges.join(gone.withColumnRenamed("id", "origin"), "origin", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select("origin", "target")
    lost = subjects.select("id").distinct().join(reachable(edges, entries.distinct()).select("id"), "id", "left_anti")
    inner = edges.join(lost.withColumnRenamed("id", "origin"), "origin", "left_semi").join(lost.withColumnRenamed("id", "target"), "target", "left_semi").select("origin", "target")
    parts = strongly_connected(inner, lost, by=by).join(lost, "id", "left_semi")
    regions = parts.select("component", "size").distinct()
    return RuleOutcome(metadata, violations(metadata, regions, "UNREACHABLE", origin="component", target=None, kind=None, n="size"), selected=entries.agg(F.count(F.lit(1)).alias("n")))


def public_roots(types: DataFrame) -> DataFrame:
    """Roots of a public library: its public types."""
    return types.where(F.array_contains("modifiers", "PUBLIC")).select(F.col("type_key").alias("id"))


def public_interface(metadata: RuleMetadata, accesses: DataFrame, consumers: DataFrame, provider: DataFrame, approved_types: DataFrame, approved_members: DataFrame) -> RuleOutcome:
    """Consumers' call sites into the provider hit approved, public and exported members only.

    accesses: origin, target_owner, target_member, offset.  provider: type, member, type_public, member_public, exported.
    Targets that the provider does not hold are counted as unresolved, not violated.
    """
    rows = accesses.join(consumers.select(F.col("id").alias("origin")).distinct(), "origin", "left_semi").join(consumers.select(F.col("id").alias("target_owner")).distinct(), "target_owner", "left_anti")
    types = provider.select(F.col("type").alias("target_owner")).distinct()
    rows = rows.join(types, "target_owner", "left_semi")
    held = rows.join(provider.select(F.col("type").alias("target_owner"), F.col("member").alias("target_member"), "type_public", "member_public", "exported"), ["target_owner", "target_member"], "left")
    ok_type = approved_types.select(F.col("id").alias("target_owner")).distinct().withColumn("ok_type", F.lit(True))
    ok_member = approved_members.select(F.col("id").alias("target_member")).distinct().withColumn("ok_member", F.lit(True))
    held = held.join(ok_type, "target_owner", "left").join(ok_member, "target_member", "left")
    approved = F.coalesce("ok_type", F.lit(False)) | F.coalesce("ok_member", F.lit(False))
    code = F.when(~approved, "NOT_APPROVED").when(~F.col("type_public"), "TYPE_NOT_PUBLIC").when(~F.col("member_public"), "MEMBER_NOT_PUBLIC").when(~F.col("exported"), "NOT_EXPORTED")
    lost = held.where("exported IS NULL").groupBy("target_owner").agg(F.count(F.lit(1)).alias("k"))
    bad = held.where("exported IS NOT NULL").withColumn("code", code).where("code IS NOT NULL").groupBy("origin", "target_member", "code").agg(F.count(F.lit(1)).alias("n"))
    return RuleOutcome(metadata, violations(metadata, bad, F.col("code"), target="target_member", kind=None, n="n"), diagnostics(metadata, lost, "UNRESOLVED_TARGET", "target_owner", F.col("k")))
