"""Type hierarchies: supertypes, three-valued assignability, meta and inherited annotations, sealed hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.algorithms import cut, reachable

OBJECT = "java.lang.Object"


def direct_relations(types: DataFrame) -> DataFrame:
    """(origin, target, kind): EXTENDS and IMPLEMENTS of types (binary_name, superclass, interfaces)."""
    up = types.where("superclass IS NOT NULL").select(F.col("binary_name").alias("origin"), F.col("superclass").alias("target"), F.lit("EXTENDS").alias("kind"))
    faces = types.select(F.col("binary_name").alias("origin"), F.explode("interfaces").alias("target"), F.lit("IMPLEMENTS").alias("kind"))
    return up.unionByName(faces)


def supertypes(relations: DataFrame, known: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(origin, target, depth, missing, cycle): all supertypes of every origin of ``relations`` (origin, target).

    ``missing``: the target is no known type (id); ``cycle``: the target is the origin itself.  Each pair is
    expanded once, at its least depth.
    """
    step = cut(relations.select("origin", "target").distinct(), "up")
    seen = cut(step.withColumn("depth", F.lit(1)), "up-seen")
    frontier, depth = seen, 1
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = frontier.where("origin <> target").select("origin", F.col("target").alias("via")).join(step.select(F.col("origin").alias("via"), "target"), "via")
        nxt = nxt.select("origin", "target").distinct().join(seen, ["origin", "target"], "left_anti")
        frontier = cut(nxt.withColumn("depth", F.lit(depth)), "up-frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    there = known.select(F.col("id").alias("target")).distinct().withColumn("here", F.lit(True))
    out = seen.join(there, "target", "left")
    return out.select("origin", "target", "depth", F.col("here").isNull().alias("missing"), (F.col("origin") == F.col("target")).alias("cycle"))


def assignability(pairs: DataFrame, ancestors: DataFrame, known: DataFrame) -> DataFrame:
    """``pairs`` (source, target) with ``assignable``: YES, NO, or UNKNOWN where an incomplete hierarchy leaves it open.

    A type is assignable to itself, and every known type to java.lang.Object.
    """
    here = known.select(F.col("id").alias("source")).distinct().withColumn("known", F.lit(True))
    complete = ancestors.groupBy(F.col("origin").alias("source")).agg(F.bool_or("missing").alias("incomplete"))
    reach = ancestors.select(F.col("origin").alias("source"), "target").distinct().withColumn("found", F.lit(True))
    rows = pairs.join(here, "source", "left").join(complete, "source", "left").join(reach, ["source", "target"], "left")
    answer = (
        F.when((F.col("source") == F.col("target")) | F.col("found"), "YES")
        .when((F.col("target") == OBJECT) & F.col("known"), "YES")
        .when(F.col("known").isNull() | F.coalesce("incomplete", F.lit(False)), "UNKNOWN")
        .otherwise("NO")
    )
    return rows.select("source", "target", answer.alias("assignable"))


def decided(assignable: Column, policy: str) -> Column:
    """What a selector makes of an answer: UNKNOWN is INCLUDEd or EXCLUDEd, or FAIL raises."""
    unknown = {"INCLUDE": F.lit(True), "EXCLUDE": F.lit(False)}.get(policy)
    if unknown is None:
        unknown = F.raise_error(F.lit("assignability is unknown")).cast("boolean")
    return F.when(assignable == "YES", True).when(assignable == "NO", False).otherwise(unknown)


def meta_annotations(occurrences: DataFrame, *, max_depth: int = 256) -> DataFrame:
    """(annotation, meta, depth): annotations on annotation types, transitively; ``occurrences``: (subject, annotation)."""
    if not 0 < max_depth <= 256:
        raise ValueError("a depth is 1 to 256")
    names = occurrences.select(F.col("annotation").alias("id")).distinct()
    on_types = occurrences.join(names, occurrences["subject"] == names["id"], "left_semi").select(F.col("subject").alias("origin"), F.col("annotation").alias("target"))
    return supertypes(on_types, names, max_depth=max_depth).select(F.col("origin").alias("annotation"), F.col("target").alias("meta"), "depth", "cycle")


def meta_annotation_states(occurrences: DataFrame, *, max_depth: int = 256) -> DataFrame:
    """(annotation, n_meta, limit, cycle): for every annotation type how many others it carries within ``max_depth``, and what that leaves out.

    ``limit``: at the bound something carries annotations that were not followed, so the number may be too small; ``cycle``: a
    type on the way carries itself.
    """
    names = occurrences.select(F.col("annotation").alias("id")).distinct()
    found = cut(meta_annotations(occurrences, max_depth=max_depth), "meta")
    carrying = occurrences.join(names, occurrences["subject"] == names["id"], "left_semi").select(F.col("subject").alias("meta")).distinct()
    stopped = found.where(F.col("depth") == max_depth).join(carrying, "meta", "left_semi")
    # What lies behind the bound may have been reached on a shorter way; only what hasn't counts.
    behind = stopped.select("annotation", F.col("meta").alias("subject")).join(occurrences.select("subject", F.col("annotation").alias("meta")), "subject")
    cut_off = behind.join(found, ["annotation", "meta"], "left_anti").select("annotation").distinct().withColumn("limit", F.lit(True))
    turning = found.where("cycle").select("annotation").distinct()
    cyclic = found.join(turning.withColumnRenamed("annotation", "meta"), "meta", "left_semi").select("annotation").unionByName(turning).distinct().withColumn("turns", F.lit(True))
    counts = found.where("annotation <> meta").groupBy("annotation").agg(F.count(F.lit(1)).alias("n_meta"))
    rows = names.withColumnRenamed("id", "annotation").join(counts, "annotation", "left").join(cut_off, "annotation", "left").join(cyclic, "annotation", "left")
    no = F.lit(False)
    return rows.select("annotation", F.coalesce("n_meta", F.lit(0)).alias("n_meta"), F.coalesce("limit", no).alias("limit"), F.coalesce("turns", no).alias("cycle"))


def occurrences_where(occurrences: DataFrame, *, visibility: str = "ANY", targets: tuple[str, ...] = ("DECLARATION",)) -> DataFrame:
    """Occurrences (subject, annotation, visible, target) of a kind: RUNTIME (visible at run time), CLASS or ANY, on DECLARATION, PARAMETER or TYPE_USE targets."""
    seen = {"ANY": F.lit(True), "RUNTIME": F.col("visible"), "CLASS": ~F.col("visible")}.get(visibility)
    if seen is None:
        raise ValueError("a visibility is ANY, RUNTIME or CLASS")
    return occurrences.where(seen & F.col("target").isin(*targets))


def annotated_with(occurrences: DataFrame, annotation: str, mode: str, *, superclass: DataFrame | None = None, inheritable: DataFrame | None = None, max_depth: int = 256) -> DataFrame:
    """(subject): DIRECT, META (through annotations of the annotation) or INHERITED (along the superclass chain).

    ``inheritable`` (annotation) limits inheritance to annotations that are inherited; rules give it, selectors don't.
    """
    direct = occurrences.where(F.col("annotation") == annotation).select("subject").distinct()
    if mode == "DIRECT":
        return direct
    if mode == "META":
        via = meta_annotations(occurrences, max_depth=max_depth).where(F.col("meta") == annotation).select("annotation").distinct()
        return occurrences.join(via, "annotation", "left_semi").select("subject").unionByName(direct).distinct()
    if inheritable is not None and not inheritable.where(F.col("annotation") == annotation).limit(1).count():
        return direct
    chain = supertypes(superclass.select(F.col("subject").alias("origin"), F.col("superclass").alias("target")), superclass.select(F.col("subject").alias("id")))
    return chain.join(direct.withColumnRenamed("subject", "target"), "target", "left_semi").select(F.col("origin").alias("subject")).unionByName(direct).distinct()


def incomplete_types(relations: DataFrame, subjects: DataFrame, known: DataFrame) -> DataFrame:
    """(id): subjects with a supertype, near or far, that is no known type (id); java.lang.Object counts as known."""
    near = reachable(relations, subjects).select("id")
    up = relations.join(near.withColumnRenamed("id", "origin"), "origin", "left_semi").where(F.col("target") != OBJECT)
    lost = up.join(known.select(F.col("id").alias("target")), "target", "left_anti").select(F.col("target").alias("id")).distinct()
    back = up.select(F.col("target").alias("origin"), F.col("origin").alias("target"))
    return reachable(back, lost).select("id").join(subjects.select("id").distinct(), "id", "left_semi")


def sealed_check(types: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(sealed, subtype, code): where declared and observed subtypes of sealed types differ.

    types: binary_name, sealed, permitted, superclass, interfaces, modifiers, package.  A subtype that is permitted more than once is
    DUPLICATE_PERMITTED, whatever else is wrong with it.  A permitted subtype that isn't seen as one
    is RELATIONSHIP_UNKNOWN, and not wrong, where its own hierarchy leads to types that nobody knows.  ``asked`` (binary_name)
    limits the answer to these types; one that isn't there is QUERY_TYPE_MISSING.
    """
    if asked is not None:
        asked = asked.select("binary_name").distinct()
        found = sealed_check(types).join(asked.withColumnRenamed("binary_name", "sealed"), "sealed", "left_semi")
        absent = asked.join(types.select("binary_name"), "binary_name", "left_anti")
        return found.unionByName(absent.select(F.col("binary_name").alias("sealed"), F.lit(None).cast("string").alias("subtype"), F.lit("QUERY_TYPE_MISSING").alias("code")))
    known = types.select(F.col("binary_name").alias("subtype"), "modifiers", "sealed", F.col("package").alias("sub_package")).withColumnRenamed("sealed", "sub_sealed")
    declared = types.where("sealed").select(F.col("binary_name").alias("sealed"), "package", F.explode("permitted").alias("subtype"))
    repeated = declared.groupBy("sealed", "subtype").agg(F.count(F.lit(1)).alias("times"), F.first("package").alias("package"))
    observed = direct_relations(types).select(F.col("target").alias("sealed"), F.col("origin").alias("subtype")).distinct()
    observed = observed.join(types.where("sealed").select(F.col("binary_name").alias("sealed")), "sealed", "left_semi").withColumn("observed", F.lit(True))
    both = repeated.join(observed, ["sealed", "subtype"], "full").join(known, "subtype", "left")
    doubtful = repeated.join(observed, ["sealed", "subtype"], "left_anti").select(F.col("subtype").alias("id")).distinct()
    unknown = incomplete_types(direct_relations(types), doubtful, types.select(F.col("binary_name").alias("id")))
    both = both.join(unknown.select(F.col("id").alias("subtype"), F.lit(True).alias("open")), "subtype", "left")
    final = F.array_contains("modifiers", "FINAL") | F.coalesce("sub_sealed", F.lit(False)) | F.array_contains("modifiers", "NON_SEALED")
    code = (
        F.when(F.col("times").isNull(), "UNDECLARED_SUBTYPE")
        .when(F.col("times") > 1, "DUPLICATE_PERMITTED")
        .when(F.col("subtype") == F.col("sealed"), "SELF_PERMITTED")
        .when(F.col("modifiers").isNull(), "MISSING_SUBTYPE")
        .when(F.col("observed").isNull() & F.col("open"), "RELATIONSHIP_UNKNOWN")
        .when(F.col("observed").isNull(), "PERMITTED_NOT_SUBTYPE")
        .when(~final, "SUBTYPE_NOT_CLOSED")
        .when(F.col("package") != F.col("sub_package"), "SUBTYPE_IN_OTHER_PACKAGE")
    )
    empty = types.where(F.col("sealed") & (F.size("permitted") == 0)).select(F.col("binary_name").alias("sealed"), F.lit(None).cast("string").alias("subtype"), F.lit("NO_PERMITTED_SUBTYPE").alias("code"))
    return both.select("sealed", "subtype", code.alias("code")).where("code IS NOT NULL").unionByName(empty)


def first_paths(relations: DataFrame, subjects: DataFrame, targets: DataFrame) -> DataFrame:
    """(subject, target, path): the first path found breadth first, edges in order of (origin, target, kind), each node expanded once a subject."""
    edges = relations.select("origin", "target", "kind").distinct()
    # Only what leads to a target can lie on a path to one, so paths are held for these nodes alone.
    leading = reachable(edges.select(F.col("target").alias("origin"), F.col("origin").alias("target")), targets)
    edges = cut(edges.join(leading.select(F.col("id").alias("target")), "target", "left_semi"), "path-edges")
    start = subjects.select(F.col("id").alias("subject"), F.col("id").alias("at"), F.array("id").alias("path"), F.array().cast("array<string>").alias("rank"))
    seen = cut(start, "path-seen")
    frontier = seen
    while True:
        step = frontier.join(edges.withColumnRenamed("origin", "at"), "at")
        rank = F.concat("rank", F.array(F.concat_ws("\x01", "target", "kind")))
        step = step.select("subject", F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path"), rank.alias("rank"))
        step = step.groupBy("subject", "at").agg(F.min(F.struct("rank", "path")).alias("best")).select("subject", "at", "best.path", "best.rank")
        frontier = cut(step.join(seen.select("subject", "at"), ["subject", "at"], "left_anti"), "path-frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen.where("subject <> at").join(targets.select(F.col("id").alias("at")), "at", "left_semi").select("subject", F.col("at").alias("target"), "path")


def nest_problems(hosts: DataFrame, members: DataFrame) -> DataFrame:
    """(type, problem, other): where hosts (type, host) and member lists (type, member) don't make nests.

    A nest is an equivalence that both sides state: its host lists the members, and every member names the host.
    CONFLICTING_HOSTS: several hosts (``other`` is null).  OWN_HOST: a type names itself.  REPEATED_MEMBER: listed more than once.
    HOST_AND_MEMBERS: a type that names a host lists members too.  NOT_LISTED: the host that a type names doesn't list it.
    HOST_NOT_NAMED: a listed member doesn't name the type that lists it.
    """
    none = F.lit(None).cast("string")
    row = lambda df, problem, other: df.select("type", F.lit(problem).alias("problem"), other.alias("other"))
    named = hosts.select("type", "host").distinct()
    listed = members.groupBy("type", "member").agg(F.count(F.lit(1)).alias("times"))
    out = row(named.groupBy("type").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "CONFLICTING_HOSTS", none)
    out = out.unionByName(row(named.where("type = host"), "OWN_HOST", F.col("host")))
    out = out.unionByName(row(listed.where("times > 1"), "REPEATED_MEMBER", F.col("member")))
    out = out.unionByName(row(named.select("type").distinct().join(listed.select("type").distinct(), "type", "left_semi"), "HOST_AND_MEMBERS", none))
    stated = listed.select(F.col("member").alias("type"), F.col("type").alias("host"))
    out = out.unionByName(row(named.where("type <> host").join(stated, ["type", "host"], "left_anti"), "NOT_LISTED", F.col("host")))
    silent = stated.where("type <> host").join(named, ["type", "host"], "left_anti")
    return out.unionByName(silent.select(F.col("host").alias("type"), F.lit("HOST_NOT_NAMED").alias("problem"), F.col("type").alias("other")))
