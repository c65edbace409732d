"""The typed model and dependency evidence from decoded classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from latticework.functions import descriptors as d
from latticework.functions.classify import FLAGS, call_site_kind, has_flag, member_kind, nesting_kind, type_kind, visibility
from latticework.functions.identity import package_of
from latticework.functions.patterns import NamePattern, any_of
from latticework.operators.lookup import classpath_winners, resolve_in_scopes
from latticework.plans.graph import Graph, conform, nodes_of


class ImportFailure(RuntimeError):
    """Under the strict policy a diagnostic fails the import."""


def _modifiers(flags: Column, names: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(has_flag(flags, n), n) for n in names]))


#: The release that versioned entries are chosen for where none is named.
TARGET_RELEASE = 25


def versioned_problem(entry: Column, multi_release: Column, target: int) -> Column:
    """Why an archive's entry below META-INF/versions takes no part for the release ``target``; null where it does, or is no such entry.

    VERSIONS_NOT_ENABLED: the manifest doesn't say that the archive has several releases.  VERSIONED_NAME_INVALID: no number without
    leading zeros, or nothing but META-INF below it.  VERSION_OUT_OF_RANGE: a release below 9, where versions begin, or above the target.
    """
    parts = F.split(entry, "/", 4)
    number, rest = F.get(parts, F.lit(2)), F.coalesce(F.get(parts, F.lit(3)), F.lit(""))
    named = number.rlike(r"^[1-9]\d*$") & rest.rlike(r"\S") & ~rest.startswith("META-INF/")
    reached = F.coalesce(number.try_cast("int").between(9, target), F.lit(False))
    first = F.coalesce(
        F.when(~F.coalesce(multi_release, F.lit(False)), "VERSIONS_NOT_ENABLED"), F.when(~named, "VERSIONED_NAME_INVALID"), F.when(~reached, "VERSION_OUT_OF_RANGE")
    )
    return F.when(entry.startswith("META-INF/versions/"), first)


def resources(decoded: DataFrame, *, mode: str = "CLASSPATH") -> DataFrame:
    """``decoded`` with scope, name, release, multi_release and resource: what competes for a name, and with which release.

    Class files of an archive below META-INF/versions/N have release N.  On a
    class path all containers are one scope, on a module path each is its own.
    """
    release = F.regexp_extract("entry", "^META-INF/versions/([1-9][0-9]{0,8})/", 1)
    versioned = (F.col("input_kind") == "JAR") & (release != "")
    scope = F.lit("classpath") if mode == "CLASSPATH" else F.concat_ws(":", F.lit("module-path"), "input_kind", "container")
    return decoded.select(
        *(c for c in decoded.columns if c != "multi_release"), scope.alias("scope"), F.col("binary_name").alias("name"), F.when(versioned, release.try_cast("int")).otherwise(0).alias("release"),
        F.coalesce("multi_release", F.lit(False)).alias("multi_release"), F.concat_ws("!", "container", "entry").alias("resource"),
    )


def resolve(decoded: DataFrame, *, policy: str = "COLLECT", release: int = TARGET_RELEASE, mode: str = "CLASSPATH", include: list[NamePattern] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types, shadows, diagnostics): of equal binary names in one scope the lowest precedence, then the highest release up to ``release``, wins.

    ``include`` limits the import to binary names that a pattern matches.
    """
    rows = resources(decoded, mode=mode)
    problem = F.when(F.col("input_kind") == "JAR", versioned_problem(F.col("entry"), F.col("multi_release"), release))
    rows = rows.withColumn("diagnostic", F.coalesce("diagnostic", problem))
    diagnostics = rows.where("diagnostic IS NOT NULL").select("container", "entry", "diagnostic")
    if policy == "STRICT" and (row := diagnostics.orderBy("container", "entry").first()):
        raise ImportFailure(f"{row['entry']}: {row['diagnostic']}")
    rows = rows.where(F.expr("diagnostic IS NULL AND module IS NULL") & any_of(F.col("binary_name"), include or []))
    ranked = classpath_winners(rows, release=release)
    classes = ranked.where("winner").drop("winner", "name", "release", "multi_release", "resource", *(["scope"] if mode == "CLASSPATH" else []))
    return classes, ranked.where("NOT winner").select("binary_name", "container", "entry"), diagnostics


def modules_table(decoded: DataFrame) -> DataFrame:
    """(name, kind, requires, exports, opens, uses, provides): a row a module descriptor."""
    found = decoded.where("diagnostic IS NULL AND module IS NOT NULL")
    return found.select(F.col("module").alias("name"), F.lit("EXPLICIT").alias("kind"), "requires", "exports", "opens", "uses", "provides")


def nesting_table(classes: DataFrame) -> DataFrame:
    """(binary_name, nesting, outer, enclosing_class, enclosing_method, problem): how each type is nested, and what speaks against it.

    A type's own inner-class entry decides; entries that other types hold of it must agree on its outer type.
    """
    own = classes.select("binary_name", "enclosing_class", "enclosing_method", F.explode_outer(F.filter("nesting", lambda e: e["inner"] == F.col("binary_name"))).alias("e"))
    own = own.groupBy("binary_name").agg(
        F.count("e").alias("entries"), F.max("e.outer").alias("outer"), F.max("e.name").alias("simple_name"),
        F.max("enclosing_class").alias("enclosing_class"), F.max("enclosing_method").alias("enclosing_method"),
    )
    said = classes.select(F.explode("nesting").alias("e")).where("e.outer IS NOT NULL").groupBy(F.col("e.inner").alias("binary_name")).agg(F.count_distinct("e.outer").alias("owners"))
    rows = own.join(said, "binary_name", "left").withColumn("owners", F.coalesce("owners", F.lit(0)))
    enclosed, outer, named_ = F.col("enclosing_class").isNotNull(), F.col("outer").isNotNull(), F.col("simple_name").isNotNull()
    problem = (
        F.when(F.col("owners") > 1, "CONFLICTING_OWNERS").when(F.col("entries") > 1, "REPEATED_ENTRY").when((F.col("entries") == 0) & enclosed, "ENCLOSED_WITHOUT_ENTRY")
        .when((F.col("entries") == 0) & (F.col("owners") > 0), "ENTRY_MISSING").when(outer & enclosed, "MEMBER_WITH_ENCLOSING_METHOD").when(outer & ~named_, "MEMBER_WITHOUT_NAME")
        .when((F.col("entries") > 0) & ~outer & ~enclosed, "LOCAL_WITHOUT_ENCLOSING_CLASS").when(F.col("outer") == F.col("binary_name"), "OWN_OWNER")
    )
    kind = nesting_kind(F.col("entries"), outer, named_, enclosed, F.col("owners"))
    return rows.select("binary_name", kind.alias("nesting"), "outer", "enclosing_class", "enclosing_method", problem.alias("problem"))


def annotations_table(classes: DataFrame) -> DataFrame:
    """(subject, owner, type, visible, target, elements): DECLARATION, PARAMETER (subject ends in :position) and TYPE_USE annotations."""
    return classes.select(F.col("binary_name").alias("owner"), F.explode("annotations").alias("a")).select("a.subject", "owner", "a.type", "a.visible", "a.target", "a.elements")


def record_components(classes: DataFrame) -> DataFrame:
    rows = classes.select(F.col("binary_name").alias("owner"), F.posexplode("components").alias("position", "c"))
    return rows.select("owner", "position", "c.name", "c.descriptor", d.element_name(F.col("c.descriptor")).alias("type"), "c.signature")


def bounded_diagnostics(diagnostics: DataFrame, limit: int = 1_000) -> DataFrame:
    """The first ``limit`` diagnostics in order, and one LIMIT row where more were left out."""
    first = diagnostics.orderBy("container", "entry").limit(limit)
    more = diagnostics.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return first.unionByName(more.select(F.lit(None).cast("string").alias("container"), F.lit(None).cast("string").alias("entry"), F.concat(F.lit("LIMIT "), F.col("n") - limit).alias("diagnostic")))


def types_table(classes: DataFrame) -> DataFrame:
    name = F.col("binary_name")
    return classes.select(
        F.concat(F.lit("type:"), name).alias("type_key"), name, package_of(name).alias("package"), type_kind(F.col("access_flags"), F.col("record")).alias("kind"),
        _modifiers(F.col("access_flags"), ("PUBLIC", "FINAL", "ABSTRACT", "SYNTHETIC")).alias("modifiers"), "superclass", "interfaces",
        (F.size("permitted") > 0).alias("sealed"), "permitted", "source_file", "container", F.col("entry").alias("resource"), "major",
    )


def members_table(classes: DataFrame) -> DataFrame:
    rows = classes.select(F.col("binary_name").alias("owner"), F.explode("members").alias("m")).select("owner", "m.*")
    names = tuple(n for n in FLAGS if n in ("PUBLIC", "PRIVATE", "PROTECTED", "STATIC", "FINAL", "ABSTRACT", "NATIVE", "SYNTHETIC"))
    return rows.select(
        "owner", "name", "descriptor", member_kind(F.col("name"), F.col("descriptor")).alias("kind"), visibility(F.col("flags")).alias("visibility"), _modifiers(F.col("flags"), names).alias("modifiers"),
        "has_code", d.parameters(F.col("descriptor")).alias("params"), d.return_type(F.col("descriptor")).alias("return_type"), "signature",
    )


def call_sites(classes: DataFrame) -> DataFrame:
    rows = classes.select(F.explode("call_sites").alias("c")).select("c.*")
    return rows.select("caller", call_site_kind(F.col("owner"), F.col("name")).alias("kind"), "offset")


def declaration_dependencies(classes: DataFrame) -> DataFrame:
    """(origin, target, kind, owner_member): what declarations name, arrays as their element, primitives left out.

    GENERIC_SIGNATURE holds what signatures name beyond the erased descriptors.
    """
    name = F.col("binary_name").alias("origin")
    up = classes.where("superclass IS NOT NULL").select(name, F.col("superclass").alias("target"), F.lit("EXTENDS").alias("kind"), F.lit(None).cast("string").alias("owner_member"))
    part = lambda column, kind: classes.select(name, F.explode(column).alias("target"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("owner_member"))
    m = members_table(classes).withColumn("owner_member", F.concat("owner", F.lit("#"), "name", "descriptor"))
    of = lambda rows, column, kind: rows.select(F.col("owner").alias("origin"), d.element_name(column).alias("target"), F.lit(kind).alias("kind"), "owner_member")
    fields = of(m.where("kind = 'FIELD'"), F.col("descriptor"), "FIELD_TYPE")
    params = of(m.where("kind <> 'FIELD'").withColumn("p", F.explode("params")), F.col("p"), "METHOD_PARAMETER_TYPE")
    returns = of(m.where("kind = 'METHOD'"), F.col("return_type"), "METHOD_RETURN_TYPE")
    signed = m.where("signature IS NOT NULL").withColumn("s", d.parse_signature("signature", F.when(F.col("kind") == "FIELD", "field").otherwise("method")))
    erased = F.transform(d.descriptor_types(F.col("descriptor")), d.element_name)
    generic = signed.select(F.col("owner").alias("origin"), F.explode(F.array_except("s.classes", erased)).alias("target"), F.lit("GENERIC_SIGNATURE").alias("kind"), "owner_member")
    classes_signed = classes.where("signature IS NOT NULL").withColumn("s", d.parse_signature("signature", F.lit("class")))
    bases = F.concat("interfaces", F.array_compact(F.array("superclass")))
    generic_up = classes_signed.select(name, F.explode(F.array_except("s.classes", bases)).alias("target"), F.lit("GENERIC_SIGNATURE").alias("kind"), F.lit(None).cast("string").alias("owner_member"))
    notes = classes.select(name, F.explode("annotations").alias("a")).select("origin", F.col("a.type").alias("target"), F.lit("ANNOTATION").alias("kind"), F.regexp_replace("a.subject", r":\d+$", "").alias("owner_member"))
    throws = classes.select(name, F.explode("references").alias("r")).where("r.kind = 'THROWS'").select("origin", F.col("r.class").alias("target"), F.lit("THROWS").alias("kind"), F.col("r.member").alias("owner_member"))
    out = up
    for more in (part("interfaces", "IMPLEMENTS"), part("permitted", "TYPE_REFERENCE"), fields, params, returns, generic, generic_up, notes, throws):
        out = out.unionByName(more)
    return out.where("target IS NOT NULL").distinct()


def code_dependencies(classes: DataFrame) -> DataFrame:
    """(origin, target, kind, owner_member, bytecode_offset, line_number) of instructions."""
    a = classes.select(F.col("binary_name").alias("origin"), F.explode("accesses").alias("a"))
    # An array's methods are called on a descriptor; its element is the dependency.
    owner = F.when(F.col("a.owner").startswith("["), d.element_name(F.translate("a.owner", ".", "/"))).otherwise(F.col("a.owner"))
    kind = F.when(F.col("a.kind").isin("FIELD_READ", "FIELD_WRITE"), "FIELD_ACCESS").otherwise(F.col("a.kind"))
    calls = a.select("origin", owner.alias("target"), kind.alias("kind"), F.col("a.caller").alias("owner_member"), F.col("a.offset").cast("long").alias("bytecode_offset"), F.col("a.line").alias("line_number"))
    r = classes.select(F.col("binary_name").alias("origin"), F.explode("references").alias("r")).where("r.kind NOT IN ('THROWS', 'CAUGHT')")
    target = F.when(F.col("r.class").startswith("["), d.element_name(F.translate("r.class", ".", "/"))).otherwise(F.col("r.class"))
    refs = r.select("origin", target.alias("target"), "r.kind", F.col("r.member").alias("owner_member"), F.col("r.offset").cast("long").alias("bytecode_offset"), F.col("r.line").alias("line_number"))
    return calls.unionByName(refs).where("target IS NOT NULL")


def type_graph(classes: DataFrame, reads: DataFrame | None = None) -> Graph:
    """Declarations and instructions as one evidence table; nodes are all types seen, external ones included.

    Where ``classes`` have scopes (a module path), so have keys: ``type:<scope>!<name>``, and a name is looked up in its own scope
    first, then in those that scope ``reads`` (scope, reads, place); without ``reads`` in all others, by precedence.  What no scope
    holds is external, and has none.
    """
    scoped = "scope" in classes.columns
    if scoped:
        types = classes.select("scope", F.col("binary_name").alias("name"), "precedence")
        if reads is None:
            order = types.groupBy(F.col("scope").alias("reads")).agg(F.min("precedence").alias("place"))
            reads = types.select("scope").distinct().join(order, F.col("scope") != F.col("reads"))  # scopes are inputs: at most some dozens
        classes = classes.withColumn("binary_name", F.concat_ws("!", "scope", "binary_name"))
    name = F.substring_index("binary_name", "!", -1)
    where = classes.select(F.col("binary_name").alias("origin"), F.concat(F.lit("location:"), F.translate(name, ".", "/"), F.lit(".class")).alias("location"), "source_file")
    rows = declaration_dependencies(classes).unionByName(code_dependencies(classes), allowMissingColumns=True).join(where, "origin")
    made = members_table(classes).where(F.array_contains("modifiers", "SYNTHETIC")).select(F.col("owner").alias("origin"), F.concat(F.substring_index("owner", "!", -1), F.lit("#"), "name", "descriptor").alias("owner_member"), F.lit(True).alias("synthetic")).distinct()
    rows = rows.withColumn("owner_member", F.regexp_replace("owner_member", "^[^#]*!", "")).join(made, ["origin", "owner_member"], "left").withColumn("synthetic", F.coalesce("synthetic", F.lit(False)))
    if scoped:
        asked = rows.withColumns({"scope": F.expr("substring(origin, 1, length(origin) - length(substring_index(origin, '!', -1)) - 1)"), "name": F.col("target")})
        rows = resolve_in_scopes(asked, types, reads).withColumn("target", F.concat_ws("!", "found", "name"))
    rows = rows.withColumn("origin", F.concat(F.lit("type:"), "origin")).withColumn("target", F.concat(F.lit("type:"), "target"))
    evidence = conform(rows)
    keys = evidence.select(F.explode(F.array("origin", "target")).alias("stable_key")).unionByName(classes.select(F.concat(F.lit("type:"), "binary_name").alias("stable_key")))
    return Graph(nodes_of(keys), evidence)


class References:
    """Declared references (origin, descriptor, kind, source) as dependencies, with what was left out counted on the way.

    ``rows``: origin, target, kind, n_sources, self, external (the target is no ``imported`` type (name)).  ``counters`` are read off
    the job that reads ``rows``, once it has run: primitives, duplicates (a source given twice), self, external.
    """

    def __init__(self, references: DataFrame, imported: DataFrame) -> None:
        self._before, self._after = Observation(), Observation()
        rows = references.select("origin", d.element_name(F.col("descriptor")).alias("target"), "kind", "source")
        rows = rows.observe(self._before, F.count(F.lit(1)).alias("n"), F.count_if(F.col("target").isNull()).alias("primitives")).where("target IS NOT NULL").distinct()
        here = imported.select(F.col("name").alias("target"), F.lit(True).alias("here")).distinct()
        grouped = rows.groupBy("origin", "target", "kind").agg(F.count(F.lit(1)).alias("n_sources"))
        found = grouped.join(here, "target", "left").select("origin", "target", "kind", "n_sources", (F.col("origin") == F.col("target")).alias("self"), F.col("here").isNull().alias("external"))
        self.rows = found.observe(self._after, F.sum("n_sources").alias("kept"), F.count_if("self").alias("self"), F.count_if("external").alias("external"))

    def counters(self) -> dict[str, int]:
        before, after = self._before.get, self._after.get
        return {"primitives": before["primitives"], "duplicates": before["n"] - before["primitives"] - (after["kept"] or 0), "self": after["self"], "external": after["external"]}


def external_types(graph: Graph, types: DataFrame) -> DataFrame:
    """(binary_name): referenced types that no input holds; they stand in as stubs."""
    keys = graph.nodes.where("id_kind = 'type'").select(F.regexp_replace("stable_key", "^type:", "").alias("binary_name"))
    return keys.join(types.select("binary_name"), "binary_name", "left_anti")
