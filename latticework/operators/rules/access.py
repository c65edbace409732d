"""Who may access what: visibility of members, exports of packages, and both together, three-valued.

A call site is judged by what the tables of types, members, modules and exports say.  What they leave open (a module that
nobody names, a hierarchy that isn't whole) stays open: UNKNOWN is an answer of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.algorithms import reachable
from latticework.operators.rules.outcome import RuleMetadata, RuleOutcome, diagnostics, violations

# How a member is visible to a caller, and how its package is exported to the caller's module.
VISIBILITIES = ("PUBLIC", "PROTECTED_SAME_PACKAGE", "PROTECTED_CROSS_PACKAGE", "PACKAGE_PRIVATE", "PACKAGE_PRIVATE_INACCESSIBLE", "PRIVATE_NESTMATE", "PRIVATE_INACCESSIBLE")
EXPORTS = ("SAME_MODULE", "UNNAMED_OR_UNKNOWN_MODULE", "AUTOMATIC_MODULE", "UNQUALIFIED_EXPORT", "QUALIFIED_EXPORT_TO_CALLER", "PACKAGE_NOT_EXPORTED", "QUALIFIED_EXPORT_TO_OTHER_MODULES")


def visible_from_outside(types: DataFrame) -> DataFrame:
    """(type): types (type, public, owner) that are public together with all types around them; an owner that isn't there hides."""
    public = types.where("public")
    return reachable(public.where("owner IS NOT NULL").select(F.col("owner").alias("origin"), F.col("type").alias("target")), public.where("owner IS NULL").select(F.col("type").alias("id"))).select(F.col("id").alias("type"))


def _export_table(exports: DataFrame) -> DataFrame:
    """One row a (module, package): ``to`` holds the modules that a qualified export names, null where it is for all."""
    open_ = F.bool_or(F.col("targets").isNull() | (F.size("targets") == 0))
    return exports.groupBy("module", "package").agg(F.when(~open_, F.array_distinct(F.flatten(F.collect_list("targets")))).alias("to"))


def visibility_of(modifier: Column, same_package: Column, same_nest: Column) -> Column:
    """One of VISIBILITIES, from the member's own modifier and where the caller stands."""
    by = {
        "PUBLIC": F.lit("PUBLIC"), "PROTECTED": F.when(same_package, "PROTECTED_SAME_PACKAGE").otherwise("PROTECTED_CROSS_PACKAGE"),
        "PRIVATE": F.when(same_nest, "PRIVATE_NESTMATE").otherwise("PRIVATE_INACCESSIBLE"), "PACKAGE_PRIVATE": F.when(same_package, "PACKAGE_PRIVATE").otherwise("PACKAGE_PRIVATE_INACCESSIBLE"),
    }
    out = F.lit(None).cast("string")
    for name, value in by.items():
        out = F.when(modifier == name, value).otherwise(out)
    return out


def access_states(accesses: DataFrame, types: DataFrame, members: DataFrame, modules: DataFrame, exports: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Distinct (origin, target_owner, target_member) of ``accesses`` with n, visibility, export and accessible (YES, NO, UNKNOWN).

    types: type, package, module, nest_host (null: the type itself).  members: type, member, visibility.  modules: module, kind
    (EXPLICIT or AUTOMATIC; one that isn't there is unknown).  exports: module, package, targets (null or empty: to all).
    ancestors: what ``supertypes`` gives; a protected member is open to subclasses of its owner.  Call sites whose ends or
    member the tables don't hold have null states.  They are counted before the joins, so a target that a third of all call
    sites hit is joined once a caller.
    """
    rows = accesses.groupBy("origin", "target_owner", "target_member").agg(F.count(F.lit(1)).alias("n"))
    side = lambda p, key: types.select(F.col("type").alias(key), F.col("package").alias(f"{p}_package"), F.col("module").alias(f"{p}_module"), F.coalesce("nest_host", "type").alias(f"{p}_host"), F.lit(True).alias(f"{p}_there"))
    # What is known of either end is joined end by end first, so each call site is shuffled once for its origin, once for its owner and once for its member.
    above = ancestors.groupBy("origin").agg(F.collect_set("target").alias("above"), F.bool_or("missing").alias("open"))
    rows = rows.join(side("o", "origin").join(above, "origin", "full"), "origin", "left")
    owners = side("t", "target_owner").join(modules.select(F.col("module").alias("t_module"), "kind"), "t_module", "left")
    owners = owners.join(_export_table(exports).select(F.col("module").alias("t_module"), F.col("package").alias("t_package"), "to", F.lit(True).alias("exported")), ["t_module", "t_package"], "left")
    rows = rows.withColumn("below", F.array_contains("above", F.col("target_owner"))).drop("above").join(owners, "target_owner", "left")
    rows = rows.join(members.select(F.col("type").alias("target_owner"), F.col("member").alias("target_member"), F.col("visibility").alias("modifier")), ["target_owner", "target_member"], "left")
    there = F.col("o_there") & F.col("t_there") & F.col("modifier").isNotNull()
    visibility = visibility_of(F.col("modifier"), F.col("o_package") == F.col("t_package"), F.col("o_host") == F.col("t_host"))
    export = (
        F.when(F.col("t_module").isNull() | F.col("kind").isNull(), "UNNAMED_OR_UNKNOWN_MODULE").when(F.col("o_module").eqNullSafe(F.col("t_module")), "SAME_MODULE")
        .when(F.col("kind") == "AUTOMATIC", "AUTOMATIC_MODULE").when(F.col("exported").isNull(), "PACKAGE_NOT_EXPORTED").when(F.col("to").isNull(), "UNQUALIFIED_EXPORT")
        .when(F.coalesce(F.array_contains("to", F.col("o_module")), F.lit(False)), "QUALIFIED_EXPORT_TO_CALLER").otherwise("QUALIFIED_EXPORT_TO_OTHER_MODULES")
    )
    rows = rows.withColumns({"visibility": F.when(there, visibility), "export": F.when(there, export)})
    v, x = F.col("visibility"), F.col("export")
    inherited = F.when(F.col("below"), "YES").when(F.coalesce("open", F.lit(False)), "UNKNOWN").otherwise("NO")
    seen = F.when(v.endswith("INACCESSIBLE"), "NO").when(v == "PROTECTED_CROSS_PACKAGE", inherited).when(v.isNotNull(), "YES")
    handed = F.when(x.isin("PACKAGE_NOT_EXPORTED", "QUALIFIED_EXPORT_TO_OTHER_MODULES"), "NO").when(x == "UNNAMED_OR_UNKNOWN_MODULE", "UNKNOWN").when(x.isNotNull(), "YES")
    both = F.when((seen == "NO") | (handed == "NO"), "NO").when((seen == "UNKNOWN") | (handed == "UNKNOWN"), "UNKNOWN").when(seen.isNotNull(), "YES")
    crosses = ~(F.col("o_package").eqNullSafe(F.col("t_package")) & F.col("o_module").eqNullSafe(F.col("t_module")))
    return rows.select("origin", "target_owner", "target_member", "n", "visibility", "export", both.alias("accessible"), crosses.alias("crosses"))


def approved_interface(metadata: RuleMetadata, states: DataFrame, visible: DataFrame, approved_types: DataFrame, approved_members: DataFrame) -> RuleOutcome:
    """Call sites over a package's or module's border hit approved, public and exported members of approved, public types only.

    states: what ``access_states`` gives; visible: (type) as ``visible_from_outside`` has it; approved: (id).  The code of a
    violation is the first of its faults; targets that aren't known are counted, not judged.
    """
    flag = lambda df, column, key, name: df.select(F.col(column).alias(key)).distinct().withColumn(name, F.lit(True))
    rows = states.where("visibility IS NOT NULL AND crosses")
    rows = rows.join(flag(visible, "type", "target_owner", "open_type"), "target_owner", "left").join(flag(approved_types, "id", "target_owner", "ok_type"), "target_owner", "left")
    rows = rows.join(flag(approved_members, "id", "target_member", "ok_member"), "target_member", "left")
    code = (
        F.when(F.col("ok_type").isNull(), "TYPE_NOT_APPROVED").when(F.col("ok_member").isNull(), "MEMBER_NOT_APPROVED").when(F.col("open_type").isNull(), "TYPE_NOT_PUBLIC")
        .when(F.col("visibility") != "PUBLIC", F.concat(F.lit("MEMBER_"), "visibility")).when(F.col("export").isin("PACKAGE_NOT_EXPORTED", "QUALIFIED_EXPORT_TO_OTHER_MODULES"), F.col("export"))
    )
    bad = rows.withColumn("code", code).where("code IS NOT NULL")
    lost = states.where("visibility IS NULL").groupBy("target_owner").agg(F.sum("n").alias("k"))
    return RuleOutcome(metadata, violations(metadata, bad, F.col("code"), target="target_member", kind=None, n="n"), diagnostics(metadata, lost, "UNRESOLVED_TARGET", "target_owner", F.col("k")))
