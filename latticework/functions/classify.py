"""Classifications of types, members, call sites and nesting, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Access flags of the class-file format.
FLAGS = {"PUBLIC": 0x0001, "PRIVATE": 0x0002, "PROTECTED": 0x0004, "STATIC": 0x0008, "FINAL": 0x0010, "SYNCHRONIZED": 0x0020, "VOLATILE": 0x0040, "BRIDGE": 0x0040, "TRANSIENT": 0x0080, "VARARGS": 0x0080, "NATIVE": 0x0100, "INTERFACE": 0x0200, "ABSTRACT": 0x0400, "STRICT": 0x0800, "SYNTHETIC": 0x1000, "ANNOTATION": 0x2000, "ENUM": 0x4000, "MANDATED": 0x8000}
#: Dependency kinds.
DEPENDENCY_KINDS = ("ANNOTATION", "CLASS_LITERAL", "CONSTRUCTOR_CALL", "EXTENDS", "FIELD_ACCESS", "FIELD_TYPE", "GENERIC_SIGNATURE", "IMPLEMENTS", "INSTANCEOF", "METHOD_CALL", "METHOD_PARAMETER_TYPE", "METHOD_RETURN_TYPE", "THROWS", "TYPE_REFERENCE")
#: SARIF levels by severity.
SARIF_LEVELS = {"INFO": "note", "WARNING": "warning", "ERROR": "error"}


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(FLAGS[name]) != 0


def type_kind(flags: Column, record: Column) -> Column:
    """Annotation before enum before interface before record before class."""
    return F.when(has_flag(flags, "ANNOTATION"), "ANNOTATION").when(has_flag(flags, "ENUM"), "ENUM").when(has_flag(flags, "INTERFACE"), "INTERFACE").when(record, "RECORD").otherwise("CLASS")


def member_kind(name: Column, descriptor: Column) -> Column:
    return F.when(name == "<init>", "CONSTRUCTOR").when(name == "<clinit>", "STATIC_INITIALIZER").when(descriptor.startswith("("), "METHOD").otherwise("FIELD")


def visibility(flags: Column) -> Column:
    return F.when(has_flag(flags, "PUBLIC"), "PUBLIC").when(has_flag(flags, "PROTECTED"), "PROTECTED").when(has_flag(flags, "PRIVATE"), "PRIVATE").otherwise("PACKAGE_PRIVATE")


def call_site_kind(owner: Column, name: Column) -> Column:
    """By the bootstrap method's owner and name."""
    lambda_ = (owner == "java.lang.invoke.LambdaMetafactory") & name.isin("metafactory", "altMetafactory")
    concat = (owner == "java.lang.invoke.StringConcatFactory") & name.isin("makeConcat", "makeConcatWithConstants")
    return F.when(lambda_, "LAMBDA_METAFACTORY").when(concat, "STRING_CONCAT").otherwise("GENERIC")


def nesting_kind(entries: Column, has_outer: Column, has_name: Column, has_enclosing_method: Column, lexical_owners: Column) -> Column:
    """From a type's inner-class entries: none is top level; several owners are a conflict and so unknown."""
    return (
        F.when(lexical_owners > 1, "UNKNOWN")
        .when((entries == 0) & ~has_enclosing_method, "TOP_LEVEL")
        .when((entries == 0) & has_enclosing_method, "UNKNOWN")
        .when(has_outer & has_enclosing_method, "UNKNOWN")
        .when(has_outer & has_name, "MEMBER")
        .when(~has_outer & has_name, "LOCAL")
        .when(~has_outer & ~has_name, "ANONYMOUS")
        .otherwise("UNKNOWN")
    )


def generated(*signals: Column) -> Column:
    """Generated code shows at least two independent signals."""
    return sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0)) >= 2


def presented(synthetic: Column, bridge: Column, mandated: Column, show_compiler_made: bool = False) -> Column:
    """What a presentation shows: compiler artefacts are hidden unless asked for; evidence tables keep them."""
    return F.lit(show_compiler_made) | ~(synthetic | bridge | mandated)


def sarif_level(severity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, level in SARIF_LEVELS.items():
        out = F.when(severity == name, level).otherwise(out)
    return out
