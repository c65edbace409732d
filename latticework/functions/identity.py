"""Stable keys and length-prefixed SHA-256 identities."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's reserved words, which no segment of a qualified name may be.
RESERVED = frozenset(
    "_ abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int"
    " interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while".split()
)
KEY_KINDS = ("package", "type", "member", "module", "location", "layer", "slice")
UNASSIGNED = "layer:<unassigned>"


class IdentityError(ValueError):
    """A key breaks the rules of its kind."""


def package_key(name: Column) -> Column:
    return F.concat(F.lit("package:"), name)


def type_key(binary_name: Column) -> Column:
    return F.concat(F.lit("type:"), binary_name)


def member_key(owner: Column, name: Column, descriptor: Column) -> Column:
    return F.concat(F.lit("member:"), owner, F.lit("#"), name, descriptor)


def module_key(name: Column) -> Column:
    return F.concat(F.lit("module:"), name)


def location_key(path: Column) -> Column:
    return F.concat(F.lit("location:"), path)


def kind_of(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def package_of(binary_name: Column) -> Column:
    """Everything before the last dot; empty where there is none."""
    return F.regexp_extract(binary_name, r"^([\s\S]*)\.[^.]*$", 1)


def simple_of(binary_name: Column) -> Column:
    return F.regexp_extract(binary_name, r"([^.$]*)$", 1)


def owner_of(member: Column) -> Column:
    """The type key of a member key."""
    return F.concat(F.lit("type:"), F.regexp_extract(member, r"^member:([^#]*)#", 1))


_SEGMENT = r"[\p{javaJavaIdentifierStart}&&[^.;\[/]][\p{javaJavaIdentifierPart}]*"


def valid_key(key: Column) -> Column:
    """Whether a stable key has its kind's form; false for null."""
    words = "|".join(sorted(RESERVED))
    qualified = rf"(?!(?:[\s\S]*\.)?(?:{words})(?:\.[\s\S]*)?$){_SEGMENT}(?:\.{_SEGMENT})*"
    checks = {
        "package": rf"package:(?:{qualified})?",
        "module": rf"module:{qualified}",
        "type": r"type:(?:[^./\[;\s:]+\.)*[^./\[;\s:]+",
        "member": r"member:[^#/\[;\s]+#(?:<init>\([^)]*\)V|<clinit>\(\)V|[^.;\[/<>()\s]+(?:\((?:\[*(?:[BCDFIJSZ]|L[^;]+;))*\)(?:V|\[*(?:[BCDFIJSZ]|L[^;]+;))|\[*(?:[BCDFIJSZ]|L[^;]+;)))",
        "location": r"location:(?!/)(?![A-Za-z]:)(?!(?:[^\\]*/)?\.{1,2}(?:/|$))[^\\\n\r]+",
        "layer": r"layer:[^\n\r]+",
        "slice": r"slice:[^\n\r]+",
    }
    return F.coalesce(key.rlike("|".join(rf"\A(?:{r})\z" for r in checks.values())), F.lit(False))


def check_layer_name(name: str) -> str:
    if not name.strip() or "\n" in name or "\r" in name or name == "<unassigned>":
        raise IdentityError(f"{name!r} can't name a layer")
    return name


def identity_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, each as UTF-8 after its length in four bytes; null counts as empty."""
    framed = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")), F.encode(p, "UTF-8")) for p in (F.coalesce(x, F.lit("")) for x in parts)]
    return F.sha2(F.concat(*framed), 256)


def identity_hash_text(*parts: str | None) -> str:
    """The same on the driver."""
    h = hashlib.sha256()
    for p in parts:
        raw = (p or "").encode()
        h.update(len(raw).to_bytes(4, "big") + raw)
    return h.hexdigest()


def check_identifier(name: str) -> bool:
    return bool(re.fullmatch(r"[^\W\d]\w*|\$\w*", name)) and name not in RESERVED
