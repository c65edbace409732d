"""JVM descriptors and generic signatures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Primitive descriptor letters and their names.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
_ONE = r"\[*(?:[BCDFIJSZV]|L[^;]+;)"
MAX_NESTING = 256


class SignatureError(ValueError):
    """A signature breaks the grammar."""


def descriptor_types(descriptor: Column) -> Column:
    """All field descriptors within a method or field descriptor, in order."""
    return F.regexp_extract_all(descriptor, F.lit(_ONE), F.lit(0))


def parameters(descriptor: Column) -> Column:
    return F.regexp_extract_all(F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1), F.lit(_ONE), F.lit(0))


def return_type(descriptor: Column) -> Column:
    return F.when(descriptor.startswith("("), F.regexp_extract(descriptor, r"\)(.+)$", 1))


def element_name(descriptor: Column) -> Column:
    """The class that a descriptor names, arrays as their element; null for primitives."""
    name = F.regexp_extract(descriptor, r"^\[*L([^;]+);$", 1)
    return F.when(name != "", F.translate(name, "/", "."))


def is_valid(descriptor: Column) -> Column:
    return F.coalesce(descriptor.rlike(rf"\A(?:\((?:\[*(?:[BCDFIJSZ]|L[^;]+;))*\){_ONE}|\[*(?:[BCDFIJSZ]|L[^;]+;))\z"), F.lit(False))


class _Signature:
    """Recursive descent over one generic signature, gathering named classes and type variables."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.classes, self.variables = text, 0, [], []

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self, c: str) -> None:
        if self.peek() != c:
            raise SignatureError(f"{c!r} expected at {self.at}")
        self.at += 1

    def word(self, ends: str) -> str:
        start = self.at
        while self.peek() and self.peek() not in ends:
            self.at += 1
        if start == self.at:
            raise SignatureError(f"a name is expected at {start}")
        return self.text[start : self.at]

    def kind(self, depth: int, void: bool = False) -> None:
        if depth > MAX_NESTING:
            raise SignatureError("nested too deeply")
        c = self.peek()
        if c in PRIMITIVES and c and (c != "V" or void):
            self.at += 1
        elif c == "[":
            self.at += 1
            self.kind(depth + 1)
        elif c == "T":
            self.at += 1
            self.variables.append(self.word(";"))
            self.take(";")
        elif c == "L":
            self.at += 1
            name = self.word("<;.").replace("/", ".")
            self.arguments(depth)
            while self.peek() == ".":
                self.at += 1
                name += "$" + self.word("<;.")
                self.arguments(depth)
            self.take(";")
            self.classes.append(name)
        else:
            raise SignatureError(f"a type is expected at {self.at}")

    def arguments(self, depth: int) -> None:
        if self.peek() != "<":
            return
        self.at += 1
        while self.peek() != ">":
            if self.peek() == "*":
                self.at += 1
                continue
            if self.peek() in ("+", "-"):
                self.at += 1
            self.kind(depth + 1)
        self.at += 1

    def parameters(self) -> None:
        if self.peek() != "<":
            return
        self.at += 1
        while self.peek() != ">":
            self.word(":")
            self.take(":")
            if self.peek() not in (":", ">"):
                self.kind(1)
            while self.peek() == ":":
                self.at += 1
                self.kind(1)
        self.at += 1

    def whole(self, kind: str) -> None:
        if kind == "field":
            self.kind(0)
        else:
            self.parameters()
            if kind == "method":
                self.take("(")
                while self.peek() != ")":
                    self.kind(0)
                self.at += 1
                self.kind(0, void=True)
                while self.peek() == "^":
                    self.at += 1
                    self.kind(0)
            else:
                while self.peek():
                    self.kind(0)
        if self.at != len(self.text):
            raise SignatureError(f"more follows at {self.at}")


def signature_references(text: str, kind: str) -> tuple[list[str], list[str]]:
    """(classes, type variables) that a class, field or method signature names, sorted and distinct."""
    s = _Signature(text)
    s.whole(kind)
    return sorted(set(s.classes)), sorted(set(s.variables))


_NAMED = T.StructType([T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("variables", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


@F.pandas_udf(_NAMED)
def parse_signature(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(signature, kind) -> what it names, or the error; the grammar is recursive, so no regular expression reads it."""
    for texts, kinds in parts:
        rows = []
        for text, kind in zip(texts, kinds, strict=True):
            if text is None:
                rows.append((None, None, None))
                continue
            try:
                rows.append((*signature_references(text, kind), None))
            except SignatureError as e:
                rows.append((None, None, str(e)))
        yield pd.DataFrame(rows, columns=["classes", "variables", "error"])
