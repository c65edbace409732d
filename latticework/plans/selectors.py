"""Selectors: immutable predicates over types, members, packages and modules, with a stable description."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.patterns import NamePattern

UNIVERSAL, EMPTY, CONDITIONAL = "UNIVERSAL", "EMPTY", "CONDITIONAL"


@dataclass(frozen=True)
class Selector:
    """A description, a constant tag, and a predicate; what needs another table prepares a flag column first.

    Predicates are Columns wherever possible, so they reach the scan as pushed filters.
    """

    description: str
    predicate: Column
    constant: str = CONDITIONAL
    prepare: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    key: str = ""

    def select(self, rows: DataFrame) -> DataFrame:
        for f in self.prepare:
            rows = f(rows)
        flags = [c for c in rows.columns if c.startswith("__")]
        return rows.where(F.coalesce(self.predicate, F.lit(False))).drop(*flags)

    def candidates_and_selected(self, rows: DataFrame) -> tuple[int, int]:
        for f in self.prepare:
            rows = f(rows)
        r = rows.agg(F.count(F.lit(1)), F.count_if(F.coalesce(self.predicate, F.lit(False)))).first()
        return r[0], r[1]

    def __and__(self, other: Selector) -> Selector:
        if EMPTY in (self.constant, other.constant):
            return none()
        if self.constant == UNIVERSAL:
            return other
        if other.constant == UNIVERSAL:
            return self
        return self._with(other, "and", self.predicate & other.predicate)

    def __or__(self, other: Selector) -> Selector:
        if UNIVERSAL in (self.constant, other.constant):
            return all_()
        if self.constant == EMPTY:
            return other
        if other.constant == EMPTY:
            return self
        return self._with(other, "or", self.predicate | other.predicate)

    def __invert__(self) -> Selector:
        if self.constant == UNIVERSAL:
            return none()
        if self.constant == EMPTY:
            return all_()
        return Selector(f"not({self.description})", ~F.coalesce(self.predicate, F.lit(False)), prepare=self.prepare)

    def excluding(self, other: Selector) -> Selector:
        return self & ~other

    def _with(self, other: Selector, word: str, predicate: Column) -> Selector:
        first, second = sorted((self, other), key=lambda s: s.description)  # the same description whichever came first
        prepare = first.prepare + tuple(p for p in second.prepare if p not in first.prepare)
        return Selector(f"{word}({first.description}, {second.description})", predicate, prepare=prepare)


def all_() -> Selector:
    return Selector("all", F.lit(True), UNIVERSAL)


def none() -> Selector:
    return Selector("none", F.lit(False), EMPTY)


def named(column: str, pattern: NamePattern) -> Selector:
    """By any name column: binary_name, canonical_name, simple_name, package, resource, name, descriptor."""
    return Selector(f"{column} {pattern.describe()}", pattern.matches(F.col(column)))


def equals(column: str, *values: str) -> Selector:
    """Kind, visibility, nesting, input kind, container, parameter or field type, module kind."""
    return Selector(f"{column} in {sorted(values)}", F.col(column).isin(*values)) if values else none()


def has_item(column: str, value: str) -> Selector:
    """Modifiers and other array columns."""
    return Selector(f"{column} has {value}", F.array_contains(column, value))


def flag(column: str) -> Selector:
    """Boolean columns: record, sealed."""
    return Selector(column, F.col(column))


def parameters_are(column: str, *types: str) -> Selector:
    return Selector(f"{column} are {list(types)}", F.col(column) == F.array(*[F.lit(t) for t in types]) if types else F.size(column) == 0)


def listed(column: str, keys: DataFrame, description: str) -> Selector:
    """By membership in another table's one column: annotated types, assignable types, declaring owners."""
    name = f"__{uuid.uuid4().hex}"
    other = keys.toDF(column).distinct()

    def prepare(rows: DataFrame) -> DataFrame:
        return rows.join(other.withColumn(name, F.lit(True)), column, "left")

    return Selector(description, F.coalesce(F.col(name), F.lit(False)), prepare=(prepare,))


def containing(package_types: DataFrame, selector: Selector) -> Selector:
    """Packages that contain a selected type."""
    return listed("package", selector.select(package_types).select("package"), f"containing({selector.description})")


def lexical_names(types: DataFrame) -> DataFrame:
    """types (binary_name, simple_name, lexical_owner) with canonical_name; local and anonymous types, owner cycles and missing owners have none."""
    from latticework.operators.algorithms import cut

    out = cut(types.select("binary_name", "simple_name", F.col("lexical_owner").alias("up"), F.when(F.col("lexical_owner").isNull(), F.col("binary_name")).alias("canonical_name")), "names")
    while True:
        ready = out.where("canonical_name IS NOT NULL").select(F.col("binary_name").alias("up"), F.col("canonical_name").alias("above"))
        nxt = out.join(ready, "up", "left").select("binary_name", "simple_name", "up", F.coalesce("canonical_name", F.concat("above", F.lit("."), "simple_name")).alias("canonical_name"))
        nxt = cut(nxt, "names")
        if nxt.where("canonical_name IS NULL").count() == out.where("canonical_name IS NULL").count():
            return types.join(nxt.select("binary_name", "canonical_name"), "binary_name")
        out = nxt
