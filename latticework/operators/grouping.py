"""Slices, layers and packages: which group a type belongs to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.identity import check_layer_name
from latticework.functions.patterns import slice_capture
from latticework.plans.graph import Graph


class GroupingError(ValueError):
    """Membership is ambiguous or incomplete where the definition forbids it."""


def _candidates(types: DataFrame, captures: list[str], explicit: list[tuple[str, Column]]) -> DataFrame:
    """(type_key, group_id) candidates; types: type_key, package and what the explicit predicates need."""
    parts = [types.select("type_key", slice_capture(c, F.col("package")).alias("group_id")) for c in captures]
    parts += [types.select("type_key", F.when(predicate, name).alias("group_id")) for name, predicate in explicit]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("group_id IS NOT NULL").distinct()


@dataclass(frozen=True)
class SliceDefinitions:
    """Capture patterns and explicit predicates; overlap FAIL or FIRST_BY_NAME, unmatched IGNORE or FAIL."""

    captures: tuple[str, ...] = ()
    explicit: tuple[tuple[str, Column], ...] = field(default=())
    overlap: str = "FAIL"
    unmatched: str = "IGNORE"

    def assign(self, types: DataFrame) -> DataFrame:
        """(type_key, group_id), one slice a type."""
        found = _candidates(types, list(self.captures), list(self.explicit))
        counted = found.groupBy("type_key").agg(F.min("group_id").alias("group_id"), F.count(F.lit(1)).alias("k"))
        if self.overlap == "FAIL" and (row := counted.where("k > 1").orderBy("type_key").first()):
            raise GroupingError(f"{row['type_key']} is in {row['k']} slices")
        if self.unmatched == "FAIL" and (row := types.select("type_key").join(counted, "type_key", "left_anti").orderBy("type_key").first()):
            raise GroupingError(f"{row['type_key']} is in no slice")
        return counted.select("type_key", "group_id")


@dataclass(frozen=True)
class Layer:
    name: str
    predicate: Column
    required: bool = True

    def __post_init__(self) -> None:
        check_layer_name(self.name)


def layer_membership(types: DataFrame, layers: list[Layer], *, overlap: str = "FAIL") -> DataFrame:
    """(type_key, group_id); a required layer must have a type, and a type at most one layer (or, FIRST_BY_NAME, the first)."""
    found = _candidates(types, [], [(x.name, x.predicate) for x in layers])
    counted = found.groupBy("type_key").agg(F.min("group_id").alias("group_id"), F.count(F.lit(1)).alias("k"))
    if overlap == "FAIL" and (row := counted.where("k > 1").orderBy("type_key").first()):
        raise GroupingError(f"{row['type_key']} is in {row['k']} layers")
    filled = {r["group_id"] for r in counted.select("group_id").distinct().collect()}  # as many as there are layers
    if empty := [x.name for x in layers if x.required and x.name not in filled]:
        raise GroupingError(f"layer {empty[0]} is required and has no type")
    return counted.select("type_key", "group_id")


def package_index(types: DataFrame) -> DataFrame:
    """(package, n_types, has_package_info, origins): split packages merge, package-info counts apart.  types: binary_name, package, container."""
    info = F.col("binary_name").endswith("package-info")
    return types.groupBy("package").agg(F.count_if(~info).alias("n_types"), F.bool_or(info).alias("has_package_info"), F.array_join(F.sort_array(F.collect_set("container")), ",").alias("origins"))


def grouped(graph: Graph, membership: DataFrame, unassigned: str | None = None) -> DataFrame:
    """The graph's rows with group_origin and group_target, as ``group_edges`` has them."""
    rows = graph.labelled(membership.select(F.col("type_key").alias("id"), F.col("group_id").alias("label")))
    rows = rows.withColumnsRenamed({"origin_label": "group_origin", "target_label": "group_target"})
    return rows.fillna(unassigned, ["group_origin", "group_target"]) if unassigned is not None else rows.where("group_origin IS NOT NULL AND group_target IS NOT NULL")


def group_edges(connections: DataFrame, membership: DataFrame, unassigned: str | None = None) -> DataFrame:
    """Evidence or connections with group_origin and group_target; types of no group get ``unassigned``, or their rows go."""
    how = "inner" if unassigned is None else "left"
    rows = connections.join(membership.withColumnsRenamed({"type_key": "origin", "group_id": "group_origin"}), "origin", how)
    rows = rows.join(membership.withColumnsRenamed({"type_key": "target", "group_id": "group_target"}), "target", how)
    if unassigned is not None:
        rows = rows.fillna(unassigned, ["group_origin", "group_target"])
    return rows
