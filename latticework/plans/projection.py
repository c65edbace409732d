"""Projections of a graph to coarser domains, with a ledger of what they drop."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.plans.graph import EDGE, Graph, conform, nodes_of

DOMAINS = ("PACKAGE", "TYPE", "MEMBER", "CLASSPATH", "MODULE")


@dataclass(frozen=True)
class Projection:
    """An immutable plan; ``apply`` turns it into lazy DataFrames.

    mapping: (source, mapped) rows; they override the domain's own mapping.  CLASSPATH and MODULE have none of their own.
    """

    domain: str
    mapping: DataFrame | None = None
    kinds: tuple[str, ...] | None = None
    relabel: tuple[tuple[str, str], ...] = ()
    keep_self: bool = True
    excluded: DataFrame | None = None

    def including_only(self, *kinds: str) -> Projection:
        """Only these kinds; none given means no edge at all."""
        return replace(self, kinds=tuple(sorted(kinds)))

    def relabeling(self, **kinds: str) -> Projection:
        return replace(self, relabel=tuple(sorted(kinds.items())))

    def without_self_edges(self) -> Projection:
        return replace(self, keep_self=False)

    def excluding(self, edges: DataFrame) -> Projection:
        """Exact source edges (origin, target, kind) to leave out."""
        return replace(self, excluded=edges)

    def _own(self, nodes: DataFrame) -> DataFrame:
        """(source, own): the domain's own mapping of the graph's nodes, null where it has none."""
        key = F.col("stable_key")
        owner_package = F.regexp_replace(F.col("package"), "^", "package:")
        own = {
            "PACKAGE": F.when(F.col("id_kind") == "package", key).when(F.col("package").isNotNull(), owner_package),
            "TYPE": F.when(F.col("id_kind") == "type", key).otherwise(F.col("owner_type")),
            "MEMBER": F.when(F.col("id_kind") == "member", key),
        }.get(self.domain, F.lit(None).cast("string"))
        return nodes.select(key.alias("source"), own.alias("own"))

    def mapped_nodes(self, nodes: DataFrame) -> DataFrame:
        """(source, mapped) of every node; null where nothing maps it."""
        found = self._own(nodes)
        if self.mapping is not None:
            given = self.mapping.select(F.col("source"), F.col("mapped").alias("given"))
            found = found.join(given, "source", "left").select("source", F.coalesce("given", "own").alias("own"))
        return found.select("source", F.col("own").alias("mapped"))

    def judged(self, graph: Graph) -> DataFrame:
        """Evidence with its mapped ends, new kind and drop_reason (null: kept); reasons in the order kind, exclusion, mapping, self."""
        ends = self.mapped_nodes(graph.nodes)
        rows = graph.labelled(ends.withColumnsRenamed({"source": "id", "mapped": "label"})).withColumnsRenamed({"origin_label": "new_origin", "target_label": "new_target"})
        excluded = F.lit(False)
        if self.excluded is not None:
            rows = rows.join(self.excluded.select(*EDGE).distinct().withColumn("out", F.lit(True)), EDGE, "left")
            excluded = F.coalesce("out", F.lit(False))
        kind = F.col("kind")
        for old, new in self.relabel:
            kind = F.when(F.col("kind") == old, new).otherwise(kind)
        wrong_kind = F.lit(False) if self.kinds is None else ~F.col("kind").isin(*self.kinds) if self.kinds else F.lit(True)
        unmapped = F.col("new_origin").isNull() | F.col("new_target").isNull()
        reason = F.when(wrong_kind, "FILTERED_KIND").when(excluded, "EXPLICITLY_EXCLUDED").when(unmapped, "UNMAPPED_ENDPOINT")
        if not self.keep_self:
            reason = reason.when(F.col("new_origin") == F.col("new_target"), "SELF_EDGE")
        return rows.withColumn("new_kind", kind).withColumn("drop_reason", reason)

    def apply(self, graph: Graph) -> tuple[Graph, DataFrame]:
        """(the projected graph, its ledger: origin, target, kind, drop_reason of each dropped source edge).  Isolated nodes stay."""
        rows = self.judged(graph)
        kept = rows.where("drop_reason IS NULL").drop("origin", "target", "kind", "drop_reason")
        evidence = conform(kept.withColumnsRenamed({"new_origin": "origin", "new_target": "target", "new_kind": "kind"}))
        keys = self.mapped_nodes(graph.nodes).where("mapped IS NOT NULL").select(F.col("mapped").alias("stable_key"))
        dropped = rows.where("drop_reason IS NOT NULL").select(*EDGE, "drop_reason").distinct()
        return Graph(nodes_of(keys), evidence), dropped


def packages() -> Projection:
    return Projection("PACKAGE")


def types() -> Projection:
    return Projection("TYPE")


def members() -> Projection:
    return Projection("MEMBER")


def modules(mapping: DataFrame) -> Projection:
    return Projection("MODULE", mapping)


def classpath(mapping: DataFrame) -> Projection:
    return Projection("CLASSPATH", mapping)
