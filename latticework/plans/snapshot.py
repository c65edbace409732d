"""Bounded views of a graph: collapse, filter, merge, limit; every omission is counted."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.identity import identity_hash
from latticework.plans.graph import DETAIL, EDGE, Graph

REPORT_DOMAINS = ("PACKAGE", "TYPE", "MEMBER", "LAYER", "SLICE", "ARTIFACT", "MODULE")


@dataclass(frozen=True)
class SnapshotQuery:
    """mapping: (source, mapped) for layers, slices, artifacts and modules; a member falls back on its owner's mapping."""

    domain: str
    mapping: DataFrame | None = None
    kinds: tuple[str, ...] | None = None
    include: DataFrame | None = None
    exclude: DataFrame | None = None
    self_edges: bool = False
    max_nodes: int = 100
    max_edges: int = 500
    max_evidence: int = 20

    def including_kinds(self, *kinds: str) -> SnapshotQuery:
        return replace(self, kinds=tuple(sorted(kinds)))

    def limited_by(self, nodes: int, edges: int, evidence: int) -> SnapshotQuery:
        return replace(self, max_nodes=nodes, max_edges=edges, max_evidence=evidence)

    def collapsed(self, graph: Graph) -> DataFrame:
        """(source, id) of the nodes that have a place in the domain and pass the node filters."""
        key = F.col("stable_key")
        if self.mapping is None:
            own = {"PACKAGE": F.concat(F.lit("package:"), "package"), "TYPE": F.coalesce("owner_type", F.when(F.col("id_kind") == "type", key)), "MEMBER": F.when(F.col("id_kind") == "member", key)}[self.domain]
            rows = graph.nodes.select(key.alias("source"), own.alias("id"))
        else:
            m = self.mapping.select("source", "mapped")
            rows = graph.nodes.join(m.withColumnsRenamed({"source": "stable_key", "mapped": "direct"}), "stable_key", "left").join(m.withColumnsRenamed({"source": "owner_type", "mapped": "through"}), "owner_type", "left")
            rows = rows.select(key.alias("source"), F.coalesce("direct", "through").alias("id"))
        rows = rows.where("id IS NOT NULL")
        if self.include is not None:
            rows = rows.join(self.include.select("id").distinct(), "id", "left_semi")
        if self.exclude is not None:
            rows = rows.join(self.exclude.select("id").distinct(), "id", "left_anti")
        return rows.select("source", "id")

    def _evidence(self, graph: Graph, places: DataFrame) -> DataFrame:
        rows = graph.labelled(places.select(F.col("source").alias("id"), F.col("id").alias("label"))).withColumnsRenamed({"origin_label": "o", "target_label": "t"})
        if self.kinds is not None:
            rows = rows.where(F.col("kind").isin(*self.kinds) if self.kinds else F.lit(False))
        rows = rows.where("o IS NOT NULL AND t IS NOT NULL")
        return rows if self.self_edges else rows.where("o <> t")

    @staticmethod
    def _merged(graph: Graph, rows: DataFrame) -> DataFrame:
        """(o, t, kinds, n_source_edges, n_evidence): counted by source edge first, so each row is shuffled once, without its detail where the graph has no repeats."""
        rows = rows if graph.unique else rows.select("o", "t", *EDGE, *DETAIL).distinct()
        each = rows.groupBy("o", "t", *EDGE).agg(F.count(F.lit(1)).alias("n"))
        return each.groupBy("o", "t").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.count(F.lit(1)).alias("n_source_edges"), F.sum("n").alias("n_evidence"))

    def snapshot(self, graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, metadata): the first nodes by id, then the first edges between those, then each edge's first evidence.

        Edges merge over kinds.  The ranks are limits over sorted rows (a bounded top-n of each task), not windows over everything.
        """
        places = self.collapsed(graph)
        all_nodes = places.groupBy("id").agg(F.count(F.lit(1)).alias("n_sources"))
        nodes = all_nodes.orderBy("id").limit(self.max_nodes)
        rows = self._evidence(graph, places)
        all_edges = self._merged(graph, rows)
        kept = F.broadcast(nodes.select("id"))  # at most max_nodes rows, so what isn't shown is never shuffled
        shown_rows = rows.join(kept.withColumnRenamed("id", "o"), "o", "left_semi").join(kept.withColumnRenamed("id", "t"), "t", "left_semi")
        edges = self._merged(graph, shown_rows).orderBy("o", "t").limit(self.max_edges)
        shown = F.least(F.col("n_evidence"), F.lit(self.max_evidence))
        edges = edges.select(identity_hash(F.col("o"), F.col("t")).alias("edge_id"), F.col("o").alias("origin"), F.col("t").alias("target"), "kinds", "n_source_edges", "n_evidence", (F.col("n_evidence") - shown).alias("omitted_evidence"))
        metadata = (
            graph.nodes.agg(F.count(F.lit(1)).alias("source_nodes"))
            .join(all_nodes.agg(F.count(F.lit(1)).alias("matched_nodes")))
            .join(all_edges.agg(F.count(F.lit(1)).alias("matched_edges"), F.coalesce(F.sum("n_evidence"), F.lit(0)).alias("matched_evidence")))
            .join(edges.agg(F.count(F.lit(1)).alias("shown_edges"), F.coalesce(F.sum("omitted_evidence"), F.lit(0)).alias("omitted_evidence")))
        )  # one row by one row each
        metadata = metadata.select("source_nodes", "matched_nodes", F.greatest(F.col("matched_nodes") - self.max_nodes, F.lit(0)).alias("omitted_nodes"), "matched_edges", (F.col("matched_edges") - F.col("shown_edges")).alias("omitted_edges"), "matched_evidence", "omitted_evidence")
        return nodes, edges, metadata

    def evidence(self, graph: Graph, edges: DataFrame) -> DataFrame:
        """Each shown edge's first ``max_evidence`` distinct evidence rows."""
        rows = self._evidence(graph, self.collapsed(graph)).select(F.col("o").alias("origin"), F.col("t").alias("target"), "kind", *DETAIL).distinct()
        rows = rows.join(F.broadcast(edges.select("origin", "target")), ["origin", "target"], "left_semi")  # at most max_edges rows
        order = Window.partitionBy("origin", "target").orderBy("kind", *[F.asc_nulls_first(c) for c in DETAIL])
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.max_evidence)
