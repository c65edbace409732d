"""The dependency multigraph: nodes and normalised evidence, edges derived late."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.functions.identity import kind_of, owner_of, package_of

NODE_SCHEMA = T.StructType([
    T.StructField("stable_key", T.StringType(), False), T.StructField("id_kind", T.StringType(), False),
    T.StructField("owner_type", T.StringType()), T.StructField("package", T.StringType()),
])
EVIDENCE_SCHEMA = T.StructType([
    T.StructField("origin", T.StringType(), False), T.StructField("target", T.StringType(), False), T.StructField("kind", T.StringType(), False),
    T.StructField("location", T.StringType(), False), T.StructField("owner_member", T.StringType()), T.StructField("bytecode_offset", T.LongType()),
    T.StructField("source_file", T.StringType()), T.StructField("line_number", T.IntegerType()), T.StructField("synthetic", T.BooleanType()),
])
EDGE = ["origin", "target", "kind"]
DETAIL = ["location", "owner_member", "bytecode_offset", "source_file", "line_number"]


class GraphError(ValueError):
    """The graph breaks an invariant."""


@dataclass(frozen=True)
class Graph:
    """Nodes (stable_key, ...) and evidence rows; the edge of an evidence row is (origin, target, kind).

    Evidence is the base table, a set: ``rows`` may hold repeats, ``evidence`` has none.  Arrays are built
    only where a result asks for them, and connectivity reads two columns of ``rows``, so it never carries
    evidence through a shuffle.

    ``unique`` says that ``rows`` hold no repeats as they are made, so nothing is shuffled to find them.  ``attach`` gives what
    ``labelled`` does in a cheaper way: evidence that is joined from tables of nodes gets its labels there, once a node.  ``repeated``
    does the same where rows may come repeatedly.
    """

    nodes: DataFrame
    rows: DataFrame
    unique: bool = False
    attach: Callable[[DataFrame], DataFrame] | None = None
    repeated: Callable[[DataFrame], DataFrame] | None = None

    @property
    def evidence(self) -> DataFrame:
        return self.rows if self.unique else self.rows.distinct()

    def labelled(self, labels: DataFrame) -> DataFrame:
        """``rows`` with origin_label and target_label: ``label`` of either end from ``labels`` (id, label), null where it has none."""
        if self.attach is not None:
            return self.attach(labels)
        rows = self.rows.join(labels.select(F.col("id").alias("origin"), F.col("label").alias("origin_label")), "origin", "left")
        return rows.join(labels.select(F.col("id").alias("target"), F.col("label").alias("target_label")), "target", "left")

    def numbered(self, labels: DataFrame) -> DataFrame:
        """(origin, target), possibly repeated: connections by ``label`` of their ends from ``labels`` (id, label); those without both go."""
        rows = (self.repeated or self.labelled)(labels).where("origin_label IS NOT NULL AND target_label IS NOT NULL")
        return rows.select(F.col("origin_label").alias("origin"), F.col("target_label").alias("target"))

    def edges(self) -> DataFrame:
        """One row an edge with its distinct evidence, sorted (nulls first)."""
        return self.rows.groupBy(*EDGE).agg(F.sort_array(F.collect_set(F.struct(*DETAIL))).alias("evidence"))

    def edge_counts(self) -> DataFrame:
        """One row an edge with the number of its distinct evidence rows."""
        rows = self.rows if self.unique else self.rows.select(*EDGE, *DETAIL).distinct()
        return rows.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("n_evidence"))

    def connections(self) -> DataFrame:
        """Distinct (origin, target): parallel edges collapse before any connectivity."""
        return self.rows.select("origin", "target").distinct()

    def induced(self, keys: DataFrame) -> Graph:
        """The subgraph on ``keys`` (stable_key): its nodes, and the evidence between them."""
        kept = keys.select("stable_key").distinct()
        evidence = self.rows.join(kept.withColumnRenamed("stable_key", "origin"), "origin", "left_semi")
        evidence = evidence.join(kept.withColumnRenamed("stable_key", "target"), "target", "left_semi")
        return Graph(self.nodes.join(kept, "stable_key", "left_semi"), evidence.select(self.rows.columns), self.unique)

    def without_evidence(self, removed: Column) -> Graph:
        """Drops evidence rows; an edge goes with its last one, nodes stay."""
        kept = ~F.coalesce(removed, F.lit(False))
        attach, repeated = self.attach, self.repeated
        return replace(self, rows=self.rows.where(kept), attach=attach and (lambda labels: attach(labels).where(kept)), repeated=repeated and (lambda labels: repeated(labels).where(kept)))

    def isolated(self) -> DataFrame:
        """(stable_key): nodes at neither end of any edge."""
        ends = self.rows.select(F.explode(F.array("origin", "target")).alias("stable_key")).distinct()
        return self.nodes.select("stable_key").join(ends, "stable_key", "left_anti")

    def dangling(self) -> DataFrame:
        """(endpoint, n): endpoints of edges that are no node."""
        ends = self.evidence.select(F.explode(F.array("origin", "target")).alias("endpoint"))
        ends = ends.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))
        return ends.join(self.nodes.select(F.col("stable_key").alias("endpoint")), "endpoint", "left_anti")


def nodes_of(keys: DataFrame) -> DataFrame:
    """Node rows from distinct ``stable_key`` values: their kind, owner and package."""
    key = F.col("stable_key")
    owner = F.when(key.startswith("member:"), owner_of(key)).when(key.startswith("type:"), key)
    package = F.when(key.startswith("package:"), F.substring_index(key, ":", -1)).when(owner.isNotNull(), package_of(F.regexp_replace(owner, "^type:", "")))
    return keys.select("stable_key").distinct().select(key, kind_of(key).alias("id_kind"), owner.alias("owner_type"), package.alias("package"))


def conform(evidence: DataFrame) -> DataFrame:
    """Evidence rows with all columns of the schema; absent optional ones are null."""
    have = set(evidence.columns)
    return evidence.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVIDENCE_SCHEMA])


def build(nodes: DataFrame, evidence: DataFrame, *, check: bool = False) -> Graph:
    """Set semantics: nodes by key, evidence by all its columns.  ``check`` raises on endpoints that are no node."""
    graph = Graph(nodes.dropDuplicates(["stable_key"]), conform(evidence))
    if check and (row := graph.dangling().orderBy("endpoint").first()):
        raise GraphError(f"an edge ends at {row['endpoint']}, which is no node")
    return graph


def graph_from(evidence: DataFrame, isolated: DataFrame | None = None) -> Graph:
    """A graph whose nodes are the endpoints of its evidence, and ``isolated`` ones (stable_key)."""
    keys = evidence.select(F.explode(F.array("origin", "target")).alias("stable_key"))
    if isolated is not None:
        keys = keys.unionByName(isolated.select("stable_key"))
    return Graph(nodes_of(keys), conform(evidence))
