"""Lookups: the last entry at or before a probe, and winners by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(probes: DataFrame, entries: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``probes`` with ``value`` of the last of ``entries`` at or before them within ``by``; null where there is none.

    Both sides share one sorted shuffle on ``by`` instead of a join on a range.
    """
    others = [c for c in probes.columns if c not in (*by, *order)]
    left = probes.select(*by, *order, F.struct(*others).alias("__probe") if others else F.lit(True).alias("__probe"), F.lit(None).cast(entries.schema[value].dataType).alias(value), F.lit(1).alias("__side"))
    right = entries.select(*by, *order, F.lit(None).cast(left.schema["__probe"].dataType).alias("__probe"), value, F.lit(0).alias("__side"))
    w = Window.partitionBy(*by).orderBy(*order, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = left.unionByName(right).withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__side = 1")
    return rows.select(*by, *order, *[F.col(f"__probe.{c}").alias(c) for c in others], value)


def as_of_ranges(probes: DataFrame, entries: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``as_of`` where one key may hold most rows: a scan in two levels, so that no task holds a key.

    Rows are dealt to ranges of (by, order).  Within a key and range a window finds the last entry; across ranges each hands
    on its last entry by a running prefix over (key, range), of which there are few.  Entries of one place count by value, the largest
    last.
    """
    from latticework.operators.algorithms import cut

    others = [c for c in probes.columns if c not in (*by, *order)]
    probe = F.struct(*others) if others else F.struct(F.lit(True).alias("here"))
    left = probes.select(*by, *order, probe.alias("__probe"), F.lit(None).cast(entries.schema[value].dataType).alias(value), F.lit(1).alias("__side"))
    right = entries.select(*by, *order, F.lit(None).cast(left.schema["__probe"].dataType).alias("__probe"), value, F.lit(0).alias("__side"))
    keys = [*by, *order, "__side", value]
    rows = left.unionByName(right).withColumn("__place", F.monotonically_increasing_id())  # many rows of one place are no hot range either
    rows = cut(rows.repartitionByRange(*keys, "__place").withColumn("__range", F.spark_partition_id()).drop("__place"), "ranges")
    inner = Window.partitionBy(*by, "__range").orderBy(*order, "__side", value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entry = (F.col("__side") == 0) & F.col(value).isNotNull()
    last = rows.groupBy(*by, "__range").agg(F.max_by(value, F.when(entry, F.struct(*order, F.col(value)))).alias("__last"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select(F.struct(*by).alias("__key"), F.col("__range").alias("__at"), F.last("__last", ignorenulls=True).over(before).alias("__handed"))
    found = rows.withColumn("__inner", F.last(value, ignorenulls=True).over(inner)).where("__side = 1")
    found = found.join(handed, F.struct(*by).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__at")))
    return found.select(*by, *order, *[F.col(f"__probe.{c}").alias(c) for c in others], F.coalesce("__inner", "__handed").alias(value))


def line_of(accesses: DataFrame, line_table: DataFrame) -> DataFrame:
    """Accesses (member, offset, ...) with the line of the largest line-table (member, pc, line) offset at or before theirs."""
    return as_of(accesses, line_table.withColumnRenamed("pc", "offset"), ["member"], ["offset"], "line")


def winners(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """All rows with ``winner``: the first of each ``by`` under ``order``; the others are its shadows."""
    return rows.withColumn("winner", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)


def classpath_winners(resources: DataFrame, *, release: int | None = None) -> DataFrame:
    """One resource a (scope, name): lowest precedence, then highest release.

    Versioned entries (release of 9 or more) count only in multi-release archives and up to the target ``release``.
    """
    if release is not None:
        base = F.col("release") == 0
        resources = resources.where(base | (F.col("multi_release") & (F.col("release") >= 9) & (F.col("release") <= release)))
    return winners(resources, ["scope", "name"], [F.col("precedence"), F.col("release").desc(), F.col("resource")])


def resolve_in_scopes(references: DataFrame, types: DataFrame, reads: DataFrame) -> DataFrame:
    """``references`` (scope, name, ...) with ``found``: the scope that holds the name for them, null where none does.

    types: scope, name.  reads: scope, reads, place.  A scope's own types come first, then those of the scopes it reads, by place
    and name.  References meet the types once a distinct (scope, name), so a name that all of them use is no hot key.
    """
    asked = references.select("scope", "name").distinct()
    readable = reads.select("scope", F.col("reads").alias("in"), "place").where(F.col("scope") != F.col("reads"))
    held = types.select(F.col("scope").alias("in"), "name").distinct()
    own = asked.join(held.withColumnRenamed("in", "scope"), ["scope", "name"], "left_semi").select("scope", "name", F.col("scope").alias("found"))
    rest = asked.join(own, ["scope", "name"], "left_anti")
    other = rest.join(readable, "scope").join(held, ["in", "name"]).groupBy("scope", "name").agg(F.min(F.struct("place", "in")).alias("first")).select("scope", "name", F.col("first.in").alias("found"))
    return references.join(own.unionByName(other), ["scope", "name"], "left")


def expand_manifest(entries: DataFrame, manifests: DataFrame, *, max_depth: int = 8, max_entries: int = 1_000) -> DataFrame:
    """(path, depth): class-path entries (path) and what their manifests (path, entry) name, breadth first within bounds."""
    from latticework.operators.algorithms import reachable

    found = reachable(manifests.select(F.col("path").alias("origin"), F.col("entry").alias("target")), entries.select(F.col("path").alias("id")), max_rounds=max_depth)
    if found.limit(max_entries + 1).count() > max_entries:
        raise ValueError(f"a class path has {max_entries} entries at most")
    return found.select(F.col("id").alias("path"), "depth")
