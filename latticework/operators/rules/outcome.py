"""What a rule gives, and its status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions.identity import identity_hash

PASSED, FAILED, SKIPPED, INCOMPLETE = "PASSED", "FAILED", "SKIPPED", "INCOMPLETE"
SEVERITIES = ("INFO", "WARNING", "ERROR")
VIOLATION = "rule_id string, violation_id string, code string, severity string, origin string, target string, kind string, n_evidence long"
DIAGNOSTIC = "rule_id string, code string, severity string, subject string, n long"


@dataclass(frozen=True)
class RuleMetadata:
    """Decorations leave the rule as it was and return a changed copy."""

    rule_id: str
    description: str = ""
    because: str = ""
    tags: tuple[str, ...] = ()
    severity: str = "ERROR"

    def named(self, description: str) -> RuleMetadata:
        return replace(self, description=description)

    def explained(self, because: str) -> RuleMetadata:
        return replace(self, because=because)

    def tagged(self, *tags: str) -> RuleMetadata:
        return replace(self, tags=tuple(sorted({*self.tags, *tags})))

    def with_severity(self, severity: str) -> RuleMetadata:
        if severity not in SEVERITIES:
            raise ValueError(f"a severity is one of {SEVERITIES}")
        return replace(self, severity=severity)


@dataclass(frozen=True)
class RuleOutcome:
    """selected: how many subjects the rule looked at, as a one-row DataFrame (n); allow_empty ALLOW, WARN or FAIL."""

    metadata: RuleMetadata
    violations: DataFrame
    diagnostics: DataFrame | None = None
    selected: DataFrame | None = None
    on_empty: str = "FAIL"
    skipped: str | None = None
    incomplete: DataFrame | None = field(default=None)

    def status(self) -> str:
        """Empty selection before incomplete before violations before pass; the counts are read in one job each."""
        if self.skipped:
            return SKIPPED
        if self.selected is not None and self.on_empty == "FAIL" and not (self.selected.first()[0] or 0):
            return INCOMPLETE
        if self.incomplete is not None and self.incomplete.limit(1).count():
            return INCOMPLETE
        return FAILED if self.violations.limit(1).count() else PASSED


def violations(metadata: RuleMetadata, rows: DataFrame, code: str | Column, *, origin: str = "origin", target: str | None = "target", kind: str | None = "kind", n: str | None = None) -> DataFrame:
    """Rows in the violation schema; the identity covers rule, code and the named ends."""
    none = F.lit(None).cast("string")
    code = F.lit(code) if isinstance(code, str) else code
    o, t, k = F.col(origin), F.col(target) if target else none, F.col(kind) if kind else none
    ident = identity_hash(F.lit(metadata.rule_id), code, o, t, k)
    return rows.select(
        F.lit(metadata.rule_id).alias("rule_id"), ident.alias("violation_id"), code.alias("code"), F.lit(metadata.severity).alias("severity"),
        o.alias("origin"), t.alias("target"), k.alias("kind"), (F.col(n) if n else F.lit(0)).cast("long").alias("n_evidence"),
    )


def diagnostics(metadata: RuleMetadata, rows: DataFrame, code: str, subject: str, n: Column | None = None) -> DataFrame:
    return rows.select(F.lit(metadata.rule_id).alias("rule_id"), F.lit(code).alias("code"), F.lit("ERROR").alias("severity"), F.col(subject).alias("subject"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def define(metadata: RuleMetadata, evaluate: Callable[[SparkSession, RuleMetadata], RuleOutcome]) -> Callable[[SparkSession], RuleOutcome]:
    """A custom rule from a Python callable."""
    return lambda spark: evaluate(spark, metadata)


def top_evidence(evidence: DataFrame, by: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` distinct evidence rows of each key, and how many there are; the rest is counted, not kept."""
    from latticework.plans.graph import DETAIL

    rows = evidence.select(*by, *DETAIL).distinct()
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("matched"))
    # A rank up to n is cut off in each task before the shuffle, so a key of any size sends n rows a task at most.
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*DETAIL))).where(F.col("place") <= n)
    first = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*DETAIL))).alias("evidence"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    found = counts.alias("c").join(first.alias("f"), same, "left")
    return found.select(*(F.col(f"c.{c}").alias(c) for c in by), F.coalesce("evidence", F.array().cast(first.schema["evidence"].dataType)).alias("evidence"), "matched", F.greatest(F.col("matched") - n, F.lit(0)).alias("omitted"))
