"""Dependency, cohesion and source metrics, and thresholds over their samples."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.operators.algorithms import cut, dense, reach_of_numbers, weak_components
from latticework.operators.rules.outcome import RuleMetadata, RuleOutcome, violations
from latticework.plans.graph import Graph

COMPUTED, NOT_APPLICABLE, INCOMPLETE_EVIDENCE = "COMPUTED", "NOT_APPLICABLE", "INCOMPLETE_EVIDENCE"


def coupling(connections: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, ca, ce, instability) on the graph induced by ``subjects`` (subject): distinct neighbours, self edges left out."""
    keys = subjects.select("subject").distinct()
    e = connections.where("origin <> target").join(keys.withColumnRenamed("subject", "origin"), "origin", "left_semi").join(keys.withColumnRenamed("subject", "target"), "target", "left_semi").select("origin", "target").distinct()
    # One pass: each edge counts once for either end.
    ends = e.select(F.explode(F.array(F.struct(F.col("origin").alias("subject"), F.lit(1).alias("o")), F.struct(F.col("target").alias("subject"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    counts = ends.groupBy("subject").agg(F.sum(1 - F.col("o")).alias("ca"), F.sum("o").alias("ce"))
    out = keys.join(counts, "subject", "left").select("subject", F.coalesce("ca", F.lit(0)).cast("long").alias("ca"), F.coalesce("ce", F.lit(0)).cast("long").alias("ce"))
    return out.withColumn("instability", F.when(F.col("ca") + F.col("ce") == 0, 0.0).otherwise(F.col("ce") / (F.col("ca") + F.col("ce"))))


def compositions(types: DataFrame, *, public_only: bool = False) -> DataFrame:
    """(subject, n_types, n_abstract) by package: abstract classes, interfaces and annotations; package-info is left out.  types: subject, binary_name, kind, modifiers."""
    rows = types.where(~F.col("binary_name").endswith("package-info"))
    if public_only:
        rows = rows.where(F.array_contains("modifiers", "PUBLIC"))
    abstract = F.array_contains("modifiers", "ABSTRACT") | F.col("kind").isin("INTERFACE", "ANNOTATION")
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n_types"), F.count_if(abstract).alias("n_abstract"))


def martin(connections: DataFrame, subjects: DataFrame, composition: DataFrame) -> DataFrame:
    """(subject, ca, ce, instability, abstractness, distance); without a composition abstractness is 0."""
    rows = coupling(connections, subjects).join(composition, "subject", "left")
    rows = rows.withColumn("abstractness", F.when(F.coalesce("n_types", F.lit(0)) == 0, 0.0).otherwise(F.col("n_abstract") / F.col("n_types")))
    return rows.select("subject", "ca", "ce", "instability", "abstractness", F.abs(F.col("abstractness") + F.col("instability") - 1).alias("distance"))


def reach_counts(connections: DataFrame | Graph, subjects: DataFrame, *, by: str = "parts") -> DataFrame:
    """(subject, depends_on): how many subjects each one reaches, itself included; ``by`` as in ``reach_of_numbers``.

    A graph in place of its connections is cheaper: it numbers the ends where its evidence is made.
    """
    keys = dense(subjects.select(F.col("subject").alias("name")).distinct(), "name")
    if isinstance(connections, Graph):
        e = connections.numbered(keys.select(F.col("name").alias("id"), F.col("id").alias("label")))
    else:
        e = connections
        for end in ("origin", "target"):
            e = e.join(keys.select(F.col("name").alias(end), F.col("id").alias(f"{end}_id")), end)
        e = e.select(F.col("origin_id").alias("origin"), F.col("target_id").alias("target"))
    found = reach_of_numbers(cut(e, "edges"), keys.select("id"), by=by)
    return found.join(keys, "id").select(F.col("name").alias("subject"), F.col("reached").alias("depends_on"))


def cumulative(counts: DataFrame) -> DataFrame:
    """One row (n, ccd, acd, racd, nccd) from reach counts; all 0 for no subject.

    NCCD divides by the sum of floor(log2 i) + 1 over 1..n, in closed form: (n + 1) * (k + 1) - 2 ** (k + 1) + 1 with k = floor(log2 n).
    """
    total = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("depends_on"), F.lit(0)).alias("ccd"))
    n, ccd = F.col("n"), F.col("ccd")
    k = F.length(F.bin(n)) - 1
    balanced = (n + 1) * (k + 1) - F.pow(F.lit(2), k + 1).cast("long") + 1
    return total.select("n", "ccd", F.when(n == 0, 0.0).otherwise(ccd / n).alias("acd"), F.when(n == 0, 0.0).otherwise(ccd / (n * n)).alias("racd"), F.when(n == 0, 0.0).otherwise(ccd / balanced).alias("nccd"))


def lcom1(uses: DataFrame, methods: DataFrame) -> DataFrame:
    """(type, lcom1): pairs of methods without a common field less those with one, at least 0.

    Pairs that share are found by the field they share; the others are what is left of all pairs, so no pair without a field in common is ever built.
    """
    n = methods.select("type", "method").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("m"))
    u = uses.select("type", "method", "field").distinct()
    other = u.select("type", "field", F.col("method").alias("method2"))
    sharing = u.join(other, ["type", "field"]).where("method < method2").select("type", "method", "method2").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("s"))
    pairs = F.expr("m * (m - 1) div 2")
    s = F.coalesce("s", F.lit(0))
    return n.join(sharing, "type", "left").select("type", F.greatest(pairs - 2 * s, F.lit(0)).cast("long").alias("lcom1"))


def lcom_hs(uses: DataFrame, methods: DataFrame, fields: DataFrame) -> DataFrame:
    """(type, lcom_hs, availability): Henderson-Sellers clamped to 0..1; not applicable below two methods or without a field."""
    m = methods.select("type", "method").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("m"))
    f = fields.select("type", "field").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("f"))
    u = uses.select("type", "method", "field").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("u"))
    rows = m.join(f, "type", "left").join(u, "type", "left").fillna(0, ["f", "u"])
    able = (F.col("m") >= 2) & (F.col("f") > 0)
    value = (F.col("m") * F.col("f") - F.col("u")) / ((F.col("m") - 1) * F.col("f"))
    return rows.select("type", F.when(able, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).alias("lcom_hs"), F.when(able, COMPUTED).otherwise(NOT_APPLICABLE).alias("availability"))


def lcom4(uses: DataFrame, methods: DataFrame, calls: DataFrame) -> DataFrame:
    """(type, lcom4): components of methods joined by a common field or by a call on the same type.  calls: type, method, callee.

    Methods meet at their fields, which are nodes too: a field of k methods makes k edges, not k * k.
    """
    node = lambda kind, c: F.concat_ws("\x01", "type", F.lit(kind), c)
    nodes = methods.select(node("m", "method").alias("id"), "type").distinct()
    edges = uses.select(node("m", "method").alias("origin"), node("f", "field").alias("target")).unionByName(calls.select(node("m", "method").alias("origin"), node("m", "callee").alias("target")))
    edges = edges.where("origin <> target").distinct()
    every = nodes.select("id").unionByName(edges.select(F.col("origin").alias("id"))).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    found = weak_components(edges, every)
    return found.join(nodes, "id").groupBy("type").agg(F.count_distinct("component").alias("lcom4"))


def cohesion_availability(has_body: Column, n_methods: Column) -> Column:
    """Interfaces and types without methods have no cohesion; a missing body leaves the evidence incomplete."""
    return F.when(n_methods == 0, NOT_APPLICABLE).when(~has_body, INCOMPLETE_EVIDENCE).otherwise(COMPUTED)


def member_counts(members: DataFrame, by: str = "owner") -> DataFrame:
    """(subject, members, fields, methods, constructors, initializers) by type or package."""
    kind = F.col("kind")
    return members.groupBy(F.col(by).alias("subject")).agg(
        F.count(F.lit(1)).alias("members"), F.count_if(kind == "FIELD").alias("fields"), F.count_if(kind == "METHOD").alias("methods"),
        F.count_if(kind == "CONSTRUCTOR").alias("constructors"), F.count_if(kind == "STATIC_INITIALIZER").alias("initializers"),
    )


#: White space of the source language.
_SPACE = r"\t-\r\x1c-\x20\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000"
#: What a source text is made of, white space apart: comments; text blocks, strings and characters; and the rest.
_LEXEME = re.compile(
    rf"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |\"{{3}}(?:\\.|[^\\])*?(?:\"{{3}}|\\?\Z)
    |(?P<quote>["'])(?:\\[^\n]|(?!(?P=quote))[^\\\n])*(?P=quote)?
    |[^{_SPACE}"'/]+|/""",
    re.DOTALL | re.VERBOSE,
)


def line_kinds(text: str) -> tuple[int, int, int, int]:
    """(physical, blank, comment, code) lines of Java source: every lexeme marks the lines it covers, and code outweighs a comment.

    A closing line break adds no line.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    n = len(starts) - (starts[-1] == len(text))
    marks = bytearray(len(starts))
    for m in _LEXEME.finditer(text):
        mark = 1 if m["comment"] else 2
        for line in range(bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1)):
            marks[line] |= mark
    code, comment = sum(x >= 2 for x in marks[:n]), marks[:n].count(1)
    return n, n - code - comment, comment, code


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in ("physical", "blank", "comment", "code")]))
def source_lines(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Line counts of whole documents; comments carry over from line to line, which no expression does."""
    for t in texts:
        yield pd.DataFrame([line_kinds(x or "") for x in t], columns=["physical", "blank", "comment", "code"])


def match_sources(types: DataFrame, documents: DataFrame) -> DataFrame:
    """(package, source_file, state): MATCHED, MISSING or EXCLUDED_GENERATED.  types: package, source_file, generated; documents: package, source_file."""
    there = documents.select("package", "source_file").distinct().withColumn("there", F.lit(True))
    rows = types.groupBy("package", "source_file").agg(F.bool_and("generated").alias("generated")).join(there, ["package", "source_file"], "left")
    return rows.select("package", "source_file", F.when(F.col("generated"), "EXCLUDED_GENERATED").when(F.col("there"), "MATCHED").otherwise("MISSING").alias("state"))


def samples(rows: DataFrame, subject: str, metrics: list[str]) -> DataFrame:
    """(subject, metric, amount): a wide metric table as samples."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("amount")) for m in metrics])
    return rows.select(F.col(subject).alias("subject"), F.explode(pairs).alias("x")).select("subject", "x.metric", "x.amount")


def threshold(metadata: RuleMetadata, found: DataFrame, metric: str, comparison: str, limit: float) -> RuleOutcome:
    """AT_MOST or AT_LEAST over samples (subject, metric, amount)."""
    beyond = {"AT_MOST": F.col("amount") > limit, "AT_LEAST": F.col("amount") < limit}[comparison]
    rows = found.where(F.col("metric") == metric)
    bad = rows.where(beyond).withColumn("shown", F.col("amount").cast("string"))
    return RuleOutcome(metadata, violations(metadata, bad, "METRIC_BEYOND", origin="subject", target="shown", kind="metric"), selected=rows.agg(F.count(F.lit(1)).alias("n")))
