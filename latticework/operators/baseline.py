"""Baselines: fingerprints, comparison with a frozen state, suppressions."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.functions.identity import identity_hash

FINDING = T.StructType([T.StructField(n, T.StringType(), False) for n in ("identity_fp", "evidence_fp", "exact_fp", "rule_id", "subject_id", "code")])
SCHEMA_VERSION = "baseline-1"


def fingerprints(found: DataFrame) -> DataFrame:
    """Findings (rule_id, code, subject_id, location) with identity (what), evidence (where) and exact (both) fingerprints."""
    ident, where = identity_hash(F.col("rule_id"), F.col("code"), F.col("subject_id")), identity_hash(F.col("location"))
    return found.select(ident.alias("identity_fp"), where.alias("evidence_fp"), identity_hash(ident, where).alias("exact_fp"), "rule_id", "subject_id", "code", "location")


def compare(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(identity_fp, evidence_fp, state): NEW, UNCHANGED, MOVED or RESOLVED, as a multiset.

    Current findings go in order; each takes the first unused equal finding of the baseline, else the first unused
    one of the same identity.  That is sequential within an identity; it comes as counts by evidence, and one walk over them
    in order pairs them all.  Identities are many and small, so a task walks over all of its own in one sorted stream and holds one
    at a time.
    """

    def pair(identity: str, names: list[str], left: list[int], new: list[int]) -> list[tuple]:
        out, front = [], 0  # all before front is used up
        for k, n in enumerate(new):
            same = min(n, left[k])
            left[k] -= same
            n -= same
            moved = n
            while n and front < len(left):
                used = min(n, left[front])
                left[front] -= used
                n -= used
                front += not left[front]
            out += [(names[k], state, count) for state, count in (("UNCHANGED", same), ("MOVED", moved - n), ("NEW", n)) if count]
        out += [(names[k], "RESOLVED", count) for k, count in enumerate(left) if count]
        return [(identity, *x) for x in out]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda out: pd.DataFrame(out, columns=["identity_fp", "evidence_fp", "state", "n"])
        at, held = None, ([], [], [])
        for rows in batches:
            out: list[tuple] = []
            for identity, *row in zip(*(rows[c].tolist() for c in ("identity_fp", "evidence_fp", "old", "new")), strict=True):
                if identity != at:
                    out += pair(at, *held)
                    at, held = identity, ([], [], [])
                for column, value in zip(held, row, strict=True):
                    column.append(value)
            yield frame(out)
        yield frame(pair(at, *held))

    rows = baseline.select("identity_fp", "evidence_fp", F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(current.select("identity_fp", "evidence_fp", F.lit(0).alias("old"), F.lit(1).alias("new")))
    rows = rows.groupBy("identity_fp", "evidence_fp").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    rows = rows.repartition("identity_fp").sortWithinPartitions("identity_fp", "evidence_fp")
    found = rows.mapInPandas(walk, "identity_fp string, evidence_fp string, state string, n long")
    return found.select("identity_fp", "evidence_fp", "state", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("one")).drop("one")


def suppress(changes: DataFrame, suppressions: DataFrame, on: datetime.date) -> DataFrame:
    """Current changes with SUPPRESSED where an active suppression fits, else EXPIRED where only expired ones do.

    A suppression (rule_id, subject_id, location; null fits all; expires_on) expires strictly after its date.
    changes: rule_id, subject_id, location, state.
    """
    names = ("rule_id", "subject_id", "location")
    active = F.col("expires_on").isNull() | (F.col("expires_on") >= F.lit(on))
    # By which keys a suppression names: each kind that occurs, eight at most, is one row a key and an equi-join; one that names none is a constant.
    kind = sum(F.when(F.col(n).isNotNull(), 1 << i).otherwise(0) for i, n in enumerate(names))
    kinds = {r["kind"]: r["active"] for r in suppressions.groupBy(kind.alias("kind")).agg(F.bool_or(active).alias("active")).collect()}
    out, fits = changes, [F.lit(None).cast("boolean")] * 2
    for k, any_active in sorted(kinds.items()):
        keys = [n for i, n in enumerate(names) if k >> i & 1]
        if keys:
            out = out.join(suppressions.where(kind == k).groupBy(*keys).agg(F.bool_or(active).alias(f"_active{k}")), keys, "left")
        fits.append(F.col(f"_active{k}") if keys else F.lit(any_active))
    best = F.greatest(*fits)  # true before false, nulls left out
    state = F.when(F.col("state") == "RESOLVED", "RESOLVED").when(best, "SUPPRESSED").when(~best, "EXPIRED").otherwise(F.col("state"))
    return out.withColumn("state", state).select(*changes.columns)


def freeze(current: DataFrame, suppressed: DataFrame) -> DataFrame:
    """What a new baseline holds: all current findings but the actively suppressed (exact_fp)."""
    return current.join(suppressed.select("exact_fp").distinct(), "exact_fp", "left_anti")


def write_baseline(found: DataFrame, path: str) -> None:
    """Sorted JSON lines, one finding each, with the schema's version."""
    found.select(F.lit(SCHEMA_VERSION).alias("schema_version"), *[f.name for f in FINDING]).orderBy("identity_fp", "evidence_fp").write.json(path)


def read_baseline(spark: SparkSession, path: str, *, max_findings: int = 1_000_000) -> DataFrame:
    """Strict: malformed lines, unknown or missing fields, other versions and too many findings are errors."""
    lines = spark.read.text(path)
    names = {f.name for f in FINDING} | {"schema_version"}
    keys = F.json_object_keys("value")
    bad = lines.where(keys.isNull() | (F.size(F.array_except(keys, F.array(*map(F.lit, sorted(names))))) > 0) | (F.size(keys) != len(names)))
    if row := bad.first():
        raise ValueError(f"not a baseline line: {row['value'][:80]}")
    schema = T.StructType([T.StructField("schema_version", T.StringType()), *FINDING])
    found = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if found.where(f"schema_version <> '{SCHEMA_VERSION}'").limit(1).count():
        raise ValueError("the baseline has another version")
    if found.limit(max_findings + 1).count() > max_findings:
        raise ValueError(f"a baseline has {max_findings} findings at most")
    return found.drop("schema_version")


def diff_text(changes: DataFrame, limit: int = 100) -> str:
    """A bounded listing: counts by state, then the first changes."""
    counts = {r["state"]: r["count"] for r in changes.groupBy("state").count().collect()}
    rows = changes.where("state <> 'UNCHANGED'").orderBy(*changes.columns).limit(limit).collect()
    return json.dumps(counts, sort_keys=True) + "\n" + "".join(f"{r['state']} " + " ".join(str(r[c]) for c in changes.columns if c != "state") + "\n" for r in rows)
