"""Queries over the driver's tables, one or more an operator, each with its DuckDB form where SQL has one."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework import workloads as wl
from latticework.functions import descriptors, patterns
from latticework.functions.classify import sarif_level
from latticework.functions.escapes import neutral_csv
from latticework.functions.identity import identity_hash, kind_of, package_of, valid_key
from latticework.operators import algorithms, baseline, grouping, hierarchy, lookup, metrics
from latticework.operators.rules import dependencies as dep
from latticework.operators.rules import modules as mod
from latticework.operators.rules import structure
from latticework.operators.rules.outcome import RuleMetadata, top_evidence
from latticework.plans import projection, selectors
from latticework.plans.graph import EDGE, Graph, graph_from
from latticework.plans.snapshot import SnapshotQuery

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("id"))


def _shown(outcome, *columns: str) -> DataFrame:
    return outcome.violations.select(*columns)


# ---- graph kernel and projection -----------------------------------------------------------------


@query(f"WITH {wl.TRADE_SQL} SELECT origin, target, kind, count(*) AS n_evidence FROM trade GROUP BY origin, target, kind")
def graph_build(spark: SparkSession, sf: str) -> DataFrame:
    return wl.trade(spark, sf).edge_counts()


@query(f"""WITH {wl.FLOW_SQL}, d AS (SELECT DISTINCT origin, target, kind, location, bytecode_offset FROM flow)
SELECT origin, target, kind, string_agg(location || '@' || bytecode_offset, ',' ORDER BY location, bytecode_offset) AS evidence FROM d GROUP BY origin, target, kind""")
def graph_edges_evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = wl.flow(spark, sf).edges()
    return e.select(*EDGE, F.array_join(F.transform("evidence", lambda x: F.concat(x["location"], F.lit("@"), x["bytecode_offset"])), ",").alias("evidence"))


@query(f"""WITH {wl.TRADE_SQL}, here AS (SELECT DISTINCT type_key FROM catalog WHERE public),
ends AS (SELECT origin AS endpoint FROM trade UNION ALL SELECT target FROM trade)
SELECT endpoint, count(*) AS n FROM ends WHERE NOT EXISTS (SELECT 1 FROM here WHERE type_key = endpoint) GROUP BY endpoint""")
def graph_dangling_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.trade(spark, sf)
    public = wl.catalog(spark, sf).where(F.array_contains("modifiers", "PUBLIC")).select(F.col("type_key").alias("stable_key"))
    return Graph(g.nodes.join(public, "stable_key", "left_semi"), g.rows).dangling()


_PROJECT = """SELECT origin, target, kind, count(*) AS n_evidence FROM (SELECT DISTINCT {o} AS origin, {t} AS target, {k} AS kind, location, bytecode_offset FROM {g}{w}) GROUP BY origin, target, kind"""
_PKG = "'package:' || regexp_extract({c}, '^type:(.*)\\.[^.]*$', 1)"


@query(f"WITH {wl.TRADE_SQL} " + _PROJECT.format(o=_PKG.format(c="origin"), t=_PKG.format(c="target"), k="kind", g="trade", w=""))
def project_package(spark: SparkSession, sf: str) -> DataFrame:
    return projection.packages().apply(wl.trade(spark, sf))[0].edge_counts()


@query(f"WITH {wl.FLOW_SQL} " + _PROJECT.format(o="origin", t="target", k="kind", g="flow", w=" WHERE origin <> target"))
def project_type(spark: SparkSession, sf: str) -> DataFrame:
    return projection.types().without_self_edges().apply(wl.flow(spark, sf))[0].edge_counts()


@query(f"""WITH {wl.TRADE_SQL}, {wl.MODULES_SQL}
SELECT origin, target, kind, count(*) AS n_evidence FROM (
  SELECT DISTINCT 'module:' || a.module AS origin, 'module:' || b.module AS target, kind, location, bytecode_offset
  FROM trade JOIN mods a ON a.type_key = origin JOIN mods b ON b.type_key = target WHERE a.module <> b.module) GROUP BY origin, target, kind""")
def project_module_map(spark: SparkSession, sf: str) -> DataFrame:
    mapping = wl.modules(spark, sf).select(F.col("type_key").alias("source"), F.concat(F.lit("module:"), "module").alias("mapped"))
    return projection.modules(mapping).without_self_edges().apply(wl.trade(spark, sf))[0].edge_counts()


@query(f"WITH {wl.FLOW_SQL} " + _PROJECT.format(o=_PKG.format(c="origin"), t=_PKG.format(c="target"), k="CASE kind WHEN 'METHOD_CALL' THEN 'CALL' WHEN 'CONSTRUCTOR_CALL' THEN 'CALL' ELSE kind END", g="flow", w=" WHERE kind IN ('METHOD_CALL', 'CONSTRUCTOR_CALL', 'THROWS')"))
def project_kind_filter_relabel(spark: SparkSession, sf: str) -> DataFrame:
    plan = projection.packages().including_only("METHOD_CALL", "CONSTRUCTOR_CALL", "THROWS").relabeling(METHOD_CALL="CALL", CONSTRUCTOR_CALL="CALL")
    return plan.apply(wl.flow(spark, sf))[0].edge_counts()


@query(f"""WITH {wl.FLOW_SQL}, x AS (SELECT min(origin) AS o FROM flow)
SELECT DISTINCT origin, target, kind, CASE WHEN kind NOT IN ('METHOD_CALL', 'THROWS') THEN 'FILTERED_KIND' WHEN origin = x.o THEN 'EXPLICITLY_EXCLUDED'
  WHEN {_PKG.format(c="origin")} = {_PKG.format(c="target")} THEN 'SELF_EDGE' END AS drop_reason
FROM flow, x WHERE kind NOT IN ('METHOD_CALL', 'THROWS') OR origin = x.o OR {_PKG.format(c="origin")} = {_PKG.format(c="target")}""")
def project_drop_ledger(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.flow(spark, sf)
    first = g.rows.agg(F.min("origin").alias("origin"))
    excluded = g.rows.join(first, "origin", "left_semi").select(*EDGE)
    return projection.packages().including_only("METHOD_CALL", "THROWS").without_self_edges().excluding(excluded).apply(g)[1]


@query(f"""WITH {wl.TRADE_SQL}, s AS (SELECT type_key FROM catalog WHERE public)
SELECT origin, target, kind, count(*) AS n_evidence FROM trade WHERE origin IN (SELECT type_key FROM s) AND target IN (SELECT type_key FROM s) GROUP BY origin, target, kind""")
def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    public = wl.catalog(spark, sf).where(F.array_contains("modifiers", "PUBLIC")).select(F.col("type_key").alias("stable_key"))
    return wl.trade(spark, sf).induced(public).edge_counts()


@query(f"WITH {wl.FLOW_SQL} SELECT origin, target, count(DISTINCT kind) AS kinds, count(*) AS n FROM (SELECT DISTINCT origin, target, kind, location, bytecode_offset FROM flow WHERE kind <> 'THROWS') GROUP BY origin, target")
def remove_evidence(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.flow(spark, sf).without_evidence(F.col("kind") == "THROWS")
    return g.evidence.groupBy("origin", "target").agg(F.count_distinct("kind").alias("kinds"), F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT user_id, epoch_us(ts) AS t, event_id AS buy FROM events WHERE event_type = 'purchase'),
q AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events)
SELECT q.user_id, q.event_id, p.buy AS line FROM q ASOF LEFT JOIN p ON q.user_id = p.user_id AND q.t >= p.t""")
def asof_lookup(spark: SparkSession, sf: str) -> DataFrame:
    e = wl.table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "event_type")
    table = e.where("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("line"))
    return lookup.as_of(e.select("user_id", "t", "event_id"), table, ["user_id"], ["t"], "line").select("user_id", "event_id", "line")


@query("""WITH p AS (SELECT epoch_us(ts) AS t, max(event_id) AS buy FROM events WHERE event_type = 'purchase' GROUP BY 1), q AS (SELECT epoch_us(ts) AS t, event_id FROM events)
SELECT q.event_id, p.buy AS line FROM q ASOF LEFT JOIN p ON q.t >= p.t""")
def asof_one_key(spark: SparkSession, sf: str) -> DataFrame:
    """All events are one key."""
    e = wl.table(spark, sf, "events").select(F.lit("all").alias("member"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "event_type")
    table = e.where("event_type = 'purchase'").select("member", "t", F.col("event_id").alias("line"))
    return lookup.as_of_ranges(e.select("member", "t", "event_id"), table, ["member"], ["t"], "line").select("event_id", "line")


@query(f"""{"WITH RECURSIVE " + wl.FLOW_SQL}, e AS (SELECT DISTINCT origin AS o, target AS t FROM flow WHERE kind <> 'FIELD_ACCESS'), v AS (SELECT o AS id FROM e UNION SELECT t FROM e),
r AS (SELECT id AS o, id AS t FROM v UNION SELECT r.o, e.t FROM r JOIN e ON r.t = e.o), s AS (SELECT x.o AS id, min(x.t) AS component FROM r x JOIN r y ON x.o = y.t AND x.t = y.o GROUP BY x.o), z AS (SELECT component, count(*) AS size FROM s GROUP BY component)
SELECT component AS origin, size AS n_evidence FROM z WHERE size > 1 OR component IN (SELECT s.component FROM s JOIN e ON e.o = s.id AND e.t = s.id)""")
def cycles_without_synthetic(spark: SparkSession, sf: str) -> DataFrame:
    """Views stand for compiler-made evidence: cycles that need one are gone."""
    g = graph_from(wl.flow_evidence(spark, sf).drop("ts").withColumn("synthetic", F.col("kind") == "FIELD_ACCESS"))
    return _shown(structure.acyclic(_RULE, g, g.nodes.select("stable_key"), keep_synthetic=False), "origin", "n_evidence")


# ---- predicates and selectors --------------------------------------------------------------------


@query("SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https?://[^/]*/[\\s\\S]*/[^/]*\\.html') AND regexp_full_match(url, '[^/]*//[^/]*/[\\s\\S]*\\.html')")
def select_glob(spark: SparkSession, sf: str) -> DataFrame:
    p = patterns.glob("*//*/**.html", "resource")
    q = patterns.trusted_regex("https?://[^/]*/[\\s\\S]*/[^/]*\\.html", "resource")
    return selectors.named("url", p).__and__(selectors.named("url", q)).select(wl.table(spark, sf, "pages").select("page_id", "url"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '[a-m][a-z]+ [a-z]{4}')")
def select_regex_safe(spark: SparkSession, sf: str) -> DataFrame:
    return selectors.named("p_name", patterns.regex("[a-m][a-z]+ [a-z]{4}")).select(wl.table(spark, sf, "part").select("p_partkey", "p_name"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name = 'small ring'")
def select_exact(spark: SparkSession, sf: str) -> DataFrame:
    return selectors.named("p_name", patterns.exact("small ring")).select(wl.table(spark, sf, "part").select("p_partkey", "p_name"))


@query(f"""WITH {wl.CATALOG_SQL} SELECT binary_name, kind FROM catalog
WHERE (regexp_full_match(binary_name, 'crm\\.n1[^.]*\\.[\\s\\S]*') OR kind = 'INTERFACE') AND NOT (public AND kind = 'CLASS') AND container <> 'BUILDING'""")
def select_boolean_algebra(spark: SparkSession, sf: str) -> DataFrame:
    s = selectors
    chosen = (s.named("binary_name", patterns.glob("crm.n1*.**")) | s.equals("kind", "INTERFACE")) & ~(s.has_item("modifiers", "PUBLIC") & s.equals("kind", "CLASS"))
    chosen = (chosen & s.all_()).excluding(s.equals("container", "BUILDING")) | s.none()
    return chosen.select(wl.catalog(spark, sf)).select("binary_name", "kind")


@query(f"""WITH {wl.TRADE_SQL} SELECT DISTINCT package FROM catalog WHERE package IN (SELECT package FROM catalog WHERE kind = 'RECORD' AND public)""")
def select_packages_containing(spark: SparkSession, sf: str) -> DataFrame:
    types = wl.catalog(spark, sf)
    chosen = selectors.containing(types, selectors.equals("kind", "RECORD") & selectors.has_item("modifiers", "PUBLIC"))
    return chosen.select(types.select("package").distinct())


@query("""SELECT page_id, CASE WHEN regexp_full_match(url, '[\\s\\S]*\\.html') THEN true WHEN regexp_full_match(url, '[\\s\\S]*/en/[\\s\\S]*') THEN false
  WHEN regexp_full_match(url, 'https:[\\s\\S]*') THEN true ELSE false END AS ignored FROM pages""")
def ignore_rules_last_match(spark: SparkSession, sf: str) -> DataFrame:
    rules = patterns.parse_ignore("# the last rule that matches decides\nhttps:**\n!**/en/**\n**.html")
    return wl.table(spark, sf, "pages").select("page_id", patterns.last_rule_wins(F.col("url"), rules).alias("ignored"))


@query("""SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, n_chars ORDER BY source, doc_id DESC) = 1 AS winner FROM documents""")
def classpath_winner(spark: SparkSession, sf: str) -> DataFrame:
    d = wl.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("scope"), F.col("n_chars").alias("name"), F.col("source").alias("precedence"), F.col("doc_id").alias("release"), F.col("doc_id").alias("resource"))
    return lookup.classpath_winners(d).select("doc_id", F.col("scope").alias("lang"), "winner")


@query("""SELECT n_nationkey, sha256(unhex(lpad(to_hex(strlen(n_name)), 8, '0')) || encode(n_name) || unhex(lpad(to_hex(strlen(n_nationkey::VARCHAR)), 8, '0')) || encode(n_nationkey::VARCHAR)) AS identity FROM nation""")
def identity_hash_names(spark: SparkSession, sf: str) -> DataFrame:
    return wl.table(spark, sf, "nation").select("n_nationkey", identity_hash(F.col("n_name"), F.col("n_nationkey").cast("string")).alias("identity"))


@query(f"WITH {wl.CATALOG_SQL} SELECT type_key, 'type' AS id_kind, true AS valid, regexp_extract(binary_name, '^(.*)\\.[^.]*$', 1) AS package FROM catalog")
def stable_keys(spark: SparkSession, sf: str) -> DataFrame:
    return wl.catalog(spark, sf).select("type_key", kind_of(F.col("type_key")).alias("id_kind"), valid_key(F.col("type_key")).alias("valid"), package_of(F.col("binary_name")).alias("package"))


@query("""SELECT conv_id, turn, '(L' || role || ';[I)V' AS descriptor, 'L' || role || ';,[I' AS parameters, 'V' AS returns, role AS first FROM conversations""")
def descriptor_parse(spark: SparkSession, sf: str) -> DataFrame:
    d = wl.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("(L"), "role", F.lit(";[I)V")).alias("descriptor"))
    p = descriptors.parameters(F.col("descriptor"))
    return d.select("conv_id", "turn", "descriptor", F.array_join(p, ",").alias("parameters"), descriptors.return_type(F.col("descriptor")).alias("returns"), descriptors.element_name(F.get(p, F.lit(0))).alias("first"))


@query("""SELECT conv_id, turn, 'Ljava/util/Map<L' || role || ';[TT;>;' AS signature, CASE WHEN role < 'java.util.Map' THEN role || ',java.util.Map' ELSE 'java.util.Map,' || role END AS classes, 'T' AS variables FROM conversations""")
def signature_parse(spark: SparkSession, sf: str) -> DataFrame:
    d = wl.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("Ljava/util/Map<L"), "role", F.lit(";[TT;>;")).alias("signature"))
    d = d.withColumn("x", descriptors.parse_signature("signature", F.lit("field")))
    return d.select("conv_id", "turn", "signature", F.array_join("x.classes", ",").alias("classes"), F.array_join("x.variables", ",").alias("variables"))


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'error' WHEN quality = 1 THEN 'note' ELSE 'warning' END AS level, CASE WHEN toxic = 1 THEN '''=1' ELSE '1' END AS cell FROM labels")
def sarif_levels_and_cells(spark: SparkSession, sf: str) -> DataFrame:
    l = wl.table(spark, sf, "labels")  # noqa: E741
    severity = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "ERROR").when(F.col("quality") == 1, "INFO").otherwise("WARNING")
    return l.select("doc_id", sarif_level(severity).alias("level"), neutral_csv(F.when(F.col("toxic") == 1, "=1").otherwise("1")).alias("cell"))


# ---- dependency, slice and layer rules -----------------------------------------------------------

_RULE = RuleMetadata("rule", "a rule")
_DEP = "SELECT origin, target, kind, count(*) AS n_evidence FROM trade t WHERE {w} GROUP BY origin, target, kind"


def _origins_targets(spark: SparkSession, sf: str, origin: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = wl.catalog(spark, sf)
    pick = lambda g: _ids(selectors.named("binary_name", patterns.glob(g)).select(c), "type_key")
    return _ids(c, "type_key"), pick(origin), pick(target)


@query(f"WITH {wl.TRADE_SQL} " + _DEP.format(w="starts_with(origin, 'type:sup.') AND starts_with(target, 'type:crm.n1')"))
def dep_no(spark: SparkSession, sf: str) -> DataFrame:
    known, o, t = _origins_targets(spark, sf, "sup.**", "crm.n1**")
    return _shown(dep.dependency_rule(_RULE, wl.trade(spark, sf), known, o, t, dep.DependencySpec("NO")), *EDGE, "n_evidence")


@query(f"WITH {wl.TRADE_SQL} " + _DEP.format(w="starts_with(origin, 'type:crm.') AND NOT starts_with(target, 'type:sup.')"))
def dep_only(spark: SparkSession, sf: str) -> DataFrame:
    known, o, t = _origins_targets(spark, sf, "crm.**", "sup.**")
    return _shown(dep.dependency_rule(_RULE, wl.trade(spark, sf), known, o, t, dep.DependencySpec("ONLY")), *EDGE, "n_evidence")


@query(f"""WITH {wl.TRADE_SQL} SELECT min(type_key) AS origin, 'NO_MATCHING_DEPENDENCY' AS code FROM catalog WHERE starts_with(binary_name, 'sup.')
HAVING count(*) > 0 AND NOT EXISTS (SELECT 1 FROM trade WHERE starts_with(origin, 'type:sup.') AND starts_with(target, 'type:cat.'))""")
def dep_any(spark: SparkSession, sf: str) -> DataFrame:
    known, o, t = _origins_targets(spark, sf, "sup.**", "cat.**")
    return _shown(dep.dependency_rule(_RULE, wl.trade(spark, sf), known, o, t, dep.DependencySpec("ANY")), "origin", "code")


@query(f"""WITH {wl.TRADE_SQL} SELECT type_key AS origin FROM catalog WHERE starts_with(binary_name, 'crm.')
  AND type_key NOT IN (SELECT origin FROM trade WHERE starts_with(target, 'type:sup.n2'))""")
def dep_required(spark: SparkSession, sf: str) -> DataFrame:
    known, o, t = _origins_targets(spark, sf, "crm.**", "sup.n2**")
    return _shown(dep.dependency_rule(_RULE, wl.trade(spark, sf), known, o, t, dep.DependencySpec("REQUIRED")), "origin")


@query(f"""WITH {wl.TRADE_SQL} SELECT target AS subject, count(*) AS n FROM (SELECT DISTINCT origin, target, kind FROM trade
  WHERE starts_with(origin, 'type:crm.') AND target NOT IN (SELECT type_key FROM catalog WHERE public)) GROUP BY target""")
def dep_external(spark: SparkSession, sf: str) -> DataFrame:
    c = wl.catalog(spark, sf)
    known = _ids(c.where(F.array_contains("modifiers", "PUBLIC")), "type_key")
    _, o, t = _origins_targets(spark, sf, "crm.**", "sup.**")
    return dep.dependency_rule(_RULE, wl.trade(spark, sf), known, o, t, dep.DependencySpec("ONLY", external="FAIL")).diagnostics.select("subject", "n")


_LAYER = f"""WITH {wl.TRADE_SQL}, {wl.LAYERS_SQL},
ge AS (SELECT coalesce(a.layer, '<unassigned>') AS o, coalesce(b.layer, '<unassigned>') AS t FROM trade LEFT JOIN lays a ON a.type_key = origin LEFT JOIN lays b ON b.type_key = target)
SELECT o AS origin, t AS target, count(*) AS n_evidence FROM ge WHERE o <> t AND {{w}} GROUP BY o, t"""


def _layer(spark: SparkSession, sf: str, *args) -> DataFrame:
    membership = grouping.layer_membership(wl.catalog(spark, sf), [grouping.Layer(k, v) for k, v in wl.layer_predicates().items()])
    return _shown(dep.layer_rule(_RULE, wl.trade(spark, sf), membership, *args), "origin", "target", "n_evidence")


@query(_LAYER.format(w="o = 'supply' AND t = 'sales'"))
def layer_no_access(spark: SparkSession, sf: str) -> DataFrame:
    return _layer(spark, sf, "NO_ACCESS", ["supply"], ["sales"])


@query(_LAYER.format(w="o = 'sales' AND t <> 'catalog'"))
def layer_may_only(spark: SparkSession, sf: str) -> DataFrame:
    return _layer(spark, sf, "MAY_ONLY_ACCESS", ["sales"], ["catalog"])


@query(_LAYER.format(w="t = 'supply' AND o <> 'sales'"))
def layer_only_accessed_by(spark: SparkSession, sf: str) -> DataFrame:
    return _layer(spark, sf, "ONLY_ACCESSED_BY", ["supply"], ["sales"])


@query(_LAYER.format(w="(o = 'catalog' OR t = 'catalog')"))
def layer_isolated(spark: SparkSession, sf: str) -> DataFrame:
    return _layer(spark, sf, "ISOLATED", ["catalog"])


def _slices(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.SliceDefinitions(captures=("crm.{slice}", "sup.{slice}")).assign(wl.catalog(spark, sf))


_SLICE = f"""WITH {wl.TRADE_SQL}, sl AS (SELECT type_key, split_part(package, '.', 2) AS s FROM catalog WHERE NOT starts_with(package, 'cat.')),
ge AS (SELECT a.s AS o, b.s AS t FROM trade JOIN sl a ON a.type_key = origin JOIN sl b ON b.type_key = target WHERE a.s <> b.s) """


@query(_SLICE + "SELECT o AS origin, t AS target, count(*) AS n_evidence FROM ge WHERE o IN ('n0', 'n1', 'n2') AND t IN ('n3', 'n4') GROUP BY o, t")
def slice_directional(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(dep.slice_rule(_RULE, wl.trade(spark, sf), _slices(spark, sf), ["n0", "n1", "n2"], ["n3", "n4"]), "origin", "target", "n_evidence")


@query(_SLICE + "SELECT least(o, t) AS origin, greatest(o, t) AS target, count(*) AS n_evidence FROM ge GROUP BY 1, 2")
def slice_mutual(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(dep.slices_independent(_RULE, wl.trade(spark, sf), _slices(spark, sf)), "origin", "target", "n_evidence")


@query(f"WITH {wl.CATALOG_SQL} SELECT package, count(*) AS n_types, false AS has_package_info, string_agg(DISTINCT container, ',' ORDER BY container) AS origins FROM catalog GROUP BY package")
def package_index(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.package_index(wl.catalog(spark, sf))


# ---- coverage, naming, inheritance, annotations, access ------------------------------------------


@query(f"""WITH {wl.CATALOG_SQL}, p AS (SELECT DISTINCT type_key, policy FROM (
    SELECT type_key, 'public' AS policy FROM catalog WHERE public UNION ALL SELECT type_key, 'supply' FROM catalog WHERE kind = 'INTERFACE' UNION ALL SELECT type_key, 'building' FROM catalog WHERE container = 'BUILDING'))
SELECT c.type_key AS origin, CASE WHEN count(policy) = 0 THEN 'UNASSIGNED' ELSE 'MULTIPLY_ASSIGNED' END AS code, count(policy) AS n_evidence
FROM catalog c LEFT JOIN p ON p.type_key = c.type_key WHERE c.kind <> 'RECORD' GROUP BY c.type_key HAVING count(policy) <> 1""")
def coverage_exactly_one(spark: SparkSession, sf: str) -> DataFrame:
    c = wl.catalog(spark, sf)
    policy = lambda name, s: s.select(c).select(F.col("type_key").alias("id"), F.lit(name).alias("policy"))
    policies = policy("public", selectors.has_item("modifiers", "PUBLIC")).unionByName(policy("supply", selectors.equals("kind", "INTERFACE"))).unionByName(policy("building", selectors.equals("container", "BUILDING")))
    return _shown(structure.coverage(_RULE, _ids(c, "type_key"), policies, _ids(c.where("kind = 'RECORD'"), "type_key")), "origin", "code", "n_evidence")


@query("""SELECT page_id::VARCHAR AS origin, url AS target, 'NAME_DOES_NOT_MATCH' AS code FROM pages WHERE NOT regexp_full_match(url, 'https:[\\s\\S]*')""")
def naming_must_match(spark: SparkSession, sf: str) -> DataFrame:
    values = wl.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("value"))
    return _shown(structure.naming(_RULE, values, patterns.glob("https:**", "resource")), "origin", "target", "code")


_HIER = """h AS (SELECT c_custkey AS o, c_custkey // 2 AS t FROM customer WHERE c_custkey > 1), known AS (SELECT DISTINCT o_custkey AS id FROM orders),
up AS (WITH RECURSIVE r AS (SELECT o, t, 1 AS depth FROM h UNION ALL SELECT r.o, h.t, r.depth + 1 FROM r JOIN h ON r.t = h.o) SELECT o, t, min(depth) AS depth FROM r GROUP BY o, t)"""


def _hierarchy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    h = wl.table(spark, sf, "customer").where("c_custkey > 1").select(F.col("c_custkey").cast("string").alias("origin"), F.expr("cast(c_custkey div 2 AS string)").alias("target"), F.lit("EXTENDS").alias("kind"))
    known = wl.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id")).distinct()
    return h, known


@query(f"WITH {_HIER} SELECT o::VARCHAR AS origin, t::VARCHAR AS target, depth, t NOT IN (SELECT id FROM known) AS missing, o = t AS cycle FROM up")
def hierarchy_closure(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.supertypes(*_hierarchy(spark, sf))


@query(f"""WITH {_HIER}, p AS (SELECT o_custkey AS s, o_custkey // 4 AS t FROM orders UNION SELECT c_custkey, 3 FROM customer),
inc AS (SELECT DISTINCT o FROM up WHERE t NOT IN (SELECT id FROM known))
SELECT s::VARCHAR AS source, t::VARCHAR AS target, CASE WHEN s = t OR EXISTS (SELECT 1 FROM up WHERE up.o = s AND up.t = p.t) THEN 'YES'
  WHEN s NOT IN (SELECT id FROM known) OR s IN (SELECT o FROM inc) THEN 'UNKNOWN' ELSE 'NO' END AS assignable FROM p""")
def assignability_3v(spark: SparkSession, sf: str) -> DataFrame:
    h, known = _hierarchy(spark, sf)
    pairs = wl.table(spark, sf, "orders").selectExpr("cast(o_custkey AS string) AS source", "cast(o_custkey div 4 AS string) AS target").union(wl.table(spark, sf, "customer").selectExpr("cast(c_custkey AS string)", "'3'")).distinct()
    return hierarchy.assignability(pairs, hierarchy.supertypes(h, known), known)


@query(f"""WITH {_HIER} SELECT o_custkey::VARCHAR AS origin FROM (SELECT DISTINCT o_custkey FROM orders) WHERE NOT EXISTS (SELECT 1 FROM up WHERE o = o_custkey AND t = 5)
  AND NOT EXISTS (SELECT 1 FROM up WHERE o = o_custkey AND t NOT IN (SELECT id FROM known))""")
def inheritance_required(spark: SparkSession, sf: str) -> DataFrame:
    h, known = _hierarchy(spark, sf)
    targets = spark.createDataFrame([("5",)], "id string")
    return _shown(structure.inheritance(_RULE, h, known, known, targets), "origin")


@query("SELECT d.doc_id::VARCHAR AS origin FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def annotation_require(spark: SparkSession, sf: str) -> DataFrame:
    l = wl.table(spark, sf, "labels")  # noqa: E741
    occurrences = l.where("quality = 1").select(F.col("doc_id").cast("string").alias("subject"), F.lit("Reviewed").alias("annotation")).union(l.where("toxic = 1").select(F.col("doc_id").cast("string"), F.lit("Toxic")))
    subjects = wl.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return _shown(structure.annotation_rule(_RULE, subjects, hierarchy.annotated_with(occurrences, "Reviewed", "DIRECT")), "origin")


@query("""WITH RECURSIVE o AS (SELECT c_custkey AS s, c_custkey // 2 AS a FROM customer WHERE c_custkey > 1), r AS (SELECT s, a FROM o UNION SELECT r.s, o.a FROM r JOIN o ON r.a = o.s)
SELECT s::VARCHAR AS subject FROM r WHERE a = 7""")
def annotation_meta(spark: SparkSession, sf: str) -> DataFrame:
    h, _ = _hierarchy(spark, sf)
    return hierarchy.annotated_with(h.select(F.col("origin").alias("subject"), F.col("target").alias("annotation")), "7", "META")


@query("""SELECT conv_id::VARCHAR AS origin, role || '#m()V' AS target, count(DISTINCT turn) AS n_evidence FROM conversations WHERE role <> 'user' GROUP BY ALL""")
def member_access_only(spark: SparkSession, sf: str) -> DataFrame:
    c = wl.table(spark, sf, "conversations")
    accesses = c.select(F.col("conv_id").cast("string").alias("caller"), F.col("role").alias("target_owner"), F.lit("m").alias("target_name"), F.lit("()V").alias("target_desc"), F.lit("METHOD_CALL").alias("kind"), F.col("turn").alias("offset"), F.lit(False).alias("compiler_created"))
    targets = spark.createDataFrame([("user", "m", "()V")], "owner string, name string, descriptor string")
    return _shown(structure.member_access(_RULE, accesses, c.select(F.col("conv_id").cast("string").alias("id")).distinct(), targets, "ONLY"), "origin", "target", "n_evidence")


@query(f"""WITH {wl.TRADE_SQL} SELECT origin, target || '#m' AS target, CASE WHEN NOT starts_with(target, 'type:sup.n1') THEN 'NOT_APPROVED' WHEN NOT c.public THEN 'TYPE_NOT_PUBLIC' ELSE 'NOT_EXPORTED' END AS code, count(*) AS n_evidence
FROM trade JOIN catalog c ON c.type_key = target WHERE starts_with(origin, 'type:crm.') AND starts_with(target, 'type:sup.')
  AND (NOT starts_with(target, 'type:sup.n1') OR NOT c.public OR starts_with(target, 'type:sup.n12')) GROUP BY ALL""")
def public_interface(spark: SparkSession, sf: str) -> DataFrame:
    c = wl.catalog(spark, sf)
    accesses = wl.trade(spark, sf).evidence.select("origin", F.col("target").alias("target_owner"), F.concat("target", F.lit("#m")).alias("target_member"), F.col("bytecode_offset").alias("offset"))
    sup = c.where("kind = 'INTERFACE'")
    provider = sup.select(F.col("type_key").alias("type"), F.concat("type_key", F.lit("#m")).alias("member"), F.array_contains("modifiers", "PUBLIC").alias("type_public"), F.lit(True).alias("member_public"), (~F.col("package").startswith("sup.n12")).alias("exported"))
    approved = _ids(selectors.named("binary_name", patterns.glob("sup.n1**")).select(sup), "type_key")
    return _shown(structure.public_interface(_RULE, accesses, _ids(c.where("kind = 'CLASS'"), "type_key"), provider, approved, spark.createDataFrame([], "id string")), "origin", "target", "code", "n_evidence")


# ---- modules and diagrams ------------------------------------------------------------------------


@query(f"""WITH {wl.TRADE_SQL}, {wl.MODULES_SQL}, seen AS (SELECT DISTINCT a.module AS origin, b.module AS target FROM trade JOIN mods a ON a.type_key = origin JOIN mods b ON b.type_key = target WHERE a.module <> b.module),
said AS (SELECT a.r_name AS origin, b.r_name AS target FROM region a, region b WHERE a.r_name < b.r_name UNION ALL SELECT r_name, 'NOWHERE' FROM region)
SELECT coalesce(seen.origin, said.origin) AS origin, coalesce(seen.target, said.target) AS target,
  CASE WHEN said.origin IS NULL THEN 'OBSERVED_ONLY' WHEN seen.origin IS NULL THEN 'DECLARED_ONLY' ELSE 'BOTH' END AS state
FROM seen FULL JOIN said ON seen.origin = said.origin AND seen.target = said.target""")
def module_requires_vs_observed(spark: SparkSession, sf: str) -> DataFrame:
    r = wl.table(spark, sf, "region").select("r_name")
    names = r.select(F.col("r_name").alias("origin"))
    declared = names.join(r.select(F.col("r_name").alias("target")), F.col("origin") < F.col("target")).unionByName(names.withColumn("target", F.lit("NOWHERE")))  # a handful of regions
    return mod.compare_modules(declared, wl.trade(spark, sf).connections(), wl.modules(spark, sf))


_DIAGRAM = "@startuml\n[sales]\n[catalog]\n[supply] as s\n[archive]\n[sales] --> [catalog]\n[sales] --> s\n[catalog] --> [archive]\ns --> [catalog]\n@enduml"


@query(f"""WITH {wl.TRADE_SQL}, {wl.LAYERS_SQL}, seen AS (SELECT a.layer AS o, b.layer AS t, count(DISTINCT origin || '|' || target) AS n FROM trade JOIN lays a ON a.type_key = origin JOIN lays b ON b.type_key = target WHERE a.layer <> b.layer GROUP BY 1, 2),
drawn(o, t) AS (VALUES ('sales', 'catalog'), ('sales', 'supply'), ('catalog', 'archive'), ('supply', 'catalog'))
SELECT o AS origin, t AS target, 'NOT_IN_DIAGRAM' AS code, n AS n_evidence FROM seen ANTI JOIN drawn USING (o, t) UNION ALL SELECT o, t, 'NOT_OBSERVED', 0 FROM drawn ANTI JOIN seen USING (o, t)""")
def plantuml_adherence(spark: SparkSession, sf: str) -> DataFrame:
    _, arrows = mod.parse_diagram(_DIAGRAM)
    return _shown(mod.diagram_rule(_RULE, wl.trade(spark, sf), wl.layers(spark, sf), arrows, require_declared=True), "origin", "target", "code", "n_evidence")


@query("""SELECT r_name AS origin, 'java.n' || n_nationkey AS target FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 9""")
def module_directive_only(spark: SparkSession, sf: str) -> DataFrame:
    n = wl.table(spark, sf, "nation").join(wl.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = n.groupBy(F.col("r_name").alias("name")).agg(F.collect_set(F.concat(F.lit("java.n"), "n_nationkey")).alias("requires")).withColumn("kind", F.lit("EXPLICIT"))
    return _shown(mod.module_directives(_RULE, m, "requires", patterns.glob("java.n?"), "ONLY"), "origin", "target")


@query(_LAYER.format(w="((o = 'sales' AND t = 'supply') OR (o = 'catalog' AND t = 'sales') OR (o = 'supply' AND t IN ('sales', 'catalog')))"))
def preset_layers(spark: SparkSession, sf: str) -> DataFrame:
    preset = mod.Preset("shop", ("sales", "catalog", "supply"), (("catalog", ("supply",)), ("sales", ("catalog",)), ("supply", ())))
    out = preset.check(wl.trade(spark, sf), wl.catalog(spark, sf), wl.layer_predicates())
    rows = out[0].violations
    for o in out[1:]:
        rows = rows.unionByName(o.violations)
    return rows.select("origin", "target", "n_evidence")


# ---- algorithms ----------------------------------------------------------------------------------

_CLOSE = f"""WITH RECURSIVE {wl.FLOW_SQL}, e AS (SELECT DISTINCT origin AS o, target AS t FROM flow WHERE origin <> target), v AS (SELECT DISTINCT id FROM (SELECT origin AS id FROM flow UNION ALL SELECT target FROM flow)),
r AS (SELECT id AS o, id AS t FROM v UNION SELECT r.o, e.t FROM r JOIN e ON r.t = e.o) """


@query(_CLOSE + """, b AS (SELECT o, t FROM r), s AS (SELECT x.o AS id, min(x.t) AS component FROM b x JOIN b y ON x.o = y.t AND x.t = y.o GROUP BY x.o),
z AS (SELECT component, count(*) AS size FROM s GROUP BY component)
SELECT id, component, size, size > 1 OR component IN (SELECT s2.component FROM s s2 JOIN flow f ON f.origin = s2.id AND f.target = s2.id) AS cyclic FROM s JOIN z USING (component)""")
def scc_components(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.flow(spark, sf)
    return algorithms.strongly_connected(g.connections(), _ids(g.nodes, "stable_key"))


@query(_CLOSE + """, b AS (SELECT o, t FROM r), s AS (SELECT x.o AS id, min(x.t) AS component FROM b x JOIN b y ON x.o = y.t AND x.t = y.o GROUP BY x.o), z AS (SELECT component, count(*) AS size FROM s GROUP BY component)
SELECT component AS origin, size AS n_evidence FROM z WHERE size > 1 OR component IN (SELECT s2.component FROM s s2 JOIN flow f ON f.origin = s2.id AND f.target = s2.id)""")
def cycle_violations(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.flow(spark, sf)
    return _shown(structure.acyclic(_RULE, g, g.nodes.select("stable_key")), "origin", "n_evidence")


@query()
def cycle_enumeration(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.flow(spark, sf)
    parts = algorithms.strongly_connected(g.connections(), _ids(g.nodes, "stable_key"))
    found = algorithms.cycles(g.connections(), parts)
    return found.select("component", F.array_join(algorithms.canonical(F.col("cycle")), ",").alias("cycle"), F.array_join("closed_path", ",").alias("closed_path"), "length", "truncated")


@query(_CLOSE + """, b AS (SELECT DISTINCT t FROM r WHERE ends_with(o, 'K0')), lost AS (SELECT id FROM v WHERE id NOT IN (SELECT t FROM b)), i AS (SELECT o, t FROM r)
SELECT component AS origin, count(*) AS n_evidence FROM (SELECT x.o AS id, min(x.t) AS component FROM i x JOIN i y ON x.o = y.t AND x.t = y.o WHERE x.o IN (SELECT id FROM lost) GROUP BY x.o) GROUP BY component""")
def reachability_unreachable(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.flow(spark, sf)
    ids = _ids(g.nodes, "stable_key")
    return _shown(structure.unreachable(_RULE, g, ids, ids.where(F.col("id").endswith("K0"))), "origin", "n_evidence")


@query(_CLOSE + "SELECT o AS subject, count(*) AS depends_on FROM r GROUP BY o")
def closure_reach_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.flow(spark, sf)
    return metrics.reach_counts(g.connections(), g.nodes.select(F.col("stable_key").alias("subject")))


@query(_CLOSE + """, c AS (SELECT o, count(*) AS n FROM r GROUP BY o), s AS (SELECT count(*) AS n, sum(n)::BIGINT AS ccd FROM c), d AS (SELECT sum(length(bin(i)))::BIGINT AS den FROM s, range(1, s.n + 1) AS q(i))
SELECT n, ccd, ccd / n AS acd, ccd / (n * n) AS racd, ccd / den AS nccd FROM s, d""")
def ccd_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cumulative(closure_reach_counts(spark, sf))


# ---- metrics -------------------------------------------------------------------------------------

_MARTIN = f"""WITH {wl.TRADE_SQL}, pe AS (SELECT DISTINCT a.package AS o, b.package AS t FROM (SELECT DISTINCT origin, target FROM trade) JOIN catalog a ON a.type_key = origin JOIN catalog b ON b.type_key = target WHERE a.package <> b.package),
comp AS (SELECT package, count(*) AS n, count(*) FILTER (kind = 'INTERFACE') AS na FROM catalog GROUP BY package),
m AS (SELECT package, (SELECT count(*) FROM pe WHERE t = package) AS ca, (SELECT count(*) FROM pe WHERE o = package) AS ce, na / n AS a FROM comp),
mm AS (SELECT 'package:' || package AS subject, ca, ce, CASE WHEN ca + ce = 0 THEN 0.0::DOUBLE ELSE ce / (ca + ce) END AS instability, a AS abstractness FROM m) """


def _martin(spark: SparkSession, sf: str) -> DataFrame:
    g, _ = projection.packages().without_self_edges().apply(wl.trade(spark, sf))
    c = wl.catalog(spark, sf).withColumn("subject", F.concat(F.lit("package:"), "package"))
    return metrics.martin(g.connections(), g.nodes.select(F.col("stable_key").alias("subject")), metrics.compositions(c))


@query(_MARTIN + "SELECT subject, ca, ce, instability, abstractness, abs(abstractness + instability - 1) AS distance FROM mm")
def martin_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _martin(spark, sf)


@query(_MARTIN + "SELECT subject AS origin, 'instability' AS kind FROM mm WHERE instability > 0.5")
def metric_threshold(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.samples(_martin(spark, sf), "subject", ["instability", "distance"])
    return _shown(metrics.threshold(_RULE, found, "instability", "AT_MOST", 0.5), "origin", "kind")


def _uses(spark: SparkSession, sf: str) -> DataFrame:
    return wl.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("type"), F.col("event_type").alias("method"), F.get_json_object("props", "$.k").alias("field")).distinct()


_USES = "u AS (SELECT DISTINCT user_id::VARCHAR AS type, event_type AS method, json_extract_string(props, '$.k') AS field FROM events), ms AS (SELECT DISTINCT type, method FROM u) "


@query(f"""WITH {_USES}, p AS (SELECT a.type, a.method AS m1, b.method AS m2, EXISTS (SELECT 1 FROM u x JOIN u y ON x.type = y.type AND x.field = y.field WHERE x.type = a.type AND x.method = a.method AND y.method = b.method) AS shares FROM ms a JOIN ms b ON a.type = b.type AND a.method < b.method)
SELECT ms.type, greatest(coalesce(max(d), 0), 0)::BIGINT AS lcom1 FROM ms LEFT JOIN (SELECT type, count(*) FILTER (NOT shares) - count(*) FILTER (shares) AS d FROM p GROUP BY type) q ON q.type = ms.type GROUP BY ms.type""")
def lcom1(spark: SparkSession, sf: str) -> DataFrame:
    u = _uses(spark, sf)
    return metrics.lcom1(u, u)


@query(f"""WITH {_USES}, c AS (SELECT type, count(DISTINCT method) AS m, count(DISTINCT field) AS f, count(*) AS n FROM u GROUP BY type)
SELECT type, CASE WHEN m >= 2 AND f > 0 THEN least(greatest((m * f - n) / ((m - 1) * f), 0.0), 1.0) END AS lcom_hs, CASE WHEN m >= 2 AND f > 0 THEN 'COMPUTED' ELSE 'NOT_APPLICABLE' END AS availability FROM c""")
def lcom_hs(spark: SparkSession, sf: str) -> DataFrame:
    u = _uses(spark, sf)
    return metrics.lcom_hs(u, u, u)


@query(f"""WITH RECURSIVE {_USES}, e AS (SELECT DISTINCT x.type, x.method AS a, y.method AS b FROM u x JOIN u y ON x.type = y.type AND x.field = y.field), r AS (SELECT type, method AS a, method AS b FROM ms UNION SELECT r.type, r.a, e.b FROM r JOIN e ON r.type = e.type AND r.b = e.a)
SELECT type, count(DISTINCT low) AS lcom4 FROM (SELECT type, a, min(b) AS low FROM r GROUP BY type, a) GROUP BY type""")
def lcom4(spark: SparkSession, sf: str) -> DataFrame:
    u = _uses(spark, sf)
    return metrics.lcom4(u, u, spark.createDataFrame([], "type string, method string, callee string"))


@query("SELECT lang AS subject, count(*) AS members, count(*) FILTER (n_chars < 1000) AS fields, count(*) FILTER (n_chars >= 1000) AS methods, 0 AS constructors, 0 AS initializers FROM documents GROUP BY lang")
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = wl.table(spark, sf, "documents").select(F.col("lang").alias("owner"), F.when(F.col("n_chars") < 1000, "FIELD").otherwise("METHOD").alias("kind"))
    return metrics.member_counts(d)


@query()
def source_lines(spark: SparkSession, sf: str) -> DataFrame:
    return wl.table(spark, sf, "documents").select("doc_id", metrics.source_lines("text").alias("x")).select("doc_id", "x.*")


@query("""SELECT lang AS package, source AS source_file, CASE WHEN bool_and(n_chars < 200) THEN 'EXCLUDED_GENERATED' WHEN lang = 'en' THEN 'MATCHED' ELSE 'MISSING' END AS state FROM documents GROUP BY lang, source""")
def source_match(spark: SparkSession, sf: str) -> DataFrame:
    d = wl.table(spark, sf, "documents")
    types = d.select(F.col("lang").alias("package"), F.col("source").alias("source_file"), (F.col("n_chars") < 200).alias("generated"))
    return metrics.match_sources(types, types.where("package = 'en'"))


# ---- snapshots, evidence, baselines --------------------------------------------------------------


@query(f"""WITH {wl.TRADE_SQL}, pe AS (SELECT 'package:' || a.package AS o, 'package:' || b.package AS t, origin, target, trade.kind, location, bytecode_offset FROM trade JOIN catalog a ON a.type_key = origin JOIN catalog b ON b.type_key = target WHERE a.package <> b.package),
n AS (SELECT 'package:' || package AS id FROM (SELECT DISTINCT package FROM catalog) ORDER BY 1 LIMIT 40)
SELECT o AS origin, t AS target, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(DISTINCT origin || '|' || target || '|' || kind) AS n_source_edges, count(*) AS n_evidence, greatest(count(*) - 5, 0) AS omitted_evidence
FROM pe WHERE o IN (SELECT id FROM n) AND t IN (SELECT id FROM n) GROUP BY o, t ORDER BY o, t LIMIT 200""")
def snapshot_topn(spark: SparkSession, sf: str) -> DataFrame:
    _, edges, _ = SnapshotQuery("PACKAGE").limited_by(40, 200, 5).snapshot(wl.trade(spark, sf))
    return edges.drop("edge_id")


@query(f"""WITH {wl.TRADE_SQL}, {wl.LAYERS_SQL}, ge AS (SELECT a.layer AS o, b.layer AS t, origin, target, kind FROM trade JOIN lays a ON a.type_key = origin JOIN lays b ON b.type_key = target WHERE a.layer <> b.layer AND kind IN ('METHOD_CALL', 'FIELD_TYPE'))
SELECT (SELECT count(*) FROM catalog) AS source_nodes, 3 AS matched_nodes, 0 AS omitted_nodes, count(DISTINCT o || t) AS matched_edges, 0 AS omitted_edges, count(*) AS matched_evidence,
  (SELECT sum(greatest(c - 20, 0))::BIGINT FROM (SELECT count(*) AS c FROM ge GROUP BY o, t)) AS omitted_evidence FROM ge""")
def snapshot_metadata(spark: SparkSession, sf: str) -> DataFrame:
    mapping = wl.layers(spark, sf).select(F.col("type_key").alias("source"), F.col("group_id").alias("mapped"))
    return SnapshotQuery("LAYER", mapping).including_kinds("METHOD_CALL", "FIELD_TYPE").snapshot(wl.trade(spark, sf))[2]


@query(f"""WITH {wl.FLOW_SQL}, d AS (SELECT DISTINCT origin, location, bytecode_offset FROM flow), k AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY location, bytecode_offset) AS i FROM d)
SELECT origin, string_agg(bytecode_offset::VARCHAR, ',' ORDER BY i) FILTER (i <= 2) AS evidence, count(*) AS matched, greatest(count(*) - 2, 0) AS omitted FROM k GROUP BY origin""")
def top_evidence_per_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = top_evidence(wl.flow(spark, sf).evidence, ["origin"], 2)
    return rows.select("origin", F.array_join(F.transform("evidence", lambda e: e["bytecode_offset"].cast("string")), ",").alias("evidence"), F.col("matched").cast("long").alias("matched"), F.col("omitted").cast("long").alias("omitted"))


def _findings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = wl.flow_evidence(spark, sf)
    rows = e.select(F.col("kind").alias("rule_id"), F.lit("EDGE").alias("code"), F.col("origin").alias("subject_id"), F.col("target").alias("location"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("old"))
    return tuple(baseline.fingerprints(rows.where(F.col("old") == old).drop("old").distinct()) for old in (True, False))


@query()
def baseline_diff(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.compare(*_findings(spark, sf))


@query(f"""WITH {wl.FLOW_SQL}, f AS (SELECT DISTINCT kind AS rule_id, origin AS subject_id, target AS location FROM flow WHERE ts >= TIMESTAMP '2024-01-16')
SELECT rule_id, subject_id, location, CASE WHEN rule_id = 'THROWS' OR (rule_id = 'METHOD_CALL' AND location LIKE '%K7') THEN 'SUPPRESSED' WHEN rule_id = 'FIELD_TYPE' THEN 'EXPIRED' ELSE 'NEW' END AS state FROM f""")
def baseline_suppressions(spark: SparkSession, sf: str) -> DataFrame:
    _, current = _findings(spark, sf)
    changes = current.select("rule_id", "subject_id", "location", F.lit("NEW").alias("state"))
    day = datetime.date
    rules = spark.createDataFrame([("THROWS", None, None, None), ("FIELD_TYPE", None, None, day(2024, 1, 31))], "rule_id string, subject_id string, location string, expires_on date")
    places = changes.where("location LIKE '%K7'").select(F.lit("METHOD_CALL").alias("rule_id"), F.lit(None).cast("string").alias("subject_id"), "location", F.lit(day(2024, 2, 1)).alias("expires_on")).distinct()
    return baseline.suppress(changes, rules.unionByName(places), day(2024, 2, 1))




from latticework import model_queries as _model_queries  # noqa: E402, F401  registers its queries
