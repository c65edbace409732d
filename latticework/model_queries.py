"""Queries for the model side: class paths, members, nesting, annotations, sealed types, modules, rule results.

The driver's tables stand for a model: customers are types in a binary hierarchy (type k extends type k div 2), parts are
members of their brands, suppliers modules.  ``queries`` registers what is here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework import workloads as wl
from latticework.functions import classify, patterns
from latticework.operators import algorithms, baseline, hierarchy, lookup, metrics
from latticework.operators.rules import access, structure
from latticework.operators.rules import modules as mod
from latticework.operators.rules.outcome import RuleMetadata, RuleOutcome, violations
from latticework.plans import projection, selectors
from latticework.plans.graph import Graph, graph_from
from latticework.queries import _RULE, _hierarchy, _ids, _shown, _HIER, query
from latticework.sources.model import References

# ---- graph of users: one giant component ------------------------------------------------------------

_CHAIN = """c AS (SELECT user_id AS s, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t FROM events),
e AS (SELECT DISTINCT 'type:app.U' || s AS o, 'type:app.U' || t AS t FROM c WHERE t IS NOT NULL), v AS (SELECT o AS id FROM e UNION SELECT t FROM e),
r AS (SELECT id AS o, id AS t FROM v UNION SELECT r.o, e.t FROM r JOIN e ON r.t = e.o)"""


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive users of each event type, as (origin, target, kind)."""
    rows = wl.table(spark, sf, "events").select(F.col("user_id").alias("s"), F.expr("lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id)").alias("t")).where("t IS NOT NULL")
    return rows.select(F.concat(F.lit("type:app.U"), "s").alias("origin"), F.concat(F.lit("type:app.U"), "t").alias("target"), F.lit("METHOD_CALL").alias("kind")).distinct()


@query(f"WITH RECURSIVE {_CHAIN}, s AS (SELECT x.o AS id, min(x.t) AS component FROM r x JOIN r y ON x.o = y.t AND x.t = y.o GROUP BY x.o) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM s")
def scc_user_chain(spark: SparkSession, sf: str) -> DataFrame:
    g = graph_from(_chain(spark, sf))
    return algorithms.strongly_connected(g.connections(), _ids(g.nodes, "stable_key"), by="pivots").select("id", "component", "size")


@query(f"WITH RECURSIVE {_CHAIN} SELECT o AS subject, count(*) AS depends_on FROM r GROUP BY o")
def reach_user_chain(spark: SparkSession, sf: str) -> DataFrame:
    g = graph_from(_chain(spark, sf))
    return metrics.reach_counts(g.connections(), g.nodes.select(F.col("stable_key").alias("subject")), by="blocks")


# ---- components and reach of graphs beyond one task -------------------------------------------------

_HANDOVER = f"""WITH RECURSIVE {wl.HANDOVER_SQL}, e AS (SELECT DISTINCT origin AS o, target AS t FROM handover WHERE origin <> target), v AS (SELECT origin AS id FROM handover UNION SELECT target FROM handover),
r AS (SELECT id AS o, id AS t FROM v UNION SELECT r.o, e.t FROM r JOIN e ON r.t = e.o)"""
_HANDOVER_PARTS = _HANDOVER + ", s AS (SELECT x.o AS id, min(x.t) AS component FROM r x JOIN r y ON x.o = y.t AND x.t = y.o GROUP BY x.o), z AS (SELECT component, count(*) AS size FROM s GROUP BY component)"
_HANDOVER_SCC = _HANDOVER_PARTS + " SELECT id, component, size, size > 1 OR id IN (SELECT origin FROM handover WHERE origin = target) OR component IN (SELECT s2.component FROM s s2 JOIN handover h ON h.origin = s2.id AND h.target = s2.id) AS cyclic FROM s JOIN z USING (component)"


def _handover_components(spark: SparkSession, sf: str, by: str) -> DataFrame:
    g = wl.handover(spark, sf)
    return algorithms.strongly_connected(g.connections(), _ids(g.nodes, "stable_key"), by=by)


@query(_HANDOVER_SCC)
def scc_handover(spark: SparkSession, sf: str) -> DataFrame:
    return _handover_components(spark, sf, "parts")


@query(_HANDOVER_SCC)
def scc_handover_pivots(spark: SparkSession, sf: str) -> DataFrame:
    return _handover_components(spark, sf, "pivots")


@query(_HANDOVER_PARTS + " SELECT component AS origin, size AS n_evidence FROM z WHERE size > 1 OR component IN (SELECT s2.component FROM s s2 JOIN handover h ON h.origin = s2.id AND h.target = s2.id)")
def cycle_violations_pivots(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.handover(spark, sf)
    return _shown(structure.acyclic(_RULE, g, g.nodes.select("stable_key"), by="pivots"), "origin", "n_evidence")


@query(_HANDOVER + """, b AS (SELECT DISTINCT t FROM r WHERE ends_with(o, 'w2.U7')), lost AS (SELECT id FROM v WHERE id NOT IN (SELECT t FROM b))
SELECT component AS origin, count(*) AS n_evidence FROM (SELECT x.o AS id, min(x.t) AS component FROM r x JOIN r y ON x.o = y.t AND x.t = y.o WHERE x.o IN (SELECT id FROM lost) GROUP BY x.o) GROUP BY component""")
def unreachable_pivots(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.handover(spark, sf)
    ids = _ids(g.nodes, "stable_key")
    return _shown(structure.unreachable(_RULE, g, ids, ids.where(F.col("id").endswith("w2.U7")), by="pivots"), "origin", "n_evidence")


@query(_HANDOVER + " SELECT o AS subject, count(*) AS depends_on FROM r GROUP BY o")
def reach_handover(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.handover(spark, sf)
    return metrics.reach_counts(g.connections(), g.nodes.select(F.col("stable_key").alias("subject")))


@query(_HANDOVER + " SELECT o AS subject, count(*) AS depends_on FROM r GROUP BY o")
def reach_handover_blocks(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.handover(spark, sf)
    return metrics.reach_counts(g.connections(), g.nodes.select(F.col("stable_key").alias("subject")), by="blocks")


def _forward_trade(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame]:
    """Trade without returns: an acyclic graph of all customers, parts and suppliers."""
    g = wl.trade(spark, sf).without_evidence(F.col("kind") == "THROWS")
    return g, g.nodes.select(F.col("stable_key").alias("subject"))


_FORWARD = f"""WITH {wl.TRADE_SQL}, e AS (SELECT DISTINCT origin AS o, target AS t FROM trade WHERE kind <> 'THROWS'),
r AS (SELECT type_key AS o, type_key AS t FROM catalog UNION SELECT o, t FROM e UNION SELECT a.o, b.t FROM e a JOIN e b ON a.t = b.o), c AS (SELECT o AS subject, count(*) AS depends_on FROM r GROUP BY o)"""


@query(_FORWARD + " SELECT subject, depends_on FROM c")
def reach_trade_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.reach_counts(*_forward_trade(spark, sf), by="blocks")


@query(_FORWARD + """, s AS (SELECT count(*) AS n, sum(depends_on)::BIGINT AS ccd FROM c), d AS (SELECT sum(length(bin(i)))::BIGINT AS den FROM s, range(1, s.n + 1) AS q(i))
SELECT n, ccd, ccd / n AS acd, ccd / (n * n) AS racd, ccd / den AS nccd FROM s, d""")
def ccd_trade(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cumulative(metrics.reach_counts(*_forward_trade(spark, sf)))


# ---- class paths -----------------------------------------------------------------------------------


@query("""WITH e AS (SELECT l_suppkey AS scope, l_partkey AS name, l_quantity AS precedence, CASE l_linenumber WHEN 1 THEN 9 WHEN 2 THEN 11 WHEN 3 THEN 17 WHEN 4 THEN 21 ELSE 0 END AS release,
    l_returnflag = 'N' AS multi_release, l_orderkey || '-' || l_linenumber || '-' || l_shipdate || '-' || l_returnflag || '-' || (l_extendedprice * 100)::BIGINT AS resource FROM lineitem)
SELECT scope, name, release, resource, row_number() OVER (PARTITION BY scope, name ORDER BY precedence, release DESC, resource) = 1 AS winner
FROM (SELECT DISTINCT * FROM e) WHERE release = 0 OR (multi_release AND release <= 17)""")
def classpath_release(spark: SparkSession, sf: str) -> DataFrame:
    release = F.lit(0)
    for line, n in ((1, 9), (2, 11), (3, 17), (4, 21)):
        release = F.when(F.col("l_linenumber") == line, n).otherwise(release)
    parts = ("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    rows = wl.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("scope"), F.col("l_partkey").alias("name"), F.col("l_quantity").alias("precedence"), release.alias("release"), (F.col("l_returnflag") == "N").alias("multi_release"),
        F.concat_ws("-", *(F.col(c).cast("string") for c in parts), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("resource"),
    )
    return lookup.classpath_winners(rows.distinct(), release=17).select("scope", "name", "release", "resource", "winner")


# ---- members and names -----------------------------------------------------------------------------

_MEMBERS = """m AS (SELECT p_brand AS owner, p_partkey::VARCHAR AS name, CASE WHEN p_size < 10 THEN 'FIELD' WHEN p_size < 12 THEN 'CONSTRUCTOR' ELSE 'METHOD' END AS kind,
  CASE WHEN p_size % 2 = 0 THEN 'PUBLIC' ELSE 'PRIVATE' END AS visibility, p_type AS return_type, p_size FROM part)"""


def _members(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size < 10, "FIELD").when(size < 12, "CONSTRUCTOR").otherwise("METHOD")
    params = F.when(size > 30, F.array(F.col("p_type"), F.lit("int"))).when(size > 20, F.array(F.lit("int"))).otherwise(F.array().cast("array<string>"))
    return wl.table(spark, sf, "part").select(F.col("p_brand").alias("owner"), F.col("p_partkey").cast("string").alias("name"), kind.alias("kind"), F.when(size % 2 == 0, "PUBLIC").otherwise("PRIVATE").alias("visibility"), F.col("p_type").alias("return_type"), params.alias("params"))


@query(f"WITH {_MEMBERS} SELECT owner, name FROM m WHERE kind = 'METHOD' AND NOT visibility = 'PRIVATE' OR kind = 'FIELD' AND length(name) = 2")
def select_members(spark: SparkSession, sf: str) -> DataFrame:
    s = selectors
    chosen = s.equals("kind", "METHOD") & ~s.equals("visibility", "PRIVATE") | s.equals("kind", "FIELD") & s.named("name", patterns.trusted_regex("[0-9]{2}"))
    return chosen.select(_members(spark, sf)).select("owner", "name")


@query(f"WITH {_MEMBERS} SELECT name, p_size > 30 AS two, p_size BETWEEN 21 AND 30 AS one FROM m WHERE p_size > 20 OR (p_size <= 20 AND return_type LIKE 'PROMO%')")
def select_by_parameters(spark: SparkSession, sf: str) -> DataFrame:
    s = selectors
    rows = _members(spark, sf)
    two = s.Selector("two parameters, the last an int", (F.size("params") == 2) & (F.get("params", F.lit(1)) == "int"))
    one = s.parameters_are("params", "int")
    none = s.parameters_are("params") & s.named("return_type", patterns.glob("PROMO**", "resource"))
    return (two | one | none).select(rows).select("name", two.predicate.alias("two"), one.predicate.alias("one"))


@query(f"WITH {_MEMBERS}, big AS (SELECT owner FROM m GROUP BY owner HAVING count(*) FILTER (kind = 'CONSTRUCTOR') > 0) SELECT owner, name FROM m WHERE owner IN (SELECT owner FROM big) AND kind = 'FIELD'")
def select_declared_by(spark: SparkSession, sf: str) -> DataFrame:
    rows = _members(spark, sf)
    owners = rows.where("kind = 'CONSTRUCTOR'").select("owner").distinct()
    return (selectors.listed("owner", owners, "declared by a type with a constructor") & selectors.equals("kind", "FIELD")).select(rows).select("owner", "name")


@query("""WITH RECURSIVE t AS (SELECT c_custkey AS k, CASE WHEN c_custkey > 1 AND c_mktsegment <> 'MACHINERY' THEN c_custkey // 2 END AS up, c_mktsegment <> 'BUILDING' AS named FROM customer),
n AS (SELECT k, 'C' || k AS name FROM t WHERE up IS NULL UNION ALL SELECT t.k, n.name || '.S' || t.k FROM t JOIN n ON t.up = n.k WHERE t.named)
SELECT t.k::VARCHAR AS binary_name, n.name AS canonical_name FROM t LEFT JOIN n ON n.k = t.k""")
def lexical_names(spark: SparkSession, sf: str) -> DataFrame:
    """Segment BUILDING stands for anonymous types, MACHINERY for top-level ones."""
    c = wl.table(spark, sf, "customer")
    top = (F.col("c_custkey") <= 1) | (F.col("c_mktsegment") == "MACHINERY")
    key = F.col("c_custkey").cast("string")
    rows = c.select(F.when(top, F.concat(F.lit("C"), key)).otherwise(key).alias("binary_name"), key.alias("k"), top.alias("top"), F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("S"), key)).alias("simple_name"), F.expr("cast(c_custkey div 2 AS string)").alias("up"))
    owner = rows.select(F.col("k").alias("up"), F.col("binary_name").alias("lexical_owner"))
    rows = rows.join(owner, "up", "left").select("binary_name", "k", "simple_name", F.when(~F.col("top"), F.col("lexical_owner")).alias("lexical_owner"))
    return selectors.lexical_names(rows).select(F.col("k").alias("binary_name"), "canonical_name")


_FLAGS = "(CASE WHEN p_size % 2 = 1 THEN 1 ELSE 0 END) + (CASE WHEN p_size % 3 = 0 THEN 512 ELSE 0 END) + (CASE WHEN p_size % 6 = 0 THEN 8192 ELSE 0 END) + (CASE WHEN p_size % 5 = 0 THEN 16384 ELSE 0 END)"


@query("""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'ANNOTATION' WHEN p_size % 5 = 0 THEN 'ENUM' WHEN p_size % 3 = 0 THEN 'INTERFACE' WHEN p_type LIKE 'PROMO%' THEN 'RECORD' ELSE 'CLASS' END AS kind,
  CASE WHEN p_size % 2 = 1 THEN 'PUBLIC' ELSE 'PACKAGE_PRIVATE' END AS visibility FROM part""")
def type_kinds(spark: SparkSession, sf: str) -> DataFrame:
    p = wl.table(spark, sf, "part").withColumn("flags", F.expr(_FLAGS))
    return p.select("p_partkey", classify.type_kind(F.col("flags"), F.col("p_type").startswith("PROMO")).alias("kind"), classify.visibility(F.col("flags")).alias("visibility"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'CONSTRUCTOR' WHEN 1 THEN 'STATIC_INITIALIZER' WHEN 2 THEN 'METHOD' ELSE 'FIELD' END AS kind,
  CASE WHEN p_size % 3 = 0 THEN 'LAMBDA_METAFACTORY' WHEN p_size % 3 = 1 THEN 'STRING_CONCAT' ELSE 'GENERIC' END AS site FROM part""")
def member_and_call_site_kinds(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    name = F.when(size % 4 == 0, "<init>").when(size % 4 == 1, "<clinit>").otherwise("m")
    descriptor = F.when(size % 4 == 3, "I").otherwise("()V")
    owner = F.when(size % 3 == 0, "java.lang.invoke.LambdaMetafactory").otherwise("java.lang.invoke.StringConcatFactory")
    bootstrap = F.when(size % 3 == 0, "altMetafactory").when(size % 3 == 1, "makeConcat").otherwise("other")
    return wl.table(spark, sf, "part").select("p_partkey", classify.member_kind(name, descriptor).alias("kind"), classify.call_site_kind(owner, bootstrap).alias("site"))


@query("""SELECT p_partkey, (CASE WHEN p_size < 20 THEN 1 ELSE 0 END + CASE WHEN p_type LIKE 'S%' THEN 1 ELSE 0 END + CASE WHEN p_brand LIKE '%1' THEN 1 ELSE 0 END) >= 2 AS generated, p_size >= 20 AND p_type NOT LIKE 'S%' AS shown FROM part""")
def generated_and_presented(spark: SparkSession, sf: str) -> DataFrame:
    small, sm, one = F.col("p_size") < 20, F.col("p_type").startswith("S"), F.col("p_brand").endswith("1")
    return wl.table(spark, sf, "part").select("p_partkey", classify.generated(small, sm, one).alias("generated"), classify.presented(small, sm, F.lit(False)).alias("shown"))


@query("""SELECT c_custkey, CASE WHEN k.owners > 1 THEN 'UNKNOWN' WHEN e = 0 AND NOT m THEN 'TOP_LEVEL' WHEN e = 0 THEN 'UNKNOWN' WHEN o AND m THEN 'UNKNOWN' WHEN o AND n THEN 'MEMBER' WHEN NOT o AND n THEN 'LOCAL' WHEN NOT o THEN 'ANONYMOUS' ELSE 'UNKNOWN' END AS nesting
FROM (SELECT c_custkey, c_custkey % 2 AS e, c_acctbal > 2000 AS o, c_mktsegment <> 'BUILDING' AS n, c_mktsegment IN ('MACHINERY', 'BUILDING') AND c_acctbal < 5000 AS m, CASE WHEN c_nationkey = 3 THEN 2 ELSE 1 END AS owners FROM customer) k""")
def nesting_kinds(spark: SparkSession, sf: str) -> DataFrame:
    kind = classify.nesting_kind(
        F.col("c_custkey") % 2, F.col("c_acctbal") > 2000, F.col("c_mktsegment") != "BUILDING",
        F.col("c_mktsegment").isin("MACHINERY", "BUILDING") & (F.col("c_acctbal") < 5000), F.when(F.col("c_nationkey") == 3, 2).otherwise(1),
    )
    return wl.table(spark, sf, "customer").select("c_custkey", kind.alias("nesting"))


# ---- hierarchies and annotations -------------------------------------------------------------------


@query("""WITH RECURSIVE o AS (SELECT c_custkey AS s, c_custkey // 2 AS a FROM customer WHERE c_custkey > 1), r AS (SELECT c_custkey AS s, c_custkey AS a FROM customer UNION SELECT r.s, o.a FROM r JOIN o ON r.a = o.s)
SELECT DISTINCT r.s::VARCHAR AS subject FROM r JOIN customer c ON c.c_custkey = r.a WHERE c.c_mktsegment = 'BUILDING'""")
def annotation_inherited(spark: SparkSession, sf: str) -> DataFrame:
    c = wl.table(spark, sf, "customer")
    occurrences = c.select(F.col("c_custkey").cast("string").alias("subject"), F.col("c_mktsegment").alias("annotation"))
    chain = c.where("c_custkey > 1").select(F.col("c_custkey").cast("string").alias("subject"), F.expr("cast(c_custkey div 2 AS string)").alias("superclass"))
    return hierarchy.annotated_with(occurrences, "BUILDING", "INHERITED", superclass=chain, inheritable=spark.createDataFrame([("BUILDING",)], "annotation string"))


@query("""SELECT doc_id, quality = 1 AS present_and_one, quality <> 1 AS other, toxic IS NULL AS no_toxic FROM labels""")
def annotation_values(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda name: F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("name"), F.col(name).cast("string").alias("value")))
    elements = F.array_compact(F.array(pair("quality"), pair("toxic")))
    is_ = lambda name, condition, value=None: structure.value_condition(F.col("elements"), name, condition, value)
    rows = wl.table(spark, sf, "labels").select("doc_id", elements.alias("elements"))
    return rows.select("doc_id", (is_("quality", "PRESENT") & is_("quality", "EQUALS", "1")).alias("present_and_one"), is_("quality", "NOT_EQUALS", "1").alias("other"), is_("toxic", "ABSENT").alias("no_toxic"))


@query("""SELECT d.doc_id::VARCHAR AS origin FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def annotation_forbid(spark: SparkSession, sf: str) -> DataFrame:
    marked = wl.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("subject"))
    return _shown(structure.annotation_rule(_RULE, wl.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id")), marked, require=False), "origin")


@query("""WITH t AS (SELECT c_custkey AS k, c_custkey // 2 AS up, coalesce(c_acctbal > 0, false) AS sealed, coalesce(c_mktsegment = 'BUILDING', false) AS final, c_nationkey AS p FROM customer),
d AS (SELECT s, c, any_value(p) AS p, count(*) AS times FROM (SELECT k AS s, 2 * k AS c, p FROM t WHERE sealed UNION ALL SELECT k, k, p FROM t WHERE sealed AND final) GROUP BY s, c),
o AS (SELECT DISTINCT t.up AS s, t.k AS c FROM t JOIN t u ON u.k = t.up AND u.sealed WHERE t.k > 1),
b AS (SELECT coalesce(d.s, o.s) AS s, coalesce(d.c, o.c) AS c, d.times, o.s IS NOT NULL AS seen, d.p FROM d FULL JOIN o ON d.s = o.s AND d.c = o.c)
SELECT s::VARCHAR AS sealed, c::VARCHAR AS subtype, code FROM (SELECT b.s, b.c, CASE WHEN times IS NULL THEN 'UNDECLARED_SUBTYPE' WHEN times > 1 THEN 'DUPLICATE_PERMITTED' WHEN s = c THEN 'SELF_PERMITTED' WHEN k.k IS NULL THEN 'MISSING_SUBTYPE' WHEN NOT seen THEN 'PERMITTED_NOT_SUBTYPE'
  WHEN NOT (k.final OR k.sealed) THEN 'SUBTYPE_NOT_CLOSED' WHEN b.p <> k.p THEN 'SUBTYPE_IN_OTHER_PACKAGE' END AS code FROM b LEFT JOIN t k ON k.k = b.c) WHERE code IS NOT NULL""")
def sealed_types(spark: SparkSession, sf: str) -> DataFrame:
    key, final = F.col("c_custkey").cast("string"), F.col("c_mktsegment") == "BUILDING"
    twice = F.expr("cast(2 * c_custkey AS string)")
    none = F.array().cast("array<string>")
    types = wl.table(spark, sf, "customer").select(
        key.alias("binary_name"), (F.col("c_acctbal") > 0).alias("sealed"), F.when(F.col("c_acctbal") > 0, F.when(final, F.array(twice, key)).otherwise(F.array(twice))).otherwise(none).alias("permitted"),
        F.when(F.col("c_custkey") > 1, F.expr("cast(c_custkey div 2 AS string)")).alias("superclass"), none.alias("interfaces"), F.when(final, F.array(F.lit("FINAL"))).otherwise(none).alias("modifiers"), F.col("c_nationkey").cast("string").alias("package"),
    )
    return hierarchy.sealed_check(types)


@query("""WITH RECURSIVE o AS (SELECT c_custkey AS s, c_custkey // 2 AS a FROM customer WHERE c_custkey > 1 UNION ALL SELECT 1, c_custkey FROM customer WHERE c_custkey = 5), n AS (SELECT DISTINCT a FROM o),
r AS (SELECT s, a, 1 AS d FROM o WHERE s IN (SELECT a FROM n) UNION SELECT r.s, o.a, d + 1 FROM r JOIN o ON o.s = r.a WHERE d < 4 AND r.s <> r.a), m AS (SELECT s, a, min(d) AS d FROM r GROUP BY s, a)
SELECT n.a::VARCHAR AS annotation, (SELECT count(*) FROM m WHERE m.s = n.a AND m.a <> n.a) AS n_meta,
  EXISTS (SELECT 1 FROM m JOIN o ON o.s = m.a WHERE m.s = n.a AND m.d = 4 AND NOT EXISTS (SELECT 1 FROM m k WHERE k.s = n.a AND k.a = o.a)) AS "limit",
  EXISTS (SELECT 1 FROM m WHERE m.s = n.a AND (m.a = n.a OR m.a IN (SELECT k.s FROM m k WHERE k.s = k.a))) AS cycle FROM n""")
def meta_annotation_states(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation k carries k div 2, and 1 carries 5: a cycle at the top, and more levels than the four that are followed."""
    c = wl.table(spark, sf, "customer")
    rows = c.where("c_custkey > 1").select(F.col("c_custkey").cast("string").alias("subject"), F.expr("cast(c_custkey div 2 AS string)").alias("annotation"))
    rows = rows.unionByName(c.where("c_custkey = 5").select(F.lit("1").alias("subject"), F.col("c_custkey").cast("string").alias("annotation")))
    return hierarchy.meta_annotation_states(rows, max_depth=4)


@query("""WITH t AS (SELECT c_custkey AS k, c_custkey // 2 AS up, c_acctbal > 0 AS sealed, c_mktsegment = 'BUILDING' AS final, c_nationkey = 3 AS lost FROM customer),
o AS (SELECT k, CASE WHEN lost THEN -1 ELSE up END AS up FROM t WHERE k > 1), r AS (SELECT k, up, 1 AS d FROM o),
a AS (WITH RECURSIVE z AS (SELECT k, up FROM o UNION SELECT z.k, o.up FROM z JOIN o ON o.k = z.up) SELECT k FROM z WHERE up = -1 OR (up > 0 AND up NOT IN (SELECT k FROM t)) GROUP BY k),
q AS (SELECT k FROM t WHERE k % 5 = 0 UNION SELECT 10000000), d AS (SELECT k AS s, 2 * k AS c FROM t WHERE sealed UNION SELECT k, 3 * k FROM t WHERE sealed), e AS (SELECT o.up AS s, o.k AS c FROM o JOIN t ON t.k = o.up AND t.sealed),
b AS (SELECT coalesce(d.s, e.s) AS s, coalesce(d.c, e.c) AS c, d.s IS NOT NULL AS said, e.s IS NOT NULL AS seen FROM d FULL JOIN e ON d.s = e.s AND d.c = e.c)
SELECT s::VARCHAR AS sealed, c::VARCHAR AS subtype, code FROM (SELECT b.s, b.c, CASE WHEN NOT said THEN 'UNDECLARED_SUBTYPE' WHEN s = c THEN 'SELF_PERMITTED' WHEN k.k IS NULL THEN 'MISSING_SUBTYPE' WHEN NOT seen AND b.c IN (SELECT k FROM a) THEN 'RELATIONSHIP_UNKNOWN' WHEN NOT seen THEN 'PERMITTED_NOT_SUBTYPE'
  WHEN NOT (k.final OR k.sealed) THEN 'SUBTYPE_NOT_CLOSED' END AS code FROM b LEFT JOIN t k ON k.k = b.c WHERE s IN (SELECT k FROM q)) WHERE code IS NOT NULL AND s > 0
UNION ALL SELECT '0', c::VARCHAR, code FROM (SELECT 0 AS c, CASE WHEN (SELECT sealed FROM t WHERE k = 0) THEN 'DUPLICATE_PERMITTED' END AS code) WHERE code IS NOT NULL
UNION ALL SELECT s::VARCHAR, c::VARCHAR, 'UNDECLARED_SUBTYPE' FROM b WHERE s = 0 AND NOT said
UNION ALL SELECT '10000000', NULL, 'QUERY_TYPE_MISSING'""")
def sealed_types_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """A type permits 2k and 3k; customers of nation 3 extend a type that nobody knows.  Every fifth type is asked for, and one that isn't there."""
    key = F.col("c_custkey").cast("string")
    none = F.array().cast("array<string>")
    c = wl.table(spark, sf, "customer")
    permitted = F.array(F.expr("cast(2 * c_custkey AS string)"), F.expr("cast(3 * c_custkey AS string)"))
    up = F.when(F.col("c_nationkey") == 3, "-1").otherwise(F.expr("cast(c_custkey div 2 AS string)"))
    types = c.select(
        key.alias("binary_name"), (F.col("c_acctbal") > 0).alias("sealed"), F.when(F.col("c_acctbal") > 0, permitted).otherwise(none).alias("permitted"), F.when(F.col("c_custkey") > 1, up).alias("superclass"),
        none.alias("interfaces"), F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("FINAL"))).otherwise(none).alias("modifiers"), F.lit("p").alias("package"),
    )
    asked = c.where("c_custkey % 5 = 0").select(key.alias("binary_name")).unionByName(spark.createDataFrame([("10000000",)], "binary_name string"))
    return hierarchy.sealed_check(types, asked)


_NESTS = """h AS (SELECT 'T' || s_suppkey AS t, 'T' || (s_suppkey // 4 * 4) AS host FROM supplier WHERE s_suppkey % 4 <> 0 OR s_acctbal < 0 UNION SELECT 'T' || s_suppkey, 'T' || (s_suppkey // 8 * 8) FROM supplier WHERE s_nationkey = 3),
l AS (SELECT 'T' || (s_suppkey // 4 * 4) AS t, 'T' || s_suppkey AS member FROM supplier WHERE s_suppkey % 4 <> 0 AND s_nationkey <> 5 UNION ALL SELECT 'T' || (s_suppkey // 4 * 4), 'T' || s_suppkey FROM supplier WHERE s_nationkey = 7)"""


@query(f"""WITH {_NESTS} SELECT t AS type, 'CONFLICTING_HOSTS' AS problem, NULL AS other FROM h GROUP BY t HAVING count(DISTINCT host) > 1
UNION ALL SELECT DISTINCT t, 'OWN_HOST', host FROM h WHERE t = host UNION ALL SELECT t, 'REPEATED_MEMBER', member FROM l GROUP BY t, member HAVING count(*) > 1
UNION ALL SELECT DISTINCT t, 'HOST_AND_MEMBERS', NULL FROM h WHERE t IN (SELECT t FROM l)
UNION ALL SELECT DISTINCT t, 'NOT_LISTED', host FROM h WHERE t <> host AND NOT EXISTS (SELECT 1 FROM l WHERE l.t = h.host AND l.member = h.t)
UNION ALL SELECT DISTINCT t, 'HOST_NOT_NAMED', member FROM l WHERE t <> member AND NOT EXISTS (SELECT 1 FROM h WHERE h.t = l.member AND h.host = l.t)""")
def nest_host_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Four suppliers are a nest; some name themselves or another host, some are listed twice or not at all."""
    s = wl.table(spark, sf, "supplier")
    name, host = F.concat(F.lit("T"), "s_suppkey"), F.concat(F.lit("T"), F.expr("s_suppkey div 4 * 4"))
    hosts = s.where("s_suppkey % 4 <> 0 OR s_acctbal < 0").select(name.alias("type"), host.alias("host")).unionByName(s.where("s_nationkey = 3").select(name.alias("type"), F.concat(F.lit("T"), F.expr("s_suppkey div 8 * 8")).alias("host")))
    listed = lambda rows: rows.select(host.alias("type"), name.alias("member"))
    return hierarchy.nest_problems(hosts, listed(s.where("s_suppkey % 4 <> 0 AND s_nationkey <> 5")).unionByName(listed(s.where("s_nationkey = 7"))))


@query(f"""WITH {_HIER}, t AS (SELECT DISTINCT o_custkey AS s FROM orders)
SELECT s::VARCHAR AS source, EXISTS (SELECT 1 FROM up WHERE o = s AND t = 5) OR s = 5 AS excluded, EXISTS (SELECT 1 FROM up WHERE o = s AND t = 5) OR s = 5 OR EXISTS (SELECT 1 FROM up WHERE o = s AND t NOT IN (SELECT id FROM known)) AS included FROM t""")
def assignability_policies(spark: SparkSession, sf: str) -> DataFrame:
    h, known = _hierarchy(spark, sf)
    pairs = known.select(F.col("id").alias("source"), F.lit("5").alias("target"))
    answer = hierarchy.assignability(pairs, hierarchy.supertypes(h, known), known)
    return answer.select("source", *(hierarchy.decided(F.col("assignable"), policy).alias(name) for policy, name in (("EXCLUDE", "excluded"), ("INCLUDE", "included"))))


@query(f"WITH {_HIER} SELECT o_custkey::VARCHAR AS origin FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey // 2 <> 3 AND NOT (o_custkey > 1 AND o_custkey // 2 NOT IN (SELECT id FROM known))")
def inheritance_direct(spark: SparkSession, sf: str) -> DataFrame:
    h, known = _hierarchy(spark, sf)
    return _shown(structure.inheritance(_RULE, h, known, known, spark.createDataFrame([("3",)], "id string"), transitive=False), "origin")


# ---- access, modules, reachability -----------------------------------------------------------------


def _accesses(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = wl.table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("caller"), F.col("role").alias("target_owner"), F.lit("m").alias("target_name"), F.lit("()V").alias("target_desc"), F.lit("METHOD_CALL").alias("kind"), F.col("turn").alias("offset"), (F.col("turn") == 0).alias("compiler_created"))
    return rows, c.select(F.col("conv_id").cast("string").alias("id")).distinct(), spark.createDataFrame([("system", "m", "()V")], "owner string, name string, descriptor string")


@query("SELECT conv_id::VARCHAR AS origin, count(DISTINCT turn) AS n_evidence FROM conversations WHERE role = 'assistant' AND turn <> 0 GROUP BY conv_id")
def member_access_no(spark: SparkSession, sf: str) -> DataFrame:
    rows, callers, _ = _accesses(spark, sf)
    return _shown(structure.member_access(_RULE, rows, callers, spark.createDataFrame([("assistant", "m", "()V")], "owner string, name string, descriptor string"), "NO"), "origin", "n_evidence")


@query("SELECT conv_id::VARCHAR AS origin FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0")
def member_access_required(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(structure.member_access(_RULE, *_accesses(spark, sf), "REQUIRED", show_compiler_made=True), "origin")


@query("SELECT min(conv_id::VARCHAR) AS origin FROM conversations HAVING count(*) FILTER (role = 'nobody') = 0 AND count(*) > 0")
def member_access_any(spark: SparkSession, sf: str) -> DataFrame:
    rows, callers, _ = _accesses(spark, sf)
    return _shown(structure.member_access(_RULE, rows, callers, spark.createDataFrame([("nobody", "m", "()V")], "owner string, name string, descriptor string"), "ANY"), "origin")


# Callers are customers, targets suppliers, packages their nations, modules the nations' regions.
_STATES = """x AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s, l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
reg AS (SELECT n_nationkey AS n, n_regionkey AS g, r_name AS m FROM nation JOIN region ON r_regionkey = n_regionkey),
up AS (SELECT c_custkey AS c, c_custkey % 10 AS s FROM customer UNION ALL SELECT c_custkey, c_custkey % 10 // 2 FROM customer UNION ALL SELECT c_custkey, c_custkey % 10 // 4 FROM customer UNION ALL SELECT c_custkey, c_custkey % 10 // 8 FROM customer UNION ALL SELECT c_custkey, 0 FROM customer),
j AS (SELECT x.c, x.s, count(*) AS n, c_nationkey = s_nationkey AS same, c_custkey % 7 = s_suppkey % 7 AS nest, s_suppkey % 4 AS v, a.m AS om, b.m AS tm, a.g AS og, b.g AS tg, b.n AS tn, c_custkey % 13 = 0 AS doubt, (x.c % 13 <> 0 AND (x.c, x.s) IN (SELECT c, s FROM up)) AS below
  FROM x JOIN customer ON c_custkey = x.c JOIN supplier ON s_suppkey = x.s JOIN reg a ON a.n = c_nationkey JOIN reg b ON b.n = s_nationkey GROUP BY ALL),
k AS (SELECT *, CASE v WHEN 0 THEN 'PUBLIC' WHEN 1 THEN CASE WHEN same THEN 'PROTECTED_SAME_PACKAGE' ELSE 'PROTECTED_CROSS_PACKAGE' END WHEN 2 THEN CASE WHEN same THEN 'PACKAGE_PRIVATE' ELSE 'PACKAGE_PRIVATE_INACCESSIBLE' END
    ELSE CASE WHEN nest THEN 'PRIVATE_NESTMATE' ELSE 'PRIVATE_INACCESSIBLE' END END AS visibility,
  CASE WHEN tg = 4 THEN 'UNNAMED_OR_UNKNOWN_MODULE' WHEN og = tg THEN 'SAME_MODULE' WHEN tg = 3 THEN 'AUTOMATIC_MODULE' WHEN tn % 3 = 0 THEN 'PACKAGE_NOT_EXPORTED' WHEN tn % 3 = 1 THEN 'UNQUALIFIED_EXPORT'
    WHEN og = (tg + 1) % 5 THEN 'QUALIFIED_EXPORT_TO_CALLER' ELSE 'QUALIFIED_EXPORT_TO_OTHER_MODULES' END AS export FROM j)"""


def _access_states(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's member is public, protected, package-private or private by its number; a third of the packages is exported, a third to one module."""
    t = lambda name: wl.table(spark, sf, name)
    x = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey", "l_orderkey", "l_linenumber").distinct()
    owner = F.concat(F.lit("S"), "l_suppkey")
    accesses = x.select(F.concat(F.lit("C"), "o_custkey").alias("origin"), owner.alias("target_owner"), F.concat(owner, F.lit("#m")).alias("target_member"))
    regions = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    known = regions.select(F.col("n_nationkey").alias("nation"), F.when(F.col("n_regionkey") != 4, F.col("r_name")).alias("module"))
    of = lambda df, letter, key, nation: df.select(F.concat(F.lit(letter), key).alias("type"), F.col(nation).alias("nation"), F.concat(F.lit("H"), F.col(key) % 7).alias("nest_host"))
    types = of(t("customer"), "C", "c_custkey", "c_nationkey").unionByName(of(t("supplier"), "S", "s_suppkey", "s_nationkey")).join(known, "nation")
    types = types.select("type", F.concat(F.lit("n"), "nation").alias("package"), "module", "nest_host")
    v = F.col("s_suppkey") % 4
    members = t("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("type"), F.concat(F.lit("S"), "s_suppkey", F.lit("#m")).alias("member"), F.when(v == 0, "PUBLIC").when(v == 1, "PROTECTED").when(v == 2, "PACKAGE_PRIVATE").otherwise("PRIVATE").alias("visibility"))
    modules = t("region").select(F.col("r_name").alias("module"), F.when(F.col("r_regionkey") == 3, "AUTOMATIC").otherwise("EXPLICIT").alias("kind"))
    to = t("region").select(((F.col("r_regionkey") + 4) % 5).alias("n_regionkey"), F.col("r_name").alias("next"))
    exports = regions.join(to, "n_regionkey").where("n_nationkey % 3 <> 0").select(F.col("r_name").alias("module"), F.concat(F.lit("n"), "n_nationkey").alias("package"), F.when(F.expr("n_nationkey % 3 = 2"), F.array("next")).alias("targets"))
    up = t("customer").select(F.concat(F.lit("C"), "c_custkey").alias("origin"), F.when(F.expr("c_custkey % 13 = 0"), "Nowhere").otherwise(F.concat(F.lit("S"), F.expr("c_custkey % 10"))).alias("target"))
    up = up.unionByName(t("supplier").where("s_suppkey BETWEEN 1 AND 9").select(F.concat(F.lit("S"), "s_suppkey").alias("origin"), F.concat(F.lit("S"), F.expr("s_suppkey div 2")).alias("target")))
    return access.access_states(accesses, types, members, modules, exports, hierarchy.supertypes(up, types.select(F.col("type").alias("id"))))


@query(f"""WITH {_STATES} SELECT 'C' || c AS origin, 'S' || s AS target_owner, n, visibility, export, CASE WHEN visibility LIKE '%INACCESSIBLE' OR export IN ('PACKAGE_NOT_EXPORTED', 'QUALIFIED_EXPORT_TO_OTHER_MODULES') OR (v = 1 AND NOT same AND NOT below AND NOT doubt) THEN 'NO'
  WHEN export = 'UNNAMED_OR_UNKNOWN_MODULE' OR (v = 1 AND NOT same AND NOT below) THEN 'UNKNOWN' ELSE 'YES' END AS accessible FROM k""")
def access_states(spark: SparkSession, sf: str) -> DataFrame:
    return _access_states(spark, sf).select("origin", "target_owner", "n", "visibility", "export", "accessible")


@query(f"""WITH {_STATES} SELECT 'C' || c AS origin, 'S' || s || '#m' AS target, CASE WHEN s % 10 = 9 THEN 'TYPE_NOT_APPROVED' WHEN s % 10 = 8 THEN 'MEMBER_NOT_APPROVED' WHEN NOT shown THEN 'TYPE_NOT_PUBLIC' WHEN v > 0 THEN 'MEMBER_' || visibility ELSE export END AS code, n AS n_evidence
FROM (SELECT k.*, s_acctbal > 0 AND s_acctbal < 9000 AS shown FROM k JOIN supplier ON s_suppkey = s) WHERE NOT (same AND om = tm) AND (s % 10 >= 8 OR NOT shown OR v > 0 OR export IN ('PACKAGE_NOT_EXPORTED', 'QUALIFIED_EXPORT_TO_OTHER_MODULES'))""")
def approved_interface(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier with a balance of 9000 or more stands within a type that isn't public."""
    s = wl.table(spark, sf, "supplier").withColumn("type", F.concat(F.lit("S"), "s_suppkey"))
    owners = spark.createDataFrame([("Shown", True, None), ("Hidden", False, None)], "type string, public boolean, owner string")
    types = s.select("type", (F.col("s_acctbal") > 0).alias("public"), F.when(F.col("s_acctbal") >= 9000, "Hidden").when(F.expr("s_suppkey % 2 = 0"), "Shown").alias("owner")).unionByName(owners)
    last = F.expr("s_suppkey % 10")
    approved = s.where(last != 9).select(F.col("type").alias("id")), s.where(last != 8).select(F.concat("type", F.lit("#m")).alias("id"))
    return _shown(access.approved_interface(_RULE, _access_states(spark, sf), access.visible_from_outside(types), *approved), "origin", "target", "code", "n_evidence")


def _declarations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nations are modules, those of the last region automatic; customers are what they require or export, their balance and segment the flags and targets."""
    c = wl.table(spark, sf, "customer")
    targets = F.when(F.col("c_mktsegment") == "BUILDING", F.array("c_mktsegment", F.lit("AUTOMOBILE"))).when(F.col("c_mktsegment") == "MACHINERY", F.array("c_mktsegment"))
    rows = c.select(F.concat(F.lit("n"), "c_nationkey").alias("name"), F.concat(F.lit("m."), "c_custkey").alias("value"), (F.col("c_acctbal") > 0).alias("transitive"), (F.col("c_acctbal") > 5000).alias("static"), targets.alias("targets"))
    modules = wl.table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.when(F.col("n_regionkey") == 4, "AUTOMATIC").otherwise("EXPLICIT").alias("kind"))
    return modules, rows


_EXPLICIT = "FROM customer JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 4"


@query(f"SELECT 'n' || c_nationkey AS origin, 'm.' || c_custkey AS target {_EXPLICIT} WHERE c_acctbal > 0 AND NOT c_acctbal > 5000 AND (c_custkey::VARCHAR) LIKE '1%'")
def requires_transitive_no(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(mod.declaration_rule(_RULE, *_declarations(spark, sf), patterns.glob("m.1**"), "NO", transitive="REQUIRED", static="FORBIDDEN"), "origin", "target")


@query(f"SELECT 'n' || c_nationkey AS origin, 'm.' || c_custkey AS target {_EXPLICIT} WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def exports_qualified_only(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(mod.declaration_rule(_RULE, *_declarations(spark, sf), patterns.glob("m.**"), "ONLY", qualification="QUALIFIED"), "origin", "target")


@query(f"SELECT 'n' || c_nationkey AS origin, 'm.' || c_custkey AS target {_EXPLICIT} WHERE c_mktsegment <> 'MACHINERY'")
def provides_targets_only(spark: SparkSession, sf: str) -> DataFrame:
    """All providers of a service must fit: those of BUILDING have one that doesn't."""
    return _shown(mod.declaration_rule(_RULE, *_declarations(spark, sf), patterns.glob("m.**"), "ONLY", targets=patterns.exact("MACHINERY")), "origin", "target")


@query("SELECT 'n' || n_nationkey AS origin FROM nation WHERE n_regionkey <> 4 AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)")
def exports_to_required(spark: SparkSession, sf: str) -> DataFrame:
    modules, rows = _declarations(spark, sf)
    rich = wl.table(spark, sf, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("m."), "c_custkey").alias("value"))
    return _shown(mod.declaration_rule(_RULE, modules, rows.join(rich, "value", "left_semi"), patterns.glob("m.**"), "REQUIRED", targets=patterns.exact("AUTOMOBILE")), "origin")


@query(f"""WITH {wl.TRADE_SQL}, e AS (SELECT DISTINCT origin, target FROM trade), s AS (SELECT CASE WHEN NOT starts_with(origin, 'type:crm.') AND NOT starts_with(target, 'type:crm.') THEN 'BOTH' WHEN NOT starts_with(origin, 'type:crm.') THEN 'ORIGIN' ELSE 'TARGET' END AS unmapped FROM e)
SELECT unmapped, count(*) AS n FROM s GROUP BY unmapped""")
def unmapped_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Only customers have a module here."""
    return mod.unmapped_connections(wl.trade(spark, sf).connections(), wl.modules(spark, sf).where(F.col("type_key").startswith("type:crm.")))


def _supplier_modules(spark: SparkSession, sf: str) -> DataFrame:
    s = wl.table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("name"), F.col("s_suppkey").cast("string").alias("x"))
    return s.groupBy("name").agg(F.collect_set(F.concat(F.lit("s."), "x")).alias("opens"), F.collect_set(F.concat(F.lit("u."), "x")).alias("uses"), F.collect_set(F.concat(F.lit("p."), "x")).alias("provides")).withColumn("kind", F.lit("EXPLICIT"))


@query("SELECT 'n' || s_nationkey AS origin, 's.' || s_suppkey AS target FROM supplier WHERE (s_suppkey::VARCHAR) LIKE '1%'")
def module_opens_no(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(mod.module_directives(_RULE, _supplier_modules(spark, sf), "opens", patterns.glob("s.1**"), "NO"), "origin", "target")


@query("SELECT DISTINCT 'n' || s_nationkey AS origin FROM supplier WHERE s_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE (s_suppkey::VARCHAR) LIKE '1%')")
def module_provides_required(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(mod.module_directives(_RULE, _supplier_modules(spark, sf), "provides", patterns.glob("p.1**"), "REQUIRED"), "origin")


@query("SELECT 'n' || s_nationkey AS origin, 'u.' || s_suppkey AS target FROM supplier WHERE length(s_suppkey::VARCHAR) <> 1")
def module_uses_only(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(mod.module_directives(_RULE, _supplier_modules(spark, sf), "uses", patterns.glob("u.?"), "ONLY"), "origin", "target")


@query(f"""WITH RECURSIVE {wl.TRADE_SQL}, e AS (SELECT DISTINCT origin AS o, target AS t FROM trade WHERE kind = 'FIELD_TYPE'), r AS (SELECT type_key AS id FROM catalog WHERE public UNION SELECT e.t FROM r JOIN e ON r.id = e.o)
SELECT type_key AS origin, 1 AS n_evidence FROM catalog WHERE type_key NOT IN (SELECT id FROM r)""")
def public_library_unreachable(spark: SparkSession, sf: str) -> DataFrame:
    c, g = wl.catalog(spark, sf), wl.trade(spark, sf)
    g = type(g)(g.nodes, g.rows.where("kind = 'FIELD_TYPE'"))
    return _shown(structure.unreachable(_RULE, g, _ids(c, "type_key"), structure.public_roots(c)), "origin", "n_evidence")


# ---- scopes, references, occurrences ---------------------------------------------------------------


@query("""WITH t AS (SELECT DISTINCT s_nationkey AS scope, s_suppkey % 20 AS name FROM supplier), q AS (SELECT c_custkey, c_nationkey AS scope, c_custkey % 25 AS name FROM customer),
r AS (SELECT a.n_nationkey AS scope, b.n_nationkey AS reads FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)
SELECT c_custkey, 'n' || coalesce((SELECT scope FROM t WHERE t.scope = q.scope AND t.name = q.name), (SELECT min(reads) FROM r JOIN t ON t.scope = r.reads WHERE r.scope = q.scope AND t.name = q.name)) AS found FROM q""")
def scoped_references(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers are types in the scope of their nation, customers references to them; nations of a region read each other, lowest first."""
    name = lambda key, n: F.concat(F.lit("T"), F.expr(f"{key} % {n}"))
    scope = lambda key: F.concat(F.lit("n"), key)
    types = wl.table(spark, sf, "supplier").select(scope("s_nationkey").alias("scope"), name("s_suppkey", 20).alias("name"))
    asked = wl.table(spark, sf, "customer").select("c_custkey", scope("c_nationkey").alias("scope"), name("c_custkey", 25).alias("name"))
    n = wl.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    reads = n.join(n.select(F.col("n_nationkey").alias("place"), "n_regionkey"), "n_regionkey").where("n_nationkey <> place").select(scope("n_nationkey").alias("scope"), scope("place").alias("reads"), "place")
    return lookup.resolve_in_scopes(asked, types, reads).select("c_custkey", "found")


_REFERENCES = """f AS (SELECT 'T' || l_suppkey AS o, 'T' || l_partkey AS t, l_returnflag AS s, l_quantity < 10 AS primitive FROM lineitem), d AS (SELECT o, t, count(DISTINCT s) AS n FROM f WHERE NOT primitive GROUP BY o, t)"""


def _references(spark: SparkSession, sf: str) -> References:
    """A line item is a reference of its supplier to its part; small quantities stand for primitive types."""
    key = lambda c: F.concat(F.lit("T"), c)
    descriptor = F.when(F.col("l_quantity") < 10, "[I").when(F.col("l_quantity") < 20, F.concat(F.lit("[[LT"), "l_partkey", F.lit(";"))).otherwise(F.concat(F.lit("LT"), "l_partkey", F.lit(";")))
    rows = wl.table(spark, sf, "lineitem").select(key("l_suppkey").alias("origin"), descriptor.alias("descriptor"), F.lit("FIELD_TYPE").alias("kind"), F.col("l_returnflag").alias("source"))
    return References(rows, wl.table(spark, sf, "supplier").select(key("s_suppkey").alias("name")))


@query(f"WITH {_REFERENCES} SELECT o AS origin, t AS target, n AS n_sources, o = t AS self, t NOT IN (SELECT 'T' || s_suppkey FROM supplier) AS external FROM d")
def declared_references(spark: SparkSession, sf: str) -> DataFrame:
    return _references(spark, sf).rows.drop("kind")


@query(f"""WITH {_REFERENCES} SELECT 'primitives' AS counter, count(*) FILTER (primitive) AS n FROM f UNION ALL SELECT 'duplicates', (SELECT count(*) FROM f WHERE NOT primitive) - (SELECT sum(n) FROM d)::BIGINT
UNION ALL SELECT 'self', count(*) FROM d WHERE o = t UNION ALL SELECT 'external', count(*) FROM d WHERE t NOT IN (SELECT 'T' || s_suppkey FROM supplier)""")
def declared_counters(spark: SparkSession, sf: str) -> DataFrame:
    found = _references(spark, sf)
    algorithms.cut(found.rows, "references")  # the one job that reads them fills the counters
    return spark.createDataFrame(sorted(found.counters().items()), "counter string, n long")


@query("SELECT doc_id::VARCHAR AS subject FROM labels WHERE quality = 1 AND toxic = 0 UNION SELECT doc_id::VARCHAR FROM documents WHERE lang = 'de' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def annotation_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Labels are occurrences, visible where quality is 1; toxic ones sit on a use of a type, unless the document is German."""
    rows = wl.table(spark, sf, "labels").join(wl.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    on_use = (F.col("toxic") == 1) & ~F.col("lang").eqNullSafe("de")
    occurrences = rows.select(F.col("doc_id").cast("string").alias("subject"), F.lit("Label").alias("annotation"), (F.col("quality") == 1).alias("visible"), F.when(on_use, "TYPE_USE").otherwise("DECLARATION").alias("target"))
    return hierarchy.annotated_with(hierarchy.occurrences_where(occurrences, visibility="RUNTIME"), "Label", "DIRECT")


@query(f"""WITH {wl.TRADE_SQL}, e AS (SELECT DISTINCT a.package AS o, b.package AS t FROM trade JOIN catalog a ON a.type_key = origin JOIN catalog b ON b.type_key = target WHERE trade.kind = 'THROWS' AND a.package <> b.package)
SELECT DISTINCT 'package:' || package AS stable_key FROM catalog WHERE package NOT IN (SELECT o FROM e UNION SELECT t FROM e)""")
def isolated_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Packages that a projection to returns leaves without an edge; they stay nodes."""
    return projection.packages().including_only("THROWS").without_self_edges().apply(wl.trade(spark, sf))[0].isolated()


@query("""SELECT lang, source, CASE WHEN count(*) FILTER (n_chars >= 5000) = 0 THEN 'NOT_APPLICABLE' WHEN max(n_chars) > 20000 THEN 'INCOMPLETE_EVIDENCE' ELSE 'COMPUTED' END AS state FROM documents GROUP BY lang, source""")
def cohesion_states(spark: SparkSession, sf: str) -> DataFrame:
    """A type is a language and source, long documents its methods; very long ones have no body here."""
    d = wl.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count_if(F.col("n_chars") >= 5000).alias("methods"), (F.max("n_chars") <= 20000).alias("bodies"))
    return d.select("lang", "source", metrics.cohesion_availability(F.col("bodies"), F.col("methods")).alias("state"))


# ---- results and baselines -------------------------------------------------------------------------


@query("""SELECT 'empty' AS rule, 'INCOMPLETE' AS status UNION ALL SELECT 'allowed', 'PASSED' UNION ALL SELECT 'skipped', 'SKIPPED' UNION ALL SELECT 'violated', CASE WHEN count(*) > 0 THEN 'FAILED' ELSE 'PASSED' END FROM region UNION ALL SELECT 'fine', 'PASSED' UNION ALL SELECT 'unknown', 'INCOMPLETE'""")
def rule_statuses(spark: SparkSession, sf: str) -> DataFrame:
    rule = RuleMetadata("r")
    rows = wl.table(spark, sf, "region").select(F.col("r_name").alias("origin"))
    bad = violations(rule, rows, "X", target=None, kind=None)
    count = rows.agg(F.count(F.lit(1)).alias("n"))
    none, zero = bad.where("origin IS NULL"), rows.where("origin IS NULL").agg(F.count(F.lit(1)).alias("n"))
    outcomes = {
        "empty": RuleOutcome(rule, none, selected=zero), "allowed": RuleOutcome(rule, none, selected=zero, on_empty="ALLOW"), "skipped": RuleOutcome(rule, bad, skipped="no module"),
        "violated": RuleOutcome(rule, bad, selected=count), "fine": RuleOutcome(rule, none, selected=count), "unknown": RuleOutcome(rule, bad, selected=count, incomplete=rows),
    }
    return spark.createDataFrame([(name, o.status()) for name, o in outcomes.items()], "rule string, status string")


@query("""SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'error'""")
def baseline_freeze(spark: SparkSession, sf: str) -> DataFrame:
    found = wl.table(spark, sf, "events").select(F.col("event_type").alias("rule_id"), F.lit("X").alias("code"), F.col("user_id").cast("string").alias("subject_id"), F.lit("here").alias("location")).distinct()
    keys = baseline.fingerprints(found)
    kept = baseline.freeze(keys, keys.where("rule_id = 'error'").select("exact_fp"))
    return kept.select(F.col("subject_id").cast("long").alias("user_id"), F.col("rule_id").alias("event_type"))


@query(f"WITH {wl.TRADE_SQL} SELECT type_key FROM catalog WHERE type_key NOT IN (SELECT origin FROM trade UNION SELECT target FROM trade)")
def isolated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    g = wl.trade(spark, sf)
    used = g.rows.select(F.explode(F.array("origin", "target")).alias("stable_key"))
    return g.nodes.select("stable_key").exceptAll(g.nodes.select("stable_key").intersect(used)).select(F.col("stable_key").alias("type_key"))


@query("""SELECT doc_id::VARCHAR AS origin, CASE WHEN lang IS NULL THEN 'NAME_MISSING' ELSE 'NAME_DOES_NOT_MATCH' END AS code FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de')
UNION ALL SELECT 'none', 'NAME_MISSING'""")
def naming_missing_value(spark: SparkSession, sf: str) -> DataFrame:
    values = wl.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("value")).unionByName(spark.createDataFrame([("none", None)], "id string, value string"))
    return _shown(structure.naming(_RULE, values, patterns.trusted_regex("en|de")), "origin", "code")
