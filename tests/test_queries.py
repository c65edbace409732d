import itertools
import random
import re

import pytest

from conftest import DATA, same_as_duck
from latticework import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_sql(spark, duck, name):
    same_as_duck(q.QUERIES[name](spark, DATA), duck, q.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE)))
def test_query_runs(spark, name):
    assert q.QUERIES[name](spark, DATA).count() > 0


def test_cycle_enumeration_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    walks = {1: [0, 1, 2, 3, 4, 5, 0], 2: [7, 7, 8], 3: [rng.randrange(7) for _ in range(14)], 4: [3, 4, 5, 6]}
    rows = [(100 * u + i, u, i, f'{{"k": {k}}}') for u, ks in walks.items() for i, k in enumerate(ks)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, at long, props string")
    events.selectExpr("event_id", "user_id", "'click' AS event_type", "timestamp_seconds(at) AS ts", "props").write.parquet(f"{tmp_path}/events.parquet")
    want = []
    for u, ks in walks.items():
        steps = set(itertools.pairwise(ks))
        for n in range(1, len(set(ks)) + 1):
            for c in itertools.permutations(sorted(set(ks), key=lambda k: f"type:app.p{k % 10}.U{u}K{k}"), n):
                if c[0] == min(c) and all(s in steps for s in itertools.pairwise([*c, c[0]])):
                    want.append(",".join(f"type:app.p{k % 10}.U{u}K{k}" for k in c))
    found = q.QUERIES["cycle_enumeration"](spark, str(tmp_path)).collect()
    assert sorted(r["cycle"] for r in found) == sorted(want) and len(want) < 100
    assert {r["length"] for r in found} >= {1, 6} and not any(r["truncated"] for r in found)
    for r in found:
        nodes = r["cycle"].split(",")
        assert r["closed_path"].split(",") == [*nodes, nodes[0]] and len(nodes) == r["length"] and r["component"] == min(nodes[0], r["component"])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sealed_types_equal_sql_where_a_subtype_is_permitted_twice(spark, duck, tmp_path):
    """Type 0 permits 2 * 0 and itself; types without a balance or segment are neither sealed nor final."""
    rows = [(0, 3, 5.0, "BUILDING"), (1, 3, 5.0, "MACHINERY"), (2, 3, None, None), (3, 4, 5.0, "BUILDING"), (4, 3, 5.0, "BUILDING"), (6, 3, 0.0, None), (9, 3, 1.0, "X"), (9, 4, 1.0, "X")]
    customer = spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    customer.write.parquet(f"{tmp_path}/customer.parquet")
    sql = q.ORACLE["sealed_types"].replace("FROM customer)", f"FROM read_parquet('{tmp_path}/customer.parquet/*.parquet'))")
    found = q.QUERIES["sealed_types"](spark, str(tmp_path))
    assert ("0", "0", "DUPLICATE_PERMITTED") in {tuple(r) for r in found.collect()}
    same_as_duck(found, duck, sql)


def test_trade_is_made_without_repeats_and_labelled_where_it_is_made(spark):
    """Lines repeat (order, number) in the tables; labels at either end are those that two joins with all evidence would give."""
    from latticework import workloads as wl
    from latticework.plans.graph import Graph

    g = wl.trade(spark, DATA)
    rows = g.rows.collect()
    assert len(rows) == len(set(rows)) > 0
    labels = wl.layers(spark, DATA).where("group_id <> 'catalog'").selectExpr("type_key AS id", "group_id AS label")
    columns = [*g.rows.columns, "origin_label", "target_label"]
    plain = Graph(g.nodes, g.rows).labelled(labels).select(columns)
    assert sorted(map(str, g.labelled(labels).select(columns).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("bound", [0, 500_000])
def test_trade_that_may_repeat_says_the_same(spark, duck, monkeypatch, bound):
    """Connections by number are made from lines and orders as they are; no evidence is made distinct for them, and no key moves."""
    from pyspark.sql import functions as F

    from latticework import workloads as wl

    monkeypatch.setattr(wl, "BROADCAST_ROWS", bound)
    g = wl.trade(spark, DATA)
    labels = wl.layers(spark, DATA).where("group_id <> 'catalog'").selectExpr("type_key AS id", "group_id AS label")
    columns = ["origin", "target", "kind", "location", "bytecode_offset"]
    same_as_duck(g.repeated(labels).select(columns).distinct(), duck, f"WITH {wl.TRADE_SQL} SELECT {', '.join(columns)} FROM trade")
    ahead = g.without_evidence(F.col("kind") == "THROWS")
    want = ahead.labelled(labels).where("origin_label IS NOT NULL AND target_label IS NOT NULL").select("origin_label", "target_label").distinct()
    assert {tuple(r) for r in ahead.numbered(labels).collect()} == {tuple(r) for r in want.collect()} == {("sales", "supply")}
    assert "HashAggregate" not in ahead.numbered(labels)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["layer_isolated", "slice_mutual", "project_package", "snapshot_topn", "plantuml_adherence", "isolated_packages"])
def test_trade_evidence_is_not_shuffled_by_its_ends(spark, name):
    """Evidence is several times its tables: it is neither joined with what its ends belong to nor shuffled whole to find repeats."""
    plan = q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(location" in plan
    for keys in ("origin#\\d+, \\d+", "target#\\d+, \\d+", "origin#\\d+, target#\\d+, kind#\\d+, location"):
        assert not re.search(f"hashpartitioning\\({keys}", plan)


def test_baseline_comparison_streams_identities_over_batches(spark):
    """A walk a finding, against the first unused equal one, else the first unused of its identity; identities end in the middle of batches."""
    from latticework.operators import baseline

    rng = random.Random(3)
    make = lambda: [(f"i{rng.randrange(40)}", f"e{rng.randrange(6)}") for _ in range(300)]
    old, new = make(), make()
    want = []
    for i in sorted({x for x, _ in old + new}):
        left = sorted(e for x, e in old if x == i)
        for e in sorted(e for x, e in new if x == i):
            state = "UNCHANGED" if e in left else "MOVED" if left else "NEW"
            if left:
                left.remove(e if e in left else left[0])
            want.append((i, e, state))
        want += [(i, e, "RESOLVED") for e in left]
    frame = lambda rows: spark.createDataFrame(rows, "identity_fp string, evidence_fp string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = baseline.compare(frame(old), frame(new))
        assert sorted(map(tuple, found.collect())) == sorted(want)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert baseline.compare(frame([]), frame([])).count() == 0


def test_trade_evidence_keeps_its_tasks_small(spark, monkeypatch, tmp_path):
    """Lists in an aggregate made it sort and spill; tasks that adaptive execution joins grew with the session's sizes."""
    import duckdb
    from pyspark.sql import functions as F

    from latticework import workloads as wl

    monkeypatch.setattr(wl, "PLACE_ROWS", 3_000)
    evidence = wl.trade_evidence(spark, DATA)
    assert "ObjectHashAggregate" not in evidence._jdf.queryExecution().toString()
    n_lines = wl.table(spark, DATA, "lineitem").count()
    assert evidence.rdd.getNumPartitions() == -(-n_lines // 3_000) > 1
    # Repeated lines, orders and customers of an order, and one that lacks its customer.
    t = str(tmp_path)
    sample = lambda name, where: wl.table(spark, DATA, name).where(where)
    orders = sample("orders", "o_orderkey < 40")
    other = orders.where("o_orderkey < 20").withColumn("o_custkey", F.lit(1).cast(orders.schema["o_custkey"].dataType))
    lost = orders.where("o_orderkey = 39").withColumn("o_custkey", F.lit(-5).cast(orders.schema["o_custkey"].dataType))
    orders.where("o_orderkey < 39").unionByName(orders.where("o_orderkey < 10")).unionByName(other).unionByName(lost).write.parquet(f"{t}/orders.parquet")
    lines = sample("lineitem", "l_orderkey < 60")
    lines.unionByName(lines.where("l_orderkey < 30").withColumn("l_returnflag", F.lit("R"))).write.parquet(f"{t}/lineitem.parquet")
    for name in ("customer", "supplier", "part"):
        sample(name, "true").write.parquet(f"{t}/{name}.parquet")
    c = duckdb.connect()
    for name in ("orders", "lineitem", "customer", "supplier", "part"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{t}/{name}.parquet/*.parquet')")
    monkeypatch.setattr(wl, "PLACE_ROWS", 50)
    same_as_duck(wl.trade_evidence(spark, t), c, f"WITH {wl.TRADE_SQL} SELECT origin, target, kind, location, bytecode_offset FROM trade")


@pytest.mark.parametrize("bound", [0, 500_000])
def test_trade_evidence_moves_groups_and_numbers(spark, monkeypatch, tmp_path, bound):
    """Counted tables are broadcast, at the place, where labels hide their size; larger ones move groups and numbers; ends without a group are one."""
    import duckdb
    from pyspark.sql import functions as F

    from latticework import workloads as wl

    monkeypatch.setattr(wl, "BROADCAST_ROWS", bound, raising=False)
    t = str(tmp_path)
    for name in ("customer", "part", "orders"):
        wl.table(spark, DATA, name).write.parquet(f"{t}/{name}.parquet")
    s = wl.table(spark, DATA, "supplier")
    s.withColumn("s_nationkey", F.expr("CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END")).write.parquet(f"{t}/supplier.parquet")
    lines = wl.table(spark, DATA, "lineitem").where("l_orderkey < 60")
    lines.unionByName(lines.withColumn("l_suppkey", F.col("l_suppkey") % s.count() + 1)).write.parquet(f"{t}/lineitem.parquet")
    c = duckdb.connect()
    for name in ("orders", "lineitem", "customer", "supplier", "part"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{t}/{name}.parquet/*.parquet')")
    same_as_duck(wl.trade_evidence(spark, t), c, f"WITH {wl.TRADE_SQL} SELECT origin, target, kind, location, bytecode_offset FROM trade")
    labels = wl.layers(spark, t).selectExpr("type_key AS id", "group_id AS label").dropDuplicates(["id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = wl.trade(spark, t).labelled(labels).select("origin", "origin_label", "target_label")._jdf.queryExecution().optimizedPlan().toString()
        joins = wl.trade_evidence(spark, t, labels)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    late = plan.index("Join Inner, (l_suppkey") < plan.index("RepartitionByExpression [location")
    assert late == (bound > 0) and "struct(id" not in plan
    assert (bound == 0) == ("hashpartitioning(l_suppkey" in joins) == ("hashpartitioning(l_partkey" in joins)
