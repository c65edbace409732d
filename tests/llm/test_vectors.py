"""Vector codes and hard negatives against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA, same_as_duck
from latticework.llm import hard_negatives as hn
from latticework.llm import registry
from latticework.llm import vector_codes as vc

ROW = "vec_id long, embedding array<float>, label int, code string, score double"


def usable(rows):
    return [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]


def codes_by_hand(rows, parts, entries, rounds):
    rows = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[[int(np.floor(256 * x)) for x in r[1][p * width : (p + 1) * width]] for p in range(parts)] for r in rows]
    books = [[cut[k][p] for k in range(min(entries, len(rows)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, at, strict=True) if a[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at = assign()
    error = [sum(far(v[p], books[p][a[p]]) for p in range(parts)) for v, a in zip(cut, at, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted((str(r[0]), str(r[2]), "".join(f"{x:02x}" for x in a), e) for r, a, e in zip(rows, at, error, strict=True)), digest


def some_rows(seed, n=90, dimension=8):
    rng = random.Random(seed)
    rows = [(rng.randrange(60), [round(rng.gauss(0, 0.3), 3) for _ in range(dimension)], rng.choice([0, 1, 2, None]), "x", 1.0) for _ in range(n)]
    rows += [(5, [0.0] * dimension, 1, "", None)] * 20  # many copies of one row
    rows += [(7, None, 1, "", None), (8, [], 1, "", None), (9, [0.1] * 7 + [None], 1, "", None), (10, [float("nan")] * dimension, 1, "", None), (11, [float("-inf")] * dimension, 2, "", None)]
    return [*rows, (None, [0.25] * dimension, 2, "", None)]


@pytest.mark.parametrize("seed, entries, rounds", [(1, 4, 2), (2, 8, 3), (3, 200, 1), (4, 3, 0)])
def test_codes_equal_brute_force(spark, seed, entries, rounds):
    rows = some_rows(seed)
    codes = vc.train(spark.createDataFrame(rows, ROW), parts=4, entries=entries, rounds=rounds)
    found = sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"]) for r in vc.encoded(codes).collect())
    assert (found, codes.digest()) == codes_by_hand(rows, 4, entries, rounds)


def test_running_sums_are_those_of_a_full_recount(spark):
    rows = some_rows(6)
    codes = vc.train(spark.createDataFrame(rows, ROW).repartition(3), parts=4, entries=5, rounds=3)
    more = some_rows(7, n=30)
    codes = vc.append(codes, spark.createDataFrame(more, ROW))
    totals = {(r["part"], r["entry"], r["position"]): r["total"] for r in codes.sums.collect() if r["total"]}
    want = {}
    for r in codes.table.select("vector", "code").collect():
        v = np.frombuffer(r["vector"], "<i4").reshape(4, -1)
        for p, e in enumerate(r["code"]):
            for k, x in enumerate([1, *v[p].tolist()], -1):
                want[p, e, k] = want.get((p, e, k), 0) + x
    assert totals == {k: x for k, x in want.items() if x}
    assert codes.table.count() == len(usable(rows)) + len(usable(more))


def test_only_changed_parts_are_summed(spark):
    codes = vc.train(spark.createDataFrame(some_rows(8), ROW), parts=4, entries=4, rounds=3)
    rows = codes.table.collect()
    moved = sum(x != y for r in rows for x, y in zip(r["code"], r["was"], strict=True))
    sent = vc._changes(codes.table, codes.books.shape).where("position = -1").collect()
    assert 0 < moved < 4 * len(rows) / 2
    assert sum(r["total"] for r in sent) == 0 and sum(r["total"] for r in sent if r["total"] > 0) <= moved
    assert vc._changes(codes.table.withColumn("was", F.col("code")), codes.books.shape).count() == 0


def test_codes_decode_to_their_entries(spark):
    codes = vc.train(spark.createDataFrame(some_rows(9), ROW), parts=4, entries=250, rounds=0)
    for r in vc.decoded(vc.encoded(codes), codes).where("error = 0").collect():
        assert [round(x * 256) for x in r["vector"]] == codes.books[np.arange(4), list(bytes.fromhex(r["code"]))].ravel().tolist()


def test_code_edges(spark):
    none = spark.createDataFrame([(1, None, 1, "", None)], ROW)
    assert vc.train(none) is None and vc.train(none.limit(0)) is None
    with pytest.raises(ValueError):
        vc.train(spark.createDataFrame([(1, [0.0] * 7, 1, "", None)], ROW), parts=4)
    with pytest.raises(ValueError):
        vc.integers(np.array([1e9]), 256)
    short = [(3, [0.5] * 4, 1, "", None), (1, [0.0] * 8, 1, "", None), (2, [1.0] * 8, 1, "", None)]
    assert vc.encoded(vc.train(spark.createDataFrame(short, ROW), parts=4)).count() == 2  # of the first vector's length


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives"])
def test_vector_queries_equal_sql(spark, duck, name):
    same_as_duck(registry.queries()[name](spark, DATA), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives"])
def test_vector_queries_equal_sql_with_nulls_ties_and_repeats(spark, tmp_path, name):
    import duckdb

    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 0.2), 2) for _ in range(32)], rng.randrange(3)) for i in range(240)]
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(60)] + [(50, rows[3][1], 1)] + [(200, None, 1), (201, [0.5] * 31 + [None], 2), (202, [float("nan")] * 32, 1), (203, rows[4][1], None)]
    if name == "op11_vector_codes":
        rows = [*rows, *rows[:5]]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    same_as_duck(registry.queries()[name](spark, str(tmp_path)), duck, registry.oracle_sql()[name])


def negatives_by_hand(rows, anchors, positives, negatives, low, high):
    rows = [(i, r) for i, r in enumerate(rows) if r in usable([r]) and r[2] is not None]
    ints = {i: np.floor(256 * np.array(r[1], np.float32).astype(float)).astype(np.int64) for i, r in rows}
    last = lambda x: 1 << 63 if x is None else x
    out = []
    for i, a in rows:
        if not anchors(a[0]):
            continue
        scored = sorted(((-int(ints[i] @ ints[j]), last(r[0]), r[0], r[2] == a[2]) for j, r in rows if j != i), key=lambda x: x[:2])
        for s, _, p, _ in [x for x in scored if x[3]][:positives]:
            good = [x for x in scored if not x[3] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a[0], p, k, x[2], -s, -x[0]) for k, x in enumerate(good, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("seed, block, tile", [(1, 7, 5), (2, 64, 3), (3, 4096, 4096)])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, block, tile):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "TILE_ROWS", tile)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.5) for _ in range(6)] for _ in range(4)]
    rows = [(rng.randrange(120), [round(c + rng.gauss(0, 0.2), 2) for c in rng.choice(centres)], rng.choice([0, 1, None]), "c", 0.0) for _ in range(150)]
    rows += [(3, rows[0][1], 1, "", None)] * 15 + [(None, rows[1][1], 0, "", None), (12, None, 1, "", None), (13, [float("inf")] * 6, 0, "", None), (14, [], 1, "", None)]
    found = hn.mine(spark.createDataFrame(rows, ROW), F.col("vec_id") % 6 == 0, positives=4, negatives=2, low=40, high=90)
    assert sorted(str(tuple(r)) for r in found.collect()) == negatives_by_hand(rows, lambda i: i is not None and i % 6 == 0, 4, 2, 40, 90)


def test_bounds_exclude_blocks_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 20)
    monkeypatch.setattr(hn, "TILE_ROWS", 4)
    rng = random.Random(5)
    rows = [(i, [(2.0 if k == i % 12 else 0.0) + rng.gauss(0, 0.02) for k in range(12)], i % 12, "", None) for i in range(1200)]
    index = hn.build(spark.createDataFrame(rows, ROW), F.col("vec_id") % 100 == 0)
    every = hn._anchors(index).select("tile", "a", F.lit(0).alias("w"), F.lit(hn._LOW).alias("lo"), F.lit(hn._HIGH).alias("hi"))
    found, scanned = hn.search(index, every, 3, same=True, tag="t")
    assert found.count() == 12 * 3 and scanned < index.blocks.count() * index.tiles.count() / 2


def test_negative_edges(spark):
    empty = spark.createDataFrame([], ROW)
    assert hn.mine(empty, F.lit(True)).count() == 0
    assert hn.mine(spark.createDataFrame([(1, [1.0, 0.0], 1, "", None), (2, None, 0, "", None)], ROW), F.lit(True)).count() == 0
    opposite = spark.createDataFrame([(1, [1.0], 1, "", None), (2, [-1.0], 1, "", None), (3, [0.5], 0, "", None)], ROW)
    assert hn.mine(opposite, F.col("vec_id") == 1).count() == 0  # the positive's score is negative
    with pytest.raises(ValueError):
        hn.mine(opposite, F.lit(True), low=90, high=50)
