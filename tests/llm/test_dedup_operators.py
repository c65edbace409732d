"""Dedup operators and the pipeline against brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA, same_as_duck
from latticework.llm import exact_dedup, line_dedup, links, ngram_join, registry, substring_dedup, wordhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WS = " \t\n\x0b\x0c\r"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles_of(text, n):
    w = words_of(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def docs_frame(spark, texts):
    return spark.createDataFrame([(i, t, None if t is None else "en", None, None) for i, t in texts], DOC)


def near_texts(seed, n=60, groups=6):
    """Texts of which many are edited copies of a few, with nulls, blanks, long ones and repeats among them."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    bases = [rng.choices(vocabulary, k=rng.randint(20, 90)) for _ in range(groups)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases)) if i % 3 else rng.choices(vocabulary, k=rng.randint(1, 60))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((i, (" " if i % 2 else "\n\t ").join(w)))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "One "), (n + 5, "a b"), (n + 6, " ".join(bases[0] * 200)), (n + 7, out[1][1])]


# ---- hashing kernel ------------------------------------------------------------------------------


def test_sets_equal_brute_force(monkeypatch):
    monkeypatch.setattr(wordhash, "BLOCK", 50)  # texts are cut in many places
    texts = [t for _, t in near_texts(1)] + ["É é\x0bA\x0ca", "x" * 400 + " y " * 90, "\x00 \x00"]
    got = [len(s) for s in wordhash.sets(pa.array(texts, pa.string()), 3)]
    assert got == [len(shingles_of(t, 3)) for t in texts]
    one, two = wordhash.sets(pa.array(["a b c d", "x A  b\nc d"]), 3)
    assert len(np.intersect1d(one, two)) == 2
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["i", "t"])
    assert [x for part in wordhash.slices(batch, 1, 100) for x in part.column(0).to_pylist()] == list(range(len(texts)))


def test_histograms_bound_the_intersection():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 4000, rng.integers(1, 900)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        a, b = (np.frombuffer(wordhash.histogram(s), np.uint8) for s in (x, y))
        assert len(np.intersect1d(x, y)) <= np.minimum(a, b).sum(dtype=int)


# ---- lines ---------------------------------------------------------------------------------------


def lines_by_brute_force(texts, least=40, times=5):
    holders = {}
    keys = {}
    for i, t in texts:
        keys[i] = [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(WS)) for x in (t or "").split("\n")]
        for k in set(keys[i]):
            holders.setdefault(k, set()).add(i)
    out = {}
    for i, t in texts:
        kept = [x for x, k in zip((t or "").split("\n"), keys[i], strict=True) if len(k) < least or len(holders[k]) < times or max(holders[k]) == i]
        out[i] = (len(keys[i]), len(keys[i]) - len(kept), "\n".join(kept))
    return out


def line_texts(seed):
    rng = random.Random(seed)
    pool = [("é" * 39, "é" * 40, "A" * 40, " a" * 25, "x" * 160)[k % 5] + str(k // 5) * (k > 4) for k in range(20)]
    out = [(i, "\n".join(rng.choice([str.upper, str.lower, lambda s: f" \t{s}\r"])(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    return [*out, (40, None), (41, ""), (42, "\n\n"), (43, pool[2] + "\n" + pool[2])]


@pytest.mark.parametrize("limit", [10**6, -1])
def test_line_dedup_equals_brute_force(spark, limit):
    texts = line_texts(2)
    index = line_dedup.LineIndex(spark, keys_per_shard=3)
    docs = docs_frame(spark, texts)
    index.insert(docs)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in index.dedup(docs.withColumn("n_lines", F.lit("clash")), broadcast_keys=limit).collect()}
    assert got == lines_by_brute_force(texts)


def test_line_index_is_reversible(spark):
    texts = line_texts(3)
    part = lambda keep: docs_frame(spark, [t for t in texts if keep(t[0])])
    index = line_dedup.LineIndex(spark, keys_per_shard=2)
    index.insert(part(lambda i: i % 2))
    index.insert(part(lambda i: i % 2 == 0))
    index.insert(part(lambda i: i % 4 == 0))  # again: nothing is counted twice
    whole = index.dedup(docs_frame(spark, texts)).select("doc_id", "text").collect()
    assert {r["doc_id"]: r["text"] for r in whole} == {i: v[2] for i, v in lines_by_brute_force(texts).items()}
    index.delete(part(lambda i: i % 2 == 0).select("doc_id"))
    odd = [t for t in texts if t[0] % 2]
    assert {r["doc_id"]: r["text"] for r in index.dedup(docs_frame(spark, odd)).collect()} == {i: v[2] for i, v in lines_by_brute_force(odd).items()}
    assert index.dedup(docs_frame(spark, odd).limit(0)).count() == 0


def test_rebuilt_filters_hold_all_keys(spark, tmp_path):
    keys = [((3 << 50) + k, 32 * k) for k in range(20)]  # one fingerprint and, at the first size, one bucket
    index = line_dedup.LineIndex(spark, str(tmp_path))
    index._rebuild(spark.createDataFrame(keys, "hi long, lo long"), f"{tmp_path}/1")
    row, (hi, lo) = index.filters.first(), np.array(keys, np.int64).T.copy()
    assert row["whole"] and line_dedup.CuckooFilter.from_bytes(row["filter"]).contains(hi, lo).all()


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    hi, lo = rng.integers(-(2**63), 2**63, (2, 3000))
    f = line_dedup.CuckooFilter.for_items(2000)
    assert f.insert(hi[:2000], lo[:2000]) and f.contains(hi[:2000], lo[:2000]).all()
    assert f.contains(hi[2000:], lo[2000:]).mean() < 0.01
    f.delete(hi[:1000], lo[:1000])
    assert f.contains(hi[1000:2000], lo[1000:2000]).all() and f.contains(hi[:1000], lo[:1000]).mean() < 0.01
    small = line_dedup.CuckooFilter(np.zeros((16, 4), np.uint16))
    assert not small.insert(hi, lo)


def test_null_identifiers_and_empty_tables(spark):
    line = "z" * 50
    docs = docs_frame(spark, [(None, line), (None, line), *((i, line) for i in range(4))])
    got = sorted(((r["doc_id"], r["n_dropped"]) for r in line_dedup.line_dedup(docs).collect()), key=str)
    assert got == [(0, 1), (1, 1), (2, 1), (3, 0), (None, 1), (None, 1)]
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


# ---- exact ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 6])
def test_exact_dedup_equals_brute_force(spark, bits):
    rng = random.Random(4)
    base = ["", "a", "ab c", "x" * 5000, "é\nü", "A", "ab  d"]
    texts = [(i, rng.choice([" ", "\n", ""]).join(rng.choice(base))) for i in range(120)] + [(200, None), (201, " \t\n"), (5, "unique"), (None, "ab c"), (None, "only here")]
    rows = exact_dedup.exact_dedup(docs_frame(spark, texts).withColumn("digest", F.lit("clash")), digest_bits=bits, memtable_rows=7).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in texts:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    want = sorted(((i, min(groups[norm(t)], key=lambda x: (x[0], x[1], x[2] or 0))[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in texts), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str) == want
    assert sum(r["kept"] for r in rows) == len(groups)


def test_exact_dedup_repeated_rows_and_nothing(spark):
    rows = exact_dedup.exact_dedup(docs_frame(spark, [(1, "a"), (1, "a"), (1, " a")])).collect()
    assert sorted((r["kept"], r["keep_id"], r["group_size"]) for r in rows) == [(False, 1, 3), (False, 1, 3), (True, 1, 3)]
    assert exact_dedup.exact_dedup(docs_frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_hot_digests_are_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    texts = [(i, "many of these") for i in range(40)] + [(100 + i, " manyofthese") for i in range(5)] + [(200, "one"), (201, "two"), (202, "two")]
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs_frame(spark, texts)).collect()}
    assert {found[i][:2] for i in (*range(40), *range(100, 105))} == {(0, 45)} and found[0][2] and not found[5][2]
    assert found[200] == (200, 1, True) and found[202] == (201, 2, False)
    clash = exact_dedup.exact_dedup(docs_frame(spark, texts), digest_bits=1).collect()  # all under two digests, told apart by their bytes
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in clash} == found


def test_bloom_has_no_false_negative():
    rng = np.random.default_rng(5)
    d = rng.integers(-(2**63), 2**63, 4000)
    f = exact_dedup.bloom(d[:2000])
    assert exact_dedup.bloom_has(f, d[:2000]).all() and exact_dedup.bloom_has(f, d[2000:]).mean() < 0.05


# ---- similarity ----------------------------------------------------------------------------------


def components_by_brute_force(texts, n, percent):
    sets = [(i, shingles_of(t, n)) for i, t in texts]
    label = {i: i for i, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[k + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("seed, n, percent", [(11, 3, 90), (12, 3, 90), (13, 5, 80), (14, 1, 60), (15, 2, 100)])
def test_ngram_join_equals_brute_force(spark, seed, n, percent):
    texts = near_texts(seed)
    docs = docs_frame(spark, texts).withColumn("n", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(docs, words=n, percent=percent).collect()}
    assert got == components_by_brute_force(texts, n, percent)


def test_ngram_join_repeated_rows_nulls_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = docs_frame(spark, [(4, text), (4, text), (7, text + " x"), (None, None), (9, text.upper())])
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.similar_documents(docs, words=3, percent=90).collect()), key=str)
    assert got == [(4, 4), (4, 4), (7, 4), (9, 4), (None, None)]
    assert ngram_join.similar_documents(docs.limit(0)).count() == 0


def test_link_search_takes_up_what_pivots_miss(spark):
    """A chain whose ends share a token with one pivot only: the closing round links the rest."""
    sets = {1: set(range(0, 20)), 2: set(range(1, 21)), 3: set(range(2, 22)), 4: set(range(40, 60)), 5: set(range(41, 61))}
    raw = lambda s: np.array(sorted(s), np.uint64).tobytes()
    postings = spark.createDataFrame([(7, i, 20, None, i) for i in sets], "token long, grp long, n long, pos long, central long")
    members = spark.createDataFrame([(i, i) for i in sets], "grp long, id long")
    table = spark.createDataFrame([(i, bytearray(raw(s))) for i, s in sets.items()], "id long, members binary")
    hints = spark.createDataFrame([(i, bytearray(b"")) for i in sets], "id long, cells binary")
    search = links.LinkSearch(postings, members, lambda ids: table.join(ids, "id", "left_semi"), hints, 90)
    assert {r["id"]: r["component"] for r in search.run().collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in links.components(edges).collect()}
    assert {i: got.get(i, i) for i in range(1, 41)} == dict.fromkeys(range(1, 41), 1) and got[101] == 100


# ---- substrings ----------------------------------------------------------------------------------


def test_passages_equal_brute_force(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 6))) for _ in range(2000)]
    passages = [rng.choices(vocabulary, k=k) for k in (30, 45, 49, 50, 51, 60, 120)]
    texts = []
    for i in range(80):
        w = rng.choices(vocabulary, k=rng.randint(0, 150))
        if i % 2:
            at = rng.randint(0, len(w))
            w[at:at] = passages[i % len(passages)]
        texts.append((i, "".join(x + rng.choice([" ", "\n", "  "]) for x in w)))
    texts += [(200, None), (201, ""), (202, " ".join(passages[5] * 2)), (203, " ".join(rng.choices(vocabulary, k=60) * 2))]
    where = {}
    for i, t in texts:
        w = words_of(t)
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {i for s in where.values() if len(s) > 1 for i in s}
    docs = docs_frame(spark, texts).withColumn("digest", F.lit("clash"))
    found = substring_dedup.repeated_passages(docs).collect()
    assert {r["doc"] for r in found} == want and all(r["n_words"] >= 50 for r in found)
    for i in want:
        assert min(r["keeper"] for r in found if r["doc"] == i) <= i
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def passages_by_hand(texts):
    """(doc, at, n_words, keeper) of the maximal stretches of shared 50 words, by looking at all of them."""
    where, want = {}, set()
    grams = [(-(2**63) if i is None else i, [tuple(w[k : k + 50]) for k in range(len(w) - 49)]) for i, w in ((i, words_of(t)) for i, t in texts)]
    for i, g in grams:
        for x in g:
            where.setdefault(x, set()).add(i)
    for i, g in grams:
        keepers = [min(where[x]) if len(where[x]) > 1 else None for x in g]
        for k, keeper in enumerate(keepers):
            if keeper is not None and (not k or keepers[k - 1] != keeper):
                n = next((j for j in range(k, len(g)) if keepers[j] != keeper), len(g)) - k
                want.add((i, k, n + 49, keeper))
    return want


def test_windows_of_many_places_are_dealt_over_salts(spark, monkeypatch):
    rng = random.Random(12)
    shared = " ".join(f"s{k}" for k in range(80))
    texts = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + (f" {shared} " if i % 2 else " ") + " ".join(f"v{rng.randrange(10**6)}" for _ in range(30))) for i in range(24)]
    of = lambda: sorted(tuple(r) for r in substring_dedup.repeated_passages(docs_frame(spark, texts)).collect())
    plain = of()
    monkeypatch.setattr(substring_dedup, "HOT_PLACES", 2)
    assert of() == plain and {r[0] for r in plain} == set(range(1, 24, 2))


def test_passages_span_what_is_shared(spark):
    rng = random.Random(23)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for k in (50, 51, 58, 64, 65, 66, 80, 130, 400):  # runs of windows shorter and longer than 50 words, at all places
        for before in (0, 7, 100):
            shared = fresh(k)
            texts += [(len(texts) + j, " ".join([*fresh(before * j), *shared, *fresh(9 * j)])) for j in range(2)]
    base = fresh(600)
    for j in range(12):  # near copies, parts, and a passage that stands twice
        copy = [*base]
        for at in rng.sample(range(600), 4):
            copy[at] = fresh(1)[0]
        texts.append((len(texts), " ".join(copy[rng.randrange(60) : rng.randrange(300, 600)])))
    texts += [(None, " ".join([*fresh(30), *base[100:190], *fresh(5), *base[100:170]])), (None, " ".join(base[120:200])), (5, " ".join([*fresh(3), *base[:70]]))]
    found = substring_dedup.repeated_passages(docs_frame(spark, texts)).collect()
    assert sorted((r["doc"], r["at"], r["n_words"], r["keeper"]) for r in found) == sorted(passages_by_hand(texts))


def test_snippets_side_by_side_are_no_passage(spark):
    rng = random.Random(24)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        one, two = fresh(45), fresh(49)
        texts += [(len(texts), " ".join([*one, *fresh(60), *two])), (len(texts) + 1, " ".join([*fresh(20), *one, *two, *fresh(20)]))]
    assert substring_dedup.repeated_passages(docs_frame(spark, texts)).count() == 0 and not passages_by_hand(texts)


def test_near_paragraphs_make_components(spark):
    rng = random.Random(22)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    near, far = [*base], [*base]
    near[100] = "changed"
    for k in range(0, 200, 12):
        far[k] = f"other{k}"
    texts = [(1, "short line\n" + " ".join(base)), (2, " ".join(near) + "\nshort line"), (3, " ".join(far)), (4, " ".join(base).upper()), (None, " ".join(base))]
    rows = substring_dedup.repeated_paragraphs(docs_frame(spark, texts)).collect()
    assert {(r["doc"], r["line"]) for r in rows} == {(1, 1), (2, 0), (4, 0), (substring_dedup._NO_ID, 0)} and len({r["component"] for r in rows}) == 1
    out = {r["doc_id"]: r["removed"] for r in substring_dedup.substring_dedup(docs_frame(spark, texts)).where("kind = 'paragraph'").collect()}
    assert out == {1: True, 2: True, 4: True, None: False}


# ---- queries and pipeline ------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = registry.queries()[name](spark, DATA)
    same_as_duck(frame, duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_gives_a_row_a_document(spark, name):
    rows = registry.queries()[name](spark, DATA)
    if name.split("_")[0] in ("op2", "op5", "op10"):
        assert rows.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    elif name.startswith("op9"):
        assert rows.count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
    else:
        assert rows.count() > 0


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline as c
    from latticework.llm import decontaminate, packing
    from latticework.llm.common import staged

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = dict(c.STAGES)
    told = staged(steps["language ID"](spark, docs, DATA), "t").collect()
    assert len(told) >= 0.98 * docs.count() and set(told[0].asDict()) == set(docs.columns)
    frame = spark.createDataFrame(told, docs.schema)
    lines = staged(steps["line dedup"](spark, frame, DATA), "t").collect()
    want = lines_by_brute_force([(r["doc_id"], r["text"]) for r in told])
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines} == {i: (v[2], len(v[2])) for i, v in want.items()}
    unique = staged(steps["n-gram Jaccard join"](spark, spark.createDataFrame(lines, docs.schema), DATA), "t").collect()
    parts = components_by_brute_force([(r["doc_id"], r["text"]) for r in lines], 5, 80)
    assert {r["doc_id"] for r in unique} == {i for i, (_, low) in parts.items() if i == low}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(items, decontaminate.ERROR_RATE, 25)
    clean = staged(steps["benchmark decontamination"](spark, spark.createDataFrame(unique, docs.schema), DATA), "t")
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(kept) == {r["doc_id"] for r in unique if not list(matcher.find(r["text"]))}
    rows = steps["packing"](spark, clean, DATA).collect()
    enc = packing.Encoder(packing.public_file("byte_bpe_50k.json"))
    for i, text in kept.items():
        ids = np.append(enc.ids(text), 0).astype("<u4")
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert [m[2] for m in mine] == [zlib.crc32(ids[s : s + n].tobytes()) for s, n, _ in mine] and sum(n for _, n, _ in mine) == len(ids)
    assert c.run(spark, DATA).count() == len(rows)
