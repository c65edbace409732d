"""Edge cases of the operators and the pipeline's stages: repeated and null identifiers, clashing columns, ties, bounds."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from test_dedup_operators import components_by_brute_force, docs_frame, near_texts
from latticework.llm import codepoints, common, decontaminate, exact_dedup, language_id, line_dedup, ngram_join, substring_dedup


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


# ---- decontamination -----------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=1, max_size=25), st.text("ab ", max_size=25), st.integers(0, 4))
def test_distance_equals_brute_force(a, b, budget):
    assert decontaminate.distance(a, b, budget) == min(brute_distance(a, b), budget + 1)


def test_short_items_stand_as_whole_words():
    rng = random.Random(8)
    items = [(k, " ".join("".join(rng.choices("abc", k=rng.randint(2, 7))) for _ in range(rng.randint(2, 4)))) for k in range(40)]
    items = [(k, t) for k, t in items if 5 <= len(t) < 25]
    matcher = decontaminate.Matcher(items, decontaminate.ERROR_RATE, 25)
    seen = set()
    for _ in range(300):
        k, item = rng.choice(items)
        text = list(item)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            text[rng.randrange(len(text))] = rng.choice(["x", "", "ab", " "])
        text = decontaminate.normalise(rng.choice(["", "xx", "ab ", "q "]) + "".join(text) + rng.choice(["", "yy", " cab", " z"]))
        found = {i: e for i, e, _, _ in matcher.find(text)}
        starts = [m.start() for m in re.finditer(r"(?<!\S)\S", text)]
        ends = [m.end() for m in re.finditer(r"\S(?!\S)", text)]
        for i, other in items:
            least = min((brute_distance(other, text[a:z]) for a in starts for z in ends if z > a), default=99)
            budget = int(decontaminate.ERROR_RATE * len(other))
            assert (i in found) == (least <= budget), (other, text)
            if i in found:
                assert found[i] == least
                seen.add(least)
    assert seen == {0, 1}
    assert not list(decontaminate.Matcher([(1, "abcdefgh ijklmno")], 0.08, 25).find("xxabcdefgh ijklmnoyy"))


def test_blocks_bound_items_and_characters(spark):
    items = spark.createDataFrame([(k, "x" * n) for k, n in enumerate([5, 5, 30, 1, 1, 1, 1])], "item_id long, text string").coalesce(1)
    assert [[len(t) for _, t in block] for block in decontaminate.item_blocks(items, 3, 12)] == [[5, 5], [30], [1, 1, 1], [1]]


# ---- similarity ----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed, n, percent", [(31, 3, 90), (32, 5, 80)])
def test_order_without_room_for_rare_counts(spark, monkeypatch, seed, n, percent):
    """A table of levels too small for all common shingles changes the order only, never the links."""
    monkeypatch.setattr(ngram_join, "CELLS_MOST", 1 << 6)
    monkeypatch.setattr(ngram_join, "RARE", 2)
    texts = near_texts(seed)
    rows = ngram_join.similar_documents(docs_frame(spark, texts), words=n, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == components_by_brute_force(texts, n, percent)


def test_levels_hold_exact_counts(spark):
    tokens = {t: k for t, k in zip(range(-500, 500), [2, 16, 17, 32, 33, 1000] * 200)}
    levels = ngram_join.Levels(spark.createDataFrame(list(tokens.items()), "token long, k long"))
    got = levels.of(np.array(list(tokens), np.int64).view(np.uint64))
    assert levels.first == 1 and got.tolist() == [{2: 1, 16: 1, 17: 2, 32: 2, 33: 3, 1000: 7}[k] for k in tokens.values()]
    assert (levels.cells > 0).sum() == len(tokens)


def test_repeated_identifiers_of_similar_documents(spark):
    """Two texts under one identifier are one document, linked where either of them is."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = ngram_join.similar_documents(docs_frame(spark, [(5, a), (5, b), (7, b + " x"), (8, a + " y"), (9, "else where")]), words=3, percent=90).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {5: 5, 7: 5, 8: 5, 9: 9} and len(rows) == 5


# ---- substrings ----------------------------------------------------------------------------------


@pytest.mark.parametrize("twice", [5, None])
def test_repeated_identifiers_keep_their_paragraphs_apart(spark, twice):
    rng = random.Random(9)
    a, b = ([f"w{rng.randint(0, 10**6)}" for _ in range(120)] for _ in range(2))
    near = lambda w: " ".join([*w[:60], "changed", *w[61:]])
    texts = [(twice, " ".join(a)), (twice, " ".join(b)), (7, near(b)), (8, near(a)), (9, " ".join(f"o{i}" for i in range(80)))]
    rows = substring_dedup.repeated_paragraphs(docs_frame(spark, texts)).collect()
    name = substring_dedup._NO_ID if twice is None else twice
    parts = {}
    for r in rows:
        parts.setdefault(r["component"], []).append(r["doc"])
    assert sorted(sorted(x) for x in parts.values()) == [[name, 7], [name, 8]]


def paragraphs_by_brute_force(texts, words=5, percent=80):
    """(doc, line) of the lines whose component spans two documents."""
    units = []
    for doc, text in texts:
        for k, line in enumerate((text or "").split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
            if len(w) >= substring_dedup.LEAST_WORDS:
                units.append((doc, k, frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))))
    label = list(range(len(units)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (_, _, s) in enumerate(units):
        for j in range(i):
            t = units[j][2]
            if 100 * len(s & t) >= percent * len(s | t):
                label[max(root(i), root(j))] = min(root(i), root(j))
    docs = {}
    for i, (doc, _, _) in enumerate(units):
        docs.setdefault(root(i), set()).add(doc)
    return {(doc, k) for i, (doc, k, _) in enumerate(units) if len(docs[root(i)]) > 1}, units


def test_paragraphs_equal_brute_force_at_a_measured_recall(spark):
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(4000)]
    bases = [rng.choices(vocabulary, k=rng.randint(60, 160)) for _ in range(12)]
    texts = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(1, 3)):
            w = list(rng.choice(bases)) if rng.random() < 0.7 else rng.choices(vocabulary, k=80)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            lines.append(" ".join(w))
        texts.append((i, "\n".join(lines)))
    texts += [(900, None), (901, ""), (902, "\n\n"), (903, " ".join(["same"] * 70)), (904, " ".join(["same"] * 70)), (905, texts[0][1])]
    want, units = paragraphs_by_brute_force(texts)
    got = {(r["doc"], r["line"]) for r in substring_dedup.repeated_paragraphs(docs_frame(spark, texts)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 100
    # Of the pairs at 0.8 or more the banding brings together what it promises.
    sets = [np.unique(np.array([hash(x) & (2**63 - 1) for x in s], np.uint64)) for _, _, s in units]
    bands = substring_dedup.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]))
    met = [bool((bands[i] == bands[j]).any()) for i in range(len(units)) for j in range(i) if 100 * len(units[i][2] & units[j][2]) >= 80 * len(units[i][2] | units[j][2])]
    assert len(met) > 200 and np.mean(met) >= 0.98


# ---- exact ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup_of_repeated_and_absent_identifiers(spark, bits):
    texts = [(5, "a"), (5, "b"), (5, "a "), (5, "b"), (None, "c"), (None, "d"), (None, "c"), (None, "d "), (7, "e"), (8, " c"), *((None, f"t{i % 9}") for i in range(60))]
    rows = exact_dedup.exact_dedup(docs_frame(spark, texts), digest_bits=bits).collect()
    norm = lambda t: re.sub(r"\s", "", t)
    groups = {}
    for i, t in texts:
        groups.setdefault(norm(t), []).append((-len(t), i is None, i or 0))
    want = sorted((str(i), len(groups[norm(t)]), str(i if len(groups[norm(t)]) == 1 else (None if min(groups[norm(t)])[1] else min(groups[norm(t)])[2]))) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["group_size"], str(r["keep_id"])) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(groups)


# ---- language ------------------------------------------------------------------------------------


def test_every_label_is_learned_and_rows_without_identifier_are_chosen_alike(spark):
    rows = [(k, f"some text {k}", f"l{k % 700:03}") for k in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len({lang for _, lang in language_id.training_rows(docs, F.lit(True), 2400)}) == 700
    none = docs.withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.when(F.col("doc_id").isNull(), "xx"))
    one, two = (language_id.training_rows(x, F.lit(True), 50) for x in (none.coalesce(1), none.repartition(7).orderBy(F.rand(3))))
    assert one == two and len(one) == 50


def test_letters_of_all_planes(spark):
    codes, bounds = codepoints.folded(["\U00030000\U000323af", "\U000e0100\U0001f600", None])
    assert [int((codes[a:z] != codepoints.SPACE).sum() - (codes[a:z] == 0).sum()) for a, z in zip(bounds[:-1], bounds[1:])] == [2, 0, 0]


# ---- stages of the pipeline ----------------------------------------------------------------------


def test_stages_with_odd_tables(spark, tmp_path):
    import corpus_pipeline as c

    steps = dict(c.STAGES)
    spark.createDataFrame([(1, "a benchmark question that is long enough to count for once"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    line = "this line stands in many documents and is long enough to go"
    rows = [(k, f"{line}\nthe text of number {k} goes on and on with word{k} and more{k}", "en" if k % 3 else None) for k in range(8)]
    leak = "so here: A benchmark question, that is long enough to count for once!"
    rows += [(None, None, None), (None, "", "en"), (None, leak, "en"), (None, "clean text of nobody at all", "en"), (3, rows[3][1], "en"), (50, leak, "en"), (60, "word " * 30_000, "en"), (61, "12 34 !!", "en")]
    docs = spark.createDataFrame([(*r, 0, "u1", 0.5, True, 7, 8, "x") for r in rows], "doc_id long, text string, lang string, n_chars int, Lang_Pred string, score double, rejected boolean, n_lines int, n_dropped int, drop_id string")
    told = steps["language ID"](spark, docs, str(tmp_path))
    assert told.columns == docs.columns and {(r["Lang_Pred"], r["score"], r["rejected"]) for r in told.collect()} == {("u1", 0.5, True)}
    assert told.where("text IS NULL OR text = '' OR doc_id = 61").count() == 0 and told.count() >= len(rows) - 5
    lines = steps["line dedup"](spark, docs, str(tmp_path))
    got = lines.collect()
    assert lines.columns == docs.columns and len(got) == len(rows) and {(r["n_lines"], r["n_dropped"], r["drop_id"]) for r in got} == {(7, 8, "x")}
    assert [r["doc_id"] for r in got if line in r["text"]] == [7] and all(r["n_chars"] == len(r["text"]) for r in got)
    apart = line_dedup.LineIndex(spark)
    apart.insert(docs)
    assert sorted(r["text"] for r in apart.dedup(docs, broadcast_keys=-1).collect()) == sorted(r["text"] for r in got)
    unique = steps["n-gram Jaccard join"](spark, docs, str(tmp_path))
    assert unique.columns == docs.columns and {r["doc_id"] for r in unique.collect()} == {*range(8), None, 60, 61}
    clean = steps["benchmark decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == len(rows) - 2 and clean.where("doc_id IS NULL").count() == 3
    packed = steps["packing"](spark, docs, str(tmp_path))
    assert packed.groupBy("doc_id", "sequence_id", "offset").count().where("count > 1").count() == 0 and packed.where("doc_id = 60").count() > 10
    for name, step in c.STAGES:
        empty = step(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)


def test_columns_set_aside_come_back(spark):
    docs = spark.createDataFrame([(1, 2, 3)], "a int, Score int, score_0 int")
    named, back = common.set_aside(docs, ("score",))
    assert "score" not in [c.lower() for c in named.columns]
    assert back(named.withColumn("score", F.lit(9))).collect() == docs.collect()
