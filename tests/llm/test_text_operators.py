"""Per-text operators: extraction, archives, language, toxicity, decontamination, packing."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticework.llm import codepoints, common, decontaminate, html_text, language_id, packing, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# ---- HTML ----------------------------------------------------------------------------------------


def page(body: str) -> str:
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>{body}<footer>&copy; us</footer></body></html>'


@pytest.mark.parametrize("body, text", [
    ("<article><h1>Head &amp; line</h1><p>One<br>two   three</p><p>The.</p></article>", "Head & line\n\nOne two three\n\nThe."),
    ('<div class="ad">Buy now</div><article><p>Text<aside>Beside</aside><p>More</p><form><label>Mail</label></form></article>', "Text\n\nMore"),
    ('<article><p>Text</p><section id="comments"><p>I think so</p></section></article><div class="cookie-notice">We use cookies</div>', "Text"),
    ("<main><p>A <a href=x>link</a> in text</p></main>", "A link in text"),
    ("<article><p>cut &lt off</p><p>unclosed <b>bold", "cut < off\n\nunclosed bold"),
    ('<article><p title="a > b">kept</p><!-- <p>gone</p> --><p hidden>gone</p></article>', "kept"),
    ("", ""),
])
def test_main_text(body, text):
    assert html_text.main_text(page(body)) == text


def test_page_without_article_uses_words_and_links():
    body = "<div><p>" + "word " * 40 + "</p><p>Short.</p><p>" + "more text " * 30 + "</p></div><ul>" + "<li><a href=x>one link</a></li>" * 5 + "</ul>"
    assert html_text.main_text(page(body)) == "\n\n".join([" ".join(["word"] * 40), "Short.", " ".join(["more text"] * 30)])


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("<>/abp &;\"'=!-\n"), max_size=200))
def test_any_markup_is_read(text):
    assert isinstance(html_text.main_text(text), str)


def test_tree_learns_its_table():
    x, y = html_text.labelled_table()
    assert [html_text.keeps(html_text.tree(), tuple(r)) for r in x] == [bool(v) for v in y]


def test_pages_with_nulls_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (None, "u", page("<article><p>é</p></article>"), "y")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_text.extract(rows).collect()}
    assert got == {1: (None, "", 0), None: ("u", "é", 1)}
    assert html_text.extract(rows.limit(0)).count() == 0


# ---- archives ------------------------------------------------------------------------------------


def round_trip(spark, rows, least=0):
    area = common.new_area(spark, "test-warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")
    warc.write_arc(pages, f"{area}/arc")
    warc.convert(spark, f"{area}/arc", f"{area}/warc", least_bytes=least)
    return warc.read_warc(spark, f"{area}/warc").collect()


def test_round_trip_with_copies_and_nulls(spark):
    rows = [(1, "http://a/ b", "x", ""), (2, None, "x", ""), (3, "http://a", None, ""), (4, "é\n", "é\r\n\r\nWARC/1.1\r\n", ""), (5, "http://a", "", ""), (None, "u", "x", ""), (6, "http://big", "y" * 300_000, ""), (2, "again", "x", "")]
    back = round_trip(spark, rows)
    assert len(back) == len(rows)
    by_record = {r["record_id"]: r for r in back}
    kept = [(r["page_id"], r["warc_type"]) for r in back if r["payload_digest"] == warc.base32_sha1(b"x")]
    assert sorted(kept, key=str) == sorted([(1, "revisit"), (2, "response"), (2, "revisit"), (None, "revisit")], key=str)
    for r in back:
        if r["refers_record"]:
            assert by_record[r["refers_record"]]["payload_digest"] == r["payload_digest"] and by_record[r["refers_record"]]["warc_type"] == "response"
        else:
            html = next(h or "" for p, _, h, _ in rows if p == r["page_id"])
            assert bytes(r["payload"]) == html.encode() and r["payload_bytes"] == len(html.encode())
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    empty = {r["page_id"]: r["warc_type"] for r in back if r["payload_bytes"] == 0}
    assert empty == {3: "revisit", 5: "response"}


def test_short_payloads_may_all_be_responses(spark):
    assert {r["warc_type"] for r in round_trip(spark, [(1, "u", "x", ""), (2, "u", "x", "")], least=2)} == {"response"}


def test_no_pages(spark):
    assert round_trip(spark, []) == []


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_versions(version):
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npay\nload"
    raw = warc.arc_start(version, "n.arc", "19970101000000").encode() + warc.arc_header(version, "http://x/a b", "1.2.3.4", "19970102030405", "text/html", len(body)).encode() + body + b"\n"
    first, second = warc.parse_arc(raw)
    assert first["filedesc"] and second["version"] == version and second["content"] == body and second["URL"] == "http://x/a b" and second["IP-address"] == "1.2.3.4"
    record = warc.synthesise(second, "file")
    assert record[3] == "1997-01-02T03:04:05Z" and record[4] == "response" and record[7] == b"pay\nload"
    for damaged in (raw[:-4], raw[10:], raw.replace(b"Archive-length", b"Archive-length x y z q r s t u v w"), b"filedesc://x 0 0 t 3\nabc"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(damaged))


# ---- language and toxicity -----------------------------------------------------------------------


def test_language_label_bound_is_a_parameter(spark):
    rows = [(k, f"some text {k}", f"l{k % 600:03}") for k in range(602)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    for bound in (2, 520):
        labels = {lang for _, lang in language_id.training_rows(docs, F.lit(True), 2400, max_labels=bound)}
        assert labels == {f"l{k:03}" for k in range(bound)}


def test_language_learns_and_rejects(spark):
    rng = random.Random(3)
    words = {"xx": "bala bolo bidu balu".split(), "yy": "čerk šipt žmrk čvsk".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(3, 40))), lang, "s", 0) for i in range(300) for lang in words]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)] + [(900, None, "xx", None, None), (901, "123 !!", "yy", None, None), (902, "", None, None, None), (None, "bala bolo", None, None, None)]
    docs = spark.createDataFrame(rows, DOC)
    model = language_id.fit(docs, common.bucket_of(F.col("doc_id"), 5) != 0)
    got = {r["doc_id"]: r for r in language_id.predict(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert np.mean([got[k]["lang_pred"] == r[2] for k, r in enumerate(rows[:600])]) > 0.98
    assert [(got[k]["lang_pred"], got[k]["score"], got[k]["rejected"]) for k in (900, 901, 902)] == [("und", 0.0, True)] * 3
    assert got[None]["lang_pred"] == "xx" and 0 <= got[None]["score"] <= 1
    nothing = language_id.fit(docs.limit(0), F.lit(True))
    assert language_id.predict(docs.limit(3), nothing).where("lang_pred <> 'und'").count() == 0


def brute_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_equals_brute_force():
    rng = random.Random(4)
    terms = sorted({"".join(rng.choices("abc", k=rng.randint(3, 8))) for _ in range(25)})
    trie = toxicity.Trie(terms)
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(400)] + terms
    codes = np.array([ord(c) for w in words for c in w], np.uint32)
    lengths = np.array([len(w) for w in words])
    errors, term = trie.match(codes, np.cumsum(lengths) - lengths, lengths)
    for w, e, t in zip(words, errors, term, strict=True):
        near = {k: brute_distance(w, x) for k, x in enumerate(terms)}
        fits = {k: d for k, d in near.items() if d == 0 or d == 1 and len(terms[k]) >= toxicity.FUZZY_LETTERS}
        assert (e, t >= 0) == ((min(fits.values()), True) if fits else (-1, False))
        assert not fits or fits[t] == e


def test_toxicity_finds_misspellings_and_spares_quotations(spark):
    rng = random.Random(5)
    plain = "the of and house river morning letter window garden people".split()
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=30)
        toxic = int(i % 5 == 0)
        if toxic:
            words[rng.randint(0, 29)] = rng.choice(["grobian", "schuft"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, toxic))
    rows += [(1000, "such a grobiam here", "en", "", 0), (1001, None, None, None, None), (1002, "", None, None, None), (1003, "a nice garden", None, None, None)]
    docs, marks = spark.createDataFrame(rows, DOC), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, common.bucket_of(F.col("doc_id"), 4) != 2)
    assert {"grobian", "schuft"} <= set(model.terms)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == t for i, t in labels)
    assert got[1001]["score"] == got[1002]["score"] < 0.3 and got[1003]["predicted"] == 0
    scorer = model.scorer()
    free, quoted, misspelt = scorer.features(["you grobian you", 'they wrote "grobian" once', "such a grobiam"])
    assert free[2] > 0 and free[6] > 0 and quoted[2] == 0 and quoted[4] > 0 and misspelt[3] > 0
    nothing = toxicity.fit(docs, marks.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs.limit(5), nothing).collect()} == {0.0}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aBé İ\x00'.1\n漢"), max_size=12)), min_size=1, max_size=4))
def test_folded_letters_know_their_places(texts):
    codes, bounds, source = codepoints.folded_at(texts)
    for i, text in enumerate(texts):
        for k in range(bounds[i], bounds[i + 1]):
            if codes[k] not in (0, codepoints.SPACE):
                assert codes[k] == codepoints.fold_table()[ord(text[source[k]])]
    assert (codes != codepoints.SPACE).sum() - (codes == 0).sum() == sum(c.isalpha() for t in texts for c in t or "")


@pytest.mark.parametrize("text, quoted", [
    ('The class is long and then, with no link to it, at the very end of it all, they wrote "ass" on a wall', True),
    ("The İİİİ class is long and has a grass roof; nothing about it is out of order at all, dear friends, but ass", False),
    ("er sagte ass zu ihm", True), ("il a écrit ass ici", True), ("ella dijo ass", True), ("we have a term for it: ass", True), ("« ass »", True), ("an ass", False),
])
def test_windows_stand_around_the_word_itself(text, quoted):
    scorer = toxicity.ToxicityModel(["ass"], np.array([2.0]), None, 0.1).scorer()
    x = scorer.features(["nothing", text])[1]
    assert (x[4] > 0, x[0] > 0) == (quoted, not quoted)


def test_toxicity_of_repeated_rows_and_long_texts(spark):
    rng = random.Random(7)
    rows = [(i, ("grobian " if i % 4 == 0 else "") + " ".join(rng.choices("the of house river morning letter".split(), k=20)), "en", "s", 0) for i in range(200)]
    rows += [(4, "grobian and more of it", "en", "s", 0)] * 300 + [(900, "river house " * 200_000 + "grobian", "en", "s", 0)] * 2
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, DOC)
    model = toxicity.fit(docs, labels, F.lit(True), fit_rows=50)
    again = toxicity.fit(docs.repartition(5), labels.repartition(3), F.lit(True), fit_rows=50)
    assert model.terms == again.terms and model.coefficients.tolist() == again.coefficients.tolist()
    found = toxicity.score(docs, model).where("doc_id IN (4, 900)").collect()
    assert len({r["score"] for r in found if r["text"] == "grobian and more of it"}) == 1 and all(r["predicted"] for r in found)


def test_toxicity_on_rows_held_out(spark):
    """Bounds of a stated size: ranking 0.95, precision 0.9, recall 0.85 on the labelled rows that had no say in the model."""
    data = "/root/testdata/sf0.1"
    found = toxicity.op10_toxicity(spark, data).where("held_out").join(spark.read.parquet(f"{data}/labels.parquet").where("toxic IS NOT NULL"), "doc_id").select("score", "toxic", "predicted").collect()
    bad, good = (np.array([r["score"] for r in found if r["toxic"] == y]) for y in (1, 0))
    assert len(bad) > 100 and np.mean((bad[:, None] > good) + 0.5 * (bad[:, None] == good)) > 0.95
    assert np.mean([r["toxic"] for r in found if r["predicted"]]) > 0.9 and sum(r["predicted"] for r in found if r["toxic"]) > 0.85 * len(bad)


# ---- decontamination and packing -----------------------------------------------------------------


def best_distance(pattern: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        out = [i]
        for j, y in enumerate(text, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        row = out
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("ab ", min_size=1, max_size=40), st.text("ab ", max_size=60), st.integers(0, 12))
def test_myers_equals_brute_force(pattern, text, budget):
    found, least = decontaminate.myers(pattern, text, budget), best_distance(pattern, text)
    assert found is None or found[0] == least
    assert (found is not None) == (least <= budget and text != "")


def test_contamination_equals_brute_force(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(8, 30))).capitalize() + ".") for k in range(12)] + [(90, None), (91, "!?"), (92, "short one")]
    docs = []
    for i in range(60):
        text = rng.choices(words, k=40)
        if i % 2:
            item = list(items[i % 12][1])
            for _ in range(rng.randint(0, int(0.12 * len(item)))):
                item[rng.randrange(len(item))] = rng.choice("xyz ")
            text.insert(rng.randint(0, 40), "".join(item))
        docs.append((i, " ".join(text), "en", "s", 0))
    docs += [(200, None, None, None, None), (201, "", None, None, None), (None, "A short one, here", None, None, None), (203, "shortly one", None, None, None)]
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contamination(d, b, block_items=5).collect()}
    want = {}
    for i, text, *_ in docs:
        for k, item in items:
            n, t = decontaminate.normalise(item), decontaminate.normalise(text)
            if len(n) >= 25 and t and (e := best_distance(n, t)) <= int(decontaminate.ERROR_RATE * len(n)):
                want[i, k] = e
    want[None, 92] = 0
    assert got == want
    assert decontaminate.decontaminate(d, b).count() == len(docs) - len({i for i, _ in want})
    assert decontaminate.contamination(d, b.limit(0)).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    enc = packing.Encoder(packing.public_file("byte_bpe_50k.json"), packing.public_file("byte_bpe_50k.tiktoken"))
    rng = random.Random(7)
    texts = ["", " ", "a  b\n\n c\t", "it's 12345 ünïcödé 漢字 🎉", "x<|endoftext|>y", "A" * 3000, "\r\n \x00"] + ["".join(chr(rng.choice([32, 65, 97, 233, 0x4E00, 0x1F600, 10])) for _ in range(60)) for _ in range(50)]
    for t in texts:
        assert enc.ids(t).tolist() == enc.slow.encode(t, add_special_tokens=False).ids


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40))
def test_plan_places_every_piece_once(counts):
    histogram = np.zeros(65, np.int64)
    for n, k in counts.items():
        histogram[n] = k
    plan = packing.make_plan(histogram)
    used: dict[int, list[tuple[int, int]]] = {}
    for n, k in counts.items():
        firsts = [x[0] for x in plan.intervals[n]]
        for r in range(k):
            first, base, at, times = plan.intervals[n][int(np.searchsorted(firsts, r, "right")) - 1]
            used.setdefault(base + (r - first) // times, []).append((at + (r - first) % times * n, n))
    assert sorted(used) == list(range(plan.sequences))
    for parts in used.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 64


def test_pack(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma x"], k=rng.randint(0, 900))), "en", "s", 0) for i in range(150)]
    docs += [(500, None, None, None, None), (501, "", None, None, None), (None, "x", None, None, None), (1, docs[1][1], "en", "s", 0)]
    d = spark.createDataFrame(docs, DOC).withColumn("length", F.lit("clash"))
    rows = packing.pack(d, size=256).collect()
    enc = packing.Encoder(packing.public_file("byte_bpe_50k.json"))
    ids = [(i, np.append(enc.ids(t or ""), 0).astype("<u4")) for i, t, *_ in docs]
    want = sorted(((i, s, len(x[s : s + 256]), zlib.crc32(x[s : s + 256].tobytes()), len(x)) for i, x in ids for s in range(0, len(x), 256)), key=str)
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows), key=str) == want
    for parts in {s: sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s) for s in {r["sequence_id"] for r in rows}}.values():
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1]) and sum(n for _, n in parts) <= 256
    total, n = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert total / (n * 256) > 0.97
    assert packing.pack(d.limit(0)).count() == 0
