"""Memory of tasks, and what must not depend on how rows meet in a batch."""

from __future__ import annotations

import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import codepoints, decontaminate, language_id

ALPHABET = "abcdeéßжλ中 .,'1\x00\U00030000\U0001f600"


def model_of(labels: int, seed: int = 5) -> language_id.LanguageModel:
    rng = np.random.default_rng(seed)
    embed = rng.normal(size=(language_id.BUCKETS, 16)).astype(np.float32)
    return language_id.LanguageModel([f"l{k:04}" for k in range(labels)], embed, rng.normal(size=(16, labels)).astype(np.float32), rng.normal(size=labels), 0.7, 0.1)


def plain_score(model: language_id.LanguageModel, text: str | None) -> tuple[str, float]:
    """One n-gram after another, one label after another."""
    folded: list[int] = [32]
    for c in [*(text or ""), " "]:
        code = 32 if not c.isalpha() else ord(c.lower()) if len(c.lower()) == 1 else ord(c)
        if code != 32 or folded[-1] != 32:
            folded.append(code)
    if all(c == 32 for c in folded):
        return "und", 0.0
    total, n = [0.0] * 16, 0
    for order in language_id.ORDERS:
        for at in range(len(folded) - order + 1):
            h = 0
            for c in folded[at : at + order]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            h ^= h >> 16
            row = model.embed[(h + order * 7919) % language_id.BUCKETS]
            total = [a + float(b) for a, b in zip(total, row, strict=True)]
            n += 1
    z = [(sum(total[d] / n * float(model.layer[d][k]) for d in range(16)) + float(model.bias[k])) / model.temperature for k in range(len(model.labels))]
    top = max(z)
    return model.labels[z.index(top)], 1 / sum(math.exp(x - top) for x in z)


def test_language_scores_by_plain_loops(spark):
    rng = random.Random(9)
    texts = [None, "", "1 2 3", "a", "aé.", "\x00b\x00"] + ["".join(rng.choices(ALPHABET, k=rng.choice((2, 30, 5000)))) for _ in range(20)]
    model = model_of(23)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want, seen = [plain_score(model, t) for t in texts], []
    for rows in (docs.coalesce(1), docs.repartition(5)):  # beside other texts or not, the very same scores
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(rows, model).collect()}
        assert [got[k][0] for k in range(len(texts))] == [lang for lang, _ in want]
        assert [got[k][1] for k in range(len(texts))] == pytest.approx([p for _, p in want], abs=1e-5)
        seen.append(got)
    assert seen[0] == seen[1]


@pytest.mark.parametrize("part", [1, 2, 3, 7, 4999])
def test_a_long_text_in_parts_is_the_same_text(part):
    rng = random.Random(part)
    for n in (0, 1, 2, 11, 5000):
        text = "".join(rng.choices(ALPHABET, k=n))
        assert np.concatenate(list(codepoints.folded_parts(text, part))).tolist() == codepoints.folded([text])[0].tolist()
        model = model_of(4)
        (a,), (p,) = model.best([text])
        (b,), (q,) = model.best([text], part=part)
        assert a == b and p == pytest.approx(q, abs=1e-6)


def peak_mb(code: str) -> int:
    """Peak memory of a process that runs ``code``."""
    out = subprocess.run([sys.executable, "-c", code + "\nimport resource; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"], capture_output=True, text=True, check=True, timeout=300)
    return int(out.stdout.split()[-1])


def test_many_labels_and_a_very_long_text_fit_a_worker():
    build = "import numpy as np\nfrom latticework.llm import language_id as l\nm = l.LanguageModel([str(k) for k in range(2400)], np.ones((l.BUCKETS, 16), np.float32), np.ones((16, 2400), np.float32), np.zeros(2400))\n"
    assert peak_mb(build + "m.best(['abc é ' * 3_400_000, *['short text'] * 1000])") < 1000


@pytest.mark.parametrize("chars", [25, 100, 2000])
def test_an_automaton_of_a_full_block_fits_a_worker(chars):
    build = f"import random\nfrom latticework.llm import decontaminate as d\nn = min(d.BLOCK_ITEMS, d.BLOCK_CHARS // {chars})\nrandom.seed(3)\nitems = [(k, ''.join(random.choices('abcdefghijklmnopqrstuvwxyzé', k={chars}))) for k in range(n)]\n"
    assert peak_mb(build + "m = d.Matcher(items, d.ERROR_RATE, 25)") - peak_mb(build) < 160


def test_blocks_find_what_one_block_finds(spark):
    rng = random.Random(4)
    items = [(k, "".join(rng.choices("abcdefghij ", k=60))) for k in range(12)]
    texts = [(k, "".join(rng.choices("abcdefghij ", k=200)) + (items[k % 12][1] if k % 3 == 0 else "") + " end") for k in range(60)] + [(None, None), (None, items[5][1]), (3, "clean"), (3, items[2][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("extra", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(decontaminate.contamination(docs, bench)) == key(decontaminate.contamination(docs, bench, block_items=5))
    kept = decontaminate.decontaminate(docs, bench)
    assert key(kept) == key(decontaminate.decontaminate(docs, bench, block_items=5)) == key(decontaminate.decontaminate(docs, bench, block_chars=61))
    assert kept.count() == 42 and kept.columns == docs.columns


def test_short_texts_are_judged_in_small_blocks():
    """A batch of 2 million characters takes under 25 MB of scratch arrays beside its texts, and gives what each text gives by itself."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from latticework.llm import language_id as li

    rng = np.random.default_rng(1)
    model = li.LanguageModel(["a", "b", "c"], rng.normal(size=(li.BUCKETS, 16)).astype(np.float32), rng.normal(size=(16, 3)).astype(np.float32), np.zeros(3))
    texts = [None, "", "12", *("".join(rng.choice(list("abcdefgh "), 2_000)) for _ in range(1_000))]
    column = pa.array(texts)
    list(li.judged(model, column[:5]))
    tracemalloc.start()
    held = len(column.to_pylist()) and tracemalloc.get_traced_memory()[0]
    found = list(li.judged(model, column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - held < 25e6
    best, top = (np.concatenate(x) for x in zip(*found, strict=True))
    alone = [model.best([t]) for t in texts]
    assert best.tolist() == [int(b[0]) for b, _ in alone] and top.tolist() == [float(t[0]) for _, t in alone]


def test_the_slow_tokenizer_is_read_when_it_is_needed():
    import pytest

    pytest.importorskip("public_tokenizers")
    from latticework.llm import packing

    enc = packing.Encoder(packing.public_file("byte_bpe_50k.json"), packing.public_file("byte_bpe_50k.tiktoken"))
    ids = enc.ids("Plain words.").tolist()
    assert "slow" not in vars(enc)
    assert ids == enc.slow.encode("Plain words.", add_special_tokens=False).ids and enc.ids("a <|endoftext|> b").tolist() == enc.slow.encode("a <|endoftext|> b", add_special_tokens=False).ids
