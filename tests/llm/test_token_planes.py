"""Token planes: round trips, crc32 across files, and the query against the library."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import DATA
from latticework.llm import bitplanes as bp

DOC = "doc_id long, text string, start long, ids_crc32 string, shard int"


@pytest.fixture(scope="module")
def words():
    return bp.Words(bp.public_file("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sdmltrev12ab.,é²ß "), st.characters(max_codepoint=0x600)), max_size=80))
def test_words_give_the_librarys_ids(words, text):
    assert words.ids(text).tolist() == words._whole(text).tolist()


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "漢字 and more", "\x1c \x85 x", "͸", "x" * 100_000, " " * 5000 + "y", "I'll we've\n\n\n 12²", "퟿"])
def test_words_of_odd_texts(words, text):
    assert words.ids(text).tolist() == words._whole(text).tolist()


def test_long_texts_are_split_at_words(words):
    text = "some words of é 12 it's\n" * 60_000
    assert len(text) > 1_000_000 and words.ids(text).tolist() == words._whole(text).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(bp.MODES))
def test_planes_round_trip(ids, mode):
    x = np.array(ids, "<u4")
    assert bp.from_planes(bp.to_planes(x, mode), len(x), mode).tolist() == ids


@pytest.mark.parametrize("mode", bp.MODES)
def test_files_round_trip(mode):
    rng = random.Random(1)
    ids = np.array([rng.randrange(1 << rng.randrange(1, 33)) for _ in range(1000)], "<u4")
    raw = bp.pack_file(ids, [bp.Piece(None, 0, 10), bp.Piece(-5, 1, 990, True)], shard=3, part=1, first=77, mode=mode, block=64)
    f = bp.TokenFile(raw + b"\n")
    assert f.ids().tolist() == ids.tolist() and f.pieces == [bp.Piece(None, 0, 10), bp.Piece(-5, 1, 990, True)]
    for a, b in [(0, 1), (63, 65), (64, 128), (999, 1000), (500, 400), (990, 5000)]:
        assert f.ids(a, b).tolist() == ids[a:b].tolist()
    torn = bytearray(raw)
    torn[-5] ^= 1
    with pytest.raises(Exception):  # noqa: B017  the block's crc32, or the decompressor, finds it
        bp.TokenFile(bytes(torn)).ids()
    with pytest.raises(ValueError):
        bp.TokenFile(raw[:-3])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=50), max_size=5))
def test_crc32_of_parts(parts):
    assert bp.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def by_hand(words, rows):
    out, at = [], 0
    for d, t in rows:
        ids = np.append(words._whole(t or ""), 0).astype("<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("mode, block, file_ids", [("byte", 8, 32), ("bit", 16, 48), ("bit", 65_536, 4_194_304)])
def test_documents_across_blocks_and_files(spark, tmp_path, words, mode, block, file_ids):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Straße", "漢", "12"]) for _ in range(rng.choice([0, 3, 40, 200])))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "no name"), (-3, "x " * 2000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(d, t, 5, "x", 1) for d, t in rows], DOC).repartition(3)
    bp.write_ids(frame, f"{tmp_path}/ids", mode=mode, block=block, file_ids=file_ids)
    found = sorted((tuple(r) for r in bp.read_documents(spark, f"{tmp_path}/ids").collect()), key=lambda r: r[1])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert found == by_hand(words, ordered)
    stream = np.concatenate([np.append(words._whole(t or ""), 0) for _, t in ordered])
    files = bp.manifest(spark, f"{tmp_path}/ids").orderBy("start").collect()
    assert sum(f["n_ids"] for f in files) == len(stream) and files[0]["start"] == 0
    got = bp.read_range(spark, f"{tmp_path}/ids", 100, 700).orderBy("start").collect()
    assert [x for r in got for x in r["ids"]] == stream[100:700].tolist()


def test_repeated_rows_and_empty_table(spark, tmp_path, words):
    rows = [(1, "same", 0, "", 0)] * 30 + [(1, "other", 0, "", 0), (1, None, 0, "", 0), (0, "first", 0, "", 0)]
    bp.write_ids(spark.createDataFrame(rows, DOC).repartition(4), f"{tmp_path}/ids", file_ids=16, block=4)
    found = bp.read_documents(spark, f"{tmp_path}/ids").orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [0] + [1] * 32 and [r["start"] for r in found] == np.cumsum([0] + [r["n_tokens"] for r in found[:-1]]).tolist()
    want = {t: zlib.crc32(np.append(words._whole(t or ""), 0).astype("<u4").tobytes()) for t in ("same", "other", None, "first")}
    assert sorted(r["ids_crc32"] for r in found) == sorted(want[r[1]] for r in rows)
    bp.write_ids(spark.createDataFrame([], DOC), f"{tmp_path}/none")
    assert bp.read_documents(spark, f"{tmp_path}/none").count() == 0


def test_query_equals_the_library(spark, words):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = sorted((tuple(r) for r in bp.op13_token_planes(spark, DATA).collect()), key=lambda r: r[1])
    assert found == by_hand(words, [tuple(r) for r in docs])
