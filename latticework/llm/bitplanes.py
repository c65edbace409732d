"""Token ids as files of bit planes: fixed-size blocks of ids are transposed into planes, each compressed by itself.

``write_ids`` encodes documents in ascending order of doc_id, ends each with id 0, and writes one stream of ids over as
many files as there are tasks and ``FILE_IDS`` ask for; ``read_documents`` reads the files back, ``read_range`` any stretch
of the stream, touching only the blocks that hold it.

File format, all numbers little-endian:

    magic ``LWPLANE1`` | u64 bytes of the index | u64 bytes of the planes | index | planes

The index, compressed with zstandard, is one JSON line (shard, part, first: ids of the shard before this file, ids, block,
mode, docs) followed by the blocks' table (u64 offset of the first plane, u32 ids, u32 crc32 of the ids, u32 number of planes,
u32 bytes of each plane) and the documents' columns (i64 doc_id, u8 whether it is null, i64 number within the shard, i64 ids in
this file, u8 whether it goes on in the next).  A block of n ids has bit planes (plane k holds bit k of every id, eight ids a
byte) or byte planes (byte k of every id), from the lowest up to the highest that isn't all zero; a mode is a file's.
Spark's own writer writes the files (one row a file), so a lost task leaves no half-written one; a byte of line end that it adds
lies behind the planes.

A document's crc32 is put together from its parts in several files without reading them again (``crc32_joined``).

Edge cases: null and empty texts are the closing id alone; texts of any length are cut at block and file borders; null doc_ids come
first; rows that repeat a doc_id are documents of their own, in the order of their texts' hashes, equal ones in the order they were read
in; further columns are left out; an empty table gives no file with ids and no row.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.common import broadcast_if, delete_path, new_area, table, write_table
from latticework.llm.packing import END_ID, public_file

MAGIC = b"LWPLANE1"
#: Ids of a block, and ids of a file: some 8 MB of planes.
BLOCK_IDS, FILE_IDS = 65_536, 4_194_304
MODES = ("bit", "byte")


# ---- ids ---------------------------------------------------------------------------------------

#: Words whose ids a worker remembers, twice as many at most, and their length: some 200 MB.
WORDS_HELD, WORD_LENGTH = 500_000, 60


def _class(kind: str) -> str:
    """The characters below U+0500 of a general category, as what stands between the brackets of a pattern."""
    return "".join(f"\\u{c:04x}" for c in range(0x500) if unicodedata.category(chr(c))[0] == kind)


class Words:
    """Ids by ``tokenizers``, word by word where that is the same.

    A byte-level vocabulary splits a text by one pattern before it merges, so a word's ids don't depend on what stands beside
    it: each distinct word goes through the library's model once.  The pattern here is that of the vocabulary file, for texts of
    characters below U+0500 whose category no version of Unicode has changed; every other text, and one that holds a special token, goes
    through the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = said.get("pre_tokenizer") or {}
        self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not said.get("normalizer") and not said.get("truncation")
        letters, numbers = _class("L"), _class("N")
        self.words = re.compile(f" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]+| ?[^\\s{letters}{numbers}]+|\\s+(?!\\S)|\\s+")
        # Unassigned characters, those that Python alone takes for white space, and all from U+0500 on are left to the library.
        self.apart = np.array([unicodedata.category(chr(c)) == "Cn" or 0x1C <= c <= 0x1F or c == 0x85 for c in range(0x500)] + [True])
        self.special = [x["content"] for x in said.get("added_tokens", [])]
        # A byte-level vocabulary writes printable bytes as themselves, and all others as the characters from U+0100 on.
        plain = [c for c in range(256) if 33 <= c <= 126 or c >= 161 and c != 173]
        self.alphabet = {c: chr(256 + k) for k, c in enumerate(c for c in range(256) if c not in plain)}
        self.known = _Remembered(self._word)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if not self.by_word or self._odd(text):
            return self._whole(text)
        parts: list[bytes] = []
        words: list[str] = []
        for m in self.words.finditer(text) if len(text) > 1_000_000 else ():
            words.append(m[0])
            if len(words) == 100_000:
                parts.append(self._joined(words))
                words = []
        parts.append(self._joined(words if parts or words else self.words.findall(text)))
        return np.frombuffer(b"".join(parts), "<u4")

    def _odd(self, text: str) -> bool:
        if any(x in text for x in self.special):
            return True
        units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
        return bool(self.apart[np.minimum(units, 0x500)].any())

    def _joined(self, words: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))

    def _word(self, word: str) -> bytes:
        found = self.library.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))
        return struct.pack(f"<{len(found)}I", *[x.id for x in found])


class _Remembered(dict):
    """The ids of words, made when first asked for; what is still in use comes back from the older half when one is full."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or self.make(word)
        if len(word) <= WORD_LENGTH:
            if len(self) >= WORDS_HELD:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


_held: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One per worker process and vocabulary."""
    if path not in _held:
        _held[path] = Words(path)
    return _held[path]


# ---- planes ------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, mode: str = "byte") -> list[bytes]:
    """The planes of a block of ids, lowest first, up to the highest that isn't all zero."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()) if len(ids) else 0
    if mode == "byte":
        columns = ids.view(np.uint8).reshape(-1, 4)
        return [columns[:, k].tobytes() for k in range((top.bit_length() + 7) // 8)]
    return [np.packbits((ids >> np.uint32(k)) & np.uint32(1) != 0, bitorder="little").tobytes() for k in range(top.bit_length())]


def from_planes(planes: list[bytes], n: int, mode: str = "byte") -> np.ndarray:
    out = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        if mode == "byte":
            out |= np.frombuffer(plane, np.uint8).astype("<u4") << np.uint32(8 * k)
        else:
            out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(k)
    return out


@dataclass
class Piece:
    """The ids of one document that one file holds."""

    doc_id: int | None
    nth: int
    n: int
    goes_on: bool = False


def pack_file(ids: np.ndarray, pieces: list[Piece], *, shard: int, part: int, first: int, mode: str = "byte", block: int = BLOCK_IDS, level: int = 3) -> bytes:
    """A whole file of the format above."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    body: list[bytes] = []
    blocks = bytearray()
    at = 0
    for start in range(0, len(ids), block):
        rows = ids[start : start + block]
        planes = [squeeze(x) for x in to_planes(rows, mode)]
        blocks += struct.pack(f"<QIII{len(planes)}I", at, len(rows), zlib.crc32(np.ascontiguousarray(rows, "<u4")), len(planes), *map(len, planes))
        body += planes
        at += sum(map(len, planes))
    head = {"shard": shard, "part": part, "first": first, "ids": len(ids), "block": block, "mode": mode, "blocks": -(-len(ids) // block), "docs": len(pieces)}
    columns = [np.array(x, kind).tobytes() for x, kind in (
        ([p.doc_id or 0 for p in pieces], "<i8"), ([p.doc_id is None for p in pieces], "u1"), ([p.nth for p in pieces], "<i8"), ([p.n for p in pieces], "<i8"), ([p.goes_on for p in pieces], "u1"),
    )]
    index = squeeze(json.dumps(head).encode() + b"\n" + bytes(blocks) + b"".join(columns))
    return b"".join([MAGIC, struct.pack("<QQ", len(index), at), index, *body])


class TokenFile:
    """A file of the format: its index is parsed, its planes stay packed until blocks are asked for."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a file of token planes")
        n_index, n_planes = struct.unpack_from("<QQ", raw, 8)
        self._planes = memoryview(raw)[24 + n_index : 24 + n_index + n_planes]
        if len(self._planes) != n_planes:
            raise ValueError("the file ends before its planes do")
        expand = zstandard.ZstdDecompressor()
        index = expand.decompress(raw[24 : 24 + n_index])
        line, _, rest = index.partition(b"\n")
        self.head: dict = json.loads(line)
        self.blocks: list[tuple[int, int, int, tuple[int, ...]]] = []  # offset, ids, crc32, bytes of planes
        at = 0
        for _ in range(self.head["blocks"]):
            offset, n, crc, planes = struct.unpack_from("<QIII", rest, at)
            self.blocks.append((offset, n, crc, struct.unpack_from(f"<{planes}I", rest, at + 20)))
            at += 20 + 4 * planes
        docs = self.head["docs"]
        columns = []
        for kind in ("<i8", "u1", "<i8", "<i8", "u1"):
            columns.append(np.frombuffer(rest, kind, docs, at))
            at += columns[-1].nbytes
        ids, null, nth, n, goes_on = (c.tolist() for c in columns)
        self.pieces = [Piece(None if x else i, k, m, bool(g)) for i, x, k, m, g in zip(ids, null, nth, n, goes_on, strict=True)]

    def block(self, k: int) -> np.ndarray:
        """The ids of block ``k``, held against their crc32."""
        offset, n, crc, sizes = self.blocks[k]
        expand, planes = zstandard.ZstdDecompressor(), []
        for size in sizes:
            planes.append(expand.decompress(self._planes[offset : offset + size]))
            offset += size
        ids = from_planes(planes, n, self.head["mode"])
        if zlib.crc32(ids) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of this file; only the blocks that hold them are unpacked."""
        stop = self.head["ids"] if stop is None else min(stop, self.head["ids"])
        size = self.head["block"]
        if start >= stop:
            return np.zeros(0, "<u4")
        found = np.concatenate([self.block(k) for k in range(start // size, (stop - 1) // size + 1)])
        return found[start - start // size * size :][: stop - start]


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of crc32, bit-reversed."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """The crc32 of bytes in several parts, each given by its crc32 and its number of bytes."""
    total = 0
    for crc, n in parts:
        shift, power = 1 << 31, 1 << 23  # x to the power 0, and to the power 8: one byte
        while n:
            if n & 1:
                shift = _times(shift, power)
            power = _times(power, power)
            n >>= 1
        total = _times(shift, total) ^ crc
    return total


# ---- files on Spark ----------------------------------------------------------------------------


def write_ids(docs: DataFrame, path: str, *, tokenizer: str = "byte_bpe_50k.json", mode: str = "byte", block: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the stream of their ids below ``path``."""
    if mode not in MODES:
        raise ValueError(f"a mode is one of {MODES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, words = TaskContext.get().partitionId(), words_of(public_file(tokenizer))
        held: list[np.ndarray] = []
        pieces: list[Piece] = []
        n = nth = part = first = 0

        def closed() -> pa.RecordBatch:
            nonlocal held, pieces, n, part, first
            raw = pack_file(np.concatenate(held), pieces, shard=shard, part=part, first=first, mode=mode, block=block)
            held, pieces, first, part, n = [], [], first + n, part + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["value"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(words.ids(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                while len(ids):
                    room = file_ids - n
                    held.append(ids[:room])
                    pieces.append(Piece(doc, nth, len(held[-1]), len(ids) > room))
                    n += len(held[-1])
                    ids = ids[room:]
                    if n == file_ids:
                        yield closed()
                nth += 1
        if n:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Equal doc_ids are told apart by text and place, so that a doc_id of many rows is no hot range.
    rows = rows.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    keys = [F.col("doc_id").asc_nulls_first(), "hash", "place"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 24").select("path", "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, shard, part, start, n_ids, n_docs): the files in the order of the stream, ``start`` being the ids of all before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [TokenFile(x.as_py()).head for x in batch.column(1)]
            columns = [batch.column(0), *(pa.array([h[k] for h in heads], pa.int64()) for k in ("shard", "part", "first", "ids", "docs"))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "shard", "part", "first", "n_ids", "n_docs"])

    files = _files(spark, path).mapInArrow(run, "path string, shard long, part long, first long, n_ids long, n_docs long")
    return _with_starts(files).select("path", "shard", "part", (F.col("before") + F.col("first")).alias("start"), "n_ids", "n_docs")


def _with_starts(rows: DataFrame) -> DataFrame:
    """``rows`` (shard, first, n_ids, ...) with ``before``: the ids of all shards before theirs.  One number a shard is ordered."""
    totals = rows.groupBy("shard").agg(F.max(F.col("first") + F.col("n_ids")).alias("total"))
    before = totals.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(broadcast_if(before, totals.count()), "shard")


_PIECE = "shard long, nth long, part long, doc_id long, first long, n_ids long, crc long"


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(shard, nth, part, doc_id, first, n_ids, crc) of every document's ids in every file: ``first`` counts within the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1):
                f = TokenFile(x.as_py())
                ids, at, rows = f.ids(), 0, []
                for p in f.pieces:
                    rows.append((f.head["shard"], p.nth, f.head["part"], p.doc_id, f.head["first"] + at, p.n, zlib.crc32(ids[at : at + p.n])))
                    at += p.n
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "nth", "part", "doc_id", "first", "n_ids", "crc"])

    return _files(spark, path).mapInArrow(run, _PIECE)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files below ``path``."""
    area = new_area(spark, "pieces")
    pieces = write_table(read_pieces(spark, path), area)
    whole = pieces.groupBy("shard", "nth").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n_ids").alias("n_ids"), F.min("crc").alias("crc"),
        F.when(F.count(F.lit(1)) > 1, F.sort_array(F.collect_list(F.struct("part", "crc", "n_ids")))).alias("parts"),
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [c if parts is None else crc32_joined([(p["crc"], 4 * p["n_ids"]) for p in parts]) for c, parts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = _with_starts(whole).select("doc_id", (F.col("before") + F.col("first")).alias("start"), F.col("n_ids").alias("n_tokens"), "crc", "parts")
    return placed.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids): ids ``start`` to ``stop`` of the whole stream, one row a file that holds some; other blocks stay packed."""
    wanted = manifest(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)).select("path", F.col("start").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = TokenFile(raw.as_py()).ids(max(0, start - at), max(0, stop - at))
                yield pa.RecordBatch.from_arrays([pa.array([max(start, at)], pa.int64()), pa.array([found.astype(np.int64)], pa.list_(pa.int64()))], names=["start", "ids"])

    return _files(spark, path).join(wanted, "path").select("at", "content").mapInArrow(run, "start long, ids array<long>")


def op13_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = new_area(spark, "token-planes")
    write_ids(table(spark, sf_dir, "documents"), area)
    back = write_table(read_documents(spark, area), new_area(spark, "token-documents"))
    delete_path(spark, area)
    return back


QUERIES = {"op13_token_planes": op13_token_planes}
