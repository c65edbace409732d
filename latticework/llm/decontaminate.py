"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased, with every run of other than letters and digits as one space.  An item of m
characters has an error budget of k = floor(``error_rate`` * m) edits and is split into k + 1 pieces: wherever a
document holds the item within k edits, at least one piece stands there unchanged.  An Aho-Corasick
automaton finds all pieces in the whole text; a hit fixes where the item would lie, and Myers'
bit-parallel algorithm gives the least edit distance of the item to any part of that window.

Items go to the tasks in blocks of ``block_items`` items and ``block_chars`` characters, whose automaton takes a Python worker up to
some 160 MB (measured by a test); each further block is one more scan, and no task holds two.  Documents are never joined or
shuffled.  Edge cases: null and empty texts match nothing, and items without a letter or digit are never found; items of
fewer than ``least_chars`` characters must stand as whole words: the part of the text that is within their budget begins and
ends where words do; equal items are reported each; of several places in a document the one with the fewest edits, then the
first, counts; repeated rows of documents, and rows with a null doc_id, are reported and judged each; an empty table of items
or documents finds nothing; columns beside doc_id and text are ignored, and pass ``decontaminate`` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import delete_path, new_area, table, write_table

_OTHER = re.compile(r"[\W_]+")
ERROR_RATE = 0.08
#: What one automaton holds at most: about 40 bytes a character, and some hundred for each item and piece.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 2_000_000


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def split_item(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in budget + 1 pieces of nearly equal length."""
    n = budget + 1
    bounds = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:z]) for a, z in zip(bounds, bounds[1:], strict=False) if z > a]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of ``pattern`` in ``text``, or None beyond ``budget``: one machine step a character of the text."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best: tuple[int, int] | None = None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full  # a match may begin anywhere, so nothing is carried in
        down = down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def distance(a: str, b: str, budget: int) -> int:
    """The edit distance of two whole strings, or budget + 1 where it is larger: Myers' algorithm with both ends fixed."""
    if abs(len(a) - len(b)) > budget:
        return budget + 1
    m = len(a)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for c in b:
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full  # the match begins with the text
        down = down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return min(score, budget + 1)


def whole_words(item: str, text: str, start: int, budget: int) -> tuple[int, int] | None:
    """(edits, end) of the best part of ``text`` near ``start`` that begins and ends where words do, or None beyond ``budget``."""
    best: tuple[int, int] | None = None
    for a in range(max(0, start - budget), min(len(text), start + budget) + 1):
        if a and text[a - 1] != " ":
            continue
        for z in range(max(a + 1, a + len(item) - budget), min(len(text), a + len(item) + budget) + 1):
            if z == len(text) or text[z] == " ":
                found = (distance(item, text[a:z], budget), z)
                if found[0] <= budget and (best is None or found < best):
                    best = found
    return best


class Matcher:
    """The pieces of all items of a block in one automaton."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, least_chars: int) -> None:
        import ahocorasick

        self.items = [(i, n, int(error_rate * len(n))) for i, t in items if (n := normalise(t))]
        self.least_chars = least_chars
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item, budget) in enumerate(self.items):
            for offset, piece in split_item(item, budget):
                where.setdefault(piece, []).append((k, offset))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def find(self, text: str | None) -> Iterator[tuple[int | None, int, int, int]]:
        """(item_id, edits, end in the normalised text, item's length) of each item found."""
        norm = normalise(text)
        if not self.any or not norm:
            return
        tried: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int]] = {}
        for last, (length, places) in self.automaton.iter(norm):
            for k, offset in places:
                _, item, budget = self.items[k]
                start = last + 1 - length - offset
                if best.get(k, (1, 0))[0] == 0 or (k, start) in tried:
                    continue
                tried.add((k, start))
                if len(item) < self.least_chars:
                    found = whole_words(item, norm, start, budget)
                    if found and (k not in best or found < best[k]):
                        best[k] = found
                    continue
                if start >= 0 and norm.startswith(item, start):
                    best[k] = (0, start + len(item))
                    continue
                if budget:
                    a = max(0, start - budget)
                    found = myers(item, norm[a : start + len(item) + budget], budget)
                    if found and (k not in best or (found[0], a + found[1]) < best[k]):
                        best[k] = (found[0], a + found[1])
        for k, (edits, end) in sorted(best.items()):
            yield self.items[k][0], edits, end, len(self.items[k][1])


MATCH = "doc_id long, item_id long, edits int, end long, item_chars int"


def contamination(docs: DataFrame, items: DataFrame, *, error_rate: float = ERROR_RATE, least_chars: int = 25, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, end, item_chars): each item that a document holds within its error budget."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None

    def matched(block: list[tuple[int | None, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate, least_chars)
            for batch in batches:
                rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in matcher.find(text.as_py())]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "edits", "end", "item_chars"])

        return source.mapInArrow(run, MATCH)

    for block in item_blocks(items, block_items, block_chars):
        found = matched(block) if found is None else found.unionByName(matched(block))
    return spark.createDataFrame([], MATCH) if found is None else found


def item_blocks(items: DataFrame, block_items: int, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items (item_id, text) in blocks of bounded number and size; an item beyond ``block_chars`` is a block of its own."""
    block: list[tuple[int | None, str]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").toLocalIterator():
        if block and (len(block) == block_items or size + len(row["text"]) > block_chars):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def decontaminate(docs: DataFrame, items: DataFrame, *, error_rate: float = ERROR_RATE, least_chars: int = 25, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold an item.  Every row is judged by its own text, so null and repeated doc_ids cost no other row.

    Between blocks the rows left are written, for scans that follow each other within a task would hold all their automata at once.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def without(rows: DataFrame, block: list[tuple[int | None, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        at = rows.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate, least_chars)
            for batch in batches:
                clean = [next(matcher.find(text.as_py()), None) is None for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(run, fields)

    area, written = new_area(docs.sparkSession, "clean"), []
    for k, block in enumerate(item_blocks(items, block_items, block_chars)):
        if k:
            docs = write_table(docs, f"{area}/{k}")
            for path in written:
                delete_path(docs.sparkSession, path)
            written = [f"{area}/{k}"]
        docs = without(docs, block)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "edits", "item_chars")


QUERIES = {"op3_decontamination": op3_decontamination}
