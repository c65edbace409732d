"""N-gram Jaccard join by grouped prefixes.

Every text is the set of its word shingles.  Equal sets become one class.  A class's shingles are put in one global
order, rare ones first; classes similar enough share a shingle in their prefixes of n - ceil(t * n) + 1.
Classes with the same prefix and size make one group: only groups enter the postings, group pairs are
filtered by size and position, and what passes is expanded to members and verified on whole sets.

Rarity is counted exactly, over all classes, for the part of the hash space that prefixes are taken from, and for
the rest of it over the classes whose prefixes reach it; counts reach the tasks as tables of levels of bounded size.  The order decides only how many candidates there are, never
which links are found.

Edge cases: null, empty and blank texts have no shingle, link with nothing and are their own
component; texts with fewer words than a shingle are one shingle as a whole; rows that repeat a doc_id count as one
document, linked where any of its texts is; rows with a null doc_id are one document whose component_id is
null unless it is linked (it sorts first, so its partners' component_id is null too); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import wordhash
from latticework.llm.common import broadcast_if, delete_path, held, new_area, release, table, write_table
from latticework.llm.links import LinkSearch

#: A shingle in more classes than this is common, and comes last in the order.
RARE = 16
#: Cells of the table of levels at most: 32 MB in each Python worker.
CELLS_MOST = 1 << 25
_NO_ID = -(2**63)


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))


def rare_bound(percent: int) -> np.uint64:
    """Hashes below this are counted: a quarter more of the hash space than a prefix takes of a set."""
    return np.uint64(min(2**64 - 1, (100 - percent + 1) * 5 * 2**64 // 400))


def profiles(units: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, k1, k2, low) from (id, text): the size of the shingle set, its 128-bit digest and its hashes below ``rare_bound``."""
    bound = rare_bound(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["n", "k1", "k2", "low"], (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        for batch in (part for whole in batches for part in wordhash.slices(whole, 1)):
            rows = [(len(s), *wordhash.set_digest(s), s[: np.searchsorted(s, bound)].view(np.int64)) for s in wordhash.sets(batch.column(1), words)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["id", *names])

    return units.mapInArrow(run, "id long, n long, k1 long, k2 long, low array<long>")


class Levels:
    """How common shingles are, from exact counts (token, k), k > 1: a table of levels by hash cell.

    Level 1 is a count of up to RARE, each doubling beyond is one more; a cell has the highest level of its tokens, 0 if
    it has none.  There are eight cells a token and CELLS_MOST at most; where more tokens are common than that has
    room for, the rarer levels stay out of it (``first`` says up to which), so its size never grows with the corpus.
    """

    def __init__(self, counts: DataFrame) -> None:
        level = F.greatest(F.lit(1), F.ceil(F.log2(F.col("k") / RARE)) + 1).cast("int")
        sizes = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}  # a row a doubling
        self.first = 1
        while sum(n for k, n in sizes.items() if k >= self.first) > CELLS_MOST // 8:
            self.first += 1
        chosen = sum(n for k, n in sizes.items() if k >= self.first)
        self.cells = np.zeros(1 << max(10, (8 * chosen).bit_length()), np.uint8)
        cell = F.expr(f"token & {len(self.cells) - 1}")
        found = counts.select(cell.alias("cell"), level.alias("level")).where(F.col("level") >= self.first).groupBy("cell").agg(F.max("level").cast("byte").alias("level"))
        for batch in found.toArrow().to_batches() if chosen else ():  # CELLS_MOST / 8 rows at most
            self.cells[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint8)

    def of(self, s: np.ndarray) -> np.ndarray:
        return self.cells[(s & np.uint64(len(self.cells) - 1)).astype(np.int64)]


def _prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def short_of_rare(low: DataFrame, percent: int, levels: Levels) -> DataFrame:
    """The (id) of those (id, n, low) whose counted rare shingles do not fill the prefix."""
    shared = low.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            common = shared.value.of(lists.flatten().to_numpy().view(np.uint64)) > 1
            before = np.concatenate([[0], np.cumsum(~common)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            n = batch.column(1).to_numpy()
            keep = np.diff(before) < n - -(-percent * n // 100) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["id"]).filter(pa.array(keep))

    return low.select("id", "n", "low").mapInArrow(run, "id long").distinct()


def other_tokens(units: DataFrame, words: int, percent: int) -> DataFrame:
    """(token): the hashes that ``profiles`` leaves out, once a text."""
    bound = rare_bound(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in wordhash.slices(whole, 1)):
            found = [s[np.searchsorted(s, bound) :] for s in wordhash.sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["token"])

    return units.mapInArrow(run, "token long")


def prefixes(units: DataFrame, words: int, percent: int, low: Levels, high: Levels) -> DataFrame:
    """(id, n, prefix_key, prefix, places, central, cells) of every text with a shingle.

    The order of shingles is: rare ones below ``rare_bound``, rare ones above, common ones by level; by hash within each.
    ``prefix`` leaves out what the counts show to be in no other prefix, ``places`` are the others' places; ``central`` grows with
    how common the shingles are.
    """
    shared = units.sparkSession.sparkContext.broadcast((low, high))
    bound = rare_bound(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = shared.value
        for batch in (part for whole in batches for part in wordhash.slices(whole, 1)):
            rows: list[tuple] = []
            for i, s in zip(batch.column(0).to_pylist(), wordhash.sets(batch.column(1), words), strict=True):
                n = len(s)
                if not n:
                    continue
                cut = int(np.searchsorted(s, bound))
                of = np.concatenate([low.of(s[:cut]), high.of(s[cut:])])
                rank = np.where(of > 1, of, np.arange(n) >= cut)
                front = np.argsort(rank, kind="stable")[: _prefix_size(n, percent)]
                key = wordhash.set_digest(s[front] * np.uint64(2) + np.uint64(1))[0]
                places = np.flatnonzero((of[front] > 0) | (np.where(front < cut, low.first, high.first) > 1))
                rows.append((i, n, key, s[front[places]].view(np.int64), places.astype(np.int32), int(1000 * rank.mean()), wordhash.histogram(s)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["id", "n", "prefix_key", "prefix", "places", "central", "cells"])

    return units.mapInArrow(run, "id long, n long, prefix_key long, prefix array<long>, places array<int>, central long, cells binary")


def shingle_sets(units: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, members) of the named ids: their sorted shingle hashes, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in wordhash.slices(whole, 1)):
            found = [s.tobytes() for s in wordhash.sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "members"])

    return units.join(broadcast_if(ids, ids.count()), "id", "left_semi").mapInArrow(run, "id long, members binary")


def similar_documents(docs: DataFrame, *, words: int = 5, percent: int = 80, area: str | None = None, report: list | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: documents link at 100 * intersection >= percent * union.

    The result reads tables below ``area``, which the caller may delete when it has been used.
    """
    spark = docs.sparkSession
    area = area or new_area(spark, "ngram")

    def counted(tokens: DataFrame, path: str) -> Levels:
        counts = write_table(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), path)
        levels = Levels(counts)
        delete_path(spark, path)
        release(spark)
        return levels

    units = _ids(docs)
    profile = write_table(profiles(units, words, percent), f"{area}/profile")
    rows = write_table(profile.select("id", "n", "k1", "k2"), f"{area}/rows")
    classes = write_table(rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")), f"{area}/classes")
    # Copies beyond their class's first document need no prefix.
    copies = rows.where("n > 0").join(classes, ["n", "k1", "k2"]).where("id <> rep").select("id", "n").distinct()
    copies = held(copies.join(classes.select(F.col("rep").alias("id"), "n"), ["id", "n"], "left_anti"))
    alone = broadcast_if(copies, copies.count())
    first = profile.where("n > 0").join(alone, ["id", "n"], "left_anti")
    low = counted(first.select(F.explode("low").alias("token")), f"{area}/low")
    # Texts whose counted shingles are too common to fill a prefix have their other shingles counted too.
    common = held(short_of_rare(first, percent, low))
    high = counted(other_tokens(units.join(broadcast_if(common, common.count()), "id", "left_semi"), words, percent), f"{area}/high")
    common.unpersist()
    delete_path(spark, f"{area}/profile")
    fronts = prefixes(units, words, percent, low, high).join(alone, ["id", "n"], "left_anti")
    fronts = write_table(fronts, f"{area}/fronts")
    # Groups: classes with the same prefix and size, named by their first member.
    groups = fronts.groupBy("n", "prefix_key").agg(F.min("id").alias("grp"))
    placed = held(fronts.select("id", "n", "prefix_key").join(groups, ["n", "prefix_key"]).distinct())
    members = placed.select("grp", "id").distinct()
    others = placed.where("grp <> id").select("id", "n", "prefix_key")
    leads = fronts.join(broadcast_if(others, others.count()), ["id", "n", "prefix_key"], "left_anti")
    # A token matters where two groups hold it, or one group of several members.  Only tokens are counted first; what is
    # left of the postings is read off the prefixes again, so that no table of all postings is ever written.
    each = leads.select(F.explode(F.arrays_zip("prefix", "places")).alias("at"), F.col("id").alias("grp"), "n", "central")
    each = each.select(F.col("at.prefix").alias("token"), "grp", "n", F.col("at.places").cast("long").alias("pos"), "central")
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    several = members.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("grp")
    one = leads.join(several, leads["id"] == several["grp"], "left_semi").where(F.size("prefix") > 0).select(F.get("prefix", F.lit(0)).alias("token"))
    useful = held(shared.unionByName(one).distinct())
    release(spark)
    postings = each.join(useful, "token", "left_semi")
    postings = write_table(postings, f"{area}/postings")
    useful.unpersist()
    copies.unpersist()
    release(spark)
    search = LinkSearch(postings, members, lambda ids: shingle_sets(units, ids, words), fronts.select("id", "cells"), percent, area=f"{area}/links")
    found = search.run()
    placed.unpersist()
    if report is not None:
        report += [("classes", classes.count()), ("groups", members.select("grp").distinct().count()), ("postings", postings.count()), *search.report]
    # Back to documents: a class's component, and the least document of each component.
    found = found.where("id <> component").select(F.col("id").alias("rep"), "component")
    placed = rows.join(classes, ["n", "k1", "k2"], "left").join(found, "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return placed.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(component != _NO_ID, component).alias("component_id"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), words=3, percent=90)


QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLE_SQL = {
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT u.y, r.low FROM r JOIN u ON u.x = r.id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT id AS doc_id, min(low) AS component_id FROM r GROUP BY id) LEFT JOIN n USING (doc_id)
"""
}
