"""Substring dedup: paragraphs by MinHash banding, passages inside paragraphs by content-anchored windows.

Paragraphs are lines of at least ``LEAST_WORDS`` words.  Equal paragraphs become one class; each class has a
MinHash signature of BANDS bands of ROWS values over its word shingles, tuned to collide for 99.9 % of
pairs at a similarity of 0.8; classes of a band meet in star rounds and a closing round, are verified by
exact Jaccard, and make components.  The paragraph of a component's smallest document stays, others go.

A repeated passage need not be a line of its own.  Windows of WINDOW words begin at the words that a
winnowing of ANCHORS positions picks by content alone, so any passage of WINDOW + ANCHORS - 1 = 50 words or more
that two documents share holds at least one window that both of them have.  From the windows found in two
documents or more the maximal stretches are derived whose every 50 words stand in another document.

Edge cases: null and short texts have no paragraph or window; a repeat within one document alone is no
repeat across documents; rows that repeat a doc_id count as one document, though each text keeps its own
paragraphs and places; a null doc_id is one document that sorts first; every column beside doc_id and text is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm import wordhash
from latticework.llm.common import broadcast_if, held, new_area, release, table, write_table
from latticework.llm.links import LinkSearch

LEAST_WORDS = 50
WINDOW, ANCHORS = 35, 16
ROWS, BANDS = 4, 14
#: Cells of the histogram that paragraphs carry into the closing join.
MARKS = 256
_NO_ID = -(2**63)
_SEEDS = np.random.default_rng(5).integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("row"))


def paragraphs(batch: pa.RecordBatch) -> tuple[list[int], np.ndarray, list[int], pa.Array]:
    """(doc, identity, line number, line) of the lines of a batch (doc, text, row) that may be long enough.

    The identity covers doc, text and line number: texts that repeat a doc_id, or have none, keep their paragraphs apart.
    """
    docs, rows, numbers, lines = [], [], [], []
    for doc, text, row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
        for k, line in enumerate((text or "").split("\n")):
            if len(line) >= 2 * LEAST_WORDS - 1:
                docs.append(doc)
                rows.append(row)
                numbers.append(k)
                lines.append(line)
    d, r = (np.array(x, np.int64).view(np.uint64) for x in (docs, rows))
    ids = wordhash.mix(wordhash.mix(wordhash.mix(d) + r) + np.array(numbers, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return docs, ids.view(np.int64), numbers, pa.array(lines, pa.string())


def signatures(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The band tokens of the sets that begin at ``starts`` in the concatenation ``s``: a row a set."""
    low = np.empty((ROWS * BANDS, len(starts)), np.uint64)
    for k, seed in enumerate(_SEEDS):
        h = s * seed
        h ^= h >> np.uint64(31)
        low[k] = np.minimum.reduceat(h * np.uint64(0x94D049BB133111EB), starts)
    tokens = np.empty((len(starts), BANDS), np.int64)
    for b in range(BANDS):
        token = np.full(len(starts), b + 1, np.uint64)
        for r in range(ROWS):
            token = wordhash.mix(token * np.uint64(0xD6E8FEB86659FD93) + low[b * ROWS + r])
        tokens[:, b] = token.view(np.int64)
    return tokens


def paragraph_classes(units: DataFrame, words: int) -> DataFrame:
    """(doc, line, id, n, k1, k2, cells, bands, marks) of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in wordhash.slices(whole, 1)):
            docs, ids, numbers, lines = paragraphs(batch)
            h, bounds = wordhash.words(lines)
            s, at = wordhash.shingles(h, bounds, words)
            rows, held = [], []
            for i in np.flatnonzero(np.diff(bounds) >= LEAST_WORDS):
                held.append(np.unique(s[at[i] : at[i + 1]]))
                rows.append((docs[i], numbers[i], int(ids[i]), len(held[-1]), *wordhash.set_digest(held[-1]), wordhash.histogram(held[-1])))
            bands = signatures(np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])) if held else np.zeros((0, BANDS), np.int64)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            marks = [np.bincount((x >> np.uint64(20)).astype(np.int64) & (MARKS - 1), minlength=MARKS) for x in held]
            marks = [m.astype(np.int16) if m.max() < 2**15 else None for m in marks]
            lists = [pa.array(list(bands), pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays([*arrays, *lists], names=["doc", "line", "id", "n", "k1", "k2", "cells", "bands", "marks"])

    return units.mapInArrow(run, "doc long, line long, id long, n long, k1 long, k2 long, cells binary, bands array<long>, marks array<smallint>")


def _paragraph_sets(units: DataFrame, docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, members) of the named paragraphs, which lie in ``docs`` (doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in wordhash.slices(whole, 1)):
            _, named, _, lines = paragraphs(batch)
            found = [s.tobytes() for s in wordhash.sets(lines, words)]
            yield pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), pa.array(found, pa.binary())], names=["id", "members"])

    chosen = units.join(broadcast_if(docs, docs.count()), "doc", "left_semi").mapInArrow(run, "id long, members binary")
    return chosen.join(broadcast_if(ids, ids.count()), "id", "left_semi")


def repeated_paragraphs(docs: DataFrame, *, words: int = 5, percent: int = 80, report: list | None = None) -> DataFrame:
    """(doc, line, n, component): paragraphs of components that span two documents or more."""
    spark = docs.sparkSession
    area = new_area(spark, "paragraphs")
    units = _ids(docs)
    rows = write_table(paragraph_classes(units, words), f"{area}/rows")
    first = rows.groupBy("n", "k1", "k2").agg(F.min(F.struct("doc", "line", "id")).alias("first"))
    classes = held(first.select("n", "k1", "k2", F.col("first.id").alias("rep"), F.col("first.doc").alias("doc")))
    reps = classes.select(F.col("rep").alias("id"))
    lead = rows.join(reps, "id", "left_semi").dropDuplicates(["id"])
    tokens = lead.select("id", "n", F.posexplode("bands").alias("band", "token"))
    tokens = held(tokens)
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    postings = tokens.join(shared, "token", "left_semi").join(lead.select("id", "bands", "marks"), "id")
    postings = postings.select("token", F.col("id").alias("grp"), "n", F.lit(None).cast("long").alias("pos"), F.lit(0).cast("long").alias("central"), F.slice("bands", F.lit(1), F.col("band")).alias("earlier"), "marks")
    postings = write_table(postings, f"{area}/postings")
    tokens.unpersist()
    members = postings.select("grp", F.col("grp").alias("id")).distinct()

    def sets_of(ids: DataFrame) -> DataFrame:
        where = classes.join(ids.withColumnRenamed("id", "rep"), "rep", "left_semi").select("doc").distinct()
        return _paragraph_sets(units, where, ids, words)

    hints = rows.join(members.select("id"), "id", "left_semi").select("id", "cells")
    search = LinkSearch(postings, members, sets_of, hints, percent)
    found = search.run().where("id <> component").select(F.col("id").alias("rep"), "component")
    release(spark)
    if report is not None:
        report += [("paragraphs", rows.count()), ("classes", classes.count()), ("postings", postings.count()), *search.report]
    placed = rows.select("doc", "line", "n", "k1", "k2").join(classes.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"]).join(found, "rep", "left")
    placed = placed.select("doc", "line", "n", F.coalesce("component", "rep").alias("component"))
    spans = placed.groupBy("component").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last")).where("keeper <> last").select("component", "keeper")
    return placed.join(spans, "component")


def windows(units: DataFrame) -> DataFrame:
    """(doc, row, at, digest): the windows at every text's winnowed words, once each; ``row`` tells the texts of one doc apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in wordhash.slices(whole, 1)):
            h, bounds = wordhash.words(batch.column(1))
            if len(h) < WINDOW:
                continue
            # The digest of the window at each word, and where it lies within one text.
            digest = rolling(h, WINDOW)
            count = np.diff(bounds)
            text = np.repeat(np.arange(len(count)), count)
            inside = np.arange(len(digest)) + WINDOW <= bounds[text[: len(digest)] + 1]
            place = np.where(inside, digest, np.uint64(2**64 - 1))
            # Winnowing over the window digests themselves: of every ANCHORS neighbouring windows the smallest is taken.
            low = np.lib.stride_tricks.sliding_window_view(np.concatenate([place, np.full(ANCHORS - 1, 2**64 - 1, np.uint64)]), ANCHORS)
            chosen = np.unique(np.arange(len(place)) + low.argmin(axis=1))
            chosen = chosen[chosen < len(place)]
            chosen = chosen[inside[chosen]]
            ids = [batch.column(k).to_numpy()[text[chosen]] for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(chosen - bounds[text[chosen]], pa.int64()), pa.array(digest[chosen].view(np.int64))], names=["doc", "row", "at", "digest"])

    return units.mapInArrow(run, "doc long, row long, at long, digest long")


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """The digest of the ``width`` words at each position."""
    out = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k] if len(out) else out
    return wordhash.mix(out)


def _around(units: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, row, at, digest): all stretches of LEAST_WORDS words that hold the window at one of ``places`` (doc, row, at), by their first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in wordhash.slices(whole, 1)):
            h, bounds = wordhash.words(batch.column(1))
            if len(h) < LEAST_WORDS:
                continue
            digest = rolling(h, LEAST_WORDS)
            lists = batch.column(3)
            text = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            at = lists.flatten().to_numpy() + bounds[text]
            first = np.maximum(at + WINDOW - LEAST_WORDS, bounds[text])
            last = np.minimum(at, bounds[text + 1] - LEAST_WORDS)
            first, last = first[first <= last], last[first <= last]
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, last + 1, -1)
            chosen = np.flatnonzero(np.cumsum(edge) > 0)
            text = np.searchsorted(bounds, chosen, "right") - 1
            ids = [batch.column(k).to_numpy()[text] for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(chosen - bounds[text], pa.int64()), pa.array(digest[chosen].view(np.int64))], names=["doc", "row", "at", "digest"])

    packed = held(places.groupBy("doc", "row").agg(F.collect_list("at").alias("places")))
    size = packed.agg(F.count(F.lit(1)), F.sum(F.size("places"))).first()
    rows = units.join(broadcast_if(packed.select("doc", "row"), size[0]), ["doc", "row"], "left_semi")
    rows = rows.join(broadcast_if(packed, size[1] or 0, 500_000), ["doc", "row"])
    return rows.select("doc", "text", "row", "places").mapInArrow(run, "doc long, row long, at long, digest long")


#: Places of a window from which they are dealt over so many salts.
HOT_PLACES, SALTS = 10_000, 32


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc, at, n_words, keeper): the maximal stretches of each document whose every LEAST_WORDS words stand in another document too.

    A stretch ends where the smallest document that has its LEAST_WORDS words changes; stretches of different
    keepers may overlap.  Windows that follow one another both here and in one other document prove all words
    between them; the LEAST_WORDS words at the ends of such a run are looked up wherever its end windows stand.
    """
    units = _ids(docs)
    area = new_area(docs.sparkSession, "passages")
    found = write_table(windows(units), f"{area}/windows")
    shared = found.groupBy("digest").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last")).where("keeper <> last").select("digest")
    shared = write_table(shared, f"{area}/shared")
    hits = held(found.join(broadcast_if(shared, shared.count()), "digest", "left_semi").distinct())
    place = F.struct("doc", "row", "at")
    ends = held(hits.groupBy("digest").agg(F.min(place).alias("a"), F.max(place).alias("z"), (F.count(F.lit(1)) > HOT_PLACES).alias("hot")))
    # A window of many places is dealt over salts, its ends to each of them: those are two places, whatever their number.
    hot = ends.where("hot").select("digest", F.lit(True).alias("many"))
    salted = hits.join(broadcast_if(hot, hot.count()), "digest", "left").withColumn("salt", F.when(F.col("many"), F.pmod(F.xxhash64("doc", "row", "at"), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    # The same window in the smallest document, or, seen from there, in the largest.
    other = F.when(F.col("doc") == F.col("a.doc"), F.col("z")).otherwise(F.col("a"))
    paired = salted.join(ends.select("digest", "a", "z", F.explode(salts).alias("salt")), ["digest", "salt"]).select("doc", "row", "at", "digest", F.col("a.doc").alias("keeper"), other.alias("other"))
    paired = paired.select("doc", "row", "at", "digest", "keeper", F.col("other.doc").alias("doc2"), F.col("other.row").alias("row2"), (F.col("other.at") - F.col("at")).alias("shift"))
    order = Window.partitionBy("doc", "row").orderBy("at")
    new = F.lag("at").over(order).isNull() | (F.col("at") - F.lag("at").over(order) > WINDOW)
    for c in ("doc2", "row2", "shift"):
        new |= F.lag(c).over(order) != F.col(c)
    paired = paired.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(order)).withColumn("last", F.coalesce(F.lead("new").over(order), F.lit(True)))
    paired = write_table(paired.select("doc", "row", "at", "digest", "keeper", "run", (F.col("new") | F.col("last")).alias("end")), f"{area}/hits")
    hits.unpersist()
    ends.unpersist()
    inner = paired.groupBy("doc", "row", "run").agg(F.min("at").alias("at"), (F.max("at") + WINDOW - LEAST_WORDS).alias("to"), F.min("keeper").alias("keeper"))
    inner = inner.where("at <= to").select("doc", "row", "at", "to", "keeper")
    open_ = held(paired.where("end").select("digest").distinct())
    twins = paired.join(broadcast_if(open_, open_.count()), "digest", "left_semi").select("doc", "row", "at")
    around = write_table(_around(units, twins), f"{area}/around")
    both = held(around.groupBy("digest").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last")).where("keeper <> last").select("digest", "keeper"))
    proved = around.join(broadcast_if(both, both.count()), "digest").select("doc", "row", "at", F.col("at").alias("to"), "keeper")
    # Stretches by their first words, at to to: those that overlap or follow one another are one.
    order = Window.partitionBy("doc", "row", "keeper").orderBy("at", "to")
    apart = F.col("at") > F.coalesce(F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    runs = inner.unionByName(proved).withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc", "row", "keeper", "run").agg(F.min("at").alias("at"), (F.max("to") - F.min("at") + LEAST_WORDS).alias("n_words"))
    out = write_table(runs.select("doc", "at", "n_words", "keeper").distinct(), f"{area}/found")
    for done in (open_, both):
        done.unpersist()
    release(docs.sparkSession)
    return out


def substring_dedup(docs: DataFrame, *, words: int = 5, percent: int = 80, report: list | None = None) -> DataFrame:
    """Repeated stretches: doc_id, kind (paragraph or passage), position (line or word number), n_words or shingles, keep_id, removed."""
    lines = repeated_paragraphs(docs, words=words, percent=percent, report=report)
    lines = lines.select("doc", F.lit("paragraph").alias("kind"), F.col("line").alias("position"), F.col("n").alias("size"), "keeper")
    inner = repeated_passages(docs).select("doc", F.lit("passage").alias("kind"), F.col("at").alias("position"), F.col("n_words").alias("size"), "keeper")
    both = lines.unionByName(inner)
    return both.select(
        F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), "kind", "position", "size",
        F.when(F.col("keeper") != _NO_ID, F.col("keeper")).alias("keep_id"), (F.col("doc") != F.col("keeper")).alias("removed"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
