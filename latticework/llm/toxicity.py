"""Toxicity: Levenshtein automata met with a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned: over all labelled training rows, words are counted in rows of either label, and
those with a high likelihood ratio for label 1 become terms with a smoothed log-odds weight.  The
terms form a trie; the Levenshtein automaton of distance ``DISTANCE`` over the whole trie is made
deterministic lazily, state by state, and run over all words of a block at once.  Exact terms need no
minimum length, misspelled ones five letters.  Each hit is scored by its window: marks of quotation
around it, words that report speech, or words that address someone.  A logistic layer over the window
scores, fitted on at most ``fit_rows`` training rows, gives the score.

Edge cases: null or empty text has no hit and gets the score of a text without hits; rows without a
label are not learned from; a doc_id labelled more than once counts as toxic if any label says so;
rows that repeat a labelled doc_id are all learned from, each by its own text, within ``fit_rows`` for the layer;
without a single label every score is 0; repeated rows are scored alike; other columns pass unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.codepoints import SPACE, blocks, folded_at
from latticework.llm.common import broadcast_if, bucket_of, staged, table

DISTANCE = 1
FUZZY_LETTERS = 5
WINDOW = 60
_WORD = re.compile(r"[^\W\d_]+")
#: Marks of quotation, and words of English, German, French and Spanish that report speech or address a reader.
_QUOTES = "\"'‘’“”«»„"
_REPORT = frozenset((
    "called calling quote quoted quotes said says saying term word wrote "
    "genannt nannte sagte sagt schrieb wort zitat zitiert zitierte "
    "appelé appelée cita citation cité disait écrit écrivait écrivit mot "
    "citado citó dice dicen dijo escribió llamado llamó palabra"
).split())
_ADDRESS = frozenset("you your yours yourself u ur dich dir euch euer dein deine toi vous votre vos usted ustedes vosotros contigo".split())


@dataclass
class Trie:
    """Lexicon trie, and the lazily determinised Levenshtein automaton over it."""

    terms: list[str]
    children: list[dict[int, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k, term in enumerate(self.terms):
            node = 0
            for c in map(ord, term):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.ends[node] = k
        letters = sorted({c for kids in self.children for c in kids})
        self.letters = {c: i + 1 for i, c in enumerate(letters)}
        self.code_of = [-1, *letters]
        self.classes = np.zeros(0x30000, np.int32)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.next = np.full((1024, self.width), -2, np.int32)
        self.sets: list[tuple[tuple[int, int], ...]] = []
        self.known: dict[tuple[tuple[int, int], ...], int] = {}
        self.accepts: list[tuple[int, int]] = []
        self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The number of the state that holds these trie nodes with their errors, closed under skipped letters."""
        todo = list(reached.items())
        while todo:
            node, errors = todo.pop()
            if errors < DISTANCE and reached[node] == errors:
                for child in self.children[node].values():
                    if reached.get(child, DISTANCE + 1) > errors + 1:
                        reached[child] = errors + 1
                        todo.append((child, errors + 1))
        if not reached:
            return -1
        key = tuple(sorted(reached.items()))
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            if len(self.sets) > len(self.next):
                self.next = np.vstack([self.next, np.full_like(self.next, -2)])
            ends = [(e, self.ends[n]) for n, e in key if n in self.ends and (e == 0 or len(self.terms[self.ends[n]]) >= FUZZY_LETTERS)]
            self.accepts.append(min(ends) if ends else (-1, -1))
        return self.known[key]

    def _step(self, state: int, letter: int) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= DISTANCE and errors < reached.get(node, DISTANCE + 1):
                reached[node] = errors

        for node, errors in self.sets[state]:
            exact = self.children[node].get(self.code_of[letter], -1)
            if exact >= 0:
                reach(exact, errors)
            if errors < DISTANCE:
                reach(node, errors + 1)
                for child in self.children[node].values():
                    reach(child, errors + 1)
        return self._state(reached)

    def match(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(errors, term) of each word's nearest term; -1 where none is near."""
        state = np.zeros(len(starts), np.int64)
        alive = np.arange(len(starts))
        errors, term = np.full(len(starts), -1), np.full(len(starts), -1)
        at = 0
        while len(alive):
            done = lengths[alive] == at
            for w in alive[done]:
                errors[w], term[w] = self.accepts[state[w]]
            alive = alive[~done]
            letters = self.classes[np.minimum(codes[starts[alive] + at], 0x30000 - 1)]
            after = self.next[state[alive], letters]
            if (after == -2).any():
                missing = np.unique(state[alive][after == -2] * self.width + letters[after == -2])
                for key in missing.tolist():
                    s, c = divmod(key, self.width)
                    value = self._step(s, c)
                    self.next[s, c] = value
                after = self.next[state[alive], letters]
            state[alive] = after
            alive = alive[after >= 0]
            at += 1
        return errors, term


@dataclass
class ToxicityModel:
    terms: list[str]
    weights: np.ndarray
    coefficients: np.ndarray | None = None
    base: float = 0.0

    def scorer(self) -> Scorer:
        return Scorer(self)


#: Features of a text, in order.
FEATURES = ("abuse weight", "abuse best", "abuse hits", "misspelled hits", "quoted hits", "quoted best", "addressed hits")


class Scorer:
    """A model ready to run in one task."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.trie = model, Trie(model.terms)

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(FEATURES)))
        if not self.model.terms or not texts:
            return out
        texts = [t or "" for t in texts]
        codes, bounds, source = folded_at(texts)
        letter = (codes != SPACE) & (codes != 0)
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        starts = np.flatnonzero(first)
        lengths = np.flatnonzero(last) + 1 - starts
        longest = max(map(len, self.model.terms)) + DISTANCE
        fit = lengths <= longest
        starts, lengths = starts[fit], lengths[fit]
        if not len(starts):
            return out
        errors, term = self._distinct(codes, starts, lengths)
        for k in np.flatnonzero(term >= 0):
            text = int(np.searchsorted(bounds, starts[k], "right")) - 1
            self._count(out[text], texts[text], int(source[starts[k]]), int(lengths[k]), int(errors[k]), float(self.model.weights[term[k]]))
        out[:, [0, 2, 3, 4, 6]] = np.log1p(out[:, [0, 2, 3, 4, 6]])
        return out

    def _distinct(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The automaton runs once for each distinct word of the block."""
        powers = np.ones(len(codes) + 1, np.uint64)
        powers[1:] = np.uint64(0x9E3779B97F4A7C15)
        np.multiply.accumulate(powers, out=powers)
        inverse = np.ones(len(codes) + 1, np.uint64)
        inverse[1:] = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        np.multiply.accumulate(inverse, out=inverse)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) * powers[:-1], out=sums[1:])
        h = (sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64)
        _, index, back = np.unique(h, return_index=True, return_inverse=True)
        errors, term = self.trie.match(codes, starts[index], lengths[index])
        return errors[back], term[back]

    def _count(self, row: np.ndarray, text: str, at: int, length: int, errors: int, weight: float) -> None:
        """Adds one hit, the word of ``length`` letters at ``at``, judged by the window around it."""
        before, after = text[max(0, at - WINDOW) : at].lower(), text[at + length : at + length + WINDOW].lower()
        near = set(_WORD.findall(before)) | set(_WORD.findall(after))
        quoted = bool(near & _REPORT) or (before.rstrip(" ")[-1:] in _QUOTES and after.lstrip(" ")[:1] in _QUOTES and before != "" and after != "") or _inside(before, after)
        if quoted:
            row[4] += 1
            row[5] = max(row[5], weight)
        else:
            row[0] += max(weight, 0)
            row[1] = max(row[1], weight * (1.0 if errors == 0 else 0.7))
            row[2] += errors == 0
            row[3] += errors > 0
            row[6] += bool(near & _ADDRESS)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        model = self.model
        if model.coefficients is None:
            return np.full(len(texts), model.base)
        x = np.column_stack([np.ones(len(texts)), self.features(texts)])
        return 1 / (1 + np.exp(-np.clip(x @ model.coefficients, -30, 30)))


def _inside(before: str, after: str) -> bool:
    """Between an opening and a closing mark of one quotation, in the window's own line."""
    before, after = before.rsplit("\n", 1)[-1], after.split("\n", 1)[0]
    for opening, closing in ("“”", "«»", "„“", '""'):
        if before.count(opening) % 2 == 1 and closing in after and (opening == closing or before.rfind(opening) > before.rfind(closing)):
            return True
    return False


#: Share of the training rows whose words make the lexicon on which the logistic layer is fitted by the others.
FOLD = 0.6


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, pos, neg, pos_a, neg_a) over all rows (text, toxic, first): in how many rows of either label, and of those with ``first``, each word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {(y, a): Counter() for y in (1, 0) for a in (False, True)}

        def flush() -> pa.RecordBatch:
            found = sorted(set().union(*counts.values()))
            columns = [[counts[y, True][w] + (0 if a else counts[y, False][w]) for w in found] for a in (False, True) for y in (1, 0)]
            for c in counts.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["word", "pos", "neg", "pos_a", "neg_a"])

        for batch in batches:
            for text, toxic, first in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts[toxic, first].update({w for w in _WORD.findall((text.as_py() or "").lower()) if len(w) >= 3})
                if sum(map(len, counts.values())) > 300_000:
                    yield flush()
        yield flush()

    counted = rows.select("text", "toxic", "first").mapInArrow(run, "word string, pos long, neg long, pos_a long, neg_a long")
    return counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "pos_a", "neg_a")))


def chosen_terms(counts: DataFrame, pos: str, neg: str, n_pos: int, n_neg: int, *, max_terms: int = 1500, min_rows: int = 3) -> tuple[list[str], np.ndarray]:
    """The at most ``max_terms`` words that speak most for label 1 (G statistic at least 12, at least five times as likely), with log odds."""
    p, n = F.col(pos), F.col(neg)
    odds = F.log(((p + 0.5) / (n_pos + 1.0)) / ((n + 0.5) / (n_neg + 1.0)))
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / ((p + n) * share))).otherwise(0.0)
    g = 2 * (part(p, n_pos / (n_pos + n_neg)) + part(n, n_neg / (n_pos + n_neg)))
    chosen = counts.where(p >= min_rows).select("word", odds.alias("weight"), g.alias("g"))
    chosen = chosen.where((F.col("weight") >= float(np.log(5))) & (F.col("g") >= 12))
    best = sorted((r["word"], r["weight"]) for r in chosen.orderBy(F.desc("g"), "word").limit(max_terms).collect())
    return [w for w, _ in best], np.array([x for _, x in best])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, *, fit_rows: int = 20_000) -> ToxicityModel:
    """Lexicon and logistic layer from the ``usable`` labelled rows."""
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20))
    labels = labels.where(usable & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    labels = labels.withColumn("first", F.coalesce(slot, F.lit(0)) < int(FOLD * (1 << 20))).withColumn("slot", slot)
    of = {(r["first"], r["toxic"]): r["count"] for r in labels.groupBy("first", "toxic").count().collect()}
    n_pos, n_neg = (of.get((True, y), 0) + of.get((False, y), 0) for y in (1, 0))
    if not n_pos + n_neg:
        return ToxicityModel([], np.zeros(0))
    base = n_pos / (n_pos + n_neg)
    if not n_pos or not n_neg:
        return ToxicityModel([], np.zeros(0), None, float(base))
    rows = docs.select("doc_id", "text").join(broadcast_if(labels, n_pos + n_neg), "doc_id")
    counts = staged(word_counts(rows).where("pos >= 2"), "toxic-words")
    model = ToxicityModel(*chosen_terms(counts, "pos", "neg", n_pos, n_neg), None, float(base))
    if not model.terms:
        return model
    # The layer is fitted on rows that had no say in its lexicon, so that it learns what a term is worth on new texts.
    first = (of.get((True, 1), 0), of.get((True, 0), 0))
    other = ToxicityModel(*chosen_terms(counts, "pos_a", "neg_a", *first)) if min(first) else model
    n_second = max(1, of.get((False, 1), 0) + of.get((False, 0), 0))
    shared = spark.sparkContext.broadcast(other)
    share = min(1.0, fit_rows / n_second)
    sample = rows.where(~F.col("first") & (F.col("slot") < int((1 << 20) * (FOLD + (1 - FOLD) * share)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            found = [scorer.features(texts) for _, texts in blocks(batch.column(0))]
            x = np.vstack(found) if found else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "toxic", "slot", "doc_id", "hash"])

    # The first rows by their labels' slots, in a fixed order: the bound holds where doc_ids repeat too.
    order = ["slot", "doc_id", "hash"]
    found = sample.select("text", "toxic", "slot", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash")).mapInArrow(run, "x array<double>, toxic int, slot long, doc_id long, hash long")
    got = found.orderBy(*order).limit(fit_rows).select("x", "toxic").collect()
    x = np.array([[1.0, *r["x"]] for r in got]).reshape(-1, len(FEATURES) + 1)
    if len(x):
        model.coefficients = logistic(x, np.array([r["toxic"] for r in got], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    order = np.lexsort(np.column_stack([x, y]).T)  # the same sums whatever order rows arrive in
    x, y = x[order], y[order]
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        change = np.linalg.solve(h, x.T @ (y - p) - penalty * b)
        b += change
        if np.abs(change).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            found = [scorer.scores(texts) for _, texts in blocks(batch.column(batch.schema.get_field_index("text")))]
            s = np.concatenate(found) if found else np.zeros(0)
            extra = [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, f"{fields}, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels, bucket_of(F.col("doc_id"), 4) != 2)
    out = score(docs, model)
    return out.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
