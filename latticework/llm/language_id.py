"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its hashed character n-grams (over lower-cased letters, any
run of other characters being one space); a linear layer and a softmax follow.  Embeddings and layer
are trained together by stochastic gradient descent in numpy on at most ``max_rows`` labelled
documents, chosen by a hash of identifier and text, an equal number of each language.  A share of those is left out of training; on it a
temperature is fitted to the scores, and the rejection bound is the score that all but ``reject`` of
its rightly labelled texts reach.  Prediction sums one embedding an n-gram; the layer comes once a text.

Edge cases: null text, or text without a letter, gives ``und`` with score 0 and is rejected; rows without lang or
text are never learned from; every label is learned, unless there are more labels
than ``max_rows`` (or than ``max_labels``, where given): then the most frequent; equal scores go to the label first in order; without any labelled row
every text is ``und``; one label alone is predicted with score 1; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.codepoints import SPACE, blocks, folded, folded_parts
from latticework.llm.common import bucket_of, table

UND = "und"
ORDERS = (2, 3, 4)
BUCKETS = 1 << 16


def ngrams(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each position (those past the end wrap to shorter ones)."""
    h = np.zeros(len(codes), np.uint32)
    for k in range(order):
        h *= np.uint32(0x01000193)
        h[: len(codes) - k] ^= codes[k:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(16)
    return (h + np.uint32(order * 7919)) & np.uint32(BUCKETS - 1)


def features(codes: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """For one text after another the buckets of all its n-grams."""
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        part = codes[a:z]
        part = part[part != 0]
        yield np.concatenate([ngrams(part, n)[: max(len(part) - n + 1, 1)] for n in ORDERS]) if len(part) else np.zeros(0, np.uint32)


#: Characters of short texts that are judged together: some 15 MB of scratch arrays a worker.
BLOCK = 100_000
#: Characters of a long text that are looked at together, n-grams whose sum is taken in single precision, and numbers of a slice of texts by labels.
PART, STRETCH, CELLS = 500_000, 4_096, 1 << 20


@dataclass
class LanguageModel:
    labels: list[str]
    embed: np.ndarray  # one row a bucket
    layer: np.ndarray  # one column a label
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def _summed(self, codes: np.ndarray, bounds: np.ndarray, carried: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum of embeddings, n-grams, letters) a text; those of n-grams that end among the first ``carried`` codes are left out.

        Stretches are measured from the beginning of their text, so its sum is the same whatever texts stand beside it.
        """
        long = np.flatnonzero(np.diff(bounds) > STRETCH)
        starts = np.sort(np.concatenate([bounds[:-1], *(np.arange(bounds[i] + STRETCH, bounds[i + 1], STRETCH) for i in long)]))
        first = np.searchsorted(starts, bounds[:-1])
        end = np.repeat(bounds[1:], np.diff(bounds))
        at = np.arange(len(codes))
        total = np.zeros((len(bounds) - 1, self.embed.shape[1]))
        count = np.zeros(len(bounds) - 1)
        for n in ORDERS:
            if len(codes) < n:
                continue
            whole = (at + n <= end) & (at + n > carried)  # no n-gram crosses into the next text
            rows = self.embed[ngrams(codes, n)]
            rows[~whole] = 0
            total += np.add.reduceat(np.add.reduceat(rows, starts, axis=0).astype(np.float64), first, axis=0)
            count += np.add.reduceat(whole, bounds[:-1], dtype=np.int64)
        return total, count, np.add.reduceat(codes != SPACE, bounds[:-1], dtype=np.int64)

    def best(self, texts: list[str | None], part: int = PART) -> tuple[np.ndarray, np.ndarray]:
        """(place of the best label, its probability) of each text; the probability is zero for texts without a letter.

        A text beyond ``part`` characters is summed part by part, and labels are compared in slices of texts, so what is held at once
        depends neither on the longest text nor on the number of labels.
        """
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0)
        total, count, letters = self._summed(*folded(["" if len(t or "") > part else t for t in texts]))
        for i, text in enumerate(texts):
            if len(text or "") > part:
                total[i], count[i], carry = 0, 0, np.zeros(0, np.uint32)
                for codes in folded_parts(text, part):
                    codes = np.concatenate([carry, codes])
                    if not len(codes):
                        continue
                    more, n, some = self._summed(codes, np.array([0, len(codes)]), len(carry))
                    total[i] += more[0]
                    count[i] += n[0]
                    letters[i] += some[0]
                    carry = codes[1 - max(ORDERS) :]
        mean = total / np.maximum(count, 1)[:, None]
        best, top = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        step = max(1, CELLS // max(1, len(self.labels)))
        for a in range(0, len(texts), step):
            part_of = mean[a : a + step]
            z = np.tile(self.bias.astype(np.float64), (len(part_of), 1))
            for d, row in enumerate(self.layer):  # the same sums in the same order, however many texts there are
                z += part_of[:, d, None] * row
            best[a : a + step] = z.argmax(axis=1)
            top[a : a + step] = 1 / np.exp((z - z.max(axis=1, keepdims=True)) / self.temperature).sum(axis=1)
        top[letters == 0] = 0
        return best, top


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max())
    return p / p.sum()


def train(rows: list[tuple[str, str]], *, dim: int = 16, epochs: int = 4, rate: float = 0.5, seed: int = 7, reject: float = 0.002) -> LanguageModel:
    """SGD over (text, lang) rows; each text is also shown as a short window, so that short texts are calibrated too."""
    labels = sorted({lang for _, lang in rows})
    place = {lang: i for i, lang in enumerate(labels)}
    rng = np.random.default_rng(seed)
    embed = (rng.normal(size=(BUCKETS, dim)) / dim).astype(np.float32)
    layer = np.zeros((dim, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    if len(labels) < 2:
        return LanguageModel(labels, embed, layer, bias)
    items: list[tuple[np.ndarray, np.ndarray, int, bool]] = []  # buckets, their shares, label, whether it is left out
    for k, (text, lang) in enumerate(rows):
        windows = [text]
        if len(text) > 120:
            at = int(rng.integers(len(text) - 60))
            windows.append(text[at : at + int(rng.integers(20, 120))])
        for w in windows:
            ids = next(features(*folded([w])))
            if len(ids) > len(ORDERS):
                unique, n = np.unique(ids, return_counts=True)
                items.append((unique, (n / n.sum()).astype(np.float32), place[lang], k % 5 == 0))
    learn, held = [x for x in items if not x[3]], [x for x in items if x[3]]
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            unique, weight, y, _ = learn[i]
            x = weight @ embed[unique]
            gradient = _softmax(x @ layer + bias)
            gradient[y] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = layer @ gradient
            layer -= step * np.outer(x, gradient)
            bias -= np.float32(0.1) * step * gradient
            embed[unique] -= (step * len(unique) ** 0.5) * weight[:, None] * back
            done += 1
    model = LanguageModel(labels, embed, layer, bias.astype(np.float64))
    if held:
        z = np.array([weight @ embed[unique] for unique, weight, _, _ in held]) @ layer + bias
        y = np.array([y for _, _, y, _ in held])
        grid = np.geomspace(0.05, 20, 60)

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

        model.temperature = float(min(grid, key=loss))
        s = z / model.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        right = p.argmax(axis=1) == y
        if right.any():
            model.reject_below = float(min(0.4, np.quantile(p.max(axis=1)[right], reject)))
    return model


def training_rows(docs: DataFrame, usable: Column, max_rows: int, max_labels: int | None = None) -> list[tuple[str, str]]:
    """At most ``max_rows`` (text, lang) rows: of each label the first of its usable rows by a hash of doc_id and text.

    Rows alike in doc_id, text and label are interchangeable, so the rows chosen never depend on their order.
    """
    labelled = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(min(max_rows, max_labels or max_rows)).collect()}
    if not counts:
        return []
    each = max(1, max_rows // len(counts))
    slot = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 20))
    # Some rows more than are wanted, by a bound on the hash, so that few reach the ranking; a label too rare for that keeps all its rows.
    bounds = [(lang, int((1 << 20) * min(1.0, (1.5 * each + 50) / n)) + 1) for lang, n in sorted(counts.items())]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("slot", "doc_id", "text"))
    found = labelled.join(wanted, "lang").where(slot < F.col("bound")).select("text", "lang", slot.alias("slot"), "doc_id").withColumn("place", place).where(F.col("place") <= each)
    rows = sorted(found.select("lang", "place", "text").collect(), key=lambda r: (r["lang"], r["place"]))
    return [(r["text"], r["lang"]) for r in rows]


def fit(docs: DataFrame, usable: Column, max_rows: int = 2400, max_labels: int | None = None) -> LanguageModel:
    """A model from the ``usable`` rows of ``docs`` (columns doc_id, text, lang); ``max_rows`` bounds the rows that the driver sees, ``max_labels`` the labels learned."""
    return train(training_rows(docs, usable, max_rows, max_labels))


def judged(model: LanguageModel, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``best`` of all texts, in blocks of about BLOCK characters."""
    for _, block in blocks(texts, BLOCK):
        yield model.best(block)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = spark.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, score, rejected = [], [], []
            column = batch.column(batch.schema.get_field_index("text"))
            if not m.labels:
                lang, score, rejected = [UND] * len(column), [0.0] * len(column), [True] * len(column)
                column = column[:0]
            for best, top in judged(m, column):
                lang += [m.labels[b] if t > 0 else UND for b, t in zip(best, top, strict=True)]
                score += top.tolist()
                rejected += (top < max(m.reject_below, 1e-12)).tolist()
            extra = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, bucket_of(F.col("doc_id"), 5) != 0)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op5_language_id": op5_language_id}
