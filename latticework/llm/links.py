"""Links between similar texts and the components they make, without listing all pairs of a group.

Candidates come as postings: (token, grp, n, pos), where texts that may be similar share a token.  Each
star round lets every token's most central group (by size class) stand for the token: its
pivot member is compared with the members of those other groups that share most tokens with it, so a
round has no more pairs than there are members.  Verified links contract components; what remains are pairs whose components still
differ.  Their number is computed without listing them, and star rounds go on with other pivots while it
is large.  A last round verifies every remaining pair, so no link between components is
ever missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import broadcast_if, delete_path, held, new_area, release, write_table


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over the undirected ``edges`` (a, b).

    Alternating large and small stars; every step is an aggregation of minima and a join with one row an
    id, and ends in a written table.
    """
    spark = edges.sparkSession
    area = new_area(spark, "components")
    now = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{area}/0")
    step, mark = 0, None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
        small = small.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        now = write_table(small, f"{area}/{step}")
        if step > 1:
            delete_path(spark, f"{area}/{step - 1}")
    members = now.groupBy("a").agg(F.min("b").alias("b"))
    return members.select(F.col("a").alias("id"), F.col("b").alias("component"))


def jaccard_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets (id, members) have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            held: tuple = (None, None)
            for i, (left, right) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                raw = left.as_buffer()
                x = held[1] if held[0] is not None and held[0].equals(raw) else np.frombuffer(raw, np.uint64)
                held = (raw, x)
                y = np.frombuffer(right.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, hints: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that histograms (id, n, cells) do not rule out: nothing that links is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            whole = np.array([bool(p) and bool(q) for p, q in zip(x, y, strict=True)], bool)
            keep = np.ones(len(batch), bool)
            if whole.any():
                at = np.flatnonzero(whole)
                left, right = (np.frombuffer(b"".join(c[i] for i in at), np.uint8).reshape(len(at), -1) for c in (x, y))
                most = np.minimum(left, right).sum(axis=1, dtype=np.int64)
                total = left.sum(axis=1, dtype=np.int64) + right.sum(axis=1, dtype=np.int64)
                keep[at] = most * (100 + percent) >= percent * total
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left = hints.select(F.col("id").alias("a"), F.col("cells").alias("x"))
    right = hints.select(F.col("id").alias("b"), F.col("cells").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


class LinkSearch:
    """Star rounds and the closing round over one set of postings.

    postings: token, grp, n (set size), pos (place of the token in the group's order, or null where
    order says nothing), central, and, where given, earlier: the group's tokens before this one, so that a pair
    that shares several tokens is met at the first alone; marks: the counts of a small histogram of the set, so that
    pairs which it rules out never leave the join.  members: grp, id.  sets_of(ids) gives (id, members) of the named ids;
    hints (id, cells) their histograms.
    """

    def __init__(self, postings: DataFrame, members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], hints: DataFrame, percent: int, *, area: str | None = None, star_rounds: int = 6, close_factor: float = 20, close_pairs: int = 50_000) -> None:
        self.spark = postings.sparkSession
        self.area = area or new_area(self.spark, "links")
        self.percent, self.sets_of, self.members, self.hints = percent, sets_of, members, hints
        self.star_rounds, self.close_factor, self.close_pairs = star_rounds, close_factor, close_pairs
        self.marked = "marks" in postings.columns
        for name, kind in (("earlier", "array<long>"), ("marks", "array<smallint>")):
            postings = postings if name in postings.columns else postings.withColumn(name, F.lit(None).cast(kind))
        self.postings = postings
        self.links: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.report: list[tuple[str, int]] = []

    def _may_link(self, pa_: str, na: str, pb: str, nb: str):
        """Size filter, and the position filter where positions are given."""
        p = self.percent
        size = (F.least(na, nb) * 100 >= F.greatest(na, nb) * p)
        rest = F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb))
        return size & (F.col(pa_).isNull() | F.col(pb).isNull() | (rest * (100 + p) >= (F.col(na) + F.col(nb)) * p))

    def _labels(self) -> DataFrame:
        """(grp, id, component) of all members now."""
        if self.links is None:
            return self.members.withColumn("component", F.col("id"))
        found = components(self.links)
        return self.members.join(found, "id", "left").select("grp", "id", F.coalesce("component", "id").alias("component"))

    def _verify(self, pairs: DataFrame, name: str, *, bounded: bool = False) -> int:
        """Tests new pairs (a, b) of ids and adds what holds to the links; gives the number tested.

        ``bounded``: histograms have been compared already, so only whole sets are left to compare.
        """
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = write_table(pairs, f"{self.area}/{name}-pairs")
        n = pairs.count()
        self.report.append((name, n))
        if n:
            left = held(pairs if bounded else possible(pairs, self.hints, self.percent))
            self.report.append((f"{name} possible", left.count()))
            ids = held(left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct())
            sets = held(self.sets_of(ids))
            sets.count()
            links = write_table(jaccard_links(left, sets, self.percent), f"{self.area}/{name}-links")
            for done in (sets, ids, left):
                done.unpersist()
            self.links = links if self.links is None else self.links.unionByName(links)
            self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        return n

    def _short(self):
        """Whether a posting lies in the shorter prefix that the smaller text of a linked pair must share a token in."""
        p = self.percent
        return F.col("pos").isNull() | ((F.col("n") - F.col("pos")) * (100 + p) >= 2 * p * F.col("n"))

    def _star(self, k: int, labels: DataFrame, postings: DataFrame) -> int:
        """One star round over the short prefixes: pivots by centrality first, then by a hash that differs from round to round."""
        size_class = F.floor(F.log("n") / float(np.log(100 / self.percent))) if self.percent < 100 else F.col("n")
        p = postings.where(self._short()).withColumn("size_class", size_class.cast("long"))
        rank = F.struct(F.col("central"), (-F.xxhash64("grp")).alias("h"), "grp", "n", "pos") if k == 0 else F.struct(F.xxhash64("grp", F.lit(k)).alias("h"), "grp", "n", "pos")
        pivots = p.groupBy("token", "size_class").agg(F.max(rank).alias("best")).select("token", "size_class", F.col("best.grp").alias("pivot"), F.col("best.n").alias("pn"), F.col("best.pos").alias("pp"))
        pivots = pivots.unionByName(pivots.withColumn("size_class", F.col("size_class") + 1))
        met = p.join(pivots, ["token", "size_class"]).where(self._may_link("pos", "n", "pp", "pn"))
        # Each group goes to the one pivot that it shares most tokens with; what this leaves open later rounds take up.
        met = met.groupBy("pivot", "grp").agg(F.count(F.lit(1)).alias("k")).groupBy("grp").agg(F.max(F.struct("k", "pivot")).alias("best")).select(F.col("best.pivot").alias("pivot"), "grp")
        lead = labels.groupBy("grp").agg(F.min(F.struct("id", "component")).alias("lead"))
        first = lead.select(F.col("grp").alias("pivot"), F.col("lead.id").alias("a"), F.col("lead.component").alias("ca"))
        pairs = met.join(first, "pivot").join(labels, "grp").where("ca <> component").select("a", F.col("id").alias("b"))
        return self._verify(pairs, f"star-{k}")

    def _open(self, labels: DataFrame) -> DataFrame:
        """Postings with each component that has a member in their group, and whether they lie in the short prefix.

        A group of one member that nothing has been linked to yet is its own component; only the others are looked up.
        """
        parts = labels.select("grp", "component").distinct()
        changed = write_table(parts.where("component <> grp").select("grp").distinct(), f"{self.area}/changed-{len(self.report)}")
        n = changed.count()
        plain = self.postings.join(broadcast_if(changed, n), "grp", "left_anti").withColumn("component", F.col("grp"))
        special = parts.join(broadcast_if(changed, n), "grp", "left_semi")
        looked = self.postings.join(broadcast_if(special, special.count()), "grp")
        columns = ["token", "grp", "component", "n", "pos", "central", "earlier", "marks"]
        return plain.select(columns).unionByName(looked.select(columns)).withColumn("short", self._short())

    @staticmethod
    def _left(open_: DataFrame) -> int:
        """How many pairs of postings the closing round would compare; counted, not listed."""
        by = open_.groupBy("token", "component").agg(F.count_if("short").cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
        by = by.groupBy("token").agg((F.sum("s") * F.sum("n") - F.sum(F.col("s") * F.col("n"))).alias("left"))
        return int(by.agg(F.sum("left")).first()[0] or 0)

    def run(self) -> DataFrame:
        """(id, component) of all members; links and tested pairs stay in the attributes of those names."""
        n_postings = self.postings.count()
        labels, left, before, open_ = self._labels(), 0, None, self.postings
        for k in range(self.star_rounds):
            tested = self._star(k, labels, open_.select("token", "grp", "n", "pos", "central").distinct() if k else open_) if n_postings else 0
            labels = write_table(self._labels(), f"{self.area}/labels-{k}")
            if k:
                delete_path(self.spark, f"{self.area}/labels-{k - 1}")
            open_ = self._open(labels)
            left = self._left(open_)
            self.report.append((f"left after star-{k}", left))
            release(self.spark)
            if not tested or left <= max(self.close_pairs, self.close_factor * n_postings) or before is not None and left > before / 2:
                break
            before = left
        if left:
            x = open_.where("short").select("token", F.col("grp").alias("ga"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("qa"), F.col("earlier").alias("ea"), F.col("marks").alias("ma"))
            y = open_.select("token", F.col("grp").alias("gb"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("qb"), F.col("earlier").alias("eb"), F.col("marks").alias("mb"))
            # The smaller text's short prefix meets the other's whole one; of equal sizes either would do, so one order is enough.
            ordered = (F.col("na") < F.col("nb")) & (F.col("ca") != F.col("cb")) | (F.col("na") == F.col("nb")) & (F.col("ca") < F.col("cb"))
            first = F.col("ea").isNull() | F.col("eb").isNull() | ~F.arrays_overlap("ea", "eb")
            most = F.aggregate(F.zip_with("ma", "mb", lambda u, v: F.least(u, v).cast("int")), F.lit(0), lambda u, v: u + v)
            within = F.col("ma").isNull() | F.col("mb").isNull() | (most * (100 + self.percent) >= (F.col("na") + F.col("nb")) * self.percent)
            met = x.join(y, "token").where(ordered & first & within & self._may_link("qa", "na", "qb", "nb")).select("ga", "ca", "gb", "cb").distinct()
            ma = labels.select(F.col("grp").alias("ga"), F.col("component").alias("ca"), F.col("id").alias("a"))
            mb = labels.select(F.col("grp").alias("gb"), F.col("component").alias("cb"), F.col("id").alias("b"))
            self._verify(met.join(ma, ["ga", "ca"]).join(mb, ["gb", "cb"]).select("a", "b"), "close", bounded=self.marked)
            labels = write_table(self._labels(), f"{self.area}/labels-close")
        return labels.select("id", "component")
