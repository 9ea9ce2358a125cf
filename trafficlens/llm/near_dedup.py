"""Near-duplicate documents from bottom-k sketches of one hash function.

Every set of word shingles keeps its ``KEPT`` least hashes, a smaller set keeps
all of them; equal sets are one class from then on. Inverted lists of the
retained values generate candidate pairs, the sketch of the union estimates
their similarity, and the full sets of those that may be similar enough decide.
Where both sketches are whole sets, the sketch of the union is exact.

Sketches of similar sets share at least a known number of values: the exact
bound if both are whole, otherwise ``LEAST_SHARED``. With all values in one
order, the rarest first, the first value they share has at least that many in
either sketch from its place on. So only the front of each sketch stands in the
lists, a pair is only made where both places leave enough room, and the smaller
set of a pair only needs its very front: values that many unlike documents have
in common seldom stand there.

A list of many members is worked off in two rounds, without pairing all of
them: first every member is compared with one hub, the most typical of the list;
the links found join most of a group of copies. Then members of different
components that still share a list are compared. Pairs inside a component need
no comparison.

Where both sets have up to ``KEPT`` shingles the lists miss nothing; otherwise a
pair of similarity 0.8 is missed with a chance below 1e-9.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import U64, Rolling, bitmap, columns, discard, filled, may_hold, slices, stored, utf8, word_bounds
from .components import components

KEPT = 256
#: Values that two sketches of 256 share at similarity 0.8, but for less than one time in 1e9: a binomial's lower tail.
LEAST_SHARED = 163
PERCENT = 80
#: Values that a row of a list knows of those before it.
EARLIER = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BODY = np.ones(256, bool)
_BODY[[32, 9, 10, 11, 12, 13]] = False


def shingle_sets(texts: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text."""
    raw, at = utf8(texts)
    data = _LOWER[raw]
    start, end, first, _ = word_bounds(_BODY[data], at)
    words = Rolling(Rolling(data.astype(U64)).of(start, end))
    every = words.every(width).view(np.int64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(every[a:b - width + 1])
        elif b > a:
            yield words.of(np.array([a]), np.array([b])).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _profiles(width: int):
    def rows(batches):
        for batch in batches:
            texts = filled(batch.column("text"))
            for low, high in slices(texts):
                sizes, digests, kept = [], [], []
                for values in shingle_sets(texts.slice(low, high - low), width):
                    sizes.append(len(values))
                    digests.append(_digest(values))
                    kept.append(values[:KEPT])
                ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(low, high - low), pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()), pa.ListArray.from_arrays(
                        pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *kept])))],
                    ["id", "n", "digest", "sketch"])

    return rows


def _sets(width: int, bits):
    def rows(batches):
        for batch in batches:
            some = np.flatnonzero(may_hold(bits.value, batch.column("h").to_numpy()))
            texts = filled(batch.column("text")).take(pa.array(some))
            for low, high in slices(texts):
                values = list(shingle_sets(texts.slice(low, high - low), width))
                yield pa.RecordBatch.from_arrays([
                    pa.array([_digest(v) for v in values], pa.binary()),
                    pa.array([v.tobytes() for v in values], pa.binary())], ["digest", "values"])

    return rows


def _similar(percent: int):
    def rows(batches):
        for batch in batches:
            yes = []
            for a, b in zip(batch.column("va"), batch.column("vb")):
                a, b = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                yes.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return rows


class NearDuplicates:
    """The stages of the search; ``links`` gives the confirmed pairs, ``groups`` a row per document."""

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", *, width: int = 4, percent: int = PERCENT):
        if percent < PERCENT:
            raise ValueError("the sketches are made for a similarity of 0.8 or more")
        self.width, self.percent = width, percent
        self.rows = columns(docs, id=id, text=text).select(F.col("id").cast("bigint"), "text")
        profile = stored(self.rows.mapInArrow(
            _profiles(width), "id bigint, n bigint, digest binary, sketch array<bigint>"), "near-profile")
        classes = profile.where("n > 0 and id is not null").groupBy("digest").agg(
            F.min("id").alias("node"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
        self.classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "*"), "near-classes")
        self.tables = [self.classes]
        self.profile = self._stored(profile.select("id", "n", "digest"), "near-members")
        discard(profile)  # from here on only the classes need sketches

    def _stored(self, df: DataFrame, purpose: str) -> DataFrame:
        self.tables.append(stored(df, purpose))
        return self.tables[-1]

    def discard(self) -> None:
        """Delete the working tables; for callers that have written what they need of the result."""
        discard(*self.tables)
        self.tables = []

    def _least(self, n, m) -> Column:
        """Values that the sketches of two similar sets of n and m shingles share at least."""
        exact = F.ceil((n + m) * self.percent / (100 + self.percent))
        return F.when(F.greatest(n, m) <= KEPT, exact).otherwise(F.lit(LEAST_SHARED)).cast("bigint")

    def lists(self) -> DataFrame:
        """Inverted lists of the rarest retained values: value, class, n, rest, earlier, weight.

        ``rest`` counts the values of the sketch from this one on; ``earlier``
        are the last ones before it that have lists.
        """
        n = F.col("n")
        values = self.classes.select("class", "n", F.explode("sketch").alias("value"))
        common = values.groupBy("value").agg(F.count("*").alias("many")).where("many > 1")
        own = values.join(common, "value").groupBy("class", "n").agg(
            F.array_sort(F.collect_list(F.struct("many", "value"))).alias("own"))
        # no partner is smaller than n * percent / 100, or larger than n * 100 / percent
        least = F.least(self._least(n, F.ceil(n * self.percent / 100)),
                        F.when(n * 100 > KEPT * self.percent, LEAST_SHARED).otherwise(n))
        weight = F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + x.many)
        # values that no other class retained come first in the order and need no list
        def entry(x, i):
            before = F.slice("own", F.greatest(i - EARLIER + 1, F.lit(1)), F.least(i, F.lit(EARLIER)))
            return F.struct(x.value.alias("value"), (F.size("own") - i).cast("bigint").alias("rest"),
                            before.getField("value").alias("earlier"))

        front = F.filter(F.transform("own", entry), lambda x: x.rest >= least)
        rarest = own.select("class", "n", weight.alias("weight"), F.explode(front).alias("x"))
        return self._stored(rarest.select("x.value", "class", "n", "x.rest", "x.earlier", "weight"), "near-lists")

    def _fits(self) -> Column:
        """Whether sets (n, rest) and (m, rest_m) may be similar, by their sizes and the room that a shared value leaves."""
        n, m = F.col("n"), F.col("m")
        near = F.least(n, m) * 100 >= F.greatest(n, m) * self.percent
        return near & (F.least("rest", "rest_m") >= self._least(n, m))

    def _pairs(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _fronts(self, lists: DataFrame) -> DataFrame:
        """The rows of sets that may be the smaller one of a pair."""
        return lists.where(F.col("rest") >= F.when(F.col("n") * 100 > KEPT * self.percent, LEAST_SHARED).otherwise(
            self._least(F.col("n"), F.col("n"))))

    def to_hubs(self, lists: DataFrame) -> DataFrame:
        """Pairs of every member with the hub of its list: the heaviest of those that may be the smaller set."""
        hubs = self._fronts(lists).groupBy("value").agg(F.max(F.struct("weight", "class", "n", "rest")).alias("hub"))
        hubs = hubs.select("value", F.col("hub.class").alias("b"), F.col("hub.n").alias("m"), F.col("hub.rest").alias("rest_m"))
        return self._pairs(lists.join(hubs, "value").where((F.col("class") != F.col("b")) & self._fits()).select(
            F.col("class").alias("a"), "b"))

    def across(self, lists: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame:
        """Pairs of different components that share a list and haven't been compared.

        One side is of the front that the smaller set needs. Where earlier
        values are seen to be shared too, the list of one of these makes the pair.
        """
        rows = lists.select("value", "class", "n", "rest", "earlier").join(labels, "class")
        # lists whose members are all of one component are done
        mixed = rows.groupBy("value").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed").select("value")
        rows = rows.join(mixed, "value")
        small = self._fronts(rows).select("value", F.col("class").alias("b"), F.col("n").alias("m"),
                                          F.col("rest").alias("rest_m"), F.col("earlier").alias("earlier_m"), F.col("label").alias("other"))
        ordered = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("class") > F.col("b")))
        pairs = rows.join(small, "value").where(
            (F.col("label") != F.col("other")) & ordered & self._fits() & ~F.arrays_overlap("earlier", "earlier_m"))
        return self._pairs(pairs.select(F.col("class").alias("a"), "b")).join(tested, ["a", "b"], "left_anti")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs that the sketch of their union does not rule out: a, b, sure (both sketches are whole sets)."""
        sketches = self.classes.select("class", "n", "sketch")
        both = pairs.join(sketches.toDF("a", "na", "sa"), "a").join(sketches.toDF("b", "nb", "sb"), "b")
        shared = F.array_intersect("sa", "sb")
        sure = F.greatest("na", "nb") <= KEPT
        union = F.col("na") + F.col("nb") - F.size(shared)
        # shared values up to the last one of the union's sketch
        least = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, KEPT)
        enough = F.size(F.array_intersect(least, shared)) >= LEAST_SHARED
        return both.where(F.when(sure, F.size(shared) * 100 >= union * self.percent).otherwise(enough)).select(
            "a", "b", sure.alias("sure"))

    def confirmed(self, pairs: DataFrame, purpose: str) -> DataFrame:
        """Pairs that are similar by their full sets: a, b. Sets that a sketch does not hold are built anew from the texts."""
        likely = self._stored(self.likely(pairs), f"near-likely-{purpose}")
        pairs = likely.where("not sure").select("a", "b")
        ids = pairs.select("a").union(pairs.select("b")).distinct().toDF("class")
        wanted = self.classes.join(ids, "class").select("class", "digest", "node")
        bits = self.rows.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("node").alias("h")), "h"))
        sets = self.rows.where("id is not null").withColumn("h", F.xxhash64("id")).mapInArrow(
            _sets(self.width, bits), "digest binary, values binary")
        sets = self._stored(sets.join(wanted.select("class", "digest"), "digest").dropDuplicates(["class"]).select(
            "class", "values"), f"near-sets-{purpose}")
        bits.unpersist()
        both = pairs.join(sets.toDF("a", "va"), "a").join(sets.toDF("b", "vb"), "b")
        links = both.select("a", "b", "va", "vb").mapInArrow(_similar(self.percent), "a bigint, b bigint")
        return self._stored(likely.where("sure").select("a", "b").union(links), f"near-links-{purpose}")

    def _edges(self, links: DataFrame) -> DataFrame:
        nodes = self.classes.select("class", "node")
        return links.join(nodes.toDF("a", "u"), "a").join(nodes.toDF("b", "v"), "b").select("u", "v")

    def labels(self, links: DataFrame) -> DataFrame:
        """(class, label): the least node that a class reaches."""
        found = components(self._edges(links))
        return self.classes.join(found, "node", "left").select("class", F.coalesce("component", "node").alias("label"))

    def links(self) -> DataFrame:
        """Confirmed pairs of classes, enough of them to connect all that are connected."""
        lists = self.lists()
        first = self._stored(self.to_hubs(lists), "near-hub-pairs")
        links = self.confirmed(first, "hubs")
        rest = self.across(lists, self._stored(self.labels(links), "near-labels"), first)
        return links.union(self.confirmed(rest, "across"))

    def groups(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id, kept.

        Texts without words have no shingles, link with nothing and stay, as
        does a row without id, whose component_id is null. Rows that share an
        id are one document. An empty table gives no rows.
        """
        labels = self.classes.join(self.labels(self.links()), "class").select("digest", "label")
        out = self.profile.select("id", "n", "digest").join(labels, "digest", "left")
        label = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("label")).otherwise(F.col("id"))
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), label.alias("component_id"),
                          F.coalesce(label == F.col("id"), F.lit(True)).alias("kept"))
