"""Line dedup by a segment-partition edit join.

Two lines within ``errors`` edits (code points inserted, deleted or replaced)
have one of ``errors + 1`` segments in common: cut the shorter line into that
many even segments, then one of them stands unchanged in the longer line, not
far from its own place. Segments of every line go into an index by length,
segment number and content. A line probes the index for its own length and for
up to ``errors`` less, with the substrings whose place leaves enough edits for
the text on either side. Lines that meet are compared by a banded bit-parallel
edit distance. A line with less than two code points per segment is a copy of
equal lines only: two edits turn most such lines into any other.

Every distinct line is one entry however often it stands in the corpus, so a
line of a third of all documents is no group of pairs. A bitmap of the index
drops most probes before the shuffle; the join is on the segments themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, Rolling, bitmap, columns, filled, may_hold, mix64, slices, stored
from .components import components

ERRORS, LEAST = 2, 24
INDEX_LOG, INDEX_MARKS = 27, 2


class Lines:
    """The lines of some texts as code points: text, number, bounds and name of each."""

    def __init__(self, texts: list[str], least: int):
        # a surrogate can't be in a Spark string; one line feed stands between texts
        self.codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), "<u4")
        ends = np.append(np.flatnonzero(self.codes == 10), len(self.codes))
        start = np.concatenate([[0], ends[:-1] + 1])
        many = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
        of = np.repeat(np.arange(len(texts)), many)
        number = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        self.all_of = of
        long = ends - start >= least
        self.of, self.number, self.start, self.end = of[long], number[long], start[long], ends[long]
        self.size = self.end - self.start
        self.name = np.array([int.from_bytes(hashlib.blake2b(
            self.codes[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
            for a, b in zip(self.start.tolist(), self.end.tolist())], np.int64)
        self.rolling = Rolling(self.codes.astype(U64))
        # bit k of a line: whether code points of class k come up an odd number of times
        odd = np.concatenate([np.zeros(1, U64), np.bitwise_xor.accumulate(U64(1) << (mix64(self.codes.astype(U64)) >> U64(58)))])
        self.odd = (odd[self.end] ^ odd[self.start]).view(np.int64)

    def keep(self, at: np.ndarray) -> None:
        """Go on with some of the lines only."""
        for part in ("of", "number", "start", "end", "size", "name", "odd"):
            setattr(self, part, getattr(self, part)[at])

    def key(self, at: np.ndarray, width: np.ndarray, size: np.ndarray, segment: int) -> np.ndarray:
        own = self.rolling.of(at, at + width)
        return mix64(own + mix64(size.astype(U64) * U64(64) + U64(segment))).view(np.int64)

    def index(self, errors: int) -> tuple[np.ndarray, np.ndarray]:
        """Which lines have segments, and a row for each of these with the key of every segment."""
        some = self.size >= shortest(errors)
        start, size = self.start[some], self.size[some]
        return some, np.column_stack([self.key(start + first, width, size, i) for i, first, width in _segments(size, errors)])

    def probes(self, errors: int):
        """(line, key) of all other substrings that may be a segment of a line of the same size or a shorter one."""
        for less in range(errors + 1):
            size = self.size - less
            for i, first, width in _segments(size, errors):
                low = max(-i, less - (errors - i))
                high = min(i, less + (errors - i))
                for shift in range(low, high + 1):
                    if less == 0 and shift == 0:
                        continue  # the line's own segment, which is in the index
                    at = first + shift
                    fits = np.flatnonzero((at >= 0) & (at + width <= self.size) & (size >= shortest(errors)))
                    yield fits, self.key(self.start[fits] + at[fits], width[fits], size[fits], i)


def shortest(errors: int) -> int:
    """Code points of the shortest line that has segments, two for each."""
    return 2 * (errors + 1)


def _segments(size: np.ndarray, errors: int):
    """Number, first place and width of even segments; the later ones are the longer."""
    parts = errors + 1
    for i in range(parts):
        first, end = i * size // parts, (i + 1) * size // parts
        yield i, first, end - first


def within(a: list[np.ndarray], b: list[np.ndarray], errors: int) -> np.ndarray:
    """Which pairs are within ``errors`` edits: a bit-parallel edit distance, all pairs at once.

    A word holds the vertical differences of the band around the diagonal, its
    top bit stands for the band's last row and one column of all pairs is worked
    off per step. The distance is followed down the band's edge to the last row
    and then along that row.
    """
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    near = (np.abs(m - n) <= errors) & (m > errors)
    out = np.zeros(len(m), bool)
    for i in np.flatnonzero((np.abs(m - n) <= errors) & (m <= errors)).tolist():
        out[i] = _plain(a[i].tolist(), b[i].tolist()) <= errors
    order = np.flatnonzero(near)
    order = order[np.argsort(n[order], kind="stable")]
    while len(order):
        count = max(1, min(len(order), (1 << 20) // int(n[order[min(len(order), 4096) - 1]] + 1), 4096))
        out[order[:count]] = _band([a[i] for i in order[:count]], [b[i] for i in order[:count]], errors)
        order = order[count:]
    return out


def _plain(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _band(a: list, b: list, errors: int) -> np.ndarray:
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, width = len(a), 2 * errors + 1
    first = np.full((rows, max(m.max(), n.max()) + width), -1, np.int32)
    second = np.full((rows, n.max()), -2, np.int32)
    for i in range(rows):
        first[i, errors:errors + m[i]] = a[i]
        second[i, :n[i]] = b[i]
    first, second = np.ascontiguousarray(first.T), np.ascontiguousarray(second.T)
    one, bits = U64(1), U64(63)
    up = np.full(rows, ((1 << (errors + 1)) - 1) << (63 - errors), U64)
    down = np.zeros(rows, U64)
    edge = np.full(rows, 1 << 62, U64)
    score = np.full(rows, errors)
    for j in range(int(n.max())):
        same = np.zeros(rows, U64)
        for r in range(width):
            same |= (first[j + r] == second[j]).astype(U64) << U64(63 - 2 * errors + r)
        diagonal = (((same & up) + up) ^ up) | same | down
        right = down | ~(diagonal | up)
        left = diagonal & up
        sloping, along = j < m - errors, (j >= m - errors) & (j < n)
        score += sloping & ((diagonal >> bits) == 0)
        score += (along & ((right & edge) != 0)).astype(int) - (along & ((left & edge) != 0))
        edge = np.where(along, edge >> one, edge)
        shifted = diagonal >> one
        up, down = left | ~(shifted | right), right & shifted
    return score <= errors


def _batches(batch):
    texts = filled(batch.column("text"))
    for low, high in slices(texts):
        yield low, high, texts.slice(low, high - low).to_pylist()


def _occurrences(errors: int, least: int):
    def rows(batches):
        for batch in batches:
            for low, high, texts in _batches(batch):
                lines = Lines(texts, least)
                some, keys = lines.index(errors)
                ends = np.searchsorted(lines.of, np.arange(high - low + 1)).astype(np.int32)
                totals = np.bincount(lines.all_of, minlength=high - low)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(some) * (errors + 1)]).astype(np.int32)), pa.array(keys.ravel()))
                entry = pa.StructArray.from_arrays(
                    [pa.array(lines.number, pa.int32()), pa.array(lines.name), pa.array(lines.odd), flat],
                    ["number", "line", "odd", "keys"])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(low, high - low), pa.array(totals, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), entry)], ["id", "n_lines", "lines"])

    return rows


def _probe_rows(errors: int, least: int, bits):
    def rows(batches):
        for batch in batches:
            for _, _, texts in _batches(batch):
                lines = Lines(texts, least)
                lines.keep(np.unique(lines.name, return_index=True)[1])
                for at, keys in lines.probes(errors):
                    some = may_hold(bits.value, keys, INDEX_LOG, INDEX_MARKS)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[some]), pa.array(lines.name[at[some]]), pa.array(lines.odd[at[some]])],
                        ["key", "line", "odd"])

    return rows


def _line_texts(least: int, bits):
    def rows(batches):
        for batch in batches:
            for _, _, texts in _batches(batch):
                lines = Lines(texts, least)
                lines.keep(np.unique(lines.name, return_index=True)[1])
                lines.keep(np.flatnonzero(may_hold(bits.value, mix64(lines.name.view(U64)))))
                found = [lines.codes[a:b].tobytes() for a, b in zip(lines.start.tolist(), lines.end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(lines.name), pa.array(found, pa.binary())], ["line", "codes"])

    return rows


def _name_hashes(batches):
    for batch in batches:
        names = batch.column("line").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(mix64(names.view(U64)).view(np.int64))], ["h"])


def _near_rows(errors: int):
    def rows(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(c)] for c in ("ca", "cb"))
            yield batch.select(["a", "b"]).filter(pa.array(within(a, b, errors), pa.bool_()))

    return rows


class LineDuplicates:
    """The stages of the join; ``links`` gives all pairs of distinct lines, ``report`` a row per document.

    A line is what stands between line feeds, taken as it is. Lines of fewer
    than ``least`` code points take no part; 1 leaves out empty lines only. Lines
    of fewer than ``shortest(errors)`` code points have copies but no links.
    Lines are named by 64 bits of a cryptographic digest. Of the lines that hang together by links, copies
    included, the one in the document with the least id stays, the first there;
    null ids come last.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", *, errors: int = ERRORS, least: int = LEAST):
        if least < 1:
            raise ValueError("an empty line is no copy")
        self.errors, self.least = errors, max(least, shortest(errors))
        self.rows = columns(docs, id=id, text=text).select(F.col("id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
        schema = "id bigint, n_lines bigint, lines array<struct<number:int,line:bigint,odd:bigint,keys:array<bigint>>>"
        self.docs = stored(self.rows.mapInArrow(_occurrences(errors, least), schema).withColumn(
            "row", F.monotonically_increasing_id()), "line-docs")

    def _broadcast(self, bits):
        return self.rows.sparkSession.sparkContext.broadcast(bits)

    def candidates(self) -> DataFrame:
        """Pairs of lines that share a segment and may be within the edits.

        An edit changes the parity of at most two classes of code points, so
        most lines that are alike in a segment only are never paired.
        """
        index = self.docs.select(F.explode("lines").alias("l")).select(F.explode("l.keys").alias("key"), "l.line", "l.odd")
        bits = self._broadcast(bitmap(index, "key", INDEX_LOG, INDEX_MARKS))
        probes = self.rows.select("text").mapInArrow(
            _probe_rows(self.errors, self.least, bits), "key bigint, line bigint, odd bigint")
        # one shuffle by key serves the removal of copies and the join
        entries = index.withColumn("own", F.lit(True)).union(probes.withColumn("own", F.lit(False)))
        entries = entries.repartition("key").groupBy("key", "line", "odd").agg(F.max("own").alias("own"))
        several = entries.groupBy("key").agg(F.count("*").alias("many"), F.max("own").alias("some")).where("many > 1 and some")
        entries = stored(entries.join(several.select("key"), "key"), "line-entries")
        left = entries.where("own").select("key", F.col("line").alias("a"), F.col("odd").alias("odd_a"))
        right = entries.select("key", F.col("line").alias("b"), F.col("odd").alias("odd_b"), "own")
        near = F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2 * self.errors
        either = (F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & ~F.col("own"))
        pairs = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & near & either)
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def links(self) -> DataFrame:
        """(a, b): every pair of distinct lines within the edits."""
        pairs = stored(self.candidates(), "line-pairs")
        names = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct()
        bits = self._broadcast(bitmap(names.mapInArrow(_name_hashes, "h bigint"), "h"))
        texts = self.rows.select("text").mapInArrow(_line_texts(self.least, bits), "line bigint, codes binary")
        texts = stored(texts.join(names, "line").dropDuplicates(["line"]), "line-texts")
        both = pairs.join(texts.toDF("a", "ca"), "a").join(texts.toDF("b", "cb"), "b")
        return stored(both.select("a", "b", "ca", "cb").mapInArrow(_near_rows(self.errors), "a bigint, b bigint"), "line-links")

    def report(self) -> DataFrame:
        """One row per document: doc_id, n_lines, n_links, n_dropped, dropped.

        ``n_lines`` counts the lines of the text (an empty or null one is one
        empty line), ``n_links`` the links of its lines to other distinct lines,
        ``dropped`` lists the numbers, from 0, of the lines that go. Rows that
        share an id are separate documents; an empty table gives no rows.
        """
        links = self.links()
        degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("links")).toDF("line", "links")
        label = components(links.toDF("u", "v")).toDF("line", "label")
        place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "number")
        seen = self.docs.select("id", "row", F.explode("lines").alias("l")).select("id", "row", "l.number", "l.line")
        # a line by itself needs no more than this count
        lines = seen.groupBy("line").agg(F.count("*").alias("copies"), F.min(place).alias("first"))
        lines = lines.join(degree, "line", "left").where("copies > 1 or links is not null").join(label, "line", "left")
        lines = stored(lines.withColumn("label", F.coalesce("label", "line")), "line-classes")
        stays = lines.groupBy("label").agg(F.min("first").alias("stays"))
        lines = lines.join(stays, "label").select("line", F.coalesce("links", F.lit(0)).alias("links"),
                                                  F.col("stays.row").alias("stays_row"), F.col("stays.number").alias("stays_number"))
        gone = ~((F.col("row") == F.col("stays_row")) & (F.col("number") == F.col("stays_number")))
        found = seen.select("row", "number", "line").join(lines, "line").groupBy("row").agg(
            F.sum("links").alias("n_links"), F.array_sort(F.collect_list(F.when(gone, F.col("number")))).alias("dropped"))
        out = self.docs.select("id", "row", "n_lines").join(found, "row", "left")
        dropped = F.coalesce("dropped", F.array().cast("array<int>"))
        return out.select(F.col("id").alias("doc_id"), "n_lines", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                          F.size(dropped).cast("bigint").alias("n_dropped"),
                          F.array_join(dropped.cast("array<string>"), ",").alias("dropped"))
