"""Removal of long byte strings that occur more than once.

A logarithmic family of sparse suffix arrays finds the places that can hold a
repeat, an exact count decides. Suffixes are sampled by content: of every
``length - depth + 1 - GRAM + 1`` neighbouring grams the least by hash, leftmost
on ties, marks a suffix, so a string of ``length`` bytes holds a marked suffix
with at least ``depth`` of its bytes to come, at the same place wherever the
string occurs. A suffix is represented by its first eight bytes and a digest of
its first ``depth``, and an array is sorted by them.

Documents arrive in batches. Each batch gets its array, which is merge-scanned
against the arrays of the family: suffixes that meet an equal one start a match
of ``depth`` bytes or more. Arrays of one size merge into the next level.

The strings that one suffix marks start side by side, at a run of places, and
equal strings are marked by equal suffixes. So runs are compared per suffix:
runs equal in whole by a hash of all their bytes, others with the most frequent
run of the suffix, extending the match to both sides. A place that is not
matched there can only match another such place; these are counted by a hash of
all bytes of their string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, Rolling, bitmap, columns, discard, filled, may_hold, mix64, slices, stored, utf8

LENGTH, DEPTH, GRAM, BATCHES = 200, 64, 16, 4
PLACE_BITS = 24
#: A longer text is worked off in parts that overlap.
PART = 1 << 22


class Family:
    """Sorted suffix tables (head, key), at most one per level; level i holds up to 2**i batches."""

    def __init__(self):
        self.levels: list[DataFrame | None] = []

    def add(self, batch: DataFrame) -> list[DataFrame]:
        """Take in (head, key, many); the tables of suffixes found more than once.

        Arrays that went into a larger one are deleted once that is written.
        """
        own = self._array(batch)
        found, level = [self._repeated(own)], 0
        for i, old in enumerate(self.levels):
            if old is None:
                continue
            if level == i:  # a full level: scan and merge in one pass, and carry
                merged = self._array(own.select("head", "key", F.lit(1).alias("many")).union(
                    old.select("head", "key", F.lit(1).alias("many"))))
                found.append(self._repeated(merged))
                discard(own, old)
                own, self.levels[i], level = merged, None, i + 1
            else:
                found.append(stored(own.join(old.select("head", "key"), ["head", "key"]).select("head", "key"), "matches"))
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = own
        return found

    @staticmethod
    def _repeated(array: DataFrame) -> DataFrame:
        return stored(array.where("many > 1").select("head", "key"), "matches")

    @staticmethod
    def _array(rows: DataFrame) -> DataFrame:
        """Equal suffixes joined, in suffix order over all files."""
        rows = rows.repartitionByRange("head", "key").groupBy("head", "key").agg(F.sum("many").alias("many"))
        return stored(rows.sortWithinPartitions("head", "key"), "suffixes")


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` neighbouring values."""
    n = len(values) - span + 1
    wide = np.full(-(-len(values) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    wide[:len(values)] = values
    blocks = wide.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], back[span - 1:span - 1 + n])


class Strings:
    """All strings of ``length`` bytes of some texts: where they start and the suffix that marks each."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, length: int, depth: int):
        self.raw, self.length, self.depth = raw, length, depth
        self.rolling = Rolling(raw.astype(U64))
        span = length - depth - GRAM + 2
        ends = np.repeat(at[1:], np.diff(at))
        start = np.flatnonzero(np.arange(len(raw)) + length <= ends)
        if not len(start):
            self.start = self.mark = start
            return
        low = U64(PLACE_BITS)
        grams = self.rolling.every(GRAM)
        keyed = (grams >> low << low) | np.arange(len(grams), dtype=U64)
        self.start = start
        self.mark = (_least(keyed, span)[start] & ((U64(1) << low) - U64(1))).astype(np.int64)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, head and key of each marked suffix."""
        new = np.ones(len(self.mark), bool)
        new[1:] = self.mark[1:] != self.mark[:-1]
        place = self.mark[new]
        head = np.zeros(len(place), np.int64)
        for i in range(8):
            head = (head << 8) | self.raw[place + i]
        return place, head ^ np.int64(-1 << 63), self.rolling.of(place, place + self.depth).view(np.int64)

    def runs(self) -> np.ndarray:
        """First and last string of each run of strings with one mark, as positions in ``start``."""
        cut = np.flatnonzero(self.mark[1:] != self.mark[:-1]) + 1
        return np.concatenate([[0], cut])[:len(self.start)], np.concatenate([cut, [len(self.mark)]])[:len(self.start) or 0] - 1

    def kinds(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of all bytes of each run, of its length and of the place of its suffix."""
        a, b = self.start[first], self.start[last] + self.length
        return mix64(self.rolling.of(a, b) + mix64((self.mark[first] - a).astype(U64))).view(np.int64)


def _parts(texts: pa.Array, length: int, depth: int):
    """(first text, strings, offsets, place of the first byte in its text) of slices and of parts of long texts.

    A part of a long text ends before its last run, with which the next begins.
    """
    for low, high in slices(texts):
        raw, at = utf8(texts.slice(low, high - low))
        if high - low > 1 or len(raw) <= PART:
            yield low, Strings(raw, at, length, depth), at, 0
            continue
        begin = 0
        while True:
            piece = raw[begin:begin + PART + length]
            strings, bounds = Strings(piece, np.array([0, len(piece)]), length, depth), np.array([0, len(piece)])
            if begin + len(piece) >= len(raw):
                yield low, strings, bounds, begin
                break
            left = int(np.searchsorted(strings.mark, strings.mark[-1]))
            strings.start, strings.mark, step = strings.start[:left], strings.mark[:left], int(strings.start[left])
            yield low, strings, bounds, begin
            begin += step


def _sha(texts: pa.Array) -> list[bytes]:
    raw, at = utf8(texts)
    data, at = memoryview(raw), at.tolist()
    return [hashlib.sha256(data[a:b]).digest() for a, b in zip(at, at[1:])]


def _names(digests: list[bytes]) -> np.ndarray:
    """Two longs of each digest."""
    return np.frombuffer(b"".join(d[:16] for d in digests), ">i8").reshape(-1, 2).astype(np.int64)


def _wanted(batch, bits):
    """The texts of a batch whose id and digest the bitmap holds, with their digests' two longs."""
    texts = filled(batch.column("text"))
    names = _names(_sha(texts)) if len(texts) else np.zeros((0, 2), np.int64)
    some = np.flatnonzero(may_hold(bits.value, _row_hash(batch.column("id"), names)))
    return texts.take(pa.array(some)), names[some], batch.column("id").take(pa.array(some))


def _row_hash(ids, names: np.ndarray) -> np.ndarray:
    ids = ids.fill_null(-1).to_numpy().astype(np.int64)
    return mix64(names[:, 0].view(U64) ^ mix64(ids.view(U64)))


def _hash_rows(batches):
    for batch in batches:
        names = np.column_stack([batch.column("d1").to_numpy(), batch.column("d2").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(_row_hash(batch.column("id"), names).view(np.int64))], ["h"])


def _suffix_rows(length: int, depth: int, batches_of: int, bits):
    def rows(batches):
        for batch in batches:
            texts, names, _ = _wanted(batch, bits)
            for low, strings, at, _ in _parts(texts, length, depth):
                place, head, key = strings.suffixes()
                own = names[low + np.searchsorted(at, place, "right") - 1, 0]
                table = pa.table({"batch": pa.array(own % batches_of, pa.int32()), "head": head, "key": key})
                table = table.group_by(["batch", "head", "key"]).aggregate([([], "count_all")])
                yield from table.rename_columns(["batch", "head", "key", "many"]).to_batches()

    return rows


def _run_rows(length: int, depth: int, bits, marks):
    """The runs of suffixes that the bitmap of matches holds."""
    def rows(batches):
        for batch in batches:
            texts, names, _ = _wanted(batch, bits)
            for low, strings, at, begin in _parts(texts, length, depth):
                key = strings.suffixes()[2]
                some = np.flatnonzero(may_hold(marks.value, key))
                first, last = (x[some] for x in strings.runs())
                start = strings.start[first]
                own = np.searchsorted(at, start, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(names[low + own, 0]), pa.array(names[low + own, 1]),
                    pa.array(start - at[own] + begin, pa.int64()), pa.array(last - first + 1, pa.int32()),
                    pa.array(key[some]), pa.array(strings.kinds(first, last))], ["d1", "d2", "start", "n", "key", "kind"])

    return rows


def _context_rows(length: int, depth: int, bits, kinds):
    """The bytes of the runs whose kind the bitmap holds, each kind once per slice."""
    def rows(batches):
        for batch in batches:
            texts, _, _ = _wanted(batch, bits)
            for _, strings, _, _ in _parts(texts, length, depth):
                key = strings.suffixes()[2]
                first, last = strings.runs()
                kind = strings.kinds(first, last)
                some = np.unique(kind, return_index=True)[1]
                some = some[may_hold(kinds.value, kind[some])]
                a, b = strings.start[first[some]], strings.start[last[some]] + length
                held = [strings.raw[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[some]), pa.array(kind[some]), pa.array(strings.mark[first[some]] - a, pa.int32()),
                    pa.array(held, pa.binary())], ["key", "kind", "at", "held"])

    return rows


def _aligned(held, at: np.ndarray, left: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes with their suffixes at column ``left``; 256 stands where a row has no byte. And the rows' sizes."""
    out = np.full((len(at), width), 256, np.int16)
    sizes = np.zeros(len(at), np.int64)
    for i, (x, a) in enumerate(zip(held, at.tolist())):
        x = np.frombuffer(x.as_buffer(), np.uint8)
        sizes[i] = len(x)
        out[i, left - a:left - a + len(x)] = x
    return out, sizes


def _compared(length: int, depth: int):
    """Runs against the most frequent run of their suffix: matched places of both, and hashes of the run's other places."""
    left = length - depth - GRAM + 2

    def pieces(batch):
        for low in range(0, batch.num_rows, 2000):
            yield batch.slice(low, 2000)

    def rows(batches):
        for batch in (p for b in batches for p in pieces(b)):
            at, hub_at = batch.column("at").to_numpy(), batch.column("hub_at").to_numpy()
            own, size = _aligned(batch.column("held"), at, left, left + length)
            hub, hub_size = _aligned(batch.column("hub_held"), hub_at, left, left + length)
            same = (own == hub) & (own < 256)
            before = np.where(same[:, :left].all(1), left, np.argmin(same[:, :left][:, ::-1], axis=1))
            after = np.where(same[:, left:].all(1), length, np.argmin(same[:, left:], axis=1))
            low, high = np.maximum(at - before, 0), np.minimum(at + after - length, size - length)
            shift = hub_at - at
            some = high >= low
            hashes, places = [], []
            for i, x in enumerate(batch.column("held")):
                rest = np.arange(size[i] - length + 1) if batch.column("kinds")[i].as_py() > 2 else np.zeros(0, int)
                if some[i]:
                    rest = rest[(rest < low[i]) | (rest > high[i])]
                places.append(rest)
                hashes.append(Rolling(np.frombuffer(x.as_buffer(), np.uint8).astype(U64)).of(rest, rest + length)
                              if len(rest) else np.zeros(0, U64))
            ends = np.cumsum([0, *map(len, places)]).astype(np.int32)
            flat = [np.concatenate([np.zeros(0, t), *x]) for x, t in ((places, int), (hashes, U64))]
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("kind"), batch.column("hub"),
                *[pa.array(np.where(some, x, -1), pa.int32()) for x in (low, high, low + shift, high + shift)],
                pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array(flat[0], pa.int32()), pa.array(flat[1].view(np.int64))], ["place", "h"]))],
                ["key", "kind", "hub", "low", "high", "hub_low", "hub_high", "rest"])

    return rows


def _text_rows(bits):
    def rows(batches):
        for batch in batches:
            texts, names, ids = _wanted(batch, bits)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(names[:, 0]), pa.array(names[:, 1]), texts.cast(pa.binary())], ["id", "d1", "d2", "raw"])

    return rows


def _cut(length: int):
    def rows(batches):
        for batch in batches:
            removed, spans, digests = [], [], []
            for raw, found in zip(batch.column("raw"), batch.column("spans")):
                raw = np.frombuffer(raw.as_buffer(), np.uint8)
                first, last = (found.values.field(k).to_numpy() for k in ("first", "last"))
                steps = np.bincount(first, minlength=len(raw) + 1) - np.bincount(last + length, minlength=len(raw) + 1)
                gone = np.cumsum(steps)[:len(raw)] > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                digests.append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("d1"), batch.column("d2"), pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()), pa.array(digests)], ["id", "d1", "d2", "n_removed", "n_spans", "kept"])

    return rows


class Repeats:
    """The search over ``docs``; ``report`` gives a row per document, ``spans`` where repeated strings start.

    Documents that are wholly equal are told by their digest: with ``length``
    bytes or more all of them go, and one of them stands for all in the search.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", *, length: int = LENGTH,
                 depth: int = DEPTH, batches: int = BATCHES):
        if not GRAM + 8 <= depth <= length - GRAM:
            raise ValueError("depth has to leave room for a gram on either side")
        self.length, self.depth, self.batches = length, depth, batches
        self.rows = columns(docs, id=id, text=text).select(F.col("id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
        hexed = F.sha2("text", 256)
        part = (lambda i: F.conv(F.substring(hexed, 1 + 16 * i, 16), 16, -10).cast("bigint"))
        self.profile = stored(self.rows.select(
            "id", F.octet_length("text").cast("bigint").alias("n"), part(0).alias("d1"), part(1).alias("d2"),
            hexed.alias("sha")), "repeat-profile")
        groups = self.profile.where(F.col("n") >= length).groupBy("d1", "d2").agg(
            F.min("id").alias("id"), F.count("*").alias("many"))
        self.groups = stored(groups, "repeat-groups")
        self.family = Family()

    def _broadcast(self, bits):
        return self.rows.sparkSession.sparkContext.broadcast(bits)

    def _bits(self, rows: DataFrame):
        return self._broadcast(bitmap(rows.select("id", "d1", "d2").mapInArrow(_hash_rows, "h bigint"), "h"))

    def matches(self, bits) -> DataFrame:
        """Suffixes that start a match of ``depth`` bytes, from the family of all batches."""
        keys = stored(self.rows.mapInArrow(
            _suffix_rows(self.length, self.depth, self.batches, bits), "batch int, head bigint, key bigint, many bigint"),
            "suffix-rows")
        found = []
        for i in range(self.batches):
            found += self.family.add(keys.where(F.col("batch") == i).select("head", "key", "many"))
        discard(keys)
        out = found[0]
        for table in found[1:]:
            out = out.union(table)
        return out

    def spans(self) -> DataFrame:
        """(d1, d2, first, last): ranges of places in each distinct text where a repeated string starts."""
        own = self._bits(self.groups)
        marks = self._broadcast(bitmap(self.matches(own), "key"))
        runs = stored(self.rows.mapInArrow(
            _run_rows(self.length, self.depth, own, marks),
            "d1 bigint, d2 bigint, start bigint, n int, key bigint, kind bigint"), "repeat-runs")
        kinds = stored(runs.groupBy("key", "kind").agg(F.count("*").alias("many"), F.any_value("n").alias("n")), "repeat-kinds")
        hubs = kinds.groupBy("key").agg(
            F.count("*").alias("kinds"), F.max(F.struct("many", "kind")).getField("kind").alias("hub")).where("kinds > 1")
        several = stored(kinds.join(hubs, "key").select("key", "kind", "kinds", "hub"), "repeat-several")
        wanted = self._broadcast(bitmap(several, "kind"))
        texts = self.rows.mapInArrow(_context_rows(self.length, self.depth, own, wanted),
                                     "key bigint, kind bigint, at int, held binary")
        # a kind's bytes once, from whatever text
        texts = texts.groupBy("key", "kind").agg(F.any_value(F.struct("at", "held")).alias("run"))
        texts = stored(texts.join(several, ["key", "kind"]).select("key", "kind", "kinds", "hub", "run.*"), "repeat-texts")
        hub = texts.where("kind = hub").select("key", F.col("at").alias("hub_at"), F.col("held").alias("hub_held"))
        compared = stored(texts.where("kind <> hub").join(hub, "key").mapInArrow(
            _compared(self.length, self.depth),
            "key bigint, kind bigint, hub bigint, low int, high int, hub_low int, hub_high int, "
            "rest array<struct<place:int,h:bigint>>"), "repeat-compared")
        rest = compared.select("key", "kind", F.explode("rest").alias("x")).select("key", "kind", "x.*")
        again = rest.groupBy("h").agg(F.count("*").alias("many")).where("many > 1").select("h")
        found = kinds.where("many > 1").select("key", "kind", F.lit(0).alias("low"), (F.col("n") - 1).alias("high"))
        found = found.union(compared.where("low >= 0").select("key", "kind", "low", "high"))
        found = found.union(compared.where("low >= 0").select("key", "hub", "hub_low", "hub_high").distinct())
        found = found.union(rest.join(again, "h").select("key", "kind", "place", F.col("place").alias("same")))
        return runs.join(found, ["key", "kind"]).select(
            "d1", "d2", (F.col("start") + F.col("low")).alias("first"), (F.col("start") + F.col("high")).alias("last"))

    def report(self) -> DataFrame:
        """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

        Null texts are empty; texts shorter than ``length`` bytes stay whole.
        Rows that share an id count as separate documents. An empty table gives
        no rows.
        """
        by = ["d1", "d2"]
        single = self.groups.where("many = 1").drop("many")
        spans = self.spans().groupBy(*by).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
        spans = stored(single.join(spans, by), "repeat-spans")
        texts = self.rows.mapInArrow(_text_rows(self._bits(spans)), "id bigint, d1 bigint, d2 bigint, raw binary")
        cut = texts.join(spans.drop("id"), by).mapInArrow(
            _cut(self.length), "id bigint, d1 bigint, d2 bigint, n_removed bigint, n_spans bigint, kept string")
        cut = cut.select(*by, "n_removed", "n_spans", "kept")
        copied = self.groups.where("many > 1").select(*by, F.lit(True).alias("copied"))
        out = self.profile.join(copied, by, "left").join(cut, by, "left")
        gone, nothing = F.col("copied").isNotNull(), hashlib.sha256(b"").hexdigest()
        return out.select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"),
            F.when(gone, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
            F.when(gone, F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
