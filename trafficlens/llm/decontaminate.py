"""Benchmark decontamination by winnowing.

Words are hashed, every run of ``gram`` words gets a hash, and of each
``window - gram + 1`` consecutive hashes the least is kept, the rightmost on
ties. A shared run of ``window`` words holds one such group of hashes, so
document and item keep the same one: no shared run is missed. Kept hashes of
the documents that may be among the benchmark's are extended to the windows of
``window`` words around them, and these are joined with the benchmark's windows
by their whole text, so chance equal hashes do no harm.

Items shorter than ``window`` words are one window of their own length. There
is no shorter guarantee to winnow with, so documents are compared at every
position for each such length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import U64, Rolling, bitmap, columns, filled, may_hold, mix64, slices, stored, utf8, word_bounds

WINDOW, GRAM = 13, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
SCHEMA = "id bigint, row bigint, n_words bigint, starts array<int>, sizes array<int>, texts array<string>"


class Words:
    """The words of a slice of texts: bytes, word bounds, first word of each text, word hashes."""

    def __init__(self, texts: pa.Array):
        raw, at = utf8(texts)
        self.data = _LOWER[raw]
        self.start, self.end, self.first, self.of = word_bounds(_WORD[self.data], at)
        self.hash = Rolling(self.data.astype(U64)).of(self.start, self.end)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of n words inside one text."""
        every = Rolling(self.hash).every(n)
        at = np.flatnonzero(self.of[:len(every)] == self.of[n - 1:n - 1 + len(every)]) if len(every) else np.zeros(0, int)
        return at, every[at]

    def text(self, first: int, n: int) -> str:
        ends = zip(self.start[first:first + n].tolist(), self.end[first:first + n].tolist())
        return b" ".join(self.data[a:b].tobytes() for a, b in ends).decode()


def winnow(at: np.ndarray, hashes: np.ndarray, of: np.ndarray, span: int) -> np.ndarray:
    """Which of the grams are the least, rightmost on ties, of some ``span`` consecutive grams of one text."""
    kept = np.zeros(len(at), bool)
    n = len(at) - span + 1
    if n <= 0:
        return kept
    best, where = hashes[:n].copy(), np.arange(n)
    for i in range(1, span):
        better = hashes[i:i + n] <= best
        np.copyto(best, hashes[i:i + n], where=better)
        np.copyto(where, np.arange(i, n + i), where=better)
    kept[where[of[at[:n]] == of[at[span - 1:]]]] = True
    return kept


def _salted(hashes: np.ndarray, n: int) -> np.ndarray:
    """Tells runs of different lengths apart."""
    return mix64(hashes + U64(n))


def _item_marks(window: int, gram: int):
    def rows(batches):
        for batch in batches:
            texts = filled(batch.column("text"))
            for low, high in slices(texts):
                words = Words(texts.slice(low, high - low))
                counts = np.diff(words.first)
                hashes, lengths = [], []
                at, own = words.grams(gram)
                kept = winnow(at, own, words.of, window - gram + 1)
                hashes.append(_salted(own[kept], gram))
                lengths.append(np.full(kept.sum(), window))
                for n in np.unique(counts[(counts > 0) & (counts < window)]).tolist():
                    at, own = words.grams(n)
                    alone = counts[words.of[at]] == n
                    hashes.append(_salted(own[alone], n))
                    lengths.append(np.full(alone.sum(), n))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(lengths), pa.int32())],
                    ["hash", "length"])

    return rows


def _item_windows(window: int):
    def rows(batches):
        for batch in batches:
            texts, names = filled(batch.column("text")), batch.column("id").to_pylist()
            for low, high in slices(texts):
                words = Words(texts.slice(low, high - low))
                ids, sizes, found = [], [], []
                for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                    n = min(window, b - a)
                    for first in range(a, b - n + 1) if n else ():
                        ids.append(names[low + i])
                        sizes.append(n)
                        found.append(words.text(first, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(sizes, pa.int32()), pa.array(found, pa.string())],
                    ["item", "size", "text"])

    return rows


def _doc_windows(window: int, gram: int, short: list[int], bits):
    """One row per document with the windows that may be the benchmark's."""
    def rows(batches):
        for batch in batches:
            texts = filled(batch.column("text"))
            for low, high in slices(texts):
                words = Words(texts.slice(low, high - low))
                at, own = words.grams(gram)
                kept = winnow(at, own, words.of, window - gram + 1)
                at, own = at[kept], own[kept]
                at = at[may_hold(bits.value, _salted(own, gram))]
                # extend: the windows that hold the gram
                start = np.unique((at[:, None] - np.arange(window - gram + 1)).ravel())
                start = start[(start >= 0) & (start + window <= len(words.of))]
                start = start[words.of[start] == words.of[start + window - 1]]
                starts, sizes = [start], [np.full(len(start), window)]
                for n in short:
                    at, own = words.grams(n)
                    at = at[may_hold(bits.value, _salted(own, n))]
                    starts.append(at)
                    sizes.append(np.full(len(at), n))
                start, size = np.concatenate(starts), np.concatenate(sizes)
                order = np.argsort(words.of[start], kind="stable")
                start, size = start[order], size[order]
                found = [words.text(a, n) for a, n in zip(start.tolist(), size.tolist())]
                ends = np.searchsorted(words.of[start], np.arange(high - low + 1)).astype(np.int32)
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(low, high - low), batch.column("row").slice(low, high - low),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(start - words.first[words.of[start]], pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(size, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(found, pa.string()))],
                    ["id", "row", "n_words", "starts", "sizes", "texts"])

    return rows


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words, are not contaminated and have the
    digest of the empty string. Rows that share an id are separate documents;
    items that share an id count once, null item ids are left out of the lists.
    Empty tables on either side give no rows or no hits.
    """
    spark = docs.sparkSession
    items = columns(items, id=item_id, text=item_text).select(F.col("id").cast("string"), "text")
    marks = stored(items.mapInArrow(_item_marks(window, gram), "hash bigint, length int").distinct(), "winnow-marks")
    short = sorted(r.length for r in marks.where(F.col("length") < window).select("length").distinct().collect())
    bits = spark.sparkContext.broadcast(bitmap(marks, "hash"))
    windows = items.mapInArrow(_item_windows(window), "item string, size int, text string")
    windows = stored(windows.distinct().withColumn("key", F.xxhash64("size", "text")), "winnow-items")

    rows = columns(docs, id=id, text=text).select(
        F.col("id").cast("bigint"), "text", F.monotonically_increasing_id().alias("row"))
    profile = stored(rows.mapInArrow(_doc_windows(window, gram, short, bits), SCHEMA), "winnow-docs")
    bits.unpersist()
    pairs = profile.select("row", F.explode(F.arrays_zip("starts", "sizes", "texts")).alias("w")).select(
        "row", F.col("w.starts").alias("start"), F.col("w.sizes").alias("size"), F.col("w.texts").alias("text"))
    known = windows.select("size", "text", "key").distinct()
    hits = stored(pairs.join(known, ["size", "text"]).select("row", "start", "size", "key"), "winnow-hits")
    # words covered by the union of a document's windows
    before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    covered = hits.withColumn("seen", F.coalesce(F.max(end).over(before), F.lit(0))).groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), end - F.greatest("start", "seen"))).alias("n_hit"),
        F.array_sort(F.collect_set("key")).alias("keys"))
    # documents with the same windows hit the same items, so each set of windows is looked up once
    covered = covered.withColumn("set", F.sha2(F.array_join(F.col("keys").cast("array<string>"), ","), 256))
    sets = covered.groupBy("set").agg(F.first("keys").alias("keys")).select("set", F.explode("keys").alias("key"))
    found = sets.join(windows.where("item is not null").select("key", "item"), "key").select("set", "item").distinct()
    listed = found.groupBy("set").agg(F.array_sort(F.collect_list("item")).alias("items")).select(
        "set", F.size("items").alias("n_items"), F.array_join("items", ",").alias("list"))
    covered = covered.join(listed, "set", "left").select("row", "n_hit", "n_items", "list")
    out = profile.select("row", "id", "n_words").join(covered, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))


SQL = r"""
WITH w AS (
  SELECT doc_id AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT i, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS t
  FROM b, unnest(range(1, greatest(len(w) - least(len(w), 13), 0) + 2)) AS u(p) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT d, p, n, array_to_string(w[p:p + n - 1], ' ') AS t
  FROM w, lengths, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS u(p)),
hit AS (SELECT dw.d, dw.p, dw.n, dw.t FROM dw SEMI JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
words AS (SELECT d, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS u(q) GROUP BY d),
items AS (
  SELECT d, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list
  FROM (SELECT DISTINCT hit.d, CAST(bw.i AS VARCHAR) AS i FROM hit JOIN bw ON hit.n = bw.n AND hit.t = bw.t) GROUP BY d)
SELECT w.d AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN words ON words.d = w.d LEFT JOIN items ON items.d = w.d
"""
