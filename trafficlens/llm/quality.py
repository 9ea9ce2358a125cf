"""Quality scores from a generalised additive model with pairwise interactions.

Every feature of a text falls into one of at most ``BINS`` bins. Shallow trees
are boosted one feature after the other, again and again, and add up to one
table per feature; the pairs of features with the largest remaining gain get
tables in the same way. A score is the logistic of the sum of table entries, so
scoring adds one array per table. The fit sees at most ``SAMPLE`` labelled rows;
features of all texts are computed and all are scored on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import U64, Rolling, columns, filled, mix64, slices, utf8, word_bounds

FEATURES = (
    "log_words", "word_length", "upper", "symbols", "stops", "digits", "wide", "repeats", "distinct", "top_word",
    "short_words", "line_words", "odd_ends", "bare_symbols", "length_spread", "same_lines")
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, SHRINK = 120, 60, 0.1, 1.0
FLOOR = 0.7

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_UPPER, _LETTER, _DIGIT, _STOP, _SYMBOL, _WIDE, _BODY = (np.zeros(256, bool) for _ in range(7))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_STOP[[ord(c) for c in ".,;:?"]] = True
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LETTER | _DIGIT | _STOP)
_WIDE[0xC0:] = True
_BODY[:] = True
_BODY[0x80:0xC0] = False  # a code point counts at its first byte


def _per_text(of: np.ndarray, weights, n: int) -> np.ndarray:
    return np.bincount(of, weights, n).astype(float)


def _most(of: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, of, counts)
    return out


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; a text without words has zeros."""
    raw, at = utf8(texts)
    n = len(texts)
    start, end, first, of = word_bounds(~_SPACE[raw], at)
    points = np.concatenate([[0], np.cumsum(_BODY[raw], dtype=np.int64)])
    words = np.diff(first).astype(float)
    many = np.maximum(words, 1)

    def total(kind):
        sums = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])
        return np.diff(sums[at]).astype(float)

    length = (points[end] - points[start]).astype(float)
    letters, chars = total(_LETTER), np.maximum(np.diff(points[at]), 1).astype(float)
    hashes = Rolling(raw.astype(U64)).of(start, end)
    again = np.zeros(len(of), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    kinds, where, times = np.unique(mix64(hashes + of.astype(U64) * U64(0x9E3779B97F4A7C15)),
                                    return_index=True, return_counts=True)
    mean = _per_text(of, length, n) / many
    spread = np.sqrt(np.maximum(_per_text(of, length * length, n) / many - mean * mean, 0))
    last = raw[end - 1] if len(end) else raw[:0]
    lines_start, lines_end, lines_first, line_of = word_bounds(raw != 10, at)
    lines = np.diff(lines_first).astype(float)
    line_hash = mix64(Rolling(raw.astype(U64)).of(lines_start, lines_end) + line_of.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, line_where = np.unique(line_hash, return_index=True)
    return np.column_stack([
        np.log1p(words), mean, total(_UPPER) / np.maximum(letters, 1), total(_SYMBOL) / many, total(_STOP) / many,
        total(_DIGIT) / chars, total(_WIDE) / chars, _per_text(of, again, n) / many,
        _per_text(of[where], None, n) / many, _most(of[where], times, n) / many, _per_text(of, length <= 3, n) / many,
        np.log1p(words / np.maximum(lines, 1)), _per_text(of, _SYMBOL[last], n) / many,
        _per_text(of, (length == 1) & _SYMBOL[last], n) / many, spread,
        1 - _per_text(line_of[line_where], None, n) / np.maximum(lines, 1)])


@dataclass
class Model:
    base: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    pair_edges: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for p in self.pairs for j in p}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of cutting bins in two, and the first bin of the right part (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + SHRINK) + (g.sum() - left_g)**2 / (h.sum() - left_h + SHRINK)
    gain -= g.sum()**2 / (h.sum() + SHRINK)
    best = int(np.argmax(gain))
    return (float(gain[best]), best + 1) if gain[best] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Step of every bin from a tree of at most ``depth`` levels."""
    _, cut = _split(g, h) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), -g.sum() / (h.sum() + SHRINK))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cut of a table into four quadrants."""
    def corners(a):
        c = a.cumsum(0).cumsum(1)
        return [c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1],
                c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]]

    step = np.zeros(g.shape)
    if min(g.shape) < 2:
        return 0.0, step
    gs, hs = corners(g), corners(h)
    gain = sum(a**2 / (b + SHRINK) for a, b in zip(gs, hs)) - g.sum()**2 / (h.sum() + SHRINK)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    for part, a, b in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                           (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), gs, hs):
        step[part] = -a[i, j] / (b[i, j] + SHRINK)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables on a sample; without labels of both kinds the score is the smoothed rate of label 1."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Model(base=float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[j], g, len(table)), np.bincount(bins[j], h, len(table)))
            table += step
            total += step[bins[j]]
    model.pair_edges = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    sizes = [len(e) + 1 for e in model.pair_edges]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]

    def grid(i, j, values):
        return np.bincount(coarse[i] * sizes[j] + coarse[j], values, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = slopes()
    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j)
                    for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _feature_rows(batches):
    for batch in batches:
        texts = filled(batch.column("text"))
        for low, high in slices(texts):
            x = text_features(texts.slice(low, high - low))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([
                batch.column("key").slice(low, high - low), batch.column("label").slice(low, high - low),
                pa.FixedSizeListArray.from_arrays(flat, len(FEATURES)).cast(pa.list_(pa.float64()))], ["key", "label", "x"])


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", *,
          sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows that are not held out, those with the least hash of their id.

    Rows without id or label are left out; a label other than 0 counts as 1.
    """
    marks = columns(labels, key=id, label=label).where("key is not null and label is not null")
    marks = marks.where(~held_out(F.col("key"))).select(
        F.col("key").cast("bigint"), (F.col("label") != 0).cast("int").alias("label"))
    marks = marks.orderBy(F.xxhash64("key"), "key", "label").limit(sample)
    rows = columns(docs, id=id, text=text).join(F.broadcast(marks), F.col("id") == F.col("key")).select("key", "label", "text")
    got = rows.mapInArrow(_feature_rows, "key bigint, label int, x array<double>").toArrow()
    y = got["label"].to_numpy().astype(float)
    x = np.array(got["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, y, got["key"].to_numpy()])  # the order of rows doesn't change a sum
    return fit(x[order], y[order])


def _scorer(model, texts: str, keep: list[str], score: str):
    def rows(batches):
        for batch in batches:
            texts_ = filled(batch.column(texts))
            scores = [model.value.score(text_features(texts_.slice(a, b - a))) for a, b in slices(texts_)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(np.concatenate([np.zeros(0), *scores]))], [*keep, score])

    return rows


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
           score: str = "score") -> DataFrame:
    """The columns of ``keep`` (all if None) and the score of every row, as a column named ``score``.

    Null and empty texts are scored like a text without words.
    """
    keep = list(docs.columns if keep is None else keep)
    if score in keep:
        raise ValueError(f"the input has a column {score}; name another one")
    rows, texts = docs.select(*[F.col(f"`{c}`") for c in keep]), text
    if text not in keep:
        texts = "text"
        while texts in (*keep, score):
            texts += "_"
        rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(texts))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(score, T.DoubleType())])
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), texts, keep, score), schema)


def quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", *,
            floor: float = FLOOR, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where the score reaches ``floor``) of every row.

    Rows that share an id are scored one by one; an empty table gives no rows;
    a row without id is not held out.
    """
    model = learn(docs, labels, id, text, label, sample=sample)
    rows = scored(columns(docs, doc_id=id, text=text), model, keep=["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= floor).cast("int").alias("predicted"))
