"""Languages by cross-parsing: how many phrases of labelled text a document is made of.

For each language a suffix automaton of sample text knows every substring of
it. A document is cut into phrases from the left, each the longest match in the
sample; the entropy estimate of a language is phrases times the logarithm of
the sample's length, per symbol. The language that needs least wins.

Text is lower-cased and runs of other ASCII characters than letters become one
space; other characters count by their UTF-8 bytes. Documents are parsed in
pieces of ``PIECE`` symbols, all pieces of a batch and all languages in step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import U64, Rolling, columns, filled, slices, stored, utf8

#: Symbols of sample text of all languages together, and at most of one.
SYMBOLS, MOST = 1 << 18, 1 << 15
#: Symbols taken from one sampled document.
EXCERPT = 512
#: Strings of so many symbols that two excerpts share are taken out of the sample.
SHARED = 32
PIECE = 256
LETTER = r"\p{L}"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, and len + 1 offsets into them."""
    raw, at = utf8(pc.utf8_lower(texts))
    data = _FOLD[raw]
    keep = np.ones(len(data), bool)
    if len(data):
        keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
        inner = at[:-1][at[:-1] < at[-1]]
        keep[inner] = True
    return data[keep], np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[at]


def suffix_automaton(text: np.ndarray, width: int) -> np.ndarray:
    """The transitions of the suffix automaton of ``text``: a table of states by ``width`` symbols, -1 where none."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in text.tolist():
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                # strings that end at fewer places get a state of their own
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    table = np.full((len(step), width), -1, np.int32)
    for state, out in enumerate(step):
        if out:
            table[state, list(out)] = list(out.values())
    return table


@dataclass
class Languages:
    """Automata of all languages in one table.

    ``table[state * width + symbol]`` is the next state times two, plus one
    where a new phrase begins with that symbol.
    """

    names: list[str]
    code: np.ndarray
    width: int
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, samples: dict[str, np.ndarray]) -> "Languages":
        names = sorted(samples)
        seen = np.unique(np.concatenate([np.zeros(0, np.uint8), *samples.values()]))
        code = np.zeros(256, np.int64)  # 0: a symbol that no sample has
        code[seen] = np.arange(1, len(seen) + 1)
        width, tables, roots, base = len(seen) + 1, [], [], 0
        for name in names:
            own = suffix_automaton(code[samples[name]], width)
            own = np.concatenate([own, np.full((1, width), -1, np.int32)])
            first = own[0].copy()
            first[first < 0] = len(own) - 1  # an unknown symbol is a phrase that nothing continues
            again = own < 0
            own = np.where(again, first[None, :], own) + base
            tables.append((own.astype(np.int64) * 2 + again).astype(np.int32))
            roots.append(base)
            base += len(own)
        flat = np.concatenate([t.ravel() for t in tables]) if tables else np.zeros(0, np.int32)
        return cls(names, code, width, flat, np.array(roots, np.int64), np.log2([len(samples[n]) + 1 for n in names]))

    def phrases(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of each text (a row) in each language (a column)."""
        lengths = np.diff(at)
        pieces = -(-lengths // PIECE)
        of = np.repeat(np.arange(len(lengths)), pieces)
        first = np.concatenate([[0], np.cumsum(pieces)])[:-1]
        nth = np.arange(len(of)) - np.repeat(first, pieces)
        start = at[:-1][of] + nth * PIECE
        size = np.minimum(lengths[of] - nth * PIECE, PIECE)
        order = np.argsort(-size, kind="stable")  # pieces that end leave at the back
        start, size = start[order], size[order]
        symbol = self.code[data]
        state = np.repeat(self.roots[:, None], len(of), 1)
        count = np.ones((len(self.roots), len(of)), np.int64)
        live = np.searchsorted(-size, -np.arange(PIECE), "left")
        for t in range(PIECE):
            n = int(live[t])
            if not n:
                break
            got = self.table[state[:, :n] * self.width + symbol[start[:n] + t]]
            state[:, :n] = got >> 1
            if t:  # the first symbol begins the phrase that is counted already
                count[:, :n] += got & 1
        out = np.zeros((len(lengths), len(self.roots)), np.int64)
        np.add.at(out, of[order], count.T)
        return out

    def costs(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits per symbol of each text in each language."""
        return self.phrases(data, at) * self.bits[None, :] / np.maximum(np.diff(at), 1)[:, None]


def held_out(id: Column) -> Column:
    """Rows whose language is never learned from."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _excerpts(batches):
    for batch in batches:
        texts, place = filled(batch.column("text")), batch.column("place").to_numpy()
        data, at = symbols(texts)
        out = []
        for i in range(len(texts)):
            spare = max(int(at[i + 1] - at[i]) - EXCERPT, 0)
            low = int(at[i]) + int(place[i] % (spare + 1))
            out.append(data[low:min(low + EXCERPT, int(at[i + 1]))].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(out, pa.binary())],
                                         ["lang", "place", "excerpt"])


def without_shared(excerpts: list[np.ndarray]) -> list[np.ndarray]:
    """Excerpts without the strings of ``SHARED`` symbols that stand in several of them.

    A passage that documents of all languages quote says nothing of a language,
    but each match of it would be as long as the passage.
    """
    grams = [np.unique(Rolling(x.astype(U64)).every(SHARED)) for x in excerpts]
    names, times = np.unique(np.concatenate([np.zeros(0, U64), *grams]), return_counts=True)
    shared, out = names[times > 1], []
    for x in excerpts:
        starts = np.flatnonzero(np.isin(Rolling(x.astype(U64)).every(SHARED), shared))
        edges = np.zeros(len(x) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + SHARED, -1)
        out.append(x[np.cumsum(edges)[:-1] == 0])
    return out


def learn(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", *, symbols: int = SYMBOLS) -> Languages:
    """Automata of at most ``MOST`` symbols a language and ``symbols`` in all.

    The sample are excerpts of ``EXCERPT`` symbols from rows that are not held
    out and have a language and a letter, those with the least hash of the text;
    a language with little text has a shorter sample, which the logarithm of its
    length makes up for. A language of which only shared strings are left is
    not learned.
    """
    rows = columns(docs, id=id, text=text, lang=lang).where(
        F.col("lang").isNotNull() & ~held_out(F.col("id")) & F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))
    place = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    rows = rows.select(F.col("lang").cast("string"), place.alias("place"), "text")
    many = rows.groupBy("lang").agg(F.count("*").alias("many"))
    many = stored(many, "language-counts")
    kinds = many.count()
    if not kinds:
        return Languages.of({})
    share = min(MOST, max(symbols // kinds, EXCERPT))
    # more rows than excerpts fit, as some are short or alike; hashes below a language's threshold are about so many
    want = 3 * share // EXCERPT
    limit = F.least(F.lit(1.0), F.lit(1.5 * want + 40) / F.col("many")) * F.lit(float(1 << 62))
    some = rows.join(F.broadcast(many), "lang").where(F.col("place") <= limit).drop("many")
    got = some.mapInArrow(_excerpts, "lang string, place bigint, excerpt binary").toArrow().to_pydict()
    parts = sorted(set(zip(got["lang"], got["place"], got["excerpt"])))
    samples: dict[str, list[np.ndarray]] = {}
    for (name, *_), part in zip(parts, without_shared([np.frombuffer(x[2], np.uint8) for x in parts])):
        samples.setdefault(name, []).append(part)
    samples = {n: np.concatenate(p)[:share] for n, p in samples.items()}
    return Languages.of({n: p for n, p in samples.items() if len(p)})


def _predict(model, names: tuple[str, str, str]):
    def rows(batches):
        own = model.value
        langs = np.array([*own.names, "und"], object)
        for batch in batches:
            texts = filled(batch.column("text"))
            for low, high in slices(texts):
                part = texts.slice(low, high - low)
                pick, score = np.full(high - low, len(own.names)), np.zeros(high - low)
                some = np.flatnonzero(pc.match_substring_regex(part, LETTER).to_numpy(zero_copy_only=False))
                if len(some) and own.names:
                    data, at = symbols(part.take(pa.array(some)))
                    cost = own.costs(data, at)
                    best = cost.argmin(1)  # ties: the first name
                    odds = np.exp2(cost.min(1, keepdims=True) - cost)
                    pick[some], score[some] = best, 1 / odds.sum(1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(low, high - low), pa.array(langs[pick], pa.string()), pa.array(score)], list(names))

    return rows


def predicted(docs: DataFrame, model: Languages, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row.

    ``und`` and a score of 0 stand for null texts and texts without a letter,
    and for all if no language was learned. The score is the share of the
    language among all by two to the power of minus its bits per symbol.
    """
    rows = columns(docs, id=id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    # null texts have no letter, so they may be empty here
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), ("doc_id", "lang_pred", "score")),
                           f"doc_id {kind}, lang_pred string, score double")


def language(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", *, symbols: int = SYMBOLS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Rows that share an id are predicted one by one; a row without id is not held
    out. Other columns don't matter. An empty table gives no rows.
    """
    rows = predicted(docs, learn(docs, id, text, lang, symbols=symbols), id, text)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
