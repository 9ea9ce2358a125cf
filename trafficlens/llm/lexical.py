"""Ranked lexical search over a length-stratified index.

Documents with an equal normaliser m form a stratum, which is stored as
segments of at most ``SEGMENT`` documents. A segment lists its terms, for each
term the frequencies that occur, and for each frequency the documents: within a
stratum the impact of a posting depends on its frequency only, so it is worked
out once for all documents of a list.

A query's bound for a segment adds the impacts of the highest frequency of each
of its terms there. Segments are visited in the order of their bounds: the
first ones of each query give it a score that its last place has to reach, and
of the others only those whose bound reaches that score are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import U64, Rolling, columns, filled, mix64, slices, stored, utf8, word_bounds

SEGMENT = 2048
#: Postings of a segment; a document with more is a segment of its own.
POSTINGS = 1 << 17
#: Postings that are added up at once.
AT_ONCE = 1 << 19
#: Terms of the queries that are answered at once.
BLOCK_TERMS = 100_000
#: Segments that a query visits first.
FIRST = 8
BEST = 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BODY = np.zeros(256, bool)
_BODY[48:58] = _BODY[65:91] = _BODY[97:123] = _BODY[128:] = True


def term_counts(texts: pa.Array):
    """For each text: number of its terms with repeats, distinct term names (sorted), their occurrences."""
    raw, at = utf8(texts)
    start, end, first, of = word_bounds(_BODY[raw], at)
    names = Rolling(_LOWER[raw].astype(U64)).of(start, end).view(np.int64)
    order = np.lexsort([names, of])
    names, of = names[order], of[order]
    new = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (of[1:] != of[:-1])])) if len(names) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(names)))
    cuts = np.searchsorted(of[new], np.arange(len(texts) + 1))
    return np.diff(first), names[new], times, cuts


def _bags(batches):
    for batch in batches:
        texts = filled(batch.column("text"))
        for low, high in slices(texts):
            n, names, times, cuts = term_counts(texts.slice(low, high - low))
            at = pa.array(cuts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(low, high - low), pa.array(n.astype(np.int64)),
                 pa.ListArray.from_arrays(at, pa.array(names)), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))],
                ["id", "n", "terms", "times"])


def _bag_frame(rows: DataFrame) -> DataFrame:
    return rows.select("id", "text").mapInArrow(_bags, "id bigint, n bigint, terms array<bigint>, times array<int>")


def _segment(m: int, part: list) -> tuple:
    """One segment: the lists of ``part``, rows (id, terms, times) of one stratum."""
    sizes = [len(t) for _, t, _ in part]
    terms, times = (np.concatenate([p[i] for p in part]) for i in (1, 2))
    slot = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
    order = np.lexsort([slot, times, terms])
    terms, times, slot = terms[order], times[order], slot[order]
    lists = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (times[1:] != times[:-1])]))
    heads = np.flatnonzero(np.concatenate([[True], terms[lists][1:] != terms[lists][:-1]]))
    return (m, [p[0] for p in part], terms[lists][heads], np.append(heads, len(lists)).astype(np.int32), times[lists],
            np.append(lists, len(terms)).astype(np.int32), slot)


_NAMES = ["m", "ids", "terms", "heads", "times", "lists", "slots"]


def _segments(batches):
    part, m, many = [], None, 0

    def close():
        kinds = [pa.int64(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), *[pa.int32()] * 4)]]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(_segment(m, part), kinds)], _NAMES)

    for batch in batches:
        ms, ids = batch.column("m").to_numpy(), batch.column("id").to_pylist()
        for i in range(len(ids)):
            terms, times = (batch.column(c)[i].values.to_numpy() for c in ("terms", "times"))
            if part and (ms[i] != m or len(part) == SEGMENT or many + len(terms) > POSTINGS):
                yield close()
                part, many = [], 0
            m = int(ms[i])
            part.append((ids[i], terms, times))
            many += len(terms)
    if part:
        yield close()


class StratifiedIndex:
    """The index of a document table: ``segments``, number ``n`` of documents with terms, ``length`` of them in terms.

    Every document with a term is indexed; those without are in no list. Terms
    are named by 64-bit hashes. Rows that share an id are separate documents.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text"):
        rows = columns(docs, id=id, text=text).withColumn("id", F.col("id").cast("bigint"))
        bags = stored(_bag_frame(rows).where("n > 0"), "lexical-bags")
        total = bags.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        self.n, self.length = int(total["n"]), int(total["length"])
        m = 25 + F.expr(f"(75L * n * {self.n}L) div {max(self.length, 1)}L")
        # a stratum that is large is dealt to several tasks, by a hash of the document
        order = [F.col("m"), F.xxhash64("id", "n", "terms")]
        bags = bags.withColumn("m", m).repartitionByRange(*order).sortWithinPartitions("m")
        made = bags.select("m", "id", "terms", "times").mapInArrow(
            _segments, "m bigint, ids array<bigint>, terms array<bigint>, heads array<int>, times array<int>, lists array<int>, "
            "slots array<int>")
        self.segments = stored(made.select(F.monotonically_increasing_id().alias("segment"), "*"), "lexical-segments", rows=32)

    def document_frequencies(self, wanted: np.ndarray) -> DataFrame:
        """(term, df) of the sorted ``wanted`` terms, counted over all segments."""
        asked = self.segments.sparkSession.sparkContext.broadcast(wanted)
        return self.segments.select("terms", "heads", "lists").mapInArrow(_list_sizes(asked), "term bigint, df bigint").groupBy(
            "term").agg(F.sum("df").cast("bigint").alias("df"))


def _weight(n: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * df + 1)))


class _Queries:
    """A block of queries as arrays: the terms of query q are ``cuts[q]:cuts[q + 1]``, sorted by name."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray):
        order = np.lexsort([term, query])
        self.names, first = np.unique(query[order], return_index=True)
        self.cuts = np.append(first, len(query))
        self.term, self.weight = term[order], weight[order]


def _impacts(times: np.ndarray, m: int) -> np.ndarray:
    times = times.astype(np.int64)
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def _find(terms: np.ndarray, asked: np.ndarray):
    at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
    return at, terms[at] == asked


def _list_sizes(asked):
    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                terms, heads, lists = (batch.column(c)[i].values.to_numpy() for c in ("terms", "heads", "lists"))
                at, found = _find(terms, asked.value)
                ends = lists[heads].astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(asked.value[found]), pa.array((ends[1:] - ends[:-1])[at[found]])], ["term", "df"])

    return rows


def _bounds(queries):
    """What no document of a segment can exceed: segment, query, bound, documents."""
    def rows(batches):
        own = queries.value
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                terms, heads, times = (batch.column(c)[i].values.to_numpy() for c in ("terms", "heads", "times"))
                m = batch.column("m")[i].as_py()
                most = _impacts(times[heads[1:] - 1], m)  # frequencies of a term are ascending
                at, found = _find(terms, own.term)
                bound = np.add.reduceat(np.where(found, own.weight * most[at], 0), own.cuts[:-1])
                some = np.flatnonzero(bound)
                out.append((np.full(len(some), batch.column("segment")[i].as_py(), np.int64), own.names[some], bound[some],
                            np.full(len(some), batch.column("many")[i].as_py(), np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["segment", "query", "bound", "many"])

    return rows


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, .. for ``size[0]`` numbers, then those from low[1] on, and so forth."""
    return np.arange(int(size.sum())) + np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size)


def _scores(own: _Queries, asked: np.ndarray, parts: tuple, impacts: np.ndarray, many: int):
    """Score of each of the ``many`` documents of a segment for each query of ``asked``, some queries at a time."""
    terms, heads, lists, slots = parts
    at = np.searchsorted(own.names, asked)
    size = own.cuts[at + 1] - own.cuts[at]
    row, pick = np.repeat(np.arange(len(asked)), size), _ranges(own.cuts[at], size)
    t, found = _find(terms, own.term[pick])
    row, t, weight = row[found], t[found], own.weight[pick][found]
    postings = np.bincount(row, (lists[heads[t + 1]] - lists[heads[t]]).astype(float), len(asked))
    for group in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(np.cumsum(postings) // AT_ONCE)) + 1):
        low, high = np.searchsorted(row, [group[0], group[-1] + 1])
        size = (heads[t + 1] - heads[t])[low:high]
        these = _ranges(heads[t[low:high]], size)
        points = np.repeat(weight[low:high], size) * impacts[these]
        base = np.repeat((row[low:high] - group[0]) * many, size)
        size = lists[these + 1] - lists[these]
        out = np.zeros(len(group) * many, np.int64)
        np.add.at(out, np.repeat(base, size) + slots[_ranges(lists[these], size)], np.repeat(points, size))
        yield group, out.reshape(len(group), many)


def _visits(queries):
    """Scores of the ``BEST`` documents of each visited segment for each of its queries."""
    def rows(batches):
        own = queries.value
        for batch in batches:
            for i in range(batch.num_rows):
                terms, heads, times, lists, slots = (
                    batch.column(c)[i].values.to_numpy() for c in ("terms", "heads", "times", "lists", "slots"))
                ids = batch.column("ids")[i].values
                known, numbers = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                asked, least = (batch.column("queries")[i].values.field(c).to_numpy() for c in ("query", "least"))
                impacts = _impacts(times, batch.column("m")[i].as_py())
                order = np.argsort(asked)
                asked, least = asked[order], np.maximum(least[order], 1)
                for group, scores in _scores(own, asked, (terms, heads, lists, slots), impacts, len(ids)):
                    row, doc = np.nonzero(scores >= least[group][:, None])
                    order = np.lexsort([numbers[doc], known[doc], -scores[row, doc], row])
                    row, doc = row[order], doc[order]
                    best = np.arange(len(row)) - np.searchsorted(row, row) < BEST
                    row, doc = row[best], doc[best]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(asked[group][row]), ids.take(pa.array(doc)), pa.array(scores[row, doc])], ["query", "doc", "score"])

    return rows


class Search:
    """Answers a table of queries, in blocks, from an index."""

    def __init__(self, index: StratifiedIndex, items: DataFrame, id: str = "item_id", text: str = "text", *, best: int = BEST):
        if best > BEST:
            raise ValueError(f"a segment reports its {BEST} best documents")
        self.index, self.best = index, best
        rows = columns(items, id=id, text=text)
        rows = stored(rows.select(F.monotonically_increasing_id().alias("query"), "*"), "lexical-items")
        self.items = rows.select("query", F.col("id").alias("item_id"))
        bags = rows.select(F.col("query").alias("id"), "text")
        terms = _bag_frame(bags).select(F.col("id").alias("query"), F.explode(F.arrays_zip("terms", "times")).alias("x"))
        self.terms = stored(terms.select("query", F.col("x.terms").alias("term"), F.col("x.times").alias("times")), "lexical-asked")

    def _blocks(self):
        """Queries in blocks of about ``BLOCK_TERMS`` terms; a longer query is a block of its own."""
        sizes = self.terms.groupBy("query").agg(F.count("*").alias("many"))
        low, total = None, 0
        for r in sizes.orderBy("query").toLocalIterator():
            if low is None or total + r["many"] > BLOCK_TERMS:
                if low is not None:
                    yield low, last
                low, total = r["query"], 0
            total, last = total + r["many"], r["query"]
        if low is not None:
            yield low, last

    def _visit(self, queries, visits: DataFrame) -> DataFrame:
        """visits: segment, query, least score. Top documents of all visited segments, per query."""
        asked = visits.groupBy("segment").agg(F.collect_list(F.struct("query", "least")).alias("queries"))
        rows = self.index.segments.join(asked, "segment").select(*_NAMES, "queries")
        return rows.mapInArrow(_visits(queries), "query bigint, doc bigint, score bigint")

    def _top(self, scores: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
        return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.best)

    def _block(self, low: int, high: int) -> DataFrame:
        spark = self.terms.sparkSession
        terms = stored(self.terms.where(F.col("query").between(low, high)), "lexical-block")
        asked = np.sort(terms.select("term").distinct().toArrow()["term"].to_numpy())
        df = self.index.document_frequencies(asked)
        rows = terms.join(df, "term").select("query", "term", (_weight(self.index.n, F.col("df")) * F.col("times")).alias("weight")).toArrow()
        if not rows.num_rows:
            return None
        queries = spark.sparkContext.broadcast(_Queries(*[rows[c].to_numpy() for c in ("query", "term", "weight")]))
        heads = self.index.segments.select("segment", "m", "terms", "heads", "times", F.size("ids").cast("bigint").alias("many"))
        bounds = stored(heads.mapInArrow(_bounds(queries), "segment bigint, query bigint, bound bigint, many bigint"), "lexical-bounds")
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "segment")
        ranked = stored(bounds.withColumn("visit", F.row_number().over(order)), "lexical-order")
        first = self._visit(queries, ranked.where(F.col("visit") <= FIRST).select("segment", "query", F.lit(1).cast("bigint").alias("least")))
        first = stored(self._top(first), "lexical-first")
        # a score that the last place has to reach; 1 while there are fewer documents than places
        least = first.where(F.col("rank") == self.best).select("query", F.col("score").alias("least"))
        rest = ranked.where(F.col("visit") > FIRST).join(F.broadcast(least), "query", "left").withColumn(
            "least", F.coalesce("least", F.lit(1).cast("bigint"))).where(F.col("bound") >= F.col("least"))
        rest = self._visit(queries, rest.select("segment", "query", "least"))
        out = stored(self._top(first.drop("rank").union(rest)), "lexical-answers")
        queries.unpersist()
        return out

    def answers(self) -> DataFrame:
        """item_id, rank, doc_id, score."""
        found = [b for b in (self._block(*x) for x in self._blocks()) if b is not None]
        if not found:
            none = F.lit(None)
            return self.items.where("false").select("item_id", none.cast("int").alias("rank"), none.cast("bigint").alias("doc_id"),
                                                    none.cast("bigint").alias("score"))
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out.join(self.items, "query").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", *, best: int = BEST) -> DataFrame:
    """The ``best`` documents for each item, by score and then by id (null first): item_id, rank, doc_id, score.

    Null and empty texts have no terms; such an item has no answers and such a
    document is in none. Items that share an id are answered one by one. Empty
    tables give no rows. Other columns of the inputs don't matter.
    """
    return Search(StratifiedIndex(docs, id, text), items, item, item_text, best=best).answers()


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
s AS (SELECT r, doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * n) // l AS m FROM d, c WHERE len(w) > 0),
p AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
a AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM q) GROUP BY q, item_id, t),
w AS (
  SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
z AS (
  SELECT q, item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM a JOIN w USING (t) JOIN p USING (t) JOIN s USING (r) GROUP BY q, item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM z WHERE score > 0 QUALIFY rank <= 10
"""
