"""Shared helpers: input tables, tables between passes, text bytes, bitmaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir, ship_package

#: The white space that separates words.
SPACE = "[\\x20\\x09-\\x0D]+"
U64 = np.uint64


#: Bytes of a batch that Spark hands to Python; its own default is eight times that.
BATCH_BYTES = "8m"


def _ready(spark: SparkSession) -> None:
    """Ship the package, and bound the memory of Python workers unless the session has its own bound."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and continue from the written copy.

    Later passes then read the same rows, also after an executor was lost. Where
    rows are large, ``rows`` bounds those that are buffered and decoded at once.
    """
    spark = df.sparkSession
    _ready(spark)
    path = shared_dir(spark, f"llm-{purpose}")
    writer = df.write if rows is None else df.write.option("parquet.block.row.count.limit", rows)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash."""
    return df.select(*[F.col(f"`{column}`").alias(name) for name, column in names.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the same with underscores where the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(texts: pa.Array, most: int = 1 << 20):
    """Row ranges of an Arrow string column with about ``most`` bytes each.

    A range holds at least one row, so a longer text is a range of its own.
    """
    sizes = np.diff(offsets_of(texts))
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if len(sizes):
        yield first, len(sizes)


def offsets_of(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and len + 1 offsets into them."""
    at = offsets_of(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def filled(column) -> pa.Array:
    """One Arrow array with null texts made empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def word_bounds(inside: np.ndarray, at: np.ndarray):
    """Runs of true bytes that don't cross a text's end.

    Start and end of each, the first run of each text (one more at the end) and
    the text of each run.
    """
    wide = np.zeros(len(inside) + 2, bool)
    wide[1:-1] = inside
    edges = np.flatnonzero(wide[1:] != wide[:-1])
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(inside))]
    both = np.unique(cuts[wide[cuts] & wide[cuts + 1]])
    if len(both):
        edges = np.sort(np.concatenate([edges, both, both]))
    start, end = edges[0::2], edges[1::2]
    first = np.searchsorted(start, at)
    return start, end, first, np.repeat(np.arange(len(at) - 1), np.diff(first))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Rolling:
    """Polynomial hashes (mod 2**64) of slices of one array, from prefix sums."""

    BASE = 0x9E3779B97F4A7C15 | 1
    KEEP = 1 << 21
    _power, _back = np.ones(1, U64), np.ones(1, U64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(Rolling._power) <= n:
            size = max(n + 1, 1 << 16)
            # those of long arrays are not kept
            keeper = Rolling if size <= self.KEEP else self
            keeper._power, keeper._back = _powers(self.BASE, size), _powers(_inverse(self.BASE), size)
        self.sums = np.empty(n + 1, U64)
        self.sums[0] = 0
        np.cumsum(values * self._power[:n], dtype=U64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of each slice; its length takes part."""
        raw = (self.sums[end] - self.sums[start]) * self._back[start]
        return mix64(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def every(self, width: int) -> np.ndarray:
        """Mixed hashes of all slices of one width."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U64)
        raw = (self.sums[width:] - self.sums[:n]) * self._back[:n]
        return mix64(raw + np.full(1, width, U64) * U64(0xD6E8FEB86659FD93))


BIT_LOG = 25


def bitmap(hashes: DataFrame, column: str, log: int = BIT_LOG, marks: int = 1) -> np.ndarray:
    """A set of 2**log bits (4 MB for 25) with ``marks`` bits for each value of a long column.

    Its size is fixed whatever the data, so it may be broadcast. It lets all
    members pass and some others; a join or an exact count has to follow. The
    driver gets at most 2**(log - 6) words, already combined on the executors.
    """
    slots = F.array(*[F.shiftrightunsigned(F.shiftleft(F.col(column), i * log), 64 - log) for i in range(marks)])
    words = hashes.select(F.explode(slots).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (log - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(U64)


def may_hold(bits: np.ndarray, hashes: np.ndarray, log: int = BIT_LOG, marks: int = 1) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for i in range(marks):
        slot = (hashes.view(U64) << U64(i * log)) >> U64(64 - log)
        out &= (bits[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) != 0
    return out
