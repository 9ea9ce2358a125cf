"""Token ids in a fixed-width bit-packed format.

A token table is Parquet with one row per block: ``part`` and ``block`` give the
order, ``docs`` the ids of its documents, ``ends`` the number of ids up to the
end of each, ``bits`` the width and ``packed`` all ids of the block, each in
``bits`` bits, least significant bit first. A block holds whole documents and
closes at ``BLOCK_IDS`` ids. Id j of a block starts at bit ``j * bits``, so any
document or id can be read alone and numpy unpacks a block in a few operations.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir
from .common import columns, filled, slices

BLOCK_IDS = 1 << 16
END_ID = 0
POOL = 800_000

#: Characters that a tokenizer may count as white space although str.isspace does not.
_ODD = "᠎​﻿"
_WHITE = frozenset({chr(c) for c in range(0x3001) if chr(c).isspace()} | set(_ODD))
_CUT = re.compile(f"(?<=[^\\s{_ODD}]) (?=[^\\s{_ODD}])")

SCHEMA = "part int, block int, docs array<bigint>, ends array<bigint>, bits int, packed binary"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits per id, least significant first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, first: int, last: int) -> np.ndarray:
    """Ids first..last-1 of a block, without touching the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", last - first, first * bits // 8).astype(np.uint32)
    low = first * bits // 8
    raw = np.frombuffer(packed, np.uint8, (last * bits + 7) // 8 - low, low)
    flat = np.unpackbits(raw, bitorder="little")[first * bits - 8 * low:][:(last - first) * bits]
    wide = np.zeros((last - first, 32), np.uint8)
    wide[:, :bits] = flat.reshape(-1, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class _Numbers(dict):
    """Numbers given to keys in the order they come up."""

    def __init__(self, owner, lead: str):
        self.owner, self.lead, self.new = owner, lead, []

    def __missing__(self, key: str) -> int:
        n = self[key] = self.owner.count
        self.owner.count = n + 1
        self.new.append((n, key))
        return n


class _After(_Numbers):
    """As above; -1 for a piece with white space at an end, where the cut isn't one."""

    def __missing__(self, key: str) -> int:
        if not key or key[0] in _WHITE or key[-1] in _WHITE:
            self[key] = -1
            return -1
        return super().__missing__(key)


class Pieces:
    """Ids of text pieces, each encoded once by the tokenizer.

    A byte-level BPE splits a text before a single space and around a single
    line end that stand between two characters other than white space, so the
    pieces between such places can be encoded alone. Beyond ``POOL`` pieces the
    memory starts anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # a token's letters stand for one byte each
        for token, n in self.tokenizer.get_vocab().items():
            self.bytes_of[n] = len(token)
        self.reset()

    def reset(self):
        self.count = 0
        self.flat = np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.whole = _Numbers(self, "")
        self.after = _After(self, " ")

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(itertools.chain.from_iterable(coded), np.uint32, sizes.sum()), sizes

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that start with a space, many in one call; the tokens' bytes tell where each ends."""
        runs = ["".join(texts[i:i + 256]) for i in range(0, len(texts), 256)]
        ids, _ = self._ids(runs)
        ends = np.cumsum(np.fromiter((len(x.encode("utf-8", "replace")) for x in texts), np.int64, len(texts)))
        reached = np.cumsum(self.bytes_of[ids])
        at = np.searchsorted(reached, ends)
        if len(ends) and (reached[-1] != ends[-1] or (reached[at] != ends).any()):
            return self._ids(texts)  # a special token inside, or another kind of tokenizer
        return ids, np.diff(at + 1, prepend=0)

    def _settle(self):
        """Encode the pieces that were new."""
        flat, first, size = [self.flat], [self.first], [self.size]
        grown = np.zeros(self.count - len(self.first), np.int64)
        starts, sizes, base = grown.copy(), grown.copy(), len(self.flat)
        for table, encode in ((self.whole, self._ids), (self.after, self._joined)):
            if table.new:
                at = np.array([n for n, _ in table.new]) - len(self.first)
                ids, own = encode([table.lead + key for _, key in table.new])
                starts[at], sizes[at] = base + np.cumsum(own) - own, own
                base += len(ids)
                flat.append(ids)
                table.new = []
        if len(grown):
            self.flat = np.concatenate(flat)
            self.first, self.size = np.concatenate([*first, starts]), np.concatenate([*size, sizes])

    def _pieces(self, text: str) -> list[int]:
        if not text:
            return []
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            found = list(map(self.after.__getitem__, rest))
            if not first or first[0] in _WHITE or first[-1] in _WHITE or -1 in found:
                first, *rest = _CUT.split(text)
                return [self.whole[first], *[self.whole[" " + x] for x in rest]]
            if out:
                out.append(self.whole["\n"])
            out.append(self.whole[first])
            out += found
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids of each."""
        if self.count > POOL:
            self.reset()
        found = [self._pieces(text) for text in texts]
        self._settle()
        index = np.fromiter(itertools.chain.from_iterable(found), np.int64)
        first, size = self.first[index], self.size[index]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(first - ends + size, size) + np.arange(size.sum())]
        ends = np.concatenate([[0], ends])[np.cumsum([0, *map(len, found)])]
        return ids, np.diff(ends)


_CODERS: dict[str, Pieces] = {}


def coder_of(path: str) -> Pieces:
    """One coder for each Python worker; later tasks of the worker know its pieces."""
    if path not in _CODERS:
        _CODERS[path] = Pieces(path)
    return _CODERS[path]


def _writer(path: str, end: int, block_ids: int):
    def blocks(batches):
        coder, part, block = None, TaskContext.get().partitionId(), 0
        docs, sizes, ids, held = [], [], [], 0

        def close():
            nonlocal docs, sizes, ids, held, block
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()),
                pa.array([docs], pa.list_(pa.int64())), pa.array([np.cumsum(sizes)], pa.list_(pa.int64())),
                pa.array([coder.bits], pa.int32()), pa.array([pack(np.concatenate(ids), coder.bits)], pa.binary())],
                ["part", "block", "docs", "ends", "bits", "packed"])
            docs, sizes, ids, held, block = [], [], [], 0, block + 1
            return row

        for batch in batches:
            coder = coder or coder_of(path)
            texts, names = filled(batch.column("text")), batch.column("id").to_pylist()
            for low, high in slices(texts):
                flat, counts = coder.encode(texts.slice(low, high - low).to_pylist())
                flat = np.insert(flat, np.cumsum(counts), end)
                counts = counts + 1
                at = 0
                for name, n in zip(names[low:high], counts.tolist()):
                    docs.append(name)
                    sizes.append(n)
                    ids.append(flat[at:at + n])
                    at += n
                    held += n
                    if held >= block_ids:
                        yield close()
        if docs:
            yield close()

    return blocks


def write_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", *, tokenizer: str | None = None,
                 end: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts in ascending id order and write them as a token table.

    Null texts are empty and give the end id alone. Null ids come last. Rows
    that share an id stand next to each other in the order of a hash of their
    text. An empty input gives a table without rows.
    """
    rows = columns(docs, id=id, text=text).withColumn("tie", F.xxhash64("text"))
    order = [F.asc_nulls_last("id"), F.asc("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("id").cast("bigint"), "text")
    rows.mapInArrow(_writer(tokenizer or tokenizer_path(), end, block_ids), SCHEMA).write.parquet(path)


def _reader(batches):
    for batch in batches:
        out = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
        for docs, ends, bits, packed, start in zip(*[batch.column(c).to_pylist() for c in (
                "docs", "ends", "bits", "packed", "start")]):
            at = [0, *ends]
            ids = unpack(packed, bits, 0, at[-1])
            out["doc_id"] += docs
            out["start"] += [start + x for x in at[:-1]]
            out["n_tokens"] += [b - a for a, b in zip(at, ends)]
            out["ids_crc32"] += [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a token table with ``start``, the ids before each."""
    blocks = spark.read.parquet(path)
    n = F.element_at("ends", -1)
    parts = blocks.groupBy("part").agg(F.sum(n).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per written file
    parts = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", n.alias("n")).withColumn(
        "inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "block", (F.col("base") + F.col("inside")).alias("start"))
    return blocks.join(sizes, ["part", "block"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a token table, in read order."""
    return read_tokens(spark, path).select("docs", "ends", "bits", "packed", "start").mapInArrow(
        _reader, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_corpus(docs: DataFrame, **options) -> DataFrame:
    """Write a token table to the shared folder and read its digests back."""
    spark = docs.sparkSession
    path = shared_dir(spark, "llm-tokens")
    write_tokens(docs, path, **options)
    return token_digests(spark, path)
