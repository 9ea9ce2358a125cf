"""Trie of the turns that conversations begin with, by hashing of fixed-length blocks.

Every conversation is cut into blocks of ``BLOCK`` turns. A prefix is named by
the exclusive or of 128-bit hashes of (depth, turn), so the names of all block
ends come from running sums that need no turn-by-turn grouping. Conversations
are grouped by the blocks first: equal blocks behind equal prefixes are one row
from then on, with the number and the least id of their conversations. Where
only one block follows a prefix, its turns are the nodes; turn boundaries are
compared only inside blocks that stand beside others.

Sums over subtrees need no walk through the tree. A node belongs to its least
member; what a conversation owns lies at the end of its path. So the sum below
a node is the sum of what its members own, less what its owner owns above it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import columns, stored

BLOCK = 8
#: Blocks of a conversation, and nodes of an owner, that are added up in one window.
RUN = 1024
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["k1", "k2"]


def _numbered(batches):
    """Number the turns of each conversation among the sorted rows of this task."""
    part, conv, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv").to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        base = np.zeros(len(starts), np.int64)
        if ids[0] == conv:
            base[0] = seen
        sizes = np.diff(np.append(starts, len(ids)))
        place = np.arange(1, len(ids) + 1) - np.repeat(starts, sizes) + np.repeat(base, sizes)
        conv, seen = ids[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), part, np.int32)), batch.column("conv"), pa.array(place), batch.column("digest"),
             batch.column("words")], ["part", "conv", "place", "digest", "words"])


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """conv, place (from 1), digest of role and text, words.

    Turns are ordered by ``turn``, null first; those with one number by their
    digest. The rows are dealt by range, so a long conversation is spread over
    tasks; its parts are numbered on from each other.
    """
    rows = columns(conversations, conv=conv, turn=turn, role=role, text=text).where("conv is not null")
    role_, text_ = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    rows = rows.select(F.col("conv").cast("bigint"), F.col("turn").cast("bigint"), digest.alias("digest"),
                       F.regexp_count(text_, F.lit(WORD)).cast("bigint").alias("words"))
    order = ["conv", "turn", "digest"]
    parts = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _numbered, "part int, conv bigint, place bigint, digest binary, words bigint"), "trie-turns")
    runs = parts.groupBy("conv", "part").agg(F.max("place").alias("many"))
    before = F.sum("many").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # at most one conversation goes on from each task to the next, so this is as short as the list of tasks
    later = runs.withColumn("before", before).where("before > 0").select("conv", "part", "before")
    return parts.join(F.broadcast(later), ["conv", "part"], "left").select(
        "conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "words")


def with_leading_turns(turns: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of another one: (conv, depth, digest, words) and all ids (conv).

    The first h turns (h = crc32(id) mod 4) come from the conversation with the
    next lower id that ``every`` divides; the own ones follow after the first h.
    """
    own = F.col("conv") % every
    ids = turns.where("place = 1").select("conv")
    asked = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    leaders = turns.where((own == 0) & (F.col("place") <= 3)).select(
        F.col("conv").alias("lead"), F.col("place").alias("depth"), "digest", "words")
    followers = ids.where(own != 0).select("conv", (F.col("conv") - own).alias("lead"), asked.alias("asked")).where("asked > 0")
    copied = followers.join(leaders, "lead").where("depth <= asked").select("conv", "depth", "digest", "words")
    # places that the other conversation could not fill
    length = leaders.groupBy("lead").agg(F.max("depth").alias("length"))
    short = followers.join(length, "lead", "left").select(
        "conv", (F.col("asked") - F.coalesce("length", F.lit(0))).alias("short")).where("short > 0")
    kept = turns.where((own == 0) | (F.col("place") > asked)).join(short, "conv", "left").select(
        "conv", (F.col("place") - F.coalesce("short", F.lit(0))).alias("depth"), "digest", "words")
    return copied.union(kept), ids


def _running_xor(column: str, window) -> Column:
    return F.coalesce(F.expr(f"bit_xor({column})").over(window), F.lit(0)).cast("bigint")


def _joined_ids(batches):
    """Sorted (k1, k2, conv) to comma-joined runs of ids of one node."""
    for batch in batches:
        a, b, ids = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv"))
        if not len(ids):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        names = ids.astype("U20").tolist()
        ends = [*starts[1:].tolist(), len(ids)]
        yield pa.RecordBatch.from_arrays([
            pa.array(a[starts]), pa.array(b[starts]), pa.array(ids[starts]),
            pa.array([",".join(names[s:e]) for s, e in zip(starts.tolist(), ends)])], ["k1", "k2", "conv", "ids"])


def _hashed_ids(batches):
    """Runs in order to one digest per node; a node's runs may stand in several batches."""
    now, digest = None, None
    for batch in batches:
        out = []
        for key, ids in zip(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()), batch.column("ids").to_pylist()):
            if key == now:
                digest.update(b"," + ids.encode())
                continue
            if now:
                out.append((*now, digest.hexdigest()))
            now, digest = key, hashlib.sha256(ids.encode())
        yield _end_rows(out)
    if now:
        yield _end_rows([(*now, digest.hexdigest())])


def _end_rows(rows):
    a, b, c = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())],
                                      ["k1", "k2", "ends_sha256"])


class PrefixTrie:
    """Trie over ``turns`` (conv, depth from 1 without gaps, digest, words) of the conversations ``ids`` (conv).

    Conversations without turns are members of the root. No conversations give
    no nodes.
    """

    def __init__(self, turns: DataFrame, ids: DataFrame, *, block: int = BLOCK):
        self.ids = ids
        k = F.floor((F.col("depth") - 1) / block)
        x = [F.xxhash64(F.lit(i), F.col("depth"), F.col("digest")).alias(f"x{i + 1}") for i in range(2)]
        rows = turns.select("conv", F.floor(k / RUN).alias("run"), k.alias("block"), "depth", "words", *x)
        # one shuffle: runs of blocks, of which the blocks and the running sums are made
        blocks = rows.repartition("conv", "run").groupBy("conv", "run", "block").agg(
            F.array_sort(F.collect_list(F.struct("depth", "x1", "x2", "words"))).alias("turns"),
            F.expr("bit_xor(x1)").alias("b1"), F.expr("bit_xor(x2)").alias("b2"))
        before = Window.partitionBy("conv", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = stored(blocks.select("*", _running_xor("b1", before).alias("s1"), _running_xor("b2", before).alias("s2")),
                        "trie-blocks")
        # what the earlier runs of a long conversation add
        runs = blocks.where(f"block >= {RUN}").select("conv").distinct().join(blocks, "conv").groupBy("conv", "run").agg(
            F.expr("bit_xor(b1)").alias("r1"), F.expr("bit_xor(b2)").alias("r2"))
        over = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.select("conv", "run", _running_xor("r1", over).alias("r1"), _running_xor("r2", over).alias("r2")).where("run > 0")
        blocks = blocks.join(runs, ["conv", "run"], "left")
        for i in "12":
            blocks = blocks.withColumn(f"s{i}", F.col(f"s{i}").bitwiseXOR(F.coalesce(f"r{i}", F.lit(0))))
            blocks = blocks.withColumn(f"e{i}", F.col(f"s{i}").bitwiseXOR(F.col(f"b{i}")))
        self.blocks = blocks.drop("r1", "r2", "run")
        self.groups = stored(self.blocks.groupBy("block", "s1", "s2", "e1", "e2").agg(
            F.count("*").alias("many"), F.min("conv").alias("conv"), F.any_value("turns").alias("turns")), "trie-groups")

    @staticmethod
    def _turn_rows(groups: DataFrame, *carry: str) -> DataFrame:
        """One row per turn of a block, named by its prefix (k1, k2) and the one before it (q1, q2)."""
        def name(j: int, i: Column) -> Column:
            return F.aggregate(F.slice("turns", F.lit(1), i + 1), F.col(f"s{j}"), lambda a, u: a.bitwiseXOR(u[f"x{j}"]))

        steps = F.transform("turns", lambda t, i: F.struct(
            t.depth.alias("depth"), t.words.alias("words"), name(1, i).alias("k1"), name(2, i).alias("k2"),
            t.x1.alias("x1"), t.x2.alias("x2")))
        rows = groups.select(*carry, F.explode(steps).alias("t"))
        return rows.select(*carry, "t.depth", "t.words", "t.k1", "t.k2", F.col("t.k1").bitwiseXOR(F.col("t.x1")).alias("q1"),
                           F.col("t.k2").bitwiseXOR(F.col("t.x2")).alias("q2"))

    def _by_turn(self, groups: DataFrame, sums: list[str], *more: Column) -> DataFrame:
        """Turns of blocks with siblings are grouped by prefix; those of a lone block are nodes as they stand."""
        beside = self.groups.groupBy("s1", "s2").agg((F.count("*") > 1).alias("siblings"))
        rows = self._turn_rows(groups.join(beside, ["s1", "s2"]), "siblings", "conv", *sums)
        apart = rows.where("siblings").groupBy(*KEY).agg(
            *[F.sum(c).alias(c) for c in sums], F.min("conv").alias("conv"), *more)
        return apart.unionByName(rows.where("not siblings").select(*apart.columns))

    def _nodes(self) -> DataFrame:
        nodes = self._by_turn(self.groups, ["many"], *[F.any_value(c).alias(c) for c in ("depth", "words", "q1", "q2")])
        none = F.lit(0).cast("bigint")
        root = self.ids.agg(F.count("*").alias("many"), F.min("conv").alias("conv")).where("many > 0").select(
            none.alias("k1"), none.alias("k2"), "many", "conv", none.alias("depth"), none.alias("words"),
            F.lit(None).cast("bigint").alias("q1"), F.lit(None).cast("bigint").alias("q2"))
        nodes = stored(nodes.unionByName(root), "trie-nodes")
        children = nodes.where("depth > 0").groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(
            F.count("*").alias("n_children"))
        nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
        return stored(nodes.withColumn("own", (F.col("many") - 1) * F.col("words")), "trie-nodes")

    def _below(self, nodes: DataFrame) -> DataFrame:
        """What the members of each node own, with (k1, k2): owned, n_leaves."""
        owners = nodes.groupBy("conv").agg(
            F.sum("own").alias("owned"), F.sum((F.col("n_children") == 0).cast("bigint")).alias("n_leaves"))
        owners = stored(owners, "trie-owners")
        keys = ["block", "s1", "s2", "e1", "e2"]
        sums = self.blocks.drop("turns").join(owners, "conv").groupBy(*keys).agg(
            F.sum("owned").alias("owned"), F.sum("n_leaves").alias("n_leaves"))
        groups = self.groups.join(sums, keys, "left").fillna(0, ["owned", "n_leaves"])
        none = F.lit(0).cast("bigint")
        root = owners.agg(F.sum("owned").alias("owned"), F.sum("n_leaves").alias("n_leaves")).select(
            none.alias("k1"), none.alias("k2"), "owned", "n_leaves")
        return self._by_turn(groups, ["owned", "n_leaves"]).drop("conv").unionByName(root)

    @staticmethod
    def _above(nodes: DataFrame) -> DataFrame:
        """Nodes with ``above``, what their owner owns at lesser depths."""
        run = F.floor(F.col("depth") / RUN)
        rows = nodes.withColumn("run", run)
        inside = Window.partitionBy("conv", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("above", F.coalesce(F.sum("own").over(inside), F.lit(0)))
        long = nodes.where(f"depth >= {RUN}").select("conv").distinct()
        runs = nodes.join(long, "conv", "left_semi").groupBy("conv", run.alias("run")).agg(F.sum("own").alias("own"))
        over = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.select("conv", "run", F.sum("own").over(over).alias("earlier")).where("earlier > 0")
        return rows.join(runs, ["conv", "run"], "left").withColumn(
            "above", F.col("above") + F.coalesce("earlier", F.lit(0))).drop("run", "earlier")

    def ends(self) -> DataFrame:
        """(k1, k2, ends_sha256) of the nodes that conversations end at.

        Ids are joined where they were sorted, so the digest of a node that many
        conversations end at reads a few long runs one after the other.
        """
        none = F.lit(0).cast("bigint")
        last = self.ids.select("conv", none.alias("b1"), none.alias("b2")).union(self.blocks.select("conv", "b1", "b2"))
        last = last.groupBy("conv").agg(F.expr("bit_xor(b1)").alias("k1"), F.expr("bit_xor(b2)").alias("k2"))
        order = [*KEY, "conv"]
        runs = last.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            _joined_ids, "k1 bigint, k2 bigint, conv bigint, ids string")
        return runs.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(
            _hashed_ids, "k1 bigint, k2 bigint, ends_sha256 string")

    def nodes(self) -> DataFrame:
        """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
        nodes = self._nodes()
        parents = nodes.where("n_children > 0").select(
            F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv").alias("parent_conv_id"))
        out = self._above(nodes).join(self._below(nodes), KEY).join(self.ends(), KEY, "left").join(parents, ["q1", "q2"], "left")
        return out.select(
            F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("many").alias("n_convs"), "n_children", "n_leaves",
            (F.col("owned") - F.col("above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text", *, block: int = BLOCK) -> DataFrame:
    """The trie of conversations rebuilt on leading turns.

    Rows without a conversation id belong to none and are left out; null role
    and text are empty. Repeated rows are turns of their own. Other columns of
    the input don't matter. An empty table gives no rows.
    """
    turns, ids = with_leading_turns(numbered_turns(conversations, conv, turn, role, text))
    return PrefixTrie(turns, ids, block=block).nodes()


SQL = r"""
WITH x AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
y AS (
  SELECT c, turn, sha256(CAST(length(r) AS VARCHAR) || ':' || r || t) AS dig,
         CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM x),
t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, dig) AS p, count(*) OVER (PARTITION BY c) AS len FROM y),
bits AS (
  SELECT DISTINCT c, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
    lambda ch: list_transform(range(8), lambda i: (CAST(ascii(ch) AS BIGINT) >> CAST(i AS INTEGER)) & 1))) AS bits FROM t),
h AS (
  SELECT c, xor(list_reduce(bits, lambda s, b: xor(s >> 1, CASE WHEN xor(s, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295),
                4294967295) % 4 AS h FROM bits),
lead AS (SELECT c AS l, p, dig, words, least(len, 3) AS n FROM t WHERE c % 20 = 0 AND p <= 3),
r AS (
  SELECT h.c, lead.p AS d, dig, words FROM h JOIN lead ON l = h.c - h.c % 20 AND p <= h.h WHERE h.c % 20 <> 0
  UNION ALL
  SELECT t.c, CASE WHEN t.c % 20 = 0 THEN t.p ELSE t.p - h.h + least(h.h, coalesce(n, 0)) END AS d, t.dig, t.words
  FROM t JOIN h USING (c) LEFT JOIN (SELECT DISTINCT l, n FROM lead) AS f ON f.l = t.c - t.c % 20
  WHERE t.c % 20 = 0 OR t.p > h.h),
p AS (
  SELECT c, d, words, sha256(array_to_string(list(dig) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING), ',')) AS k FROM r
  UNION ALL SELECT c, 0, 0, '' FROM h),
n AS (SELECT k, any_value(d) AS d, count(*) AS many, min(c) AS c, any_value(words) AS words FROM p GROUP BY k),
up AS (SELECT DISTINCT a.k, b.k AS q FROM p AS a JOIN p AS b ON a.c = b.c AND b.d = a.d - 1),
kids AS (SELECT q, count(*) AS kids FROM up GROUP BY q),
f AS (SELECT n.*, up.q, coalesce(kids.kids, 0) AS kids FROM n LEFT JOIN up ON up.k = n.k LEFT JOIN kids ON kids.q = n.k),
below AS (
  SELECT a.k, sum((f.many - 1) * f.words) AS saved, count(*) FILTER (WHERE f.kids = 0) AS leaves
  FROM f JOIN p AS a ON a.c = f.c AND a.d <= f.d GROUP BY a.k),
tops AS (SELECT c, k FROM p QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1),
ends AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM tops GROUP BY k)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, g.c AS parent_conv_id, f.many AS n_convs, f.kids AS n_children,
       below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM f LEFT JOIN n AS g ON g.k = f.q LEFT JOIN below ON below.k = f.k LEFT JOIN ends ON ends.k = f.k
"""
