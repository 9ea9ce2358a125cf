"""Mixing sources to target weights, DataFrame operations only.

The words of a source, in a fixed order of its documents, are packed into
blocks of ``block_words``. Every output shard draws a multinomial number of
slots per source; the slots of a source are numbered over all shards and mapped
through a pseudorandom permutation of its block indexes, one per epoch; blocks
and documents are then joined by index.

The draws of all shards together are brought to each source's quota: the few
slots a source won beyond it go to the sources that fell short. Quotas are
capped at two epochs, so no block is taken more than twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, columns, stored

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 64
SHARD_SLOTS = 8192
ROUNDS = 16
CELLS = 1 << 16
CHUNK_ROWS = 20_000


def word_count(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    gaps = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))
    return F.when(plain == "", F.lit(0)).otherwise(gaps + 1).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, size) to one row per source: source, number, source_size, target.

    Resharing the excess until no target is above its cap ends where every
    target is the smaller of its cap and one common rate times its weight.
    Sources are capped in order of cap per weight, so the rate is the first
    that leaves the next source uncapped. There is one row per source here.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    own = own.withColumn("number", place).withColumn("weight", cycle).withColumn(
        "cap", F.col("source_size").cast("double") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "number")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rate = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    own = own.withColumn("rate", rate).withColumn("free", F.col("rate") <= F.col("ratio"))
    final = F.min(F.when(F.col("free"), F.struct("ratio", "number", "rate"))).over(everything)
    return own.select("source", "number", "source_size", F.least(
        F.col("cap"), F.coalesce(final.getField("rate") * F.col("weight"), F.col("cap"))).alias("target"))


def packed(sizes: DataFrame) -> DataFrame:
    """Add ``start``: the words of the same source packed before each row.

    Rows are dealt into chunks of about ``CHUNK_ROWS`` by a hash of their id;
    prefix sums of the chunks' totals and of the rows of a chunk give the
    place, so no task orders a whole source.
    """
    chunks = F.greatest(F.lit(1), F.floor(F.lit(sizes.count()) / CHUNK_ROWS)).cast("bigint")
    rows = sizes.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks))
    totals = rows.groupBy("number", "chunk").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("number", "chunk", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("number", "chunk").orderBy("id", "size", "row").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(totals, ["number", "chunk"]).withColumn("start", F.col("base") + F.col("inside")).drop(
        "chunk", "base", "inside")


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the given columns only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def permuted(index: Column, n: Column, *key) -> Column:
    """A pseudorandom permutation of 0..n-1, a swap-or-not shuffle.

    Each round pairs x with k - x mod n and a keyed bit of the pair decides
    whether they swap, so every round is a bijection for any n.
    """
    def swap(x, turn):
        other = F.pmod(F.pmod(F.xxhash64(*key, turn, F.lit("k")), n) - x, n)
        bit = F.xxhash64(*key, turn, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def slots(quota: DataFrame, seed: int) -> DataFrame:
    """Every output slot's block: shard, slot, number, block.

    ``quota``: number, slots, blocks of each source.
    """
    spark = quota.sparkSession
    order = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    quota = quota.withColumn("low", F.coalesce(F.sum("slots").over(order), F.lit(0)))
    total = quota.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    # source s owns [low, low + slots) of the draws 0..total-1; cells make the search an equi-join
    cell = (lambda x: F.floor(x * F.lit(CELLS) / F.lit(max(total, 1))).cast("bigint"))
    owners = quota.where("slots > 0").withColumn("cell", F.explode(F.sequence(
        cell(F.col("low")), cell(F.col("low") + F.col("slots") - 1))))
    draws = spark.range(total).select(
        F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), (F.col("id") % SHARD_SLOTS).alias("slot"),
        F.least(F.floor(uniform(F.lit(seed), F.col("id")) * total), F.lit(total - 1)).alias("draw"))
    drawn = stored(draws.withColumn("cell", cell(F.col("draw"))).join(owners.select(
        "number", "low", (F.col("low") + F.col("slots")).alias("high"), "cell"), "cell").where(
        (F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high"))).select("shard", "slot", "number"), "mix-draws")
    # number a source's slots over all shards
    counts = drawn.groupBy("number", "shard").agg(F.count("*").alias("n"))
    shards = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("number", "shard", F.coalesce(F.sum("n").over(shards), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("number", "shard").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).join(counts, ["number", "shard"]).select(
        "shard", "slot", "number", (F.col("base") + F.col("inside")).alias("turn"))
    # slots beyond a source's quota, in a fixed order, go to the sources that are short
    won = drawn.groupBy("number").agg(F.count("*").alias("won"))
    state = quota.join(won, "number", "left").withColumn("won", F.coalesce("won", F.lit(0)))
    over, short = F.greatest(F.col("won") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("won"), F.lit(0))
    state = state.withColumn("over_from", F.coalesce(F.sum(over).over(order), F.lit(0))).withColumn(
        "short_from", F.coalesce(F.sum(short).over(order), F.lit(0)))
    ranked = ranked.join(state.select("number", "slots", "blocks", "over_from"), "number")
    kept = ranked.where("turn < slots").select("shard", "slot", "number", "turn", "blocks")
    spare = ranked.where("turn >= slots").select(
        "shard", "slot", (F.col("over_from") + F.col("turn") - F.col("slots")).alias("spare"))
    wanted = state.where("won < slots").select("number", "blocks", "won", "short_from", F.explode(
        F.sequence(F.col("won"), F.col("slots") - 1)).alias("turn")).select(
        "number", "blocks", "turn", (F.col("short_from") + F.col("turn") - F.col("won")).alias("spare"))
    filled = spare.join(wanted, "spare").select("shard", "slot", "number", "turn", "blocks")
    every = kept.unionByName(filled)
    epoch, index = F.floor(F.col("turn") / F.col("blocks")).cast("bigint"), F.col("turn") % F.col("blocks")
    return every.select("shard", "slot", "number", permuted(
        index, F.col("blocks"), F.lit(seed), F.col("number"), epoch).alias("block"))


class Mix:
    """The plan of a mix over ``docs`` (id, source, text columns).

    Null texts have no words; null sources form the last source. Rows that
    share an id are separate documents. Without any word nothing is taken. All
    tables hold whole documents; nothing depends on the order of the input.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", *,
                 weights=WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = 8):
        self.docs = docs
        self.names = dict(id=id, source=source, text=text)
        self.block_words, self.most = block_words, most
        rows = columns(docs, **self.names)
        sizes = stored(rows.select("id", "source", word_count(F.col("text")).alias("size"),
                                   F.xxhash64("text").alias("row")), "mix-sizes")
        self.sources = stored(targets(sizes, weights, share, most), "mix-sources")
        named = sizes.join(self.sources, sizes["source"].eqNullSafe(self.sources["source"])).select(
            "id", sizes["source"], "size", "row", "number", "source_size", "target")
        # a block has a little fewer words in the mean, as the last one is short; no source with a target gets no slot
        blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
        quota = self.sources.select("number", blocks.alias("blocks"), F.greatest(F.least(
            F.round(F.col("target") * blocks / F.col("source_size")).cast("bigint"), blocks * most),
            (F.col("target") > 0).cast("bigint")).alias("slots")).where("blocks > 0")
        self.slots = stored(slots(quota, seed), "mix-slots")
        self.places = stored(packed(named), "mix-places")

    def pieces(self) -> DataFrame:
        """A row for each document and block that share words: number, block, from, words, and the document."""
        size, n = F.col("size"), self.block_words
        first, last = F.floor(F.col("start") / n), F.floor((F.col("start") + size - 1) / n)
        rows = self.places.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        at = F.greatest(F.col("start"), F.col("block") * n)
        return rows.withColumn("from", at - F.col("start")).withColumn(
            "words", F.least(F.col("start") + size, (F.col("block") + 1) * n) - at)

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken for every row."""
        times = self.slots.groupBy("number", "block").agg(F.count("*").alias("times"))
        key = ["number", "start"]  # unique where a row has words
        got = self.pieces().join(times, ["number", "block"]).groupBy(*key).agg(
            F.sum(F.col("words") * F.col("times")).alias("taken"))
        some = self.places.where("size > 0").join(got, key, "left")
        every = some.unionByName(self.places.where("size = 0").withColumn("taken", F.lit(0).cast("bigint")))
        return every.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
                            F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))

    def documents(self) -> DataFrame:
        """The mix as rows with the input's columns: a document's taken words, once for each time they are taken.

        A document gives a row with the words of its blocks that are taken at
        least once and a second row with those taken twice; white space between
        the words of a block is kept. ``n_chars``, where the input has it, is
        that of the new text.
        """
        id, text = self.names["id"], self.names["text"]
        times = self.slots.groupBy("number", "block").agg(F.count("*").alias("times"))
        chosen = self.pieces().join(times, ["number", "block"]).groupBy("id", "row", "size").agg(
            F.collect_list(F.struct("start", "from", "words", "times")).alias("pieces"))
        docs = self.docs.select(F.struct("*").alias("doc"), F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"),
                                F.xxhash64(F.col(f"`{text}`")).alias("row"))
        # repeated rows have their pieces together in one row of ``chosen``, told apart by ``start``
        twin = F.row_number().over(Window.partitionBy("id", "row").orderBy(F.lit(0))) - 1
        docs = docs.withColumn("twin", twin).alias("d").join(
            chosen.alias("c"), (F.col("d.row") == F.col("c.row")) & F.col("d.id").eqNullSafe(F.col("c.id"))).select(
            "d.doc", "d.text", "d.twin", "c.pieces", "c.size")
        starts = F.array_sort(F.array_distinct(F.col("pieces.start")))
        docs = docs.withColumn("at", F.get(starts, F.col("twin"))).where("at is not null").withColumn(
            "own", F.array_sort(F.transform(F.filter("pieces", lambda p: p.start == F.col("at")),
                                            lambda p: F.struct(p["from"].alias("from"), p.words.alias("words"), p.times.alias("times")))))
        total = (lambda parts: F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n + p.words))
        even = (F.array_min("own.times") == F.array_max("own.times")) & (total(F.col("own")) == F.col("size"))
        words = F.regexp_extract_all("text", F.lit(f"({SPACE[:-1]}*[^{SPACE[1:-2]}]+)"), F.lit(1))
        # the words stand below the generator, so that they are taken once for a document and not once for a piece
        docs = docs.withColumn("tokens", F.when(~even, words)).select(
            "doc", "text", "size", "own", "tokens", F.explode(F.sequence(F.lit(1), F.array_max("own.times"))).alias("pass"))
        docs = docs.withColumn("part", F.filter("own", lambda p: p.times >= F.col("pass")))
        cut = F.regexp_replace(F.array_join(F.flatten(F.transform("part", lambda p: F.slice(
            "tokens", (p["from"] + 1).cast("int"), p.words.cast("int")))), ""), f"^{SPACE}", "")
        docs = docs.withColumn("new", F.when(total(F.col("part")) == F.col("size"), F.col("text")).otherwise(cut))
        doc = F.col("doc").withField(f"`{text}`", F.col("new"))
        if "n_chars" in self.docs.columns:
            doc = doc.withField("n_chars", F.length("new").cast(self.docs.schema["n_chars"].dataType))
        return docs.select(doc.alias("doc")).select("doc.*")


def targets_by_hand(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> dict:
    """Plain resharing loop over {source: size}, to check ``targets`` with."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        full = {s for s in free if rate * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: rate * weight[s] for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= full
    return out
