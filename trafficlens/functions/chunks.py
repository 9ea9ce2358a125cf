"""Splitting ordered groups so that no key is bound to one task.

A window partitioned by a user or a series sends that key's whole history to
one task. These helpers give the same results with partitions of bounded
length:

* ``with_lookback``: for frames of bounded reach. Rows near the end of a chunk
  are copied into the following one, so each chunk sees its own look-back.
* ``running_sum`` / ``carried_lag``: for unbounded frames. One seed row per
  chunk carries the state left by the earlier chunks.
* ``sliced_sum``: ``running_sum`` along time, over slices so short that a burst
  is many of them; the slices themselves are summed up in two levels.
* ``as_of``: a point-in-time join, by a value carried over slices of time.
* ``time_chunk``: slices of time, for ``running_sum`` and ``carried_lag``.
* ``row_blocks``: blocks of rows, for frames that reach back a limited number of
  rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import floor_div

CHUNK, OWN, BLOCK = "_chunk", "_own", "_block"


def with_lookback(df: DataFrame, position: Column, size: int, reach: int) -> DataFrame:
    """Add ``_chunk`` (``position div size``) and copy rows ahead by ``reach``.

    ``_own`` is false on copies; drop those after the window expressions. A row
    is copied ``reach // size + 1`` times at most.
    """
    first = floor_div(position, size)
    last = floor_div(position + F.lit(reach), size)
    return (
        df.withColumn("_first", first)
        .withColumn(CHUNK, F.explode(F.sequence("_first", last)))
        .withColumn(OWN, F.col(CHUNK) == F.col("_first"))
        .drop("_first")
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(OWN)).drop(CHUNK, OWN, BLOCK)


def running_sum(df: DataFrame, keys: list[str], chunk: str, order: list, sums: dict[str, Column], *,
                own: bool = True) -> DataFrame:
    """Cumulative sums per key in ``order``, computed chunk by chunk; without the row itself unless ``own``.

    ``chunk`` must not decrease along ``order``. Chunk totals are aggregated
    before the shuffle; their prefix sums enter each chunk as a seed row.
    """
    temp = {f"_v_{n}": c for n, c in sums.items()}
    rows = df.withColumns(temp)
    totals = rows.groupBy(*keys, chunk).agg(*[F.sum(t).alias(t) for t in temp])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(chunk).rowsBetween(
        Window.unboundedPreceding, -1)
    seeds = totals.select(
        *keys, chunk, *[F.sum(t).over(before).alias(t) for t in temp], F.lit(1).alias("_seed"))
    union = rows.withColumn("_seed", F.lit(0)).unionByName(seeds, allowMissingColumns=True)
    within = Window.partitionBy(*keys, chunk).orderBy(F.col("_seed").desc(), *order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if own else -1)
    return (
        union.withColumns({n: F.sum(f"_v_{n}").over(within) for n in sums})
        .where(F.col("_seed") == 0)
        .drop("_seed", *temp)
    )


def sliced_sum(df: DataFrame, keys: list[str], time: str, size: int, sums: dict[str, Column], *,
               order: list[str] | None = None, part: int = 4096) -> DataFrame:
    """Cumulative sums per key along ``time``, a whole number; computed in slices of ``size``.

    Rows of one time count together; with ``order``, which starts with
    ``time``, one after the other. Slice totals are aggregated before the
    shuffle and summed up in parts of ``part`` slices, so that a task holds one
    slice of rows, ``part`` totals of slices, or one total per part of a key.
    """
    temp = {f"_s_{n}": c for n, c in sums.items()}
    rows = df.withColumns(temp).withColumn("_slice", floor_div(F.col(time), size))
    totals = rows.groupBy(*keys, "_slice").agg(*[F.sum(t).alias(t) for t in temp]).withColumn(
        "_part", floor_div(F.col("_slice"), part))
    earlier = running_sum(totals, keys, "_part", ["_slice"], {f"_e{t}": F.col(t) for t in temp}, own=False)
    seeds = earlier.select(*keys, "_slice", *[F.col(f"_e{t}").alias(t) for t in temp], F.lit(1).alias("_first"))
    union = rows.withColumn("_first", F.lit(0)).unionByName(seeds, allowMissingColumns=True)
    slices = Window.partitionBy(*keys, "_slice")
    within = (slices.orderBy(F.col("_first").desc(), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
              if order else slices.orderBy(F.asc_nulls_first(time)).rangeBetween(Window.unboundedPreceding, 0))
    return (
        union.withColumns({n: F.sum(f"_s_{n}").over(within) for n in sums})
        .where(F.col("_first") == 0)
        .drop("_first", "_slice", *temp)
    )


def carried_lag(df: DataFrame, keys: list[str], chunk: str, order: list[str], cols: dict[str, str]) -> DataFrame:
    """``lag(col)`` per key in ``order`` for ``{output: col}``, chunk by chunk."""
    carried = list(dict.fromkeys([*order, *cols.values()]))
    lasts = df.groupBy(*keys, chunk).agg(F.max(F.struct(*carried)).alias("_last"))
    later = Window.partitionBy(*keys).orderBy(chunk)
    seeds = (
        lasts.withColumn("_to", F.lead(chunk).over(later))
        .where(F.col("_to").isNotNull())
        .select(*keys, F.col("_to").alias(chunk), "_last.*", F.lit(1).alias("_seed"))
    )
    union = df.withColumn("_seed", F.lit(0)).unionByName(seeds, allowMissingColumns=True)
    within = Window.partitionBy(*keys, chunk).orderBy(F.col("_seed").desc(), *order)
    return (
        union.withColumns({n: F.lag(c).over(within) for n, c in cols.items()})
        .where(F.col("_seed") == 0)
        .drop("_seed")
    )


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, cols: list[str], *,
          order: tuple[str, ...] = (), seconds: int = 3600) -> DataFrame:
    """Add ``cols`` of the newest row of ``right`` at or before the time of each row; null where there is none.

    Both tables are cut into slices of ``seconds`` and read once, in order of
    time; the last row of the earlier slices enters a slice as a seed. So a key
    with most of the rows is worked off by many tasks, and no pair of rows is
    made. Rows of ``right`` at the same time are told apart by ``order``.
    """
    slice_of = floor_div(F.unix_micros("_at"), seconds * 1_000_000)
    marks = right.select(*keys, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), F.struct(
        F.col(right_time).alias("_t"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *cols).alias("_carried"))
    rows = left.withColumns({"_at": F.col(left_time), "_side": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn(CHUNK, slice_of)
    lasts = rows.groupBy(*keys, CHUNK).agg(F.max("_carried").alias("_carried"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    seeds = lasts.withColumn("_carried", F.last("_carried", True).over(before)).where("_carried is not null").withColumn("_side", F.lit(-1))
    within = Window.partitionBy(*keys, CHUNK).orderBy("_at", "_side", "_carried").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)  # seeds have no time and come first
    found = rows.unionByName(seeds, allowMissingColumns=True).withColumn("_carried", F.last("_carried", True).over(within))
    return found.where("_side = 1").select(*left.columns, *[F.col(f"_carried.{c}").alias(c) for c in cols])


def time_chunk(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Add ``_chunk``: the slice of ``seconds`` that a row's time falls in."""
    return df.withColumn(CHUNK, floor_div(F.unix_micros(ts), seconds * 1_000_000))


def row_blocks(df: DataFrame, keys: list[str], time: str, order: list[str], *, reach: int, slice_units: int,
               block: int = 10_000) -> DataFrame:
    """Add ``_block``: blocks of ``block`` rows of each group.

    ``df`` comes from ``with_lookback`` and is grouped by ``keys``. Rows get
    dense positions by prefix counts over time slices; the last ``reach`` rows
    of a block are copied into the next.
    """
    df = running_sum(df.withColumn("_slice", floor_div(F.col(time), slice_units)), keys, "_slice", order, {"_at": F.lit(1)})
    first = floor_div(F.col("_at") - 1, block)
    last = floor_div(F.col("_at") - 1 + F.lit(reach), block)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(
        OWN, F.col(OWN) & (F.col(BLOCK) == first)).drop("_slice", "_at")
