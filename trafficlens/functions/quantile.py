"""Exact interpolated quantiles without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation
buffer. Here the order statistics are selected in two steps, both by counting:

1. Values are counted by key and *cell*, a 1,024th of an octave, before any
   shuffle. Prefix sums over a key's cells say which cell holds a wanted rank.
   A cell's smallest and largest value answer its first and last rank.
2. Only cells with a wanted rank between those are looked into. Their values are
   counted by key, cell and value, and ranked by prefix sums over ``PARTS`` even
   parts of the cell.

Cells are chosen by exact counts, so no rank can be missed, and no task ranks
more than one part of a cell, however many rows a key has.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from .chunks import running_sum

PER_OCTAVE = 1024
PARTS = 4096
#: Above every ``PER_OCTAVE * log2`` of a double, so that cells of positive values are positive.
SHIFT = 1 << 21
CELL, PART = "_cell", "_part"


def cell(v: Column) -> Column:
    """Number of the cell of a double; never falls as the value rises. NaN is the largest value."""
    size = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + SHIFT
    outer = 2 * SHIFT
    return (
        F.when(F.isnan(v), outer + 1).when(v == float("inf"), outer).when(v == float("-inf"), -outer)
        .when(v > 0, size).when(v < 0, -size).otherwise(0))


def _within(rank: Column, start: Column, many: Column) -> Column:
    return (start <= rank) & (rank < start + many)


def _ranks(quantiles: dict[str, float], n: Column) -> list[Column]:
    """The two ranks, from 0, that each quantile of ``n`` values lies between."""
    places = [(n - 1) * F.lit(float(q)) for q in quantiles.values()]
    return [f(place) for place in places for f in (F.floor, F.ceil)]


def counted_cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per key and cell: rows (``_f``), least and largest value, rows in earlier cells (``_start``) and of the key (``_n``)."""
    cells = rows.groupBy(*by, CELL).agg(F.count("*").alias("_f"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    key = Window.partitionBy(*by)
    before = key.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumns({"_start": F.coalesce(F.sum("_f").over(before), F.lit(0)), "_n": F.sum("_f").over(key)})


def ranked_values(rows: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """The distinct values of ``cells`` with their count (``_f``) and the rows of the key before them (``_start``)."""
    other = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*by, CELL])], "_low", "_high", "_start", "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*by, CELL])]
    values = rows.join(other, same).groupBy(*by, CELL, "_v").agg(
        F.count("*").alias("_f"), *[F.first(c).alias(c) for c in ("_low", "_high", "_start", "_n")])
    # halves, because the difference of two large doubles may overflow
    share = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
    values = values.withColumn(PART, F.floor(share * PARTS))
    placed = running_sum(values, [*by, CELL], PART, ["_v"], {"_upto": F.col("_f")})
    return placed.withColumn("_start", F.col("_start") + F.col("_upto") - F.col("_f"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row per key with linear-interpolated quantiles of ``value``; nulls don't count."""
    by = keys or ["_k"]
    v = F.col(value).cast("double") + F.lit(0.0)  # -0.0 becomes 0.0
    rows = df.select(*(keys or [F.lit(0).alias("_k")]), v.alias("_v")).where("_v is not null").withColumn(CELL, cell(F.col("_v")))
    n, f, start = F.col("_n"), F.col("_f"), F.col("_start")
    ranks = _ranks(quantiles, n)
    cells = counted_cells(rows, by).where(reduce(or_, [_within(r, start, f) for r in ranks]))
    between = reduce(or_, [_within(r, start + 1, f - 2) for r in ranks])
    values = ranked_values(rows, cells.where((F.col("_low") < F.col("_high")) & between), by)
    ends = F.array(
        F.struct(start.alias("_start"), F.when(F.col("_low") == F.col("_high"), f).otherwise(1).alias("_f"), F.col("_low").alias("_v")),
        F.struct((start + f - 1).alias("_start"), F.lit(1).cast("bigint").alias("_f"), F.col("_high").alias("_v")))
    known = cells.select(*by, "_n", F.inline(ends)).unionByName(values.select(*by, "_n", "_start", "_f", "_v"))
    found = known.groupBy(*by).agg(F.first("_n").alias("_n"), *[
        F.max(F.when(_within(r, start, f), F.col("_v"))).alias(f"_r{i}") for i, r in enumerate(ranks)])
    results = []
    for i, (name, q) in enumerate(quantiles.items()):
        a, z, place = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}"), (n - 1) * F.lit(float(q))
        results.append(F.when(a == z, a).otherwise(a + (z - a) * (place - F.floor(place))).alias(name))
    return found.select(*keys, *results)
