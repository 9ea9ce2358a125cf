"""Exact ordered folds over long series, parallel over chunks.

A smoothed limit depends on the limit before it, and integer truncation makes
the step non-linear, so it is no window expression. But its state is one of
finitely many integers: a chunk of the series is therefore a table "state
before -> state after". Tables of all chunks are built at the same time.
Tables compose, so those of ``FAN`` chunks in a row become one, and so on for
``levels``; what is left is chained per series. The start states then go down
the same tree, and each chunk is replayed from its own. No task sees more than
``FAN`` tables on the way, and the result equals the one-by-one fold.

Long series (``levels``) are written once. Their chunks are built and replayed
from the position and the folded value alone, one row of results to a chunk, so
that the other columns of a request are never handed to Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..session import materialize
from .chunks import CHUNK
from .columns import floor_div

#: Chunk tables composed by one task; a table is at most the range of states long.
FAN = 1024
GROUP = "_group"
#: States meet soon, though not always in one; after each block those that have met go on as one, and ``FEW`` one by one.
BLOCK, FEW = 64, 16


def _chunked(df: DataFrame, position: str, size: int) -> DataFrame:
    return df.withColumn(CHUNK, floor_div(F.col(position).cast("bigint"), size))


def _run(df: DataFrame, key: str, position: str, size: int, value: str, *, start, table, compose, chain, step,
         table_type: str, state_type: str, output: T.StructField, starts: DataFrame | None = None,
         levels: int = 0, fan: int = FAN) -> DataFrame:
    """The passes shared by both folds; ``df`` has a dense position. ``step`` lists the states after each value.

    ``starts`` (key, state) are the states that series go on from; others begin
    at ``start``.
    """
    if levels:
        df = materialize(df, "fold")
    cut = _chunked(df.select(key, position, value) if levels else df, position, size)

    def _with_key(rest: str) -> T.StructType:
        return T.StructType([df.schema[key], *T._parse_datatype_string(rest).fields])

    def build(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [group[0]], CHUNK: [group[1]], "_table": [table(pdf.sort_values(position))]})

    tables = cut.groupBy(key, CHUNK).applyInPandas(
        build, _with_key(f"{CHUNK} bigint, _table {table_type}"))

    def along(pdf: pd.DataFrame, state) -> pd.DataFrame:
        pdf, states = pdf.sort_values(CHUNK), []
        for one in pdf["_table"]:
            states.append(state)
            state = chain(one, state)
        return pd.DataFrame({key: pdf[key], CHUNK: pdf[CHUNK], "_start": states})

    def link(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["_first"].iloc[0]
        return along(pdf, start if pd.isna(first) else first)

    def merge(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for one in pdf.sort_values(CHUNK)["_table"]:
            whole = one if whole is None else compose(whole, one)
        return pd.DataFrame({key: [group[0]], CHUNK: [group[1]], "_table": [whole]})

    def below(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return along(left, right["_start"].iloc[0])

    started = _with_key(f"{CHUNK} bigint, _start {state_type}")

    def chunk_starts(tables: DataFrame, levels: int) -> DataFrame:
        """The state that each chunk begins with."""
        if levels:
            grouped = tables.withColumn(GROUP, floor_div(F.col(CHUNK), fan))
            merged = grouped.groupBy(key, GROUP).applyInPandas(merge, tables.schema)
            above = chunk_starts(merged, levels - 1)
            return grouped.groupBy(key, GROUP).cogroup(above.groupBy(key, CHUNK)).applyInPandas(below, started)
        if starts is None:
            tables = tables.withColumn("_first", F.lit(None).cast(state_type))
        else:
            own = starts.toDF(key, "_first").withColumn("_first", F.col("_first").cast(state_type))
            tables = tables.join(own, key, "left")
        return tables.groupBy(key).applyInPandas(link, started)

    schema = T.StructType([*df.schema.fields, output])

    def replay(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=schema.names)
        pdf = left.sort_values(position).drop(columns=CHUNK)
        return pdf.assign(**{output.name: step(pdf, right["_start"].iloc[0])})

    def states(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=["_key", "_at", "_from", "_states"])
        pdf = left.sort_values(position)
        return pd.DataFrame({"_key": pdf[key].iloc[:1].tolist(), "_at": pdf[CHUNK].iloc[:1].tolist(), "_from": pdf[position].iloc[:1].tolist(),
                             "_states": [step(pdf, right["_start"].iloc[0])]})

    begun = chunk_starts(tables, levels)
    chunks = cut.groupBy(key, CHUNK).cogroup(begun.groupBy(key, CHUNK))
    if not levels:
        return chunks.applyInPandas(replay, schema)
    kinds = T._parse_datatype_string("_at bigint, _from bigint").fields
    found = chunks.applyInPandas(states, T.StructType([
        T.StructField("_key", df.schema[key].dataType), *kinds, T.StructField("_states", T.ArrayType(output.dataType))]))
    place = (F.col(position) - F.col("_from") + 1).cast("int")
    return _chunked(df, position, size).join(found, F.col(key).eqNullSafe(F.col("_key")) & (F.col(CHUNK) == F.col("_at"))).select(
        *df.columns, F.element_at("_states", place).alias(output.name))


def limit_trajectory(df: DataFrame, key: str, position: str, raw: str, *, start: float, alpha: float,
                     low: int, high: int, out: str = "rate_limit", size: int = 4096,
                     starts: DataFrame | None = None, levels: int = 0, fan: int = FAN) -> DataFrame:
    """``L_t = int(clip(alpha * raw_t + (1 - alpha) * L_{t-1}, low, high))``.

    Without ``levels`` one task chains the chunks of a series, which fits window
    tables (4 million windows are 1,024 chunks). With two, 4 * 10^12 rows of one
    series leave no task more than ``fan`` tables.

    ``starts`` (key, limit) are limits that an earlier run ended with. One that
    is not an integer of the range, as after a change of the bounds, is brought
    to the nearest below it or to the bound.
    """
    if starts is not None:
        name, limit = starts.columns
        starts = starts.select(name, F.greatest(F.lit(low), F.least(F.lit(high), F.floor(limit))).cast("double").alias(limit))
    # every state after the first step is an integer of this range
    states = np.arange(low, high + 1, dtype="float64")
    keep = 1.0 - alpha

    def advance(value, x):
        return np.trunc(np.clip(alpha * x + keep * value, low, high))

    def one_by_one(values, state):
        """As ``advance``, for one state; far faster on plain numbers."""
        for x in values:
            state = alpha * x + keep * state
            state = float(int(low if state < low else high if state > high else state))
            yield state

    def table(pdf):
        # entry 0 answers for the start value, which may lie outside the range
        value, values = np.concatenate([[start], states]), pdf[raw].to_numpy("float64").tolist()
        leads = np.arange(value.size)  # the place in ``value`` that each state has come to
        for i in range(0, len(values), BLOCK):
            block = values[i:i + BLOCK]
            if value.size > FEW:
                for x in block:
                    value = advance(value, x)
            else:
                value = np.array([list(one_by_one(block, v))[-1] for v in value.tolist()])
            value, place = np.unique(value, return_inverse=True)
            leads = place[leads]
        return value.astype("int64").tolist() if value.size == 1 else value[leads].astype("int64").tolist()

    def compose(first, then):
        first, then = np.asarray(first), np.asarray(then)
        return (then if then.size == 1 else then[first - low + 1]).tolist()

    def chain(one, state):
        if len(one) == 1:
            return float(one[0])
        known = state == int(state) and low <= state <= high
        return float(one[int(state) - low + 1 if known else 0])

    def step(pdf, state):
        return [int(s) for s in one_by_one(pdf[raw].to_numpy("float64").tolist(), float(state))]

    return _run(df, key, position, size, raw, start=float(start), table=table, compose=compose, chain=chain, step=step,
                table_type="array<bigint>", state_type="double", output=T.StructField(out, T.LongType()), starts=starts,
                levels=levels, fan=fan)


def clamped_sum(df: DataFrame, key: str, position: str, delta: str, *, start: float, low: float,
                high: float, out: str, size: int = 100_000, starts: DataFrame | None = None,
                levels: int = 0, fan: int = FAN) -> DataFrame:
    """``x_t = min(high, max(low, x_{t-1} + delta_t))`` where delta is not 0.

    Clamped additions compose: a chunk is ``x -> min(u, max(l, x + c))``.
    """
    def table(pdf):
        c, l, u = 0.0, -np.inf, np.inf
        for d in pdf[delta].to_numpy("float64"):
            if d > 0:
                c, l, u = c + d, min(high, l + d), min(high, u + d)
            elif d < 0:
                c, l, u = c + d, max(low, l + d), max(low, u + d)
        return [float(c), float(l), float(u)]

    def compose(first, then):
        (a, l, u), (b, low_, high_) = first, then
        return [a + b, float(min(high_, max(low_, l + b))), float(min(high_, max(low_, u + b)))]

    def chain(one, state):
        c, l, u = one
        return float(min(u, max(l, state + c)))

    def step(pdf, state):
        values = np.empty(len(pdf))
        for i, d in enumerate(pdf[delta].to_numpy("float64")):
            if d > 0:
                state = min(high, state + d)
            elif d < 0:
                state = max(low, state + d)
            values[i] = state
        return values.tolist()

    return _run(df, key, position, size, delta, start=float(start), table=table, compose=compose, chain=chain, step=step,
                table_type="array<double>", state_type="double", output=T.StructField(out, T.DoubleType()), starts=starts,
                levels=levels, fan=fan)
