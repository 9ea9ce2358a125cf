"""Row-frame features of the dense window table.

All frames have a bounded reach, so the table is cut into chunks of windows
with a copied look-back: one series never becomes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.chunks import CHUNK, own_rows, with_lookback
from ..functions.columns import clip, safe_ratio
from .windows import POS, SERIES

CHUNK_WINDOWS = 4096


def over_windows(table: DataFrame, reach: int, exprs) -> DataFrame:
    """Add ``exprs(window)`` columns; ``reach`` is the longest look-back in rows."""
    cut = with_lookback(table, F.col(POS), CHUNK_WINDOWS, reach)
    w = Window.partitionBy(SERIES, CHUNK).orderBy(POS)
    return own_rows(cut.withColumns(exprs(w)))


def _burst(w, count: Column, k: int) -> dict[str, Column]:
    frame = w.rowsBetween(-(k - 1), 0)
    full = F.count(count).over(frame) == k
    return {
        # a standard deviation, kept under its established name
        "request_variance": F.when(full, F.coalesce(F.stddev_samp(count).over(frame), F.lit(0.0))).otherwise(0.0),
        "spike_ratio": F.when(full, count / (F.avg(count).over(frame) + 1)).otherwise(0.0),
    }


def _rolling(w, count: Column, windows) -> dict[str, Column]:
    out = {}
    for k in windows:
        frame = w.rowsBetween(-(k - 1), 0)
        mean, std = F.avg(count).over(frame), F.stddev_samp(count).over(frame)
        out[f"request_count_ma{k}"] = mean
        out[f"request_count_std{k}"] = std
        out[f"request_count_max{k}"] = F.max(count).over(frame)
        out[f"deviation_ma{k}"] = (count - mean) / (std + 1)
    return out


def _change(w, count: Column) -> dict[str, Column]:
    one, two = F.lag(count, 1).over(w), F.lag(count, 2).over(w)
    zero = F.lit(0).cast("bigint")
    return {
        "request_velocity": F.coalesce(count - one, zero),
        "request_acceleration": F.coalesce((count - one) - (one - two), zero),
        "request_pct_change": F.coalesce(F.try_divide(count.cast("double"), one.cast("double")) - 1, F.lit(0.0)),
    }


def burst_metrics(table: DataFrame, k: int = 5) -> DataFrame:
    """Rolling std and spike ratio; 0 until ``k`` windows have been seen."""
    return over_windows(table, k, lambda w: _burst(w, F.col("request_count"), k))


def rolling_stats(table: DataFrame, windows=(5, 10, 30)) -> DataFrame:
    """Rolling mean, std, max and deviation; the first std is null."""
    return over_windows(table, max(windows), lambda w: _rolling(w, F.col("request_count"), windows))


def rate_of_change(table: DataFrame) -> DataFrame:
    return over_windows(table, 2, lambda w: _change(w, F.col("request_count")))


def all_rolling(table: DataFrame, windows=(5, 10, 30), k: int = 5) -> DataFrame:
    """Burst, rolling and rate-of-change features in one sort of the table."""
    count = F.col("request_count")
    return over_windows(
        table, max(*windows, k, 2),
        lambda w: {**_burst(w, count, k), **_rolling(w, count, windows), **_change(w, count)})


def spike_ratio_simple(table: DataFrame, k: int = 5) -> DataFrame:
    """Count over the mean of up to ``k`` windows; 0 when both are 0."""
    count = F.col("request_count")
    return over_windows(
        table, k, lambda w: {"spike_ratio": safe_ratio(count, F.avg(count).over(w.rowsBetween(-(k - 1), 0)))})


def smoothed_signal(table: DataFrame, k: int = 5, value: str = "request_count") -> DataFrame:
    """Relative excess over the rolling mean, scaled to 0..1."""
    count = F.col(value)

    def signal(w):
        ratio = count / (F.avg(count).over(w.rowsBetween(-(k - 1), 0)) + F.lit(1e-8))
        return {"traffic_signal": clip((ratio - 1) / 5, 0.0, 1.0)}

    return over_windows(table, k, signal)


def moving_average_forecast(table: DataFrame, base: float, k: int = 10) -> DataFrame:
    """Mean of the previous ``k`` windows, ``base`` before there are any."""
    count = F.col("request_count")
    return over_windows(
        table, k, lambda w: {"predicted": F.coalesce(F.avg(count).over(w.rowsBetween(-k, -1)), F.lit(float(base)))})


def first_windows(table: DataFrame, n: int) -> DataFrame:
    """The first ``n`` windows of each series; positions are dense, no ranking."""
    return table.where(F.col(POS) < n)


def chronological_split(table: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Label the first ``int(share * n)`` windows of each series as train."""
    sizes = table.groupBy(SERIES).agg(
        F.floor(F.lit(train_share) * (F.max(POS) + 1)).cast("bigint").alias("_train"))
    return (
        table.join(sizes, SERIES)
        .withColumn("split", F.when(F.col(POS) < F.col("_train"), "train").otherwise("test"))
        .drop("_train")
    )
