"""The full window feature table of a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import WindowConfig
from ..functions.columns import temporal
from ..operators.rolling import all_rolling
from ..operators.windows import START, window_aggregates


def feature_table(log: DataFrame, cfg: WindowConfig = WindowConfig(), *, series: Column | None = None) -> DataFrame:
    """Aggregates, calendar, burst, rolling and rate-of-change features."""
    table = window_aggregates(log, cfg.window_seconds, series=series).withColumns(temporal(F.col(START)))
    return all_rolling(table, cfg.rolling_windows, cfg.burst_window)
