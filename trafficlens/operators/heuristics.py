"""Rule-based anomaly scores, used where no model is fitted."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import HeuristicConfig, OnlineHeuristicConfig
from ..functions.columns import clip


def _add(*rules: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for cond, points in rules:
        total = total + F.when(cond, points).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def ratio_ladder(rate: Column, base: float) -> Column:
    """Score by how many times the base limit is exceeded."""
    ratio = rate / F.lit(float(base))
    return F.when(ratio > 5, 0.9).when(ratio > 3, 0.7).when(ratio > 2, 0.4).otherwise(0.1)


#: Fixed value: points of a window whose count spikes.
SPIKE_POINTS = 0.3


def window_score(cfg: HeuristicConfig = HeuristicConfig(), spike: bool = True) -> Column:
    """Score of a window table row; without the spike rule where a stream adds that from its state."""
    return _add(
        *([(F.col("spike_ratio") > cfg.spike_ratio, SPIKE_POINTS)] if spike else []),
        (F.col("ip_concentration") > cfg.ip_concentration, 0.3),
        (F.col("error_rate") > cfg.error_rate, 0.2),
        (F.col("request_count") > cfg.request_count, 0.2))


def online_score(cfg: OnlineHeuristicConfig = OnlineHeuristicConfig()) -> Column:
    """Score of a trailing-window snapshot row."""
    return _add(
        (F.col("request_count") > cfg.request_count, 0.3),
        (F.col("ip_concentration") > cfg.ip_concentration, 0.3),
        (F.col("error_rate") > cfg.error_rate, 0.2),
        (F.col("user_request_count") > cfg.user_request_count, 0.2))


def threshold_score(count: Column, threshold: Column) -> Column:
    return clip(count / (threshold + F.lit(1e-8)), 0.0, 1.0)
