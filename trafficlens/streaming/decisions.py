"""Decisions of a live stream, by limits that the same stream has led to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SIMPLE, HeuristicConfig, LimitConfig
from ..functions.columns import micros
from ..operators import heuristics
from ..operators.windows import NO, SERIES
from .state import adaptive_limits
from .windows import simple_features

LOOK_BACK = 5
PARTS = 32


def window_limits(stream: DataFrame, seconds: int = 60, limits: LimitConfig = SIMPLE,
                  rules: HeuristicConfig = HeuristicConfig(), delay: str = "10 minutes") -> DataFrame:
    """Score, smoothed limit and decision of each window, once the watermark has passed its end."""
    rows = simple_features(stream, seconds, delay).withColumn("points", heuristics.window_score(rules, spike=False))
    return adaptive_limits(rows, limits, spike=(rules.spike_ratio, heuristics.SPIKE_POINTS, LOOK_BACK), width=seconds)


def live_decisions(stream: DataFrame, seconds: int = 60, limits: LimitConfig = SIMPLE,
                   rules: HeuristicConfig = HeuristicConfig(), delay: str = "10 minutes") -> DataFrame:
    """A decision for every request of a closed window, by the window's own limit.

    Requests wait in the state of the join until their window closes, and for no
    longer: both sides have the window's end in event time as a key, so the
    watermark clears them. Requests of a window are dealt over ``PARTS`` keys and
    its one limit row is copied for each, so that a busy window is not one task.
    Requests that are late for their window are in neither side.
    """
    named = stream if SERIES in stream.columns else stream.withColumn(SERIES, F.lit("all"))
    waiting = named.withWatermark("ts", delay).withColumn("w", F.window("ts", f"{seconds} seconds"))
    waiting = waiting.withColumn("closes", F.window_time("w")).select(
        SERIES, "closes", F.pmod(F.xxhash64("request_id", "user_id"), F.lit(PARTS)).alias("part"),
        micros(F.col("ts")).alias("t"), "request_id", "user_id", "endpoint")
    closed = window_limits(stream, seconds, limits, rules, delay).select(
        SERIES, "closes", NO, "anomaly_score", "rate_limit", "allow",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).alias("part"))
    return waiting.join(closed, [SERIES, "closes", "part"]).select(
        "request_id", F.timestamp_micros("t").alias("ts"), SERIES, NO, "user_id", "endpoint", "anomaly_score", "rate_limit",
        "allow")
