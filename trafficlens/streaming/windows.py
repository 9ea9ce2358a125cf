"""Streaming window statistics in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import safe_ratio
from ..operators.windows import NO, SERIES, START, check_width


def _with_series(stream: DataFrame) -> DataFrame:
    return stream if SERIES in stream.columns else stream.withColumn(SERIES, F.lit("all"))


def _statistics(stream: DataFrame, delay: str, width: str, slide: str | None) -> DataFrame:
    """Exact counts and distinct counts per window, in append mode.

    The first aggregation is keyed by window and value, so the state of a busy
    window spreads over all partitions and no set of users is ever held in one
    row; the second adds up those counts.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = _with_series(stream).withWatermark("ts", delay).select(
        SERIES, window.alias("w"), "ts", "user_id", "ip", "status_code", "endpoint", "response_time",
        F.col("is_attack") if "is_attack" in stream.columns else F.lit(0).alias("is_attack"))
    long = rows.withColumn("_x", F.explode(F.array(
        F.struct(F.lit("user").alias("dim"), F.col("user_id").alias("value")),
        F.struct(F.lit("ip").alias("dim"), F.col("ip").alias("value")))))
    once = F.col("_x.dim") == "user"
    per_value = long.groupBy("w", SERIES, F.col("_x.dim").alias("dim"), F.col("_x.value").alias("value")).agg(
        F.count_if(once).alias("n"),
        F.count_if(once & (F.col("status_code") >= 400)).alias("errors"),
        F.count_if(once & (F.col("endpoint") == "/api/checkout")).alias("checkouts"),
        F.sum(F.when(once, F.col("response_time")).otherwise(0.0)).alias("latency"),
        F.max("is_attack").alias("is_attack"))
    # the window column itself keys the second aggregation: it keeps the watermark
    per_window = per_value.groupBy("w", SERIES).agg(
        F.sum("n").alias("request_count"), F.sum("errors").alias("errors"), F.sum("checkouts").alias("checkouts"),
        F.sum("latency").alias("latency"), F.max("is_attack").alias("is_attack"),
        F.count_if(F.col("dim") == "user").alias("unique_users"),
        F.count_if(F.col("dim") == "ip").alias("unique_ips"))
    return per_window


def window_features(stream: DataFrame, seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Tumbling windows, emitted once when the watermark passes their end."""
    check_width(seconds)
    n = F.col("request_count")
    return _statistics(stream, delay, f"{seconds} seconds", None).select(
        SERIES, F.col("w"),
        F.floor(F.unix_seconds(F.col("w.start")) / seconds).alias(NO), F.col("w.start").alias(START),
        "request_count", "unique_users", "unique_ips",
        (F.col("errors") / (n + 1)).alias("error_rate"),
        safe_ratio(F.col("latency"), n).alias("avg_response_time"),
        (F.col("checkouts") / (n + 1)).alias("checkout_ratio"),
        (n / (F.col("unique_ips") + 1)).alias("ip_concentration"),
        "is_attack")


def simple_features(stream: DataFrame, seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """What the simple rules read, per closed window; plain shares, as in the batch table."""
    check_width(seconds)
    n = F.col("request_count")
    return _statistics(stream, delay, f"{seconds} seconds", None).select(
        SERIES, F.floor(F.unix_seconds(F.col("w.start")) / seconds).alias(NO), F.col("w.start").alias(START),
        "request_count", safe_ratio(F.col("errors"), n).alias("error_rate"),
        (n / (F.col("unique_ips") + 1)).alias("ip_concentration"))


def sliding_statistics(stream: DataFrame, width: str = "60 seconds", slide: str = "5 seconds",
                       delay: str = "10 minutes") -> DataFrame:
    """Overlapping windows: the state of the last ``width`` every ``slide``."""
    n = F.col("request_count")
    return _statistics(stream, delay, width, slide).select(
        SERIES, F.col("w.start").alias(START), F.col("w.end").alias("window_end"),
        "request_count", "unique_users", "unique_ips",
        safe_ratio(F.col("errors"), n).alias("error_rate"),
        safe_ratio(F.col("latency"), n).alias("avg_response_time"),
        safe_ratio(n, F.col("unique_ips")).alias("ip_concentration"))


def deduplicated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of a request id that arrive within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def decide(stream: DataFrame, limits: DataFrame, seconds: int) -> DataFrame:
    """Request stream joined to a static table of window limits."""
    from ..operators.policy import join_windows

    joined = join_windows(stream, limits, seconds)
    return joined.select("request_id", "ts", SERIES, NO, "user_id", "endpoint", "anomaly_score", "rate_limit", "allow")


def running_stats(decisions: DataFrame) -> DataFrame:
    """Counters over a decision stream (complete mode)."""
    blocked = F.count_if(~F.col("allow"))
    total = F.count("*")
    return decisions.groupBy().agg(
        total.alias("total_requests"), F.count_if("allow").alias("allowed"), blocked.alias("blocked"),
        F.coalesce(F.try_divide(blocked.cast("double"), total.cast("double")), F.lit(0.0)).alias("block_rate"))
