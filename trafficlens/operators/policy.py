"""Adaptive limit policy: the factors of the limit, the limit, the decisions.

The factors are plain column expressions; only the smoothed limit is ordered
and runs as a chunked fold (see ``functions.fold``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import FULL, ONLINE, SIMPLE, HeuristicConfig, LimitConfig
from ..functions.chunks import CHUNK, as_of, running_sum
from ..functions.columns import clip, floor_div, micros, two_decimals
from ..functions.fold import limit_trajectory
from .windows import KEY, POS, SERIES, START, assign_windows

US = 1_000_000


def prediction_score(predicted: Column, cfg: LimitConfig = FULL) -> Column:
    if cfg.base_limit <= 0:
        return F.lit(1.0)
    return clip(predicted / F.lit(float(cfg.base_limit)), 0.5, 2.0)


def online_prediction_score(predicted: Column, cfg: LimitConfig = ONLINE) -> Column:
    return F.least(F.lit(2.0), predicted / F.lit(float(cfg.base_limit)))


def fairness(user_requests: Column, total_requests: Column, error_rate: Column, is_bot: Column,
             cfg: LimitConfig = FULL) -> Column:
    """Boost for users with a small share and few errors; half of it for bots."""
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(
        user_requests.cast("double"), total_requests.cast("double")), F.lit(1.0)))
    reputation = (F.lit(1.0) - F.least(F.lit(1.0), error_rate)) * F.when(is_bot == 1, 0.5).otherwise(1.0)
    return clip(F.lit(1.0) + F.lit(cfg.fairness_beta) * (F.lit(1.0) - share) * reputation, 0.5, 1.5)


def context(hour: Column, is_business_hours: Column, is_flash_sale: Column, cfg: LimitConfig = FULL) -> Column:
    return (
        F.when(is_flash_sale == 1, F.lit(cfg.flash_sale_multiplier))
        .when(is_business_hours == 1, 1.0)
        .when(hour.between(0, 6), 0.6)
        .when(hour.between(18, 22), 0.8)
        .otherwise(1.0))


def online_context(is_business_hours: Column) -> Column:
    return F.when(is_business_hours == 1, 1.2).otherwise(0.8)


def ensemble(prediction: Column, anomaly: Column, risk: Column | None = None, cfg: LimitConfig = FULL,
             w_forecast: Column | None = None, w_anomaly: Column | None = None) -> Column:
    w1 = F.lit(cfg.forecast_weight) if w_forecast is None else w_forecast
    w2 = F.lit(cfg.anomaly_weight) if w_anomaly is None else w_anomaly
    safety = F.lit(1.0) - anomaly
    if risk is not None:
        safety = safety * (F.lit(1.0) - risk)
    return w1 * prediction + w2 * safety


def health(cpu: Column, cfg: LimitConfig = FULL) -> Column:
    """1 up to the cpu threshold, falling to 0.5 at 100 percent; 1 if unknown."""
    stress = (cpu - cfg.cpu_threshold) / (100 - cfg.cpu_threshold)
    return F.when(cpu > cfg.cpu_threshold, F.greatest(F.lit(0.5), 1 - stress * 0.5)).otherwise(1.0)


def confidence(prediction: Column, anomaly: Column, fair: Column, risk: Column) -> Column:
    one = F.lit(1.0)
    return clip(
        F.lit(0.3) * F.greatest(anomaly, one - anomaly)
        + F.lit(0.25) * (one - F.abs(prediction - one))
        + F.lit(0.25) * (one - F.abs(fair - one))
        + F.lit(0.2) * F.greatest(risk, one - risk),
        0.0, 1.0)


def attach_metrics(table: DataFrame, metrics: DataFrame) -> DataFrame:
    """System metrics per window; windows without a sample keep nulls."""
    return table.join(metrics, KEY, "left")


def smoothed_limits(table: DataFrame, cfg: LimitConfig, raw: str = "raw_limit", *,
                    starts: DataFrame | None = None, levels: int = 0) -> DataFrame:
    """Add ``rate_limit``: the raw limit smoothed, bounded and truncated in order.

    ``starts`` (series_key, limit) are the limits that an earlier run ended with.
    ``levels`` are those of the fold: 0 for windows, 2 for requests.
    """
    return limit_trajectory(table, SERIES, POS, raw, start=cfg.base_limit, alpha=cfg.alpha, low=cfg.min_limit,
                            high=cfg.max_limit, starts=starts, levels=levels)


def learned_weights(table: DataFrame, weights: DataFrame, at: str = START, *, seconds: int = 86_400) -> DataFrame:
    """Add ``forecast_weight`` and ``anomaly_weight``: the newest learned at or before the decision.

    ``weights`` is a weight trajectory (policy_key, ts, request_id and the two
    weights), its policies are the series. Rows before the first feedback keep
    nulls, for which the formulas take the configured weights.
    """
    own = weights.withColumnRenamed("policy_key", SERIES)
    return as_of(table, own, [SERIES], at, "ts", ["forecast_weight", "anomaly_weight"], order=("request_id",), seconds=seconds)


def _weights(table: DataFrame, cfg: LimitConfig) -> dict[str, Column]:
    if "anomaly_weight" not in table.columns:
        return {}
    return {"w_forecast": F.coalesce("forecast_weight", F.lit(cfg.forecast_weight)),
            "w_anomaly": F.coalesce("anomaly_weight", F.lit(cfg.anomaly_weight))}


def allowed(rate: Column, limit: Column) -> Column:
    return rate < limit


# Reason texts are fixed values.
def full_reason(rate: Column, limit: Column, anomaly: Column, risk: Column) -> Column:
    return (
        F.when(rate < limit, "Allowed: Within adaptive rate limit")
        .when(risk > 0.8, "Blocked: Bot pattern detected across endpoints")
        .when(anomaly > 0.7, "Blocked: High anomaly score (suspected attack)")
        .when(rate > limit * 1.5, "Blocked: Excessive traffic rate")
        .otherwise(F.concat(F.lit("Blocked: Rate "), rate.cast("string"),
                            F.lit(" exceeds limit "), limit.cast("string"))))


def online_reason(rate: Column, limit: Column, anomaly: Column) -> Column:
    return (
        F.when(rate < limit, "Traffic within normal limits")
        .when(anomaly > 0.7, F.concat(
            F.lit("High anomaly score ("), two_decimals(anomaly), F.lit(") - suspected attack")))
        .when(rate > limit * 1.5, F.concat(
            F.lit("Excessive traffic rate ("), rate.cast("string"), F.lit(" req/min)")))
        .otherwise(F.concat(F.lit("Rate "), rate.cast("string"),
                            F.lit(" exceeds adaptive limit "), limit.cast("string"))))


def simple_reason(anomaly: Column, spike: Column, ip_concentration: Column,
                  cfg: HeuristicConfig = HeuristicConfig()) -> Column:
    return F.when(anomaly > 0.5, F.concat(
        F.lit("HIGH ANOMALY (score: "), two_decimals(anomaly), F.lit(")"),
        F.when(spike > cfg.spike_ratio, " - Traffic spike detected").otherwise(""),
        F.when(ip_concentration > cfg.ip_concentration, " - Concentrated IPs").otherwise(""),
    )).otherwise("Normal traffic pattern")


def join_windows(log: DataFrame, limits: DataFrame, seconds: int) -> DataFrame:
    """Attach the columns of a window table to each request.

    An equi-join on series and window. The engine sizes the window side at run
    time: it is broadcast only when small, otherwise skewed windows are split.
    """
    return assign_windows(log, seconds).join(limits, KEY, "left")


def replay_requests(log: DataFrame, limits: DataFrame, seconds: int, *, slices: int = 60) -> DataFrame:
    """Allow the first ``rate_limit`` requests of each window, in arrival order.

    The position in the window is a prefix count over slices of the window, so
    a window with most of the traffic is ranked by many tasks.
    """
    rows = assign_windows(log, seconds).withColumn(
        CHUNK, floor_div(micros(F.col("ts")), max(1, seconds * US // slices)))
    ranked = running_sum(rows, KEY, CHUNK, ["ts", "request_id"], {"position": F.lit(1)}).drop(CHUNK)
    return ranked.join(limits.select(*KEY, "rate_limit"), KEY, "left").withColumn(
        "allow", F.col("position") - 1 < F.col("rate_limit"))


def limit_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(SERIES).agg(
        F.min_by("rate_limit", POS).alias("first_limit"),
        F.min("rate_limit").alias("lowest_limit"),
        F.max_by("rate_limit", POS).alias("last_limit"))


def simple_decisions(features: DataFrame, score: Column, limits: LimitConfig = SIMPLE,
                     heuristics: HeuristicConfig = HeuristicConfig(), *, starts: DataFrame | None = None) -> DataFrame:
    """Window decisions from the anomaly score alone."""
    scored = features.withColumn("anomaly_score", score).withColumn(
        "raw_limit", F.lit(float(limits.base_limit)) * (1 - F.col("anomaly_score")))
    limited = smoothed_limits(scored, limits, starts=starts)
    return limited.withColumns({
        "allow": allowed(F.col("request_count"), F.col("rate_limit")),
        "reason": simple_reason(F.col("anomaly_score"), F.col("spike_ratio"), F.col("ip_concentration"), heuristics),
    })


def online_decisions(features: DataFrame, limits: LimitConfig = ONLINE, *, levels: int = 0) -> DataFrame:
    """Window decisions of the online formula; needs ``predicted`` and ``anomaly_score``."""
    scored = features.withColumn("prediction_score", online_prediction_score(F.col("predicted"), limits))
    scored = scored.withColumn("ensemble_score", ensemble(
        F.col("prediction_score"), F.col("anomaly_score"), None, limits, **_weights(features, limits)))
    scored = scored.withColumn("raw_limit", F.lit(float(limits.base_limit)) * F.col("ensemble_score")
                               * online_context(F.col("is_business_hours")))
    limited = smoothed_limits(scored, limits, levels=levels)
    rate, limit = F.col("request_count"), F.col("rate_limit")
    return limited.withColumns({
        "allow": allowed(rate, limit),
        "reason": online_reason(rate, limit, F.col("anomaly_score")),
        "recommendation": F.when(rate < limit, "Continue normally").otherwise("Reduce request rate"),
    })


def full_factors(features: DataFrame, limits: LimitConfig = FULL) -> DataFrame:
    """All factors of the full formula and the raw limit.

    Reads ``request_count, predicted, anomaly_score, behavioral_risk,
    user_requests, total_requests, error_rate, user_is_bot, hour,
    is_business_hours, is_flash_sale, cpu_usage``.
    """
    col = F.col
    scored = features.withColumns({
        "prediction_score": prediction_score(col("predicted"), limits),
        "fairness_multiplier": fairness(
            col("user_requests"), col("total_requests"), col("error_rate"), col("user_is_bot"), limits),
        "context_multiplier": context(col("hour"), col("is_business_hours"), col("is_flash_sale"), limits),
        "health_multiplier": health(col("cpu_usage"), limits),
    })
    scored = scored.withColumn("ensemble_score", ensemble(
        col("prediction_score"), col("anomaly_score"), col("behavioral_risk"), limits, **_weights(features, limits)))
    return scored.withColumn("raw_limit", F.lit(float(limits.base_limit)) * col("ensemble_score")
                             * col("fairness_multiplier") * col("context_multiplier") * col("health_multiplier"))


def full_decisions(features: DataFrame, limits: LimitConfig = FULL, *, levels: int = 0) -> DataFrame:
    limited = smoothed_limits(full_factors(features, limits), limits, levels=levels)
    rate, limit = F.col("request_count"), F.col("rate_limit")
    return limited.withColumns({
        "allow": allowed(rate, limit),
        "confidence": confidence(F.col("prediction_score"), F.col("anomaly_score"),
                                 F.col("fairness_multiplier"), F.col("behavioral_risk")),
        "reason": full_reason(rate, limit, F.col("anomaly_score"), F.col("behavioral_risk")),
    })


def decision_stats(decisions: DataFrame) -> DataFrame:
    total = F.count("*")
    blocked = F.count_if(~F.col("allow"))
    return decisions.agg(
        total.alias("total_requests"), F.count_if("allow").alias("allowed"), blocked.alias("blocked"),
        F.coalesce(F.try_divide(blocked.cast("double"), total.cast("double")), F.lit(0.0)).alias("block_rate"))


def recent_decisions(decisions: DataFrame, n: int = 20, order: str = "window_start") -> DataFrame:
    """The newest ``n`` decisions; a top-k, so no global sort."""
    return decisions.orderBy(F.desc(order)).limit(n)
