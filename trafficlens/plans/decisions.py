"""From a request log to limit decisions per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import FULL, ONLINE, SIMPLE, BehaviorConfig, HeuristicConfig, LimitConfig, OnlineHeuristicConfig, WindowConfig
from ..operators import behavior, heuristics, policy
from ..operators.forecast import previous_sequence
from ..operators.rolling import moving_average_forecast, spike_ratio_simple
from ..operators.windows import KEY, POS, assign_windows, simple_window_features, user_share
from ..session import materialize
from .feature_table import feature_table
from .training import TrainedModels


def simple_features(log: DataFrame, seconds: int) -> DataFrame:
    return spike_ratio_simple(simple_window_features(log, seconds))


def window_decisions(log: DataFrame, seconds: int = 60, limits: LimitConfig = SIMPLE,
                     rules: HeuristicConfig = HeuristicConfig()) -> DataFrame:
    """Heuristic score, smoothed limit, decision and reason for every window."""
    return policy.simple_decisions(simple_features(log, seconds), heuristics.window_score(rules), limits, rules)


def heaviest_user(log: DataFrame, seconds: int) -> DataFrame:
    """Requests, window total and bot flag of the busiest user of each window."""
    shares = user_share(log, seconds)
    top = F.max(F.struct("user_requests", "is_bot"))
    return shares.groupBy(*KEY).agg(top.alias("_top"), F.max("total_requests").alias("total_requests")).select(
        *KEY, F.col("_top.user_requests").alias("user_requests"), F.col("_top.is_bot").alias("user_is_bot"),
        "total_requests")


def window_risk(log: DataFrame, seconds: int, cfg: BehaviorConfig = BehaviorConfig()) -> DataFrame:
    """Highest suspicion score among the requests of each window."""
    scored = assign_windows(behavior.suspicion(log, cfg), seconds)
    return scored.groupBy(*KEY).agg(F.max("suspicion_score").alias("behavioral_risk"))


def metrics_from_load(table: DataFrame, per_request: float) -> DataFrame:
    """A metrics table for logs without one: cpu grows with the request count."""
    return table.select(*KEY, F.least(F.lit(100.0), F.col("request_count") * per_request).alias("cpu_usage"))


def model_inputs(log: DataFrame, models: TrainedModels, seconds: int) -> DataFrame:
    """Forecast and anomaly probability of each window by trained models.

    The forecast is made from the windows before, with zeros where there are
    too few. The feature table is written once and read by both models.
    """
    table = materialize(feature_table(log, WindowConfig(window_seconds=seconds)), "model-inputs")
    out = models.score(table).select(*KEY, F.col("anomaly_probability").alias("_anomaly"))
    if models.forecaster is None:
        return out.withColumn("_predicted", F.lit(None).cast("double"))
    ahead = models.forecaster.transform(previous_sequence(table.select(*KEY, POS, "request_count"), models.forecaster.length))
    return out.join(ahead.select(*KEY, F.col("predicted").alias("_predicted")), KEY)


def full_inputs(log: DataFrame, metrics: DataFrame, seconds: int, limits: LimitConfig = FULL,
                cfg: BehaviorConfig = BehaviorConfig(), models: TrainedModels | None = None) -> DataFrame:
    """Everything the full limit formula reads, one row per window.

    Without ``models`` (or without a forecaster) the moving average stands for
    the forecast, without ``models`` the ladder of load ratios for the forest.
    """
    table = moving_average_forecast(simple_window_features(log, seconds), limits.base_limit)
    table = table.withColumn("anomaly_score", heuristics.ratio_ladder(F.col("request_count"), limits.base_limit))
    if models is not None:
        table = table.join(model_inputs(log, models, seconds), KEY, "left").withColumns({
            "anomaly_score": F.coalesce("_anomaly", "anomaly_score"),
            "predicted": F.coalesce("_predicted", "predicted")}).drop("_anomaly", "_predicted")
    for side in (heaviest_user(log, seconds), window_risk(log, seconds, cfg)):
        table = table.join(side, KEY, "left")
    sale = F.lit(0)
    if "traffic_type" in log.columns:
        sales = assign_windows(log, seconds).groupBy(*KEY).agg(
            F.max((F.col("traffic_type") == "flash_sale").cast("int")).alias("_sale"))
        table, sale = table.join(sales, KEY, "left"), F.coalesce("_sale", F.lit(0))
    table = policy.attach_metrics(table, metrics).withColumn("is_flash_sale", sale)
    # an empty window has one request by one harmless user, as the defaults say
    return table.fillna({"user_requests": 1, "total_requests": 1, "user_is_bot": 0, "behavioral_risk": 0.0})


def full_window_decisions(log: DataFrame, metrics: DataFrame, seconds: int = 60, limits: LimitConfig = FULL,
                          cfg: BehaviorConfig = BehaviorConfig(), models: TrainedModels | None = None) -> DataFrame:
    return policy.full_decisions(full_inputs(log, metrics, seconds, limits, cfg, models), limits)


def online_inputs(log: DataFrame, seconds: int, rules: OnlineHeuristicConfig = OnlineHeuristicConfig()) -> DataFrame:
    """Inputs of the online formula: current load as forecast, additive score."""
    table = simple_window_features(log, seconds).join(heaviest_user(log, seconds), KEY, "left")
    table = table.withColumns({
        "user_request_count": F.coalesce("user_requests", F.lit(0)),
        "ip_concentration": F.coalesce(
            F.try_divide(F.col("request_count").cast("double"), F.col("unique_ips").cast("double")), F.lit(0.0)),
        "predicted": F.col("request_count").cast("double"),
    })
    return table.withColumn("anomaly_score", heuristics.online_score(rules))


def online_window_decisions(log: DataFrame, seconds: int = 60, limits: LimitConfig = ONLINE,
                            rules: OnlineHeuristicConfig = OnlineHeuristicConfig()) -> DataFrame:
    return policy.online_decisions(online_inputs(log, seconds, rules), limits)
