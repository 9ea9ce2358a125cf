"""Feedback on decisions: outcomes, rewards and the weights learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import FULL, LearningConfig, LimitConfig
from ..functions.chunks import CHUNK, running_sum
from ..functions.columns import floor_div, micros
from ..functions.fold import clamped_sum

US = 1_000_000
POLICY = "policy_key"
SLICE_SECONDS = 3600


def outcome(blocked: Column, label: Column) -> Column:
    return (
        F.when(blocked & (label == 1), "true_positive")
        .when(blocked, "false_positive")
        .when(label == 1, "false_negative")
        .otherwise("true_negative"))


def decision_outcomes(decisions: DataFrame, label: str = "is_attack") -> DataFrame:
    return decisions.withColumn("type", outcome(~F.col("allow"), F.col(label)))


def join_decisions(feedback: DataFrame, decisions: DataFrame) -> DataFrame:
    """Attach each feedback event to the decision it is about."""
    return feedback.join(decisions, "request_id", "left")


def reward(kind: Column, cpu: Column, response_time: Column, cfg: LimitConfig = FULL) -> Column:
    """Weighted accuracy and system reward; missing metrics count as healthy."""
    accuracy = (
        F.when(kind == "true_positive", 1.0).when(kind == "true_negative", 0.5)
        .when(kind == "false_positive", -1.0).when(kind == "false_negative", -2.0).otherwise(0.0))
    system = (
        F.when(cpu > cfg.cpu_threshold, -0.5).otherwise(0.0)
        + F.when(response_time > cfg.response_time_threshold, -0.5).otherwise(0.0))
    return F.lit(0.7) * accuracy + F.lit(0.3) * system


def with_reward(feedback: DataFrame, cfg: LimitConfig = FULL) -> DataFrame:
    return feedback.withColumn("reward", reward(
        F.col("type"), F.col("system_metrics.cpu_usage"), F.col("system_metrics.avg_response_time"), cfg))


def _sliced(feedback: DataFrame) -> DataFrame:
    return feedback.withColumn(CHUNK, floor_div(micros(F.col("ts")), SLICE_SECONDS * US))


def weight_trajectory(feedback: DataFrame, cfg: LimitConfig = FULL,
                      learn: LearningConfig = LearningConfig(), *, starts: DataFrame | None = None) -> DataFrame:
    """Ensemble weights after each feedback event.

    ``starts`` (policy_key, anomaly_weight) are the weights that an earlier run
    ended with; other policies begin with those of ``cfg``.

    Each step moves the same amount from one weight to the other, so weights
    that start with sum 1 keep it and the path is a running sum.
    """
    if abs(cfg.forecast_weight + cfg.anomaly_weight - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    rewarded = with_reward(feedback, cfg)
    size = F.lit(learn.learning_rate) * F.abs("reward")
    move = (
        F.when(F.col("type") == "false_negative", size)
        .when(F.col("type") == "false_positive", -size).otherwise(0.0))
    path = running_sum(_sliced(rewarded), [POLICY], CHUNK, ["ts", "request_id"], {"_moved": move}).drop(CHUNK)
    first = F.lit(cfg.anomaly_weight)
    if starts is not None:
        path = path.join(starts.toDF(POLICY, "_first"), POLICY, "left")
        first = F.coalesce("_first", first)
    # the weights sum to 1
    return path.withColumns({
        "anomaly_weight": first + F.col("_moved"),
        "forecast_weight": F.lit(cfg.forecast_weight + cfg.anomaly_weight) - first - F.col("_moved"),
    }).drop("_moved", "_first")


def clamped_weight_trajectory(feedback: DataFrame, cfg: LimitConfig = FULL,
                              learn: LearningConfig = LearningConfig(), *, starts: DataFrame | None = None) -> DataFrame:
    """Weights moved by a fixed step per mistake and clamped to a range; ``starts`` as for ``weight_trajectory``."""
    kind = F.col("type")
    rows = running_sum(_sliced(feedback), [POLICY], CHUNK, ["ts", "request_id"], {"_position": F.lit(1)}).drop(CHUNK)
    rows = rows.withColumn("_step", (
        F.when(kind == "false_negative", learn.clamp_step)
        .when(kind == "false_positive", -learn.clamp_step).otherwise(0.0)))
    path = clamped_sum(rows, POLICY, "_position", "_step", start=cfg.anomaly_weight,
                       low=learn.clamp_low, high=learn.clamp_high, out="anomaly_weight", starts=starts)
    return path.withColumn("forecast_weight", F.lit(1.0) - F.col("anomaly_weight")).drop("_position", "_step")


def stress_level(cpu: Column, response_time: Column) -> Column:
    cpu_stress = F.greatest(F.lit(0.0), (F.coalesce(cpu, F.lit(50.0)) - 50) / 50)
    rt_stress = F.greatest(F.lit(0.0), (F.coalesce(response_time, F.lit(200.0)) - 200) / 500)
    return (cpu_stress + rt_stress) / 2


def stress_adjusted(limit: Column, stress: Column, cfg: LimitConfig = FULL) -> Column:
    """Tightened limit under stress, never below the minimum."""
    tightened = (limit * (F.lit(1.0) - stress * 0.5)).cast("bigint")
    return F.when(stress > 0.5, F.greatest(F.lit(cfg.min_limit).cast("bigint"), tightened)).otherwise(limit)


def outcome_counts(feedback: DataFrame) -> DataFrame:
    kinds = ("true_positive", "true_negative", "false_positive", "false_negative")
    return feedback.agg(*[F.count_if(F.col("type") == k).alias(f"{k}s") for k in kinds])


def learning_stats(feedback: DataFrame) -> DataFrame:
    tp, tn = F.col("true_positives"), F.col("true_negatives")
    fp, fn = F.col("false_positives"), F.col("false_negatives")
    total = tp + tn + fp + fn
    return outcome_counts(feedback).withColumns({
        "total_decisions": total,
        "accuracy": F.try_divide((tp + tn).cast("double"), total.cast("double")),
        "precision": tp / (tp + fp + F.lit(1e-10)),
        "recall": tp / (tp + fn + F.lit(1e-10)),
    })


def performance_summary(feedback: DataFrame) -> DataFrame:
    """False positives and negatives as rates over all decisions."""
    counts = learning_stats(feedback)
    total = F.col("total_decisions").cast("double")
    return counts.select(
        "total_decisions", "false_positives", "false_negatives",
        F.coalesce(F.try_divide(F.col("false_positives"), total), F.lit(0.0)).alias("false_positive_rate"),
        F.coalesce(F.try_divide(F.col("false_negatives"), total), F.lit(0.0)).alias("false_negative_rate"))
