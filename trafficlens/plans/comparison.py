"""Comparison of limiting methods on a chronological split of the windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import ForestConfig
from ..operators import evaluate
from ..operators.rolling import chronological_split, smoothed_signal
from ..operators.windows import KEY, POS, simple_window_features
from ..session import materialize
from .training import fit_forest, normal_windows

FIXED, SIMPLE_ANOMALY, HYBRID = "fixed", "anomaly", "hybrid"
COLUMNS = ["method", *KEY, "is_attack", "blocked", "score"]


def with_signals(table: DataFrame, anomaly: Column) -> DataFrame:
    """Split label, smoothed traffic signal and anomaly probability per window."""
    return chronological_split(smoothed_signal(table)).withColumn("anomaly_probability", anomaly)


def counts_and_labels(log: DataFrame, seconds: int) -> DataFrame:
    """Split label, count and attack label per window: all that the fixed limiter reads.

    The log is aggregated once, for both parts of the split, and no user or ip
    of a window is told apart.
    """
    table = simple_window_features(log, seconds).select(*KEY, POS, "request_count", "is_attack")
    return materialize(chronological_split(table), "counts")


def _part(table: DataFrame, split: str) -> DataFrame:
    return table.where(F.col("split") == split)


def fixed_predictions(table: DataFrame, threshold: DataFrame | None = None) -> DataFrame:
    """The fixed limiter on the test windows; without a ``threshold`` that of the normal training windows."""
    threshold = evaluate.normal_threshold(_part(table, "train")) if threshold is None else threshold
    return evaluate.fixed_limiter(_part(table, "test"), threshold).withColumn("method", F.lit(FIXED))


def hybrid_predictions(table: DataFrame) -> DataFrame:
    weight = evaluate.best_weight(evaluate.weight_grid(_part(table, "train"))).select("w1").scalar()
    test = _part(table, "test").withColumn("_w1", weight)
    return evaluate.hybrid_limiter(test, F.col("_w1")).withColumn("method", F.lit(HYBRID))


def anomaly_predictions(table: DataFrame, cut: float = 0.5) -> DataFrame:
    score = F.col("anomaly_probability")
    return _part(table, "test").withColumns({
        "method": F.lit(SIMPLE_ANOMALY), "blocked": (score > cut).cast("int"), "score": score})


def heuristic_comparison(table: DataFrame, anomaly: Column) -> DataFrame:
    """All three methods with a rule-based anomaly probability.

    ``table`` needs ``request_count, is_attack, user_ratio`` and whatever
    ``anomaly`` reads.
    """
    prepared = materialize(with_signals(table, anomaly), "comparison")
    parts = [fixed_predictions(prepared), anomaly_predictions(prepared), hybrid_predictions(prepared)]
    merged = parts[0].select(*COLUMNS)
    for part in parts[1:]:
        merged = merged.unionByName(part.select(*COLUMNS))
    return evaluate.compare_methods(materialize(merged, "predictions"))


def forest_comparison(table: DataFrame, names: list[str],
                      simple: ForestConfig = ForestConfig(n_estimators=50, contamination=0.15),
                      hybrid: ForestConfig = ForestConfig()) -> DataFrame:
    """All three methods, the threshold and the forests learned from the normal training windows.

    Where no training window is free of attacks, all three learn from all of
    them, so that every method decides every test window.
    """
    prepared = materialize(chronological_split(smoothed_signal(table)), "comparison")
    train = _part(prepared, "train")
    threshold = evaluate.count_threshold(normal_windows(train))
    predictions = [fixed_predictions(prepared, threshold).select(*COLUMNS)]
    scaler, forest = fit_forest(table, names, simple, normal_only=True, train=train)
    scored = forest.transform(prepared.withColumn("features", scaler.vector()))
    predictions.append(_part(scored, "test").select(
        F.lit(SIMPLE_ANOMALY).alias("method"), *KEY, "is_attack",
        F.col("is_anomaly").alias("blocked"), F.col("anomaly_probability").alias("score")))
    scaler, forest = fit_forest(table, names, hybrid, normal_only=True, train=train)
    scored = forest.transform(prepared.withColumn("features", scaler.vector()))
    predictions.append(hybrid_predictions(scored).select(*COLUMNS))
    merged = predictions[0]
    for part in predictions[1:]:
        merged = merged.unionByName(part)
    return evaluate.compare_methods(materialize(merged, "predictions"))
