"""Evaluation of limiting methods on labelled windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.chunks import running_sum
from ..functions.columns import clip, safe_ratio
from ..functions.quantile import exact_quantiles
from .heuristics import threshold_score

# Candidate forecast weights, built as start + i * step.
WEIGHT_GRID = tuple(0.3 + i * 0.1 for i in range(7))
SCORE_RANGES = 256


def count_threshold(rows: DataFrame, p: float = 0.9, value: str = "request_count") -> DataFrame:
    """Linear-interpolated percentile of the windows' counts, one row."""
    found = exact_quantiles(rows, [], value, {"threshold": p})
    return found.agg(F.max("threshold").alias("threshold"))  # a null row where there are no windows


def normal_threshold(train: DataFrame, p: float = 0.9, value: str = "request_count") -> DataFrame:
    """``count_threshold`` of the normal windows."""
    return count_threshold(train.where(F.col("is_attack") == 0), p, value)


def fixed_limiter(test: DataFrame, threshold: DataFrame, value: str = "request_count") -> DataFrame:
    """Block above a fixed threshold."""
    rows = test.withColumn("threshold", threshold.scalar())
    return rows.withColumns({
        "blocked": (F.col(value) > F.col("threshold")).cast("int"),
        "score": threshold_score(F.col(value), F.col("threshold")),
    })


def hybrid_limiter(rows: DataFrame, w_forecast: Column, *, signal: str = "traffic_signal",
                   anomaly: str = "anomaly_probability", user_ratio: str = "user_ratio") -> DataFrame:
    """Weighted signals; the fairness factor applies to the decision, not to the score."""
    combined = w_forecast * F.col(signal) + (F.lit(1.0) - w_forecast) * F.col(anomaly)
    fair = F.lit(1.0) + F.lit(0.3) * (F.lit(1.0) - clip(F.col(user_ratio), 0.0, 1.0))
    return rows.withColumns({
        "blocked": (combined * fair > 0.5).cast("int"),
        "score": clip(combined, 0.0, 1.0),
    })


def weight_grid(train: DataFrame, *, signal: str = "traffic_signal",
                anomaly: str = "anomaly_probability", label: str = "is_attack") -> DataFrame:
    """F1 of each candidate weight; counts are combined before the shuffle."""
    rows = train.withColumn("w1", F.explode(F.array(*[F.lit(w) for w in WEIGHT_GRID])))
    hit = F.col("w1") * F.col(signal) + (F.lit(1.0) - F.col("w1")) * F.col(anomaly) > 0.5
    attack = F.col(label) == 1
    counts = rows.groupBy("w1").agg(
        F.count_if(hit & attack).alias("tp"), F.count_if(hit & ~attack).alias("fp"),
        F.count_if(~hit & attack).alias("fn"))
    return counts.withColumn("f1", safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def best_weight(grid: DataFrame, default: float = 0.6) -> DataFrame:
    """The weight with the highest F1, the lowest such weight on ties, one row."""
    best = F.max_by("w1", F.struct("f1", -F.col("w1")))
    return grid.agg(F.max("f1").alias("f1"), best.alias("_w")).select(
        F.when(F.col("f1") > 0, F.round("_w", 1)).otherwise(F.lit(default)).alias("w1"), "f1")


def confusion(rows: DataFrame, *by: str, label: str = "is_attack", blocked: str = "blocked") -> DataFrame:
    y, p = F.col(label) == 1, F.col(blocked) == 1
    return rows.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))


def metrics(counts: DataFrame) -> DataFrame:
    """Rates of a confusion table; 0 wherever a denominator is 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({
        "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, tp + fn),
        "f1_score": safe_ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": safe_ratio(fp, fp + tn),
        "false_negative_rate": safe_ratio(fn, fn + tp),
    })


def roc_auc(rows: DataFrame, *by: str, score: str = "score", label: str = "is_attack") -> DataFrame:
    """Area under the ROC curve with ties counted half; 0.5 for one class.

    Equal scores are pre-aggregated. Negatives below a score are a running sum
    over ranges of the score with about as many distinct scores each, so there
    is no global ranking.
    """
    keys = list(by) or ["_k"]
    rows = rows if by else rows.withColumn("_k", F.lit(0))
    y = F.col(label) == 1
    per_score = rows.groupBy(*keys, F.col(score).cast("double").alias("_s")).agg(
        F.count_if(y).alias("_p"), F.count_if(~y).alias("_n"))
    bounds = per_score.agg(F.percentile_approx("_s", [i / SCORE_RANGES for i in range(1, SCORE_RANGES)])).scalar()
    cut = per_score.withColumn("_bounds", bounds).withColumn(
        "_range", F.size(F.filter("_bounds", lambda x: x < F.col("_s")))).drop("_bounds")
    placed = running_sum(cut, keys, "_range", ["_s"], {"_upto": F.col("_n")})
    below = F.col("_upto") - F.col("_n")
    sums = placed.groupBy(*keys).agg(
        F.sum(F.col("_p") * (below + F.col("_n") / 2)).alias("_u"),
        F.sum("_p").alias("_pos"), F.sum("_n").alias("_neg"))
    pairs = F.col("_pos").cast("double") * F.col("_neg")
    return sums.select(*by, F.coalesce(F.try_divide(F.col("_u"), pairs), F.lit(0.5)).alias("roc_auc"))


def classification_report(rows: DataFrame, label: str = "is_attack", blocked: str = "blocked",
                          classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support of each class; those of ``classes`` have a row even if they never occur."""
    counts = rows.groupBy(F.col(label).alias("y"), F.col(blocked).alias("p")).agg(F.count("*").alias("c"))
    sides = counts.select("c", F.explode(F.array(
        F.struct(F.col("y").alias("label"), (F.col("y") == F.col("p")).cast("int").alias("hit"), F.lit(0).alias("pred")),
        F.struct(F.col("p").alias("label"), F.lit(0).alias("hit"), F.lit(1).alias("pred")))).alias("_x"))
    kind = rows.schema[label].dataType
    always = rows.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("c"), F.explode(F.array(*[F.lit(k).cast(kind) for k in classes])).alias("label"),
        F.lit(0).alias("hit"), F.lit(0).alias("pred"))
    per = sides.select("c", "_x.*").unionByName(always).groupBy("label").agg(
        F.sum(F.col("c") * F.col("hit")).alias("tp"),
        F.sum(F.col("c") * F.col("pred")).alias("predicted"),
        F.sum(F.col("c") * (1 - F.col("pred"))).alias("support"))
    return per.select(
        "label", safe_ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("support")).alias("recall"),
        safe_ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1_score"), "support")


# Compared metrics and whether a higher value is better.
METRIC_DIRECTIONS = {
    "accuracy": True, "precision": True, "recall": True, "f1_score": True,
    "false_positive_rate": False, "false_negative_rate": False, "roc_auc": True,
}


def compare_methods(predictions: DataFrame, method: str = "method") -> DataFrame:
    """One row per method with all metrics; ``predictions`` is in long form."""
    table = metrics(confusion(predictions, method))
    return table.join(roc_auc(predictions, method), method)


def mark_best(comparison: DataFrame, method: str = "method") -> DataFrame:
    """Long form: value of each metric and method, and whether it is the best."""
    long = comparison.select(method, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(up).alias("higher"))
        for m, up in METRIC_DIRECTIONS.items()])).alias("_x")).select(method, "_x.*")
    best = long.groupBy("metric").agg(F.max("value").alias("_max"), F.min("value").alias("_min"))
    return long.join(best, "metric").select(
        "metric", method, "value",
        (F.col("value") == F.when(F.col("higher"), F.col("_max")).otherwise(F.col("_min"))).alias("is_best"))


def improvement(comparison: DataFrame, baseline: str, candidate: str, method: str = "method") -> DataFrame:
    """Relative change of a method against a baseline, in percent."""
    def of(name, metric):
        return F.max(F.when(F.col(method) == name, F.col(metric)))

    wide = comparison.agg(*[
        of(name, m).alias(f"{tag}_{m}")
        for tag, name in (("b", baseline), ("c", candidate))
        for m in ("accuracy", "false_positive_rate", "recall")])

    def change(metric, sign, floor):
        b, c = F.col(f"b_{metric}"), F.col(f"c_{metric}")
        base = F.greatest(b, F.lit(floor)) if floor else b
        return F.try_divide(sign * (c - b), base) * 100

    return wide.select(
        change("accuracy", 1, None).alias("accuracy_improvement"),
        change("false_positive_rate", -1, 0.001).alias("fpr_reduction"),
        change("recall", 1, 0.001).alias("recall_improvement"))


def interesting(decisions: DataFrame) -> DataFrame:
    """Windows with a high score or a real attack."""
    return decisions.where((F.col("anomaly_score") > 0.5) | (F.col("is_attack") == 1))
