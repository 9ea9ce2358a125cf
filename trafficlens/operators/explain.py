"""Readable explanations of decisions: ranked factors, reasons, audit text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT_REASON, EXPLAIN_FEATURES, PRIMARY_REASONS
from ..functions.columns import two_decimals

NEWLINE = "\n"


def explain_vector(df: DataFrame) -> DataFrame:
    """Add ``explain_vector``: the six explanation features with defaults."""
    parts = [
        F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)
        for name, default in EXPLAIN_FEATURES.items()]
    return df.withColumn("explain_vector", F.array(*parts))


def top_factors(values: Column, importances: Column, names: list[str], k: int = 3) -> Column:
    """The ``k`` most important features as (``name: value``, importance).

    Ties keep feature order.
    """
    labels = F.array(*[F.lit(n) for n in names])
    rows = F.transform(
        F.sequence(F.lit(1), F.lit(len(names))),
        lambda i: F.struct(
            (-F.element_at(importances, i)).alias("rank"), i.alias("idx"),
            F.concat(F.element_at(labels, i), F.lit(": "),
                     two_decimals(F.element_at(values, i))).alias("factor"),
            F.element_at(importances, i).alias("importance")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda r: F.struct(
        r.factor.alias("factor"), r.importance.alias("importance")))


def primary_reason(factor: Column) -> Column:
    """Reason text of a ``name: value`` factor."""
    name = F.trim(F.element_at(F.split(factor, ":"), 1))
    table = F.create_map(*[F.lit(x) for pair in PRIMARY_REASONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit(DEFAULT_REASON))


# Recommendation texts are fixed values.
def recommendation(blocked: Column, score: Column) -> Column:
    return (
        F.when(~blocked, "Request pattern is normal. No action needed.")
        .when(score > 0.8, "Strong attack signature detected. Consider blacklisting this IP.")
        .when(score > 0.5, "Suspicious behavior detected. User should reduce request rate.")
        .otherwise("Minor anomaly detected. User should verify they're not exceeding limits."))


def explain(df: DataFrame, importances: Column, *, ts: str = "window_start") -> DataFrame:
    """Add ``explanation`` to a decision table (``allow, anomaly_score, rate_limit``)."""
    df = explain_vector(df).withColumn(
        "_factors", top_factors(F.col("explain_vector"), importances, list(EXPLAIN_FEATURES)))
    return df.withColumn("explanation", F.struct(
        F.when(F.col("allow"), "ALLOWED").otherwise("BLOCKED").alias("decision"),
        F.col("anomaly_score").alias("confidence"),
        F.col("anomaly_score").alias("anomaly_score"),
        F.col("rate_limit").alias("adaptive_limit"),
        primary_reason(F.col("_factors")[0].factor).alias("primary_reason"),
        F.col("_factors").alias("contributing_factors"),
        recommendation(~F.col("allow"), F.col("anomaly_score")).alias("recommendation"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )).drop("_factors")


def _percent(col: Column) -> Column:
    return F.concat(two_decimals(col * 100), F.lit("%"))


# The layout of the audit block is a fixed format.
def audit_text(explanation: str = "explanation") -> Column:
    e = F.col(explanation)
    factors = F.concat_ws("", F.transform(e.contributing_factors, lambda f: F.concat(
        F.lit("  - "), f.factor, F.lit(" (importance: "), _percent(f.importance), F.lit(")" + NEWLINE))))
    return F.concat(
        F.lit(NEWLINE + "["), e.timestamp, F.lit("] RATE LIMIT DECISION" + NEWLINE),
        F.lit("Decision: "), e.decision, F.lit(NEWLINE),
        F.lit("Confidence: "), _percent(e.confidence), F.lit(NEWLINE),
        F.lit("Adaptive Limit: "), e.adaptive_limit.cast("string"), F.lit(" req/min" + NEWLINE * 2),
        F.lit("PRIMARY REASON: "), e.primary_reason, F.lit(NEWLINE * 2 + "CONTRIBUTING FACTORS:" + NEWLINE),
        factors, F.lit(NEWLINE + "RECOMMENDATION: "), e.recommendation,
        F.lit(NEWLINE + "=" * 60 + NEWLINE))
