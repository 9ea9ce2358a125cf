"""Scalar column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def clip(col: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def or_zero(col: Column) -> Column:
    """Null, NaN and infinite values become 0."""
    value = col.cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def sigmoid_of_score(score: Column) -> Column:
    """Anomaly probability of a score whose low values are anomalous."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(score))


def severity(prob: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    return F.when(prob > high, "high").when(prob > medium, "medium").otherwise("low")


def two_decimals(col: Column) -> Column:
    """Text with two decimals; exact ties round to even, as in C and Python."""
    return F.call_function("format_number", col.cast("double"), F.lit("0.00"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def floor_div(col: Column, size: int) -> Column:
    """Integer division rounding towards minus infinity, exact for any bigint."""
    return ((col - F.pmod(col, F.lit(size))) / F.lit(size)).cast("bigint")


def indicator(cond: Column) -> Column:
    return cond.cast("int")


def temporal(ts: Column) -> dict[str, Column]:
    """Calendar features of an event time (Monday is day 0)."""
    hour, dow = F.hour(ts), F.weekday(ts)
    angle = F.lit(2 * math.pi) * hour / F.lit(24.0)
    return {
        "hour": hour,
        "minute": F.minute(ts),
        "day_of_week": dow,
        "is_business_hours": indicator(hour.between(9, 17)),
        "is_night": indicator(hour.between(0, 6)),
        "is_weekend": indicator(dow >= 5),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    }


def with_defaults(df, defaults: dict):
    """Fill nulls in known columns and add the ones that are missing."""
    out = {}
    for name, default in defaults.items():
        lit = F.lit(default)
        out[name] = F.coalesce(F.col(name), lit) if name in df.columns else lit
    return df.withColumns(out)
