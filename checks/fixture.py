"""Parameters the check queries run with.

The fixture events are sparse (about 14 per hour), so windows and histories are
longer and limits lower than the library defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trafficlens.config import (
    BehaviorConfig, HeuristicConfig, LimitConfig, OnlineHeuristicConfig, ParallelPattern, SequencePattern)
from trafficlens.operators import feedback as fb
from trafficlens.operators.windows import SERIES, START
from trafficlens.plans import decisions as plans
from trafficlens.session import prepare
from trafficlens.sources.request_log import events_request_log

HOUR, GAP = 3600, 600
DAY_MS, HISTORY = 86_400_000, 6 * 3600
TRAILING = 3600
LATENCY_SCALE = 30.0
CPU_PER_REQUEST = 4.5

SIMPLE_LIMITS = LimitConfig(base_limit=20, min_limit=5, max_limit=60, alpha=0.3)
FULL_LIMITS = LimitConfig(base_limit=20, min_limit=5, max_limit=60, alpha=0.2)
RULES = HeuristicConfig(spike_ratio=1.3, ip_concentration=0.95, error_rate=0.3, request_count=20)
ONLINE_RULES = OnlineHeuristicConfig(request_count=15, ip_concentration=1.1, error_rate=0.3, user_request_count=1)

CHECKOUT = SequencePattern("rapid_checkout", ("/api/products", "/api/cart", "/api/checkout"), HISTORY * 1000, 0.9)
SCAN = SequencePattern(
    "endpoint_scanning", ("/api/products", "/api/cart", "/login", "/api/payment"), DAY_MS // 2, 0.95)
PARALLEL = ParallelPattern("parallel_requests", 3, DAY_MS, 0.85)
LOGINS = SequencePattern("credential_stuffing", ("/login", "/login", "/login"), DAY_MS, 0.9)
SHORT = BehaviorConfig(history_seconds=HISTORY, max_history=100, rapid_gap_seconds=600, patterns=(CHECKOUT,))
DAY = BehaviorConfig(history_seconds=86_400, max_history=100, rapid_gap_seconds=600, patterns=(CHECKOUT, SCAN, PARALLEL, LOGINS))


def only(pattern) -> BehaviorConfig:
    return BehaviorConfig(history_seconds=86_400, max_history=100, rapid_gap_seconds=600, patterns=(pattern,))


def session(spark: SparkSession) -> SparkSession:
    """Library settings; on one machine also no more shuffle partitions than cores."""
    prepare(spark)
    cores = spark.sparkContext.defaultParallelism
    if spark.sparkContext.master.startswith("local") and int(spark.conf.get("spark.sql.shuffle.partitions")) > cores:
        spark.conf.set("spark.sql.shuffle.partitions", str(cores))
    return spark


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_request_log(session(spark), sf_dir)


def out(df: DataFrame, *cols) -> DataFrame:
    """Select, round doubles to 6 places, and drop the zone from timestamps."""
    df = df.select(*cols) if cols else df
    exprs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.window_decisions(log(spark, sf_dir), HOUR, SIMPLE_LIMITS, RULES)


def with_ids(table: DataFrame) -> DataFrame:
    return table.withColumn("request_id", F.date_format(START, "yyyyMMddHH"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feedback event per window decision, with metrics derived from load."""
    rows = fb.decision_outcomes(with_ids(decisions(spark, sf_dir)))
    return rows.select(
        F.col(SERIES).alias(fb.POLICY), "request_id", F.col(START).alias("ts"), "type",
        F.col("is_attack").alias("actual_label"), (~F.col("allow")).cast("int").alias("predicted_label"),
        F.struct(
            F.least(F.lit(100.0), F.col("request_count") * CPU_PER_REQUEST).alias("cpu_usage"),
            (F.round("avg_response_time", 6) * LATENCY_SCALE).alias("avg_response_time"),
            F.col("error_rate").alias("error_rate")).alias("system_metrics"))
