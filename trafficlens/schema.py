"""Schemas of the request log and of feedback events."""

from __future__ import annotations

from pyspark.sql import types as T

REQUEST_LOG = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("response_time", T.DoubleType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("traffic_type", T.StringType()),
    T.StructField("is_bot", T.IntegerType()),
    T.StructField("is_attack", T.IntegerType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

SYSTEM_METRICS = T.StructType([
    T.StructField("cpu_usage", T.DoubleType()),
    T.StructField("avg_response_time", T.DoubleType()),
    T.StructField("error_rate", T.DoubleType()),
])

FEEDBACK = T.StructType([
    T.StructField("policy_key", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("type", T.StringType()),
    T.StructField("actual_label", T.IntegerType()),
    T.StructField("predicted_label", T.IntegerType()),
    T.StructField("system_metrics", SYSTEM_METRICS),
])
