"""Readers for request logs: CSV, JSON, Parquet and streams of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..schema import EVENTS, REQUEST_LOG


def read_request_log(spark: SparkSession, path: str, fmt: str = "csv",
                     schema: StructType = REQUEST_LOG) -> DataFrame:
    """A batch request log with a declared schema; CSV files carry a header."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return normalise(reader.format(fmt).load(path))


def stream_request_log(spark: SparkSession, path: str, fmt: str = "parquet",
                       schema: StructType = REQUEST_LOG, **options) -> DataFrame:
    """The same log as a stream over files that keep arriving in ``path``."""
    reader = spark.readStream.schema(schema).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True)
    return normalise(reader.format(fmt).load(path))


def normalise(df: DataFrame) -> DataFrame:
    """Name the event time ``ts`` and give it the type watermarks need."""
    if "timestamp" in df.columns and "ts" not in df.columns:
        df = df.withColumnRenamed("timestamp", "ts")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def merge_sources(*logs: DataFrame) -> DataFrame:
    """Union request logs by name; columns a source lacks become null.

    No global sort: consumers order inside their own windows.
    """
    merged, *rest = logs
    for log in rest:
        merged = merged.unionByName(log, allowMissingColumns=True)
    return merged


def write_merged(path: str, *logs: DataFrame) -> None:
    """Merge request logs by time: the order of the files, and of the rows in a file, is ``ts``, then ``request_id``.

    The times are dealt to tasks by sampled ranges, so a busy minute is many
    files; rows without a time come first.
    """
    order = ["ts", "request_id"]
    merge_sources(*logs).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def _with_place(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def file_bounds(spark: SparkSession, path: str) -> DataFrame:
    """Per file of a merged log: rows, first and last (ts, request_id), and whether it starts where its predecessor ends."""
    key = F.struct(F.isnotnull("ts").alias("timed"), "ts", "request_id")
    bounds = _with_place(spark, path).groupBy("_file").agg(
        F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    files = Window.orderBy("_file")  # one row per file
    return bounds.withColumn("in_order", F.coalesce(F.lag("last").over(files) <= F.col("first"), F.lit(True)))


def read_merged(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """A merged log with each row's place in the order of time, from 1.

    The place comes from the row counts of the earlier files and the row's own
    number in its file; no rows are sorted or shuffled.
    """
    rows = _with_place(spark, path)
    files = rows.groupBy("_file").agg(F.count("*").alias("_rows"))  # one row per file
    earlier = F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return rows.join(files, "_file").withColumn(position, F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")


# Event type to endpoint of the fixture view.
EVENT_ENDPOINTS = {
    "view": "/api/products",
    "click": "/api/cart",
    "signup": "/login",
    "purchase": "/api/checkout",
}


def from_events(events: DataFrame) -> DataFrame:
    """View a generic ``events`` table as a request log."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    endpoint = F.lit("/api/payment")
    for name, path in EVENT_ENDPOINTS.items():
        endpoint = F.when(kind == name, path).otherwise(endpoint)
    status = (
        F.when(kind == "error", F.when(k % 2 == 0, 503).otherwise(429))
        .when(kind == "signup", 201).otherwise(200))
    bot = k >= 97
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("U"), F.col("user_id")).alias("user_id"),
        F.concat(F.lit("192.168."), F.floor(k / 10), F.lit("."), k).alias("ip"),
        endpoint.alias("endpoint"),
        F.when(kind == "view", "GET").otherwise("POST").alias("method"),
        status.cast("int").alias("status_code"),
        F.col("value").alias("response_time"),
        F.when(bot, "python-requests/2.28").otherwise(
            F.concat(F.lit("Mozilla/5.0 ("), F.col("user_id") % 4, F.lit(")"))).alias("user_agent"),
        bot.cast("int").alias("is_bot"),
        (bot & kind.isin("purchase", "error")).cast("int").alias("is_attack"),
    )


def events_request_log(spark: SparkSession, directory: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{directory}/events.parquet"))


def events_request_stream(spark: SparkSession, directory: str, glob: str = "events.parquet",
                          **options) -> DataFrame:
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).options(**options)
    return from_events(reader.parquet(directory))
