"""Writers and readers of the tables the engine keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def write_feature_table(table: DataFrame, path: str) -> None:
    """Window feature table as Parquet, one folder per day.

    Rows are ranged by day and window, so files are even and a day is written
    by few tasks even when days differ in size.
    """
    dated = table.withColumn("window_date", F.to_date("window_start"))
    dated.repartitionByRange("window_date", "series_key", "window_no").write.mode("overwrite").partitionBy(
        "window_date").parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    """CSV with a header; timestamps keep their microseconds."""
    table.write.mode("overwrite").option("header", True).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)


def write_matrix(table: DataFrame, vector: Column, label: str, path: str, keys: list[str]) -> None:
    """Feature vectors and labels, with the keys that identify the rows."""
    table.select(*keys, vector.alias("features"), F.col(label).cast("int").alias("label")).write.mode(
        "overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_audit(decisions: DataFrame, text: Column, path: str) -> None:
    """Append audit text, one record per decision."""
    decisions.select(text.alias("value")).write.mode("append").text(path)


def newest(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """The newest ``n`` rows per key; earlier rows are cut before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def save_state(decisions: DataFrame, weights: DataFrame, path: str, *,
               keep_decisions: int = 1000, keep_feedback: int = 100) -> None:
    """Engine state: newest decisions per series, newest feedback with weights per policy."""
    newest(decisions, keep_decisions, ["series_key"], ["window_no"]).write.mode("overwrite").parquet(
        f"{path}/decisions")
    newest(weights, keep_feedback, ["policy_key"], ["ts", "request_id"]).write.mode("overwrite").parquet(
        f"{path}/feedback")


def load_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``decisions`` and ``feedback`` as saved; recency 1 holds the current limit and weights."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("decisions", "feedback")}
