"""Next-window traffic forecasts from the dense window table."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..config import ForecastConfig
from .rolling import over_windows
from .windows import POS, SERIES


def lag_sequences(table: DataFrame, length: int = 60, value: str = "request_count") -> DataFrame:
    """The previous ``length`` values per window, where there are as many."""
    out = over_windows(table, length, lambda w: {
        "sequence": F.collect_list(F.col(value)).over(w.rowsBetween(-length, -1))})
    return out.where(F.size("sequence") == length).withColumn("target", F.col(value))


def padded_sequence(table: DataFrame, length: int = 60, value: str = "request_count") -> DataFrame:
    """The latest ``length`` values up to each window, left-padded with zeros."""
    out = over_windows(table, length, lambda w: {
        "_seen": F.collect_list(F.col(value)).over(w.rowsBetween(-(length - 1), 0))})
    padding = F.array_repeat(F.lit(0).cast("bigint"), length - F.size("_seen"))
    return out.withColumn("sequence", F.concat(padding, "_seen")).drop("_seen")


def previous_sequence(table: DataFrame, length: int = 60, value: str = "request_count") -> DataFrame:
    """The ``length`` values before each window, left-padded with zeros."""
    out = over_windows(table, length, lambda w: {
        "_seen": F.collect_list(F.col(value)).over(w.rowsBetween(-length, -1))})
    padding = F.array_repeat(F.lit(0).cast("bigint"), length - F.size("_seen"))
    return out.withColumn("sequence", F.concat(padding, "_seen")).drop("_seen")


def chronological(df: DataFrame, validation: float) -> DataFrame:
    """Mark the last ``ceil(validation * n)`` rows of each series, by position."""
    spans = df.groupBy(SERIES).agg(F.min(POS).alias("_low"), F.count("*").alias("_n"))
    train = F.col("_n") - F.ceil(F.col("_n") * F.lit(validation))
    return df.join(spans, SERIES).withColumn(
        "split", F.when(F.col(POS) - F.col("_low") < train, "train").otherwise("val")).drop("_low", "_n")


class LagRegression:
    """Linear regression on the lag vector; a fitted ML pipeline underneath."""

    def __init__(self, model: PipelineModel, length: int):
        self.model, self.length = model, length

    @staticmethod
    def fit(train: DataFrame, length: int, reg: float = 0.1) -> "LagRegression":
        rows = LagRegression._vectors(train)
        stage = LinearRegression(featuresCol="lags", labelCol="target", predictionCol="_raw",
                                 regParam=reg, solver="normal")
        return LagRegression(Pipeline(stages=[stage]).fit(rows), length)

    @staticmethod
    def _vectors(df: DataFrame) -> DataFrame:
        out = df.withColumn("lags", array_to_vector(F.col("sequence").cast("array<double>")))
        return out.withColumn("target", F.col("target").cast("double")) if "target" in df.columns else out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``predicted``, never below 0."""
        out = self.model.transform(self._vectors(df))
        return out.withColumn("predicted", F.greatest(F.lit(0.0), F.col("_raw"))).drop("_raw", "lags")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str, length: int) -> "LagRegression":
        return LagRegression(PipelineModel.load(path), length)


def ar1_coefficients(table: DataFrame, value: str = "request_count") -> DataFrame:
    """Slope and intercept of each window's count on the previous one, per series."""
    pairs = over_windows(table, 1, lambda w: {"_previous": F.lag(value).over(w)})
    y, x = F.col(value).cast("double"), F.col("_previous").cast("double")
    return pairs.groupBy(SERIES).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def ar1_forecast(table: DataFrame, coefficients: DataFrame, value: str = "request_count") -> DataFrame:
    """Add ``predicted`` for windows that have a predecessor."""
    pairs = over_windows(table, 1, lambda w: {"_previous": F.lag(value).over(w)})
    joined = pairs.where(F.col("_previous").isNotNull()).join(coefficients, SERIES)
    return joined.withColumn("predicted", F.greatest(
        F.lit(0.0), F.col("intercept") + F.col("slope") * F.col("_previous"))).drop("_previous", "slope", "intercept")


def forecast_errors(df: DataFrame, value: str = "request_count", by: str = "split") -> DataFrame:
    error = F.col("predicted") - F.col(value)
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"))


def persistence(count: Column, has_model: bool = False, cfg: ForecastConfig = ForecastConfig()) -> Column:
    """The current count, raised by the growth factor once a model exists."""
    return count * F.lit(cfg.growth) if has_model else count.cast("double")
