"""Feature matrix and standard scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import FEATURE_NAMES, OPTIONAL_FEATURE_NAMES
from ..functions.columns import or_zero


def present_features(df: DataFrame, optional: bool = True) -> list[str]:
    """The known features a table has, in training order."""
    names = FEATURE_NAMES + (OPTIONAL_FEATURE_NAMES if optional else ())
    return [n for n in names if n in df.columns]


def feature_vector(names: list[str]) -> Column:
    return F.array(*[or_zero(F.col(n)) for n in names])


@dataclass(frozen=True)
class ScalerModel:
    """(x - mean) / population std; a constant feature is only centred."""

    names: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def columns(self) -> dict[str, Column]:
        return {
            n: (or_zero(F.col(n)) - F.lit(m)) / F.lit(s)
            for n, m, s in zip(self.names, self.mean, self.scale)}

    def vector(self) -> Column:
        return F.array(*self.columns().values())

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(zip(range(len(self.names)), self.names, self.mean, self.scale)),
            "position int, feature string, mean double, scale double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ScalerModel":
        # one row per feature of the model
        rows = spark.read.parquet(path).orderBy("position").collect()
        return ScalerModel(tuple(r.feature for r in rows), tuple(r["mean"] for r in rows),
                           tuple(r["scale"] for r in rows))


def fit_scaler(df: DataFrame, names: list[str]) -> ScalerModel:
    """One aggregation pass; only two numbers per feature reach the driver."""
    stats = df.agg(
        F.array(*[F.avg(or_zero(F.col(n))) for n in names]).alias("mean"),
        F.array(*[F.stddev_pop(or_zero(F.col(n))) for n in names]).alias("std")).first()
    scale = [s if s else 1.0 for s in stats["std"]]
    return ScalerModel(tuple(names), tuple(stats["mean"]), tuple(scale))
