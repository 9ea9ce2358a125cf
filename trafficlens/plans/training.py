"""Training pipeline: features, scaler, forest, importances, forecaster."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import EngineConfig, ForestConfig
from ..operators import iforest
from ..operators.forecast import LagRegression, chronological, lag_sequences
from ..operators.scaling import ScalerModel, fit_scaler, present_features
from ..operators.windows import KEY
from ..session import materialize
from .feature_table import feature_table


@dataclass
class TrainedModels:
    scaler: ScalerModel
    forest: iforest.IsolationForestModel
    forecaster: LagRegression | None

    def scale(self, table: DataFrame) -> DataFrame:
        return table.withColumn("features", self.scaler.vector())

    def score(self, table: DataFrame) -> DataFrame:
        return self.forest.transform(self.scale(table))


def normal_windows(rows: DataFrame) -> DataFrame:
    """The windows without an attack; all windows, with a warning, where none is free of one."""
    normal = rows.where(F.col("is_attack") == 0)
    if not normal.isEmpty():
        return normal
    warnings.warn("no window is free of attacks; limits and forests learn from all windows", stacklevel=3)
    return rows


def fit_forest(table: DataFrame, names: list[str], cfg: ForestConfig, *, normal_only: bool = False,
               train: DataFrame | None = None) -> tuple[ScalerModel, iforest.IsolationForestModel]:
    """Scaler and forest on a window table (or on the ``train`` part of it).

    With ``normal_only`` the forest learns from windows without an attack. A
    busy log may have none; then it learns from all windows, with a warning.
    """
    rows = table if train is None else train
    scaler = fit_scaler(rows, names)
    if normal_only:
        rows = normal_windows(rows)
    vectors = rows.select(*KEY, scaler.vector().alias("features"))
    return scaler, iforest.fit(vectors, "features", KEY, cfg)


def train(log: DataFrame, cfg: EngineConfig = EngineConfig(), *, optional: bool = True) -> TrainedModels:
    """Fit all models on a request log."""
    table = materialize(feature_table(log, cfg.windows), "training")
    scaler, forest = fit_forest(table, present_features(table, optional), cfg.forest)
    length = cfg.forecast.sequence_length
    sequences = chronological(lag_sequences(table, length), cfg.forecast.validation_split)
    fitted = LagRegression.fit(sequences.where(F.col("split") == "train"), length)
    return TrainedModels(scaler, forest, fitted)
