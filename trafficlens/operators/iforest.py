"""Isolation forest: distributed sampling, tree building and scoring.

Every tree is grown from its own small hash sample, one task per tree. The
fitted forest is a node table with at most ``trees * (2 * max_samples - 1)``
rows, which bounds what is sent to the workers for scoring.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..config import ForestConfig
from ..functions.chunks import CHUNK, running_sum
from ..functions.columns import severity, sigmoid_of_score
from ..functions.quantile import exact_quantiles

NODES = ("tree_id int, node_id int, feature int, threshold double, left int, right int, "
         "depth int, n_samples int")
OVERSAMPLE = 4
HASH_RANGE = 1 << 53
RANK_ROWS = 20_000


def average_path(n):
    """Expected path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, "float64")
    safe = np.maximum(n, 3)
    long = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def sample_trees(df: DataFrame, features: str, keys: list[str], cfg: ForestConfig,
                 oversample: int = OVERSAMPLE) -> DataFrame:
    """``max_samples`` rows for each tree, chosen by row hash.

    A row is only emitted for the trees whose hash falls under a cut sized for
    a few times the sample, so the data is never multiplied by the number of
    trees. The choice depends on row keys alone, not on partitioning.
    """
    total = df.agg(F.count("*").cast("double")).scalar()
    cut = F.lit(float(oversample * cfg.max_samples)) / F.greatest(total, F.lit(1.0)) * HASH_RANGE

    def draw(tree):
        return F.pmod(F.xxhash64(*keys, tree, F.lit(cfg.random_state)), F.lit(HASH_RANGE))

    chosen = F.filter(F.transform(
        F.sequence(F.lit(0), F.lit(cfg.n_estimators - 1)),
        lambda t: F.struct(t.alias("tree_id"), draw(t).alias("h"))), lambda x: x.h < F.col("_cut"))
    rows = (
        df.select(*keys, F.col(features).alias("features")).withColumn("_cut", cut)
        .select(*keys, "features", F.explode(chosen).alias("_s")).select(*keys, "features", "_s.*"))
    order = Window.partitionBy("tree_id").orderBy("h", *keys)
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cfg.max_samples)


def grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Random splits until points are isolated; rows (node, feature, ...)."""
    nodes: list = []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        idx, depth, parent, is_right = todo.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][4 if is_right else 3] = node
        sub = x[idx]
        low, high = (sub.min(0), sub.max(0)) if len(idx) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(high > low)
        if depth >= max_depth or len(idx) <= 1 or not usable.size:
            nodes.append([node, -1, 0.0, -1, -1, depth, len(idx)])
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:
            threshold = float(low[feature])
        nodes.append([node, feature, threshold, -1, -1, depth, len(idx)])
        goes_left = sub[:, feature] <= threshold
        todo.append((idx[~goes_left], depth + 1, node, True))
        todo.append((idx[goes_left], depth + 1, node, False))
    return nodes


def _tree_builder(cfg: ForestConfig):
    depth = math.ceil(math.log2(max(cfg.max_samples, 2)))

    def build(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf.sort_values("_rank")["features"].to_numpy()).astype("float64")
        rows = grow_tree(x, np.random.default_rng([cfg.random_state, group[0]]), depth)
        out = pd.DataFrame(rows, columns=["node_id", "feature", "threshold", "left", "right", "depth", "n_samples"])
        out.insert(0, "tree_id", group[0])
        return out

    return build


class Forest:
    """Node arrays of all trees, traversed for a batch of rows at once."""

    def __init__(self, nodes: pd.DataFrame, width: int, max_samples: int):
        nodes = nodes.sort_values(["tree_id", "node_id"])
        sizes = nodes.groupby("tree_id").size()
        base = np.concatenate([[0], np.cumsum(sizes.to_numpy())[:-1]])
        shift = np.repeat(base, sizes.to_numpy())
        self.roots = base
        self.width = width
        self.feature = nodes["feature"].to_numpy()
        self.threshold = nodes["threshold"].to_numpy()
        self.left = nodes["left"].to_numpy() + shift
        self.right = nodes["right"].to_numpy() + shift
        self.length = nodes["depth"].to_numpy() + average_path(nodes["n_samples"].to_numpy())
        self.levels = int(nodes["depth"].max())
        self.norm = float(average_path(max_samples)) or 1.0

    def walk(self, x: np.ndarray, counts: bool = False):
        """Scores (lower is more anomalous) and, if asked, splits per feature."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        seen = np.zeros((len(x), self.width)) if counts else None
        for _ in range(self.levels):
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                break
            value = x[rows, np.where(inner, feature, 0)]
            following = np.where(value <= self.threshold[at], self.left[at], self.right[at])
            if counts:
                flat = (rows * self.width + np.where(inner, feature, 0))[inner]
                seen += np.bincount(flat, minlength=seen.size).reshape(seen.shape)
            at = np.where(inner, following, at)
        score = -np.power(2.0, -self.length[at].mean(1) / self.norm)
        return score, seen


@dataclass
class IsolationForestModel:
    """A fitted forest: node table, offset and its parameters."""

    spark: SparkSession
    nodes: pd.DataFrame
    width: int
    samples: int
    cfg: ForestConfig
    offset: float = 0.0

    def __post_init__(self):
        bound = self.cfg.n_estimators * (2 * self.cfg.max_samples - 1)
        if len(self.nodes) > bound:
            raise ValueError(f"node table exceeds its bound of {bound} rows")
        self._shared = self.spark.sparkContext.broadcast(Forest(self.nodes, self.width, self.samples))

    def node_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.nodes, NODES)

    def score(self, features: str = "features") -> Column:
        """Anomaly score relative to the offset; below 0 is an anomaly."""
        shared = self._shared

        @F.pandas_udf(T.DoubleType())
        def raw(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype="float64")
            return pd.Series(shared.value.walk(np.vstack(batch.to_numpy()).astype("float64"))[0])

        return raw(F.col(features).cast("array<double>")) - F.lit(self.offset)

    def attribution(self, features: str = "features") -> Column:
        """Share of the splits on each feature along the paths of a row."""
        shared, width = self._shared, self.width

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def shares(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype="object")
            seen = shared.value.walk(np.vstack(batch.to_numpy()).astype("float64"), True)[1]
            total = seen.sum(1, keepdims=True)
            return pd.Series(list(np.where(total > 0, seen / np.maximum(total, 1), 1.0 / width)))

        return shares(F.col(features).cast("array<double>"))

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add score, flag, probability, confidence and severity."""
        scored = df.withColumn("anomaly_score", self.score(features))
        prob = sigmoid_of_score(F.col("anomaly_score"))
        return scored.withColumns({
            "is_anomaly": (F.col("anomaly_score") < 0).cast("int"),
            "anomaly_probability": prob,
            "confidence": F.abs("anomaly_score"),
            "severity": severity(prob),
        })

    def save(self, path: str) -> None:
        """Node table and parameters as Parquet."""
        self.node_table().write.mode("overwrite").parquet(f"{path}/nodes")
        self.spark.createDataFrame(
            [(self.width, self.samples, self.offset, self.cfg.n_estimators, self.cfg.max_samples,
              self.cfg.contamination, self.cfg.random_state)],
            "width int, samples int, offset double, n_estimators int, max_samples int, "
            "contamination double, random_state int").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForestModel":
        p = spark.read.parquet(f"{path}/params").first()
        cfg = ForestConfig(p.n_estimators, p.max_samples, p.contamination, p.random_state)
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()  # bounded by the parameters
        return IsolationForestModel(spark, nodes, p.width, p.samples, cfg, p.offset)


def fit(df: DataFrame, features: str, keys: list[str], cfg: ForestConfig = ForestConfig()) -> IsolationForestModel:
    """Fit the forest; the offset is the contamination quantile of its own scores."""
    spark = df.sparkSession
    total = df.count()
    for oversample in (OVERSAMPLE, 4 * OVERSAMPLE, 16 * OVERSAMPLE):
        built = sample_trees(df, features, keys, cfg, oversample).groupBy("tree_id").applyInPandas(_tree_builder(cfg), NODES)
        nodes = built.toPandas()  # at most n_estimators * (2 * max_samples - 1) rows
        sizes = nodes.loc[nodes["node_id"] == 0, "n_samples"]
        if len(sizes) == cfg.n_estimators and sizes.min() == min(cfg.max_samples, total):
            break  # every tree got its sample; otherwise draw from a wider cut
    if nodes.empty:
        raise ValueError("no training rows")
    roots = nodes.loc[nodes["node_id"] == 0, "n_samples"]
    width = int(df.select(F.size(features)).first()[0])
    model = IsolationForestModel(spark, nodes, width, int(roots.max()), cfg)
    scores = df.select(model.score(features).alias("score"))
    offset = exact_quantiles(scores, [], "score", {"offset": cfg.contamination}).first()["offset"]
    return replace(model, offset=float(offset))


def permutation_importance(model: IsolationForestModel, df: DataFrame, names: list[str], keys: list[str],
                           features: str = "features", seed: int = 42) -> DataFrame:
    """Mean absolute score change when one feature is permuted, for each feature.

    Rows are permuted by hash order: each row gets a dense rank in one hash
    order, each of its values a dense rank in another, and values move to the
    row of equal rank. Ranks are prefix counts over hash ranges, and all
    features are rescored in one long table.
    """
    total = df.count()

    def hashed(*extra):
        return F.xxhash64(*keys, *extra, F.lit(seed))

    def ranked(rows, by, key):
        slices = max(1, total // RANK_ROWS)
        place = F.col("_h").cast("double") / F.lit(float(1 << 64)) + 0.5
        cut = rows.withColumn("_h", key).withColumn(CHUNK, F.floor(place * slices))
        return running_sum(cut, by, CHUNK, ["_h", *keys], {"_rank": F.lit(1)}).drop("_h", CHUNK)

    base = df.select(*keys, F.col(features).alias("_x"), model.score(features).alias("_score"))
    base = ranked(base, [], hashed())
    values = df.select(*keys, F.posexplode(features).alias("_f", "_v"))
    moved = ranked(values, ["_f"], hashed(F.col("_f"))).select("_f", "_v", "_rank")
    swapped = moved.join(base.drop(*keys), "_rank").withColumn(
        "_y", F.transform("_x", lambda x, i: F.when(i == F.col("_f"), F.col("_v")).otherwise(x)))
    change = F.abs(F.col("_score") - model.score("_y"))
    labels = F.array(*[F.lit(n) for n in names])
    return swapped.groupBy("_f").agg(F.avg(change).alias("importance")).select(
        F.element_at(labels, F.col("_f") + 1).alias("feature"), "importance")
