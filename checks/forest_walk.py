"""Checks of forests: a fixed forest walked row by row, and properties of fitted ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from trafficlens.operators import explain as ex, forecast as fc, iforest, windows as win

from . import sql
from .fixture import HOUR, log, out, session
from .models import counts, fitted
from .registry import check
from .sql import LOG, r, with_

NAMES = ["request_count", "error_rate", "unique_ips"]
#: Three small trees over NAMES: (node, feature, threshold, left, right, depth, samples).
TREES = [
    [(0, 0, 12.5, 1, 2, 0, 16), (1, -1, 0.0, -1, -1, 1, 9), (2, 1, 0.21, 3, 4, 1, 7), (3, -1, 0.0, -1, -1, 2, 5), (4, -1, 0.0, -1, -1, 2, 2)],
    [(0, 2, 10.5, 1, 2, 0, 16), (1, 1, 0.15, 3, 4, 1, 6), (2, -1, 0.0, -1, -1, 1, 10), (3, -1, 0.0, -1, -1, 2, 1), (4, -1, 0.0, -1, -1, 2, 5)],
    [(0, 1, 0.3, 1, 2, 0, 16), (1, 0, 18.5, 3, 4, 1, 13), (2, -1, 0.0, -1, -1, 1, 3), (3, -1, 0.0, -1, -1, 2, 11), (4, -1, 0.0, -1, -1, 2, 2)],
]
SAMPLES, OFFSET = 16, -0.43


def walk(tree: list, leaf, inner=lambda node, below: below, node: int = 0) -> str:
    """SQL CASE over the tree; ``leaf`` and ``inner`` give the value of a node."""
    _, feature, threshold, left, right, _, _ = tree[node]
    if feature < 0:
        return leaf(tree[node])
    low, high = (walk(tree, leaf, inner, n) for n in (left, right))
    return inner(tree[node], f"(CASE WHEN {NAMES[feature]} <= {threshold}::DOUBLE THEN {low} ELSE {high} END)")


def length(node: tuple) -> str:
    return f"{node[5] + float(iforest.average_path(node[6]))!r}::DOUBLE"


def splits(feature: int) -> str:
    """SQL: inner nodes on a feature along a row's paths."""
    return " + ".join(
        walk(t, lambda n: "0", lambda n, below: f"({int(n[1] == feature)} + {below})") for t in TREES)


PATH = " + ".join(walk(t, length) for t in TREES)
SCORED = f"""fs AS (
  SELECT *, -pow(2.0::DOUBLE, -(({PATH}) / {len(TREES)}) / {float(iforest.average_path(SAMPLES))!r}::DOUBLE) - ({OFFSET}::DOUBLE) AS score,
         {", ".join(f"{splits(i)} AS s{i}" for i in range(3))}
  FROM wf),
fp AS (SELECT *, 1 / (1 + exp(score)) AS prob, s0 + s1 + s2 AS total FROM fs)"""


def model(spark) -> iforest.IsolationForestModel:
    columns = ["node_id", "feature", "threshold", "left", "right", "depth", "n_samples"]
    nodes = pd.concat([pd.DataFrame(t, columns=columns).assign(tree_id=i) for i, t in enumerate(TREES)])
    nodes = nodes[["tree_id", *columns]]
    return iforest.IsolationForestModel(spark, nodes, len(NAMES), SAMPLES, iforest.ForestConfig(n_estimators=3), OFFSET)


def rows(spark, sf_dir):
    table = win.window_aggregates(log(spark, sf_dir), HOUR, measures=("distinct", "ratios"))
    return table.withColumn("features", F.array(*[F.col(n).cast("double") for n in NAMES]))


@check("forest_walk_verdict", with_(LOG, sql.windows(), SCORED, select=(
    f"SELECT window_no, {r('score')} AS anomaly_score, CAST(score < 0 AS INT) AS is_anomaly, {r('prob')} AS anomaly_probability, "
    f"{r('abs(score)')} AS confidence, CASE WHEN prob > 0.8 THEN 'high' WHEN prob > 0.5 THEN 'medium' ELSE 'low' END AS severity FROM fp")))
def forest_walk_verdict(spark, sf_dir):
    """Score, flag, probability, confidence and severity from a fixed forest."""
    table = rows(spark, sf_dir)
    return out(model(spark).transform(table), "window_no", "anomaly_score", "is_anomaly", "anomaly_probability", "confidence", "severity")


@check("forest_walk_attribution", with_(LOG, sql.windows(), SCORED, select=" UNION ALL ".join(
    f"SELECT window_no, '{n}' AS feature, {r(f's{i}::DOUBLE / total')} AS share FROM fp" for i, n in enumerate(NAMES))))
def forest_walk_attribution(spark, sf_dir):
    """Share of each feature in the splits along a row's paths."""
    labels = F.array(*[F.lit(n) for n in NAMES])
    long = rows(spark, sf_dir).select("window_no", model(spark).attribution().alias("_a")).select(
        "window_no", F.posexplode("_a").alias("_i", "share"))
    return out(long, "window_no", F.element_at(labels, F.col("_i") + 1).alias("feature"), "share")


@check("forest_walk_top_factors", with_(LOG, sql.windows(), SCORED, (
    "tf AS (" + " UNION ALL ".join(f"SELECT window_no, {i} AS i, '{n}' AS feature, s{i}::DOUBLE / total AS share FROM fp"
                                   for i, n in enumerate(NAMES)) + ")"), select=(
    f"SELECT window_no, rank, feature, {r('share')} AS importance FROM ("
    "SELECT *, CAST(row_number() OVER (PARTITION BY window_no ORDER BY share DESC, i) - 1 AS INT) AS rank FROM tf) WHERE rank < 2")))
def forest_walk_top_factors(spark, sf_dir):
    """The two features with the largest shares, ties in feature order."""
    factors = ex.top_factors(F.col("features"), F.col("_a"), NAMES, 2)
    long = rows(spark, sf_dir).withColumn("_a", model(spark).attribution()).select(
        "window_no", F.posexplode(factors).alias("rank", "_f"))
    return out(long, "window_no", "rank", F.element_at(F.split("_f.factor", ":"), 1).alias("feature"),
               F.col("_f.importance").alias("importance"))


@check("forest_shape", with_(LOG, sql.windows(), select=(
    "SELECT CAST(g AS INT) AS tree_id, CAST(least(256, (SELECT count(*) FROM wf)) AS INT) AS samples, true AS children_add_up, "
    "true AS depth_bounded FROM generate_series(0, 99) t(g)")))
def forest_shape(spark, sf_dir):
    """Each fitted tree has its sample, children that add up and bounded depth."""
    fitted_model, _, _ = fitted(spark, sf_dir)
    nodes = fitted_model.node_table()
    size = nodes.select("tree_id", F.col("node_id").alias("child"), F.col("n_samples").alias("n"))
    inner = nodes.where("feature >= 0").select("tree_id", "node_id", "n_samples", F.explode(F.array("left", "right")).alias("child"))
    sums = inner.join(size, ["tree_id", "child"]).groupBy("tree_id", "node_id").agg(
        (F.sum("n") == F.first("n_samples")).alias("ok")).groupBy("tree_id").agg(F.bool_and("ok").alias("children_add_up"))
    whole = nodes.groupBy("tree_id").agg(
        F.max(F.when(F.col("node_id") == 0, F.col("n_samples"))).cast("int").alias("samples"),
        (F.max("depth") <= 8).alias("depth_bounded"))
    return whole.join(sums, "tree_id")


@check("forest_saved_scores", with_(LOG, sql.windows(), select="SELECT window_start, true AS same FROM wf"))
def forest_saved_scores(spark, sf_dir):
    """A saved and loaded forest scores every window as before."""
    from trafficlens.session import shared_dir

    before, table, _ = fitted(spark, sf_dir)
    path = shared_dir(spark, "forest")
    before.save(path)
    after = iforest.IsolationForestModel.load(spark, path)
    return out(table, "window_start", (before.score() == after.score()).alias("same"))


ONE_LAG = """pv AS (SELECT *, lag(request_count) OVER (ORDER BY pos) AS prev FROM wf),
cf AS (SELECT regr_slope(request_count, prev) AS slope, regr_intercept(request_count, prev) AS icpt FROM pv)"""


@check("lag_regression_one", with_(LOG, sql.windows(), ONE_LAG, select=(
    f"SELECT pos, request_count AS target, {r('greatest(0.0::DOUBLE, icpt + slope * prev)')} AS predicted FROM pv, cf WHERE prev IS NOT NULL")))
def lag_regression_one(spark, sf_dir):
    """With one lag and no penalty the fitted, saved and loaded regression is least squares."""
    from trafficlens.session import shared_dir

    session(spark)
    table = fc.lag_sequences(counts(spark, sf_dir), 1)
    fitted_model = fc.LagRegression.fit(table, 1, reg=0.0)
    path = shared_dir(spark, "forecaster")
    fitted_model.save(path)
    return out(fc.LagRegression.load(path, 1).transform(table), "pos", F.col("target").cast("bigint").alias("target"), "predicted")
