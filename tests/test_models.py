"""Forest, quantiles, metrics and forecasts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.config import ForestConfig
from trafficlens.functions.quantile import exact_quantiles
from trafficlens.operators import evaluate as ev, iforest, scaling
from trafficlens.plans import comparison, training

CFG = ForestConfig(n_estimators=20, max_samples=64)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(480, 5)), rng.normal(size=(20, 5)) + 6])
    x[:, 4] = 1.0  # constant feature
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, features array<double>").cache()


@pytest.fixture(scope="module")
def model(points):
    return iforest.fit(points, "features", ["id"], CFG)


def test_forest_shape(model):
    nodes = model.nodes
    assert nodes.groupby("tree_id").size().size == 20
    assert (nodes[nodes.node_id == 0].n_samples == 64).all() and nodes.depth.max() <= 6
    inner = nodes[nodes.feature >= 0]
    assert not (inner.feature == 4).any()
    sizes = nodes.set_index(["tree_id", "node_id"]).n_samples
    for r in inner.itertuples():
        assert sizes[(r.tree_id, r.left)] + sizes[(r.tree_id, r.right)] == r.n_samples


def test_scores_equal_plain_traversal(model, points):
    trees = {t: g.set_index("node_id") for t, g in model.nodes.groupby("tree_id")}
    got = points.select("features", model.score().alias("s"), model.attribution().alias("a")).limit(40).collect()
    for row in got:
        lengths, used = [], np.zeros(5)
        for tree in trees.values():
            at = tree.loc[0]
            while at.feature >= 0:
                used[int(at.feature)] += 1
                at = tree.loc[at.left if row.features[int(at.feature)] <= at.threshold else at.right]
            lengths.append(at.depth + float(iforest.average_path(at.n_samples)))
        want = -(2 ** (-np.mean(lengths) / float(iforest.average_path(64)))) - model.offset
        assert row.s == pytest.approx(want, abs=1e-12)
        assert row.a == pytest.approx(list(used / used.sum())) and sum(row.a) == pytest.approx(1)


def test_contamination_and_outliers(model, points):
    out = model.transform(points)
    flagged, share = out.agg(F.sum("is_anomaly"), F.avg(F.when(F.col("id") >= 480, F.col("is_anomaly")))).first()
    assert flagged == 50 and share > 0.9
    low, high = out.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert -1 < low < 0 < high < 1


def test_independent_of_partitions(model, points):
    again = iforest.fit(points.repartition(7), "features", ["id"], CFG)
    assert again.offset == pytest.approx(model.offset)
    key = ["tree_id", "node_id"]
    assert again.nodes.sort_values(key).reset_index(drop=True).equals(model.nodes.sort_values(key).reset_index(drop=True))


def test_save_and_load(model, points, spark, tmp_path):
    model.save(str(tmp_path / "m"))
    loaded = iforest.IsolationForestModel.load(spark, str(tmp_path / "m"))
    gap = points.select(
        F.abs(model.score() - loaded.score()).alias("d")).agg(F.max("d")).first()
    assert gap[0] == 0


def test_permutation_importance(model, points):
    names = list("abcde")
    got = {r.feature: r.importance for r in iforest.permutation_importance(model, points, names, ["id"]).collect()}
    assert set(got) == set(names) and got["e"] == 0 and all(got[n] > 0 for n in "abcd")


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    data = {"big": np.round(rng.gamma(2, 40, 60_000), 3), "tiny": np.array([3.0, 1.0]), "same": np.full(500, 7.0)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"q10": 0.1, "q50": 0.5, "q95": 0.95}).collect()}
    for k, vs in data.items():
        for name, p in (("q10", 0.1), ("q50", 0.5), ("q95", 0.95)):
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12)
    whole = exact_quantiles(df, [], "v", {"q": 0.25}).first().q
    assert whole == pytest.approx(np.quantile(np.concatenate(list(data.values())), 0.25), rel=1e-12)


def test_hot_key_is_ranked_in_small_parts(spark):
    """Two million equally dense values under one key, close together: exact, and no ranked part has many of them."""
    from trafficlens.functions import quantile as qt

    n = 2_000_000
    df = spark.range(n).select((F.lit(1.7e9) + F.col("id") * 7919 % n / 1024.0).alias("v"))
    want = np.quantile(1.7e9 + np.arange(n) / 1024.0, [0.25, 0.5, 0.95])
    got = exact_quantiles(df, [], "v", {"a": 0.25, "b": 0.5, "c": 0.95}).first()
    assert list(got) == pytest.approx(want, rel=1e-15)
    rows = df.select(F.lit(0).alias("k"), F.col("v").alias("_v")).withColumn(qt.CELL, qt.cell(F.col("_v")))
    parts = qt.ranked_values(rows, qt.counted_cells(rows, ["k"]), ["k"]).groupBy(qt.CELL, qt.PART).count()
    assert parts.agg(F.max("count")).first()[0] <= 2 * n / qt.PARTS


def test_quantiles_of_unusual_values(spark):
    data = {"signs": [-3.0, -0.0, 0.0, 2.0, 5e-324], "ends": [-1.7e308, 1e308, 1.7e308],
            "infinite": [float("-inf"), 1.0, 1.5, float("inf")], None: [4.0, None, 4.5, 4.25]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("none", None)], "k string, v double")
    got = {r.k: r.m for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"signs": 0.0, "ends": 1e308, "infinite": 1.25, None: 4.25}
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert exact_quantiles(nan, [], "v", {"m": 0.5}).first().m == 2.0


def test_auc_with_ties_and_one_class(spark):
    rng = np.random.default_rng(4)
    rows = [(int(y), float(np.round(s, 1))) for y, s in zip(rng.integers(0, 2, 300), rng.normal(size=300))]
    df = spark.createDataFrame(rows, "is_attack int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert ev.roc_auc(df).first()[0] == pytest.approx(want)
    assert ev.roc_auc(df.where("is_attack = 1")).first()[0] == 0.5


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "is_attack int, blocked int")
    m = ev.metrics(ev.confusion(df)).first()
    assert (m.accuracy, m.precision, m.recall, m.f1_score, m.false_negative_rate) == (1.0, 0.0, 0.0, 0.0, 0.0)


def test_scaler_centres_constant_features(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    model = scaling.fit_scaler(df, ["a", "b"])
    assert [list(r.x) for r in df.select(model.vector().alias("x")).collect()] == [[-1.0, 0.0], [1.0, 0.0]]


def test_previous_values_are_padded_and_never_the_own_one(spark):
    from trafficlens.operators.forecast import previous_sequence

    table = spark.createDataFrame([(k, i, i, 10 + i) for k, n in (("a", 5), ("b", 1)) for i in range(n)],
                                  "series_key string, window_no bigint, pos bigint, request_count bigint")
    got = {(r.series_key, r.pos): r.sequence for r in previous_sequence(table, 3).collect()}
    assert got == {("a", 0): [0, 0, 0], ("a", 1): [0, 0, 10], ("a", 2): [0, 10, 11], ("a", 3): [10, 11, 12],
                   ("a", 4): [11, 12, 13], ("b", 0): [0, 0, 0]}


def test_decisions_without_a_forecaster_keep_the_moving_average(spark, data):
    from checks.fixture import DAY, FULL_LIMITS, HOUR
    from checks.forest_walk import NAMES, model
    from trafficlens.operators.windows import window_aggregates
    from trafficlens.plans import decisions as plans
    from trafficlens.plans.training import TrainedModels
    from trafficlens.sources.request_log import events_request_log

    log = events_request_log(spark, data).where("ts < '2024-01-03'")
    metrics = plans.metrics_from_load(window_aggregates(log, HOUR, measures=()), 4.5)
    forest = TrainedModels(scaling.ScalerModel(tuple(NAMES), (0.0,) * 3, (1.0,) * 3), model(spark), None)
    plain = {r.pos: r for r in plans.full_inputs(log, metrics, HOUR, FULL_LIMITS, DAY).collect()}
    scored = {r.pos: r for r in plans.full_inputs(log, metrics, HOUR, FULL_LIMITS, DAY, forest).collect()}
    assert plain.keys() == scored.keys() and len(plain) > 10
    assert all(scored[p].predicted == plain[p].predicted for p in plain)
    assert all(0 < scored[p].anomaly_score < 1 for p in plain)
    assert any(scored[p].anomaly_score != plain[p].anomaly_score for p in plain)


def busy(spark):
    """Windows of which none is free of attacks."""
    rows = [(float(i % 7), float(i), 1, i) for i in range(300)]
    table = spark.createDataFrame(rows, "request_count double, other double, is_attack int, pos bigint")
    return table.select(F.lit("all").alias("series_key"), F.col("pos").alias("window_no"), "*", F.timestamp_seconds("pos").alias("window_start"))


def test_a_log_without_normal_windows_still_has_a_forest(spark):
    table, names = busy(spark), ["request_count", "other"]
    with pytest.warns(UserWarning, match="free of attacks"):
        scaler, made = training.fit_forest(table, names, CFG, normal_only=True)
    plain = training.fit_forest(table, names, CFG)[1]
    scores = table.withColumn("features", scaler.vector()).select(made.score().alias("a"), plain.score().alias("b"))
    assert scores.where("a = b").count() == 300
    some = table.withColumn("is_attack", F.when(F.col("window_no") < 100, 0).otherwise(1))
    assert training.fit_forest(some, names, CFG, normal_only=True)[1].samples == 64
    few = table.withColumn("is_attack", F.when(F.col("window_no") < 10, 0).otherwise(1))
    assert training.fit_forest(few, names, CFG, normal_only=True)[1].samples == 10  # normal windows alone, where there are some


def test_methods_are_compared_on_a_log_without_normal_windows(spark):
    table = busy(spark).withColumn("user_ratio", F.lit(0.5))
    with pytest.warns(UserWarning, match="free of attacks"):
        got = comparison.forest_comparison(table, ["request_count", "other"], CFG, CFG).collect()
    by = {r.method: r for r in got}
    assert set(by) == {"fixed", "anomaly", "hybrid"}
    assert all(by[m].tp + by[m].fn == 60 and by[m].roc_auc == 0.5 for m in ("anomaly", "hybrid"))


def test_every_method_decides_every_window_of_a_log_without_normal_windows(spark):
    """Without a normal window the fixed limiter had no threshold, and its windows were in no count."""
    table = busy(spark).withColumn("user_ratio", F.lit(0.5))
    with pytest.warns(UserWarning, match="free of attacks"):
        got = comparison.forest_comparison(table, ["request_count", "other"], CFG, CFG).collect()
    assert {r.method: r.tp + r.tn + r.fp + r.fn for r in got} == {"fixed": 60, "anomaly": 60, "hybrid": 60}


def test_the_fixed_limiter_reads_counts_and_labels_only(spark, data):
    """The log is read before the split, and no shares of users are made for it."""
    from checks import models
    from checks.fixture import HOUR
    from trafficlens.sources.request_log import events_request_log

    table = comparison.counts_and_labels(events_request_log(spark, data), HOUR)
    assert set(table.columns) == {"series_key", "window_no", "pos", "request_count", "is_attack", "split"}
    assert not any("events.parquet" in f for f in comparison.fixed_predictions(table).inputFiles())
    rows = {r.window_no: r for r in models.prepared(spark, data).collect()}
    got = table.collect()
    assert len(got) == len(rows) and all((r.request_count, r.is_attack, r.split) == (
        rows[r.window_no].request_count, rows[r.window_no].is_attack, rows[r.window_no].split) for r in got)


def test_report_has_both_classes(spark):
    """As scikit-learn's with both labels named: a class that never occurs has zeros."""
    rows = spark.createDataFrame([(1, 1)] * 5, "is_attack int, blocked int")
    got = {r.label: (r.precision, r.recall, r.f1_score, r.support) for r in ev.classification_report(rows).collect()}
    assert got == {0: (0.0, 0.0, 0.0, 0), 1: (1.0, 1.0, 1.0, 5)}
    none = {r.label: r.support for r in ev.classification_report(rows.where("is_attack = 0")).collect()}
    assert none == {0: 0, 1: 0}
