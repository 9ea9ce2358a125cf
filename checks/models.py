"""Checks of evaluation, method comparison, forests and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.config import ForestConfig
from trafficlens.functions.columns import sigmoid_of_score
from trafficlens.operators import evaluate as ev, explain as ex, forecast as fc, heuristics, iforest, scaling, windows as win
from trafficlens.plans import comparison, training
from trafficlens.plans.decisions import heaviest_user, simple_features
from trafficlens.plans.feature_table import feature_table
from trafficlens.session import materialize, shared_dir
from trafficlens.sources import tables

from . import sql
from .features import HOURLY, SIGNAL
from .fixture import HOUR, RULES, decisions, log, out, session
from .policy_checks import HEAVY, SHARES
from .registry import check
from .sql import DECISIONS, LOG, WINDOW_SCORE, r, with_

# --- evaluation ---------------------------------------------------------------------------------------------

SIGNALS = (LOG, sql.simple_features(), SHARES, HEAVY, f"""cm AS (
  SELECT sf.*, {WINDOW_SCORE} AS anomaly_probability, {SIGNAL} AS traffic_signal,
         coalesce(user_requests::DOUBLE / total_requests, 1) AS user_ratio,
         CASE WHEN pos < floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
  FROM sf LEFT JOIN heavy USING (window_no)),
th AS (SELECT quantile_cont(request_count::DOUBLE, 0.9) AS threshold FROM cm WHERE split = 'train' AND is_attack = 0),
fx AS (
  SELECT window_no, is_attack, CAST(request_count > threshold AS INT) AS blocked,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, request_count / (threshold + 1e-8::DOUBLE))) AS score
  FROM cm, th WHERE split = 'test'),
gw AS (SELECT unnest([0.3 + i * 0.1::DOUBLE for i in range(0, 7)])::DOUBLE AS w1),
gc AS (
  SELECT w1, count(*) FILTER (hit AND is_attack = 1) AS tp, count(*) FILTER (hit AND is_attack = 0) AS fp,
         count(*) FILTER (NOT hit AND is_attack = 1) AS fn
  FROM (SELECT *, w1 * traffic_signal + (1 - w1) * anomaly_probability > 0.5 AS hit FROM cm, gw WHERE split = 'train') GROUP BY 1),
gf AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1 FROM gc),
bw AS (SELECT CASE WHEN f1 > 0 THEN round(w1, 1) ELSE 0.6::DOUBLE END AS w1, f1 FROM gf ORDER BY f1 DESC, gf.w1 LIMIT 1),
hy AS (
  SELECT window_no, is_attack, CAST(c * (1 + 0.3::DOUBLE * (1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, user_ratio)))) > 0.5 AS INT) AS blocked,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)) AS score
  FROM (SELECT cm.*, w1 * traffic_signal + (1 - w1) * anomaly_probability AS c FROM cm, bw WHERE split = 'test')),
an AS (SELECT window_no, is_attack, CAST(anomaly_probability > 0.5 AS INT) AS blocked, anomaly_probability AS score FROM cm WHERE split = 'test'),
pr AS (SELECT 'fixed' AS method, * FROM fx UNION ALL SELECT 'hybrid', * FROM hy UNION ALL SELECT 'anomaly', * FROM an)""")


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"


def metric_ctes(source: str, by: str) -> str:
    return f"""co AS (
  SELECT {by} AS method, count(*) FILTER (is_attack = 1 AND blocked = 1) AS tp, count(*) FILTER (is_attack = 0 AND blocked = 0) AS tn,
         count(*) FILTER (is_attack = 0 AND blocked = 1) AS fp, count(*) FILTER (is_attack = 1 AND blocked = 0) AS fn
  FROM {source} GROUP BY 1),
ra AS (SELECT {by} AS method, is_attack, rank() OVER (PARTITION BY {by} ORDER BY score)
              + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS rk FROM {source}),
au AS (SELECT method, sum(CASE WHEN is_attack = 1 THEN rk END) AS s, sum(is_attack) AS p, sum(1 - is_attack) AS q FROM ra GROUP BY 1),
me AS (
  SELECT co.*, {ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {ratio('tp', 'tp + fp')} AS precision,
         {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1_score,
         {ratio('fp', 'fp + tn')} AS false_positive_rate, {ratio('fn', 'fn + tp')} AS false_negative_rate,
         CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE (s - p * (p + 1) / 2.0::DOUBLE) / (p * q) END AS roc_auc
  FROM co JOIN au USING (method))"""


METRICS = list(ev.METRIC_DIRECTIONS)


def labelled(spark, sf_dir):
    rows = simple_features(log(spark, sf_dir), HOUR).join(heaviest_user(log(spark, sf_dir), HOUR), win.KEY, "left")
    return rows.withColumn("user_ratio", F.coalesce(F.col("user_requests") / F.col("total_requests"), F.lit(1.0)))


def prepared(spark, sf_dir):
    return comparison.with_signals(labelled(spark, sf_dir), heuristics.window_score(RULES))


def blocked_rows(spark, sf_dir):
    return decisions(spark, sf_dir).withColumns(
        {"blocked": (~F.col("allow")).cast("int"), "score": F.col("anomaly_score")})


BLOCKED = "bl AS (SELECT *, CAST(NOT allow AS INT) AS blocked, anomaly_score AS score FROM dec)"


@check("fixed_threshold_limiter", with_(*SIGNALS, select=f"SELECT window_no, blocked, {r('score')} AS score FROM fx"))
def fixed_threshold_limiter(spark, sf_dir):
    return out(comparison.fixed_predictions(comparison.counts_and_labels(log(spark, sf_dir), HOUR)), "window_no", "blocked", "score")


@check("weight_grid_search", with_(*SIGNALS, select=f"SELECT {r('w1')} AS w1, {r('f1')} AS f1 FROM bw"))
def weight_grid_search(spark, sf_dir):
    train = prepared(spark, sf_dir).where(F.col("split") == "train")
    return out(ev.best_weight(ev.weight_grid(train)))


@check("hybrid_limiter", with_(*SIGNALS, select=f"SELECT window_no, blocked, {r('score')} AS score FROM hy"))
def hybrid_limiter(spark, sf_dir):
    return out(comparison.hybrid_predictions(prepared(spark, sf_dir)), "window_no", "blocked", "score")


@check("confusion_matrix", with_(LOG, DECISIONS, BLOCKED, metric_ctes("bl", "series_key"), select=(
    "SELECT tp, tn, fp, fn FROM me"), recursive=True))
def confusion_matrix(spark, sf_dir):
    return ev.confusion(blocked_rows(spark, sf_dir))


@check("classification_metrics", with_(LOG, DECISIONS, BLOCKED, metric_ctes("bl", "series_key"), select=(
    "SELECT tp, tn, fp, fn, " + ", ".join(f"{r(m)} AS {m}" for m in METRICS if m != "roc_auc") + " FROM me"), recursive=True))
def classification_metrics(spark, sf_dir):
    return out(ev.metrics(ev.confusion(blocked_rows(spark, sf_dir))))


@check("roc_auc", with_(LOG, sql.windows(), "sc AS (SELECT 'all' AS m, is_attack, 0 AS blocked, avg_response_time AS score FROM wf)",
                        metric_ctes("sc", "m"), select=f"SELECT {r('roc_auc')} AS roc_auc FROM me"))
def roc_auc(spark, sf_dir):
    """A continuous score with few ties: the mean latency."""
    table = win.window_aggregates(log(spark, sf_dir), HOUR, measures=("latency", "labels"))
    return out(ev.roc_auc(table, score="avg_response_time"))


@check("roc_auc_labels", (
    "WITH sc AS (SELECT 'a' AS m, l.toxic AS is_attack, 0 AS blocked, n_chars AS score FROM labels l JOIN documents USING (doc_id)), "
    + metric_ctes("sc", "m") + f" SELECT {r('roc_auc')} AS roc_auc FROM me"))
def roc_auc_labels(spark, sf_dir):
    session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(docs, "doc_id")
    return out(ev.roc_auc(rows, score="n_chars", label="toxic"))


@check("classification_report", with_(LOG, DECISIONS, BLOCKED, select=" UNION ALL ".join(
    f"SELECT {c} AS label, {r(ratio(f'count(*) FILTER (is_attack = {c} AND blocked = {c})', f'count(*) FILTER (blocked = {c})'))} AS precision, "
    f"{r(ratio(f'count(*) FILTER (is_attack = {c} AND blocked = {c})', f'count(*) FILTER (is_attack = {c})'))} AS recall, "
    f"{r(ratio(f'2 * count(*) FILTER (is_attack = {c} AND blocked = {c})', f'count(*) FILTER (blocked = {c}) + count(*) FILTER (is_attack = {c})'))} AS f1_score, "
    f"count(*) FILTER (is_attack = {c}) AS support FROM bl" for c in (0, 1)), recursive=True))
def classification_report(spark, sf_dir):
    return out(ev.classification_report(blocked_rows(spark, sf_dir)))


def compared(spark, sf_dir):
    return comparison.heuristic_comparison(labelled(spark, sf_dir), heuristics.window_score(RULES))


@check("method_comparison", with_(*SIGNALS, metric_ctes("pr", "method"), select=(
    "SELECT method, metric, value, value = best AS is_best FROM (SELECT *, CASE WHEN metric LIKE 'false%' THEN min(value) OVER w ELSE max(value) OVER w END AS best FROM ("
    + " UNION ALL ".join(f"SELECT method, '{m}' AS metric, {r(m)} AS value FROM me" for m in METRICS)
    + ") WINDOW w AS (PARTITION BY metric))")))
def method_comparison(spark, sf_dir):
    """Comparison table written as CSV, read back, best method per metric."""
    path = shared_dir(spark, "comparison")
    tables.write_csv(out(compared(spark, sf_dir)), path)
    kinds = ", ".join(["method string", *[f"{c} bigint" for c in ("tp", "tn", "fp", "fn")], *[f"{m} double" for m in METRICS]])
    return out(ev.mark_best(spark.read.schema(kinds).option("header", True).csv(path)))


@check("method_improvement", with_(*SIGNALS, metric_ctes("pr", "method"), (
    "x AS (SELECT b.accuracy AS ba, b.false_positive_rate AS bf, b.recall AS br, c.accuracy AS ca, c.false_positive_rate AS cf, c.recall AS cr "
    "FROM me b, me c WHERE b.method = 'fixed' AND c.method = 'hybrid')"), select=(
    f"SELECT {r('(ca - ba) / ba * 100')} AS accuracy_improvement, {r('(bf - cf) / greatest(bf, 0.001::DOUBLE) * 100')} AS fpr_reduction, "
    f"{r('(cr - br) / greatest(br, 0.001::DOUBLE) * 100')} AS recall_improvement FROM x")))
def method_improvement(spark, sf_dir):
    return out(ev.improvement(compared(spark, sf_dir), comparison.FIXED, comparison.HYBRID))


# --- isolation forest ---------------------------------------------------------------------------------------

SMALL = ForestConfig(n_estimators=50)


def features(spark, sf_dir):
    """The feature table, written once; models are fitted on the written copy."""
    return materialize(feature_table(log(spark, sf_dir), HOURLY), "features")


def vectors(spark, sf_dir):
    table = features(spark, sf_dir)
    names = scaling.present_features(table, optional=False)
    model = scaling.fit_scaler(table, names)
    return table.withColumn("features", model.vector()), names


def fitted(spark, sf_dir, cfg=ForestConfig()):
    rows, names = vectors(spark, sf_dir)
    return iforest.fit(rows.select(*win.KEY, "features"), "features", win.KEY, cfg), rows, names


@check("iforest_fit")
def iforest_fit(spark, sf_dir):
    """Node table of the forest, one row per tree with its size and depth."""
    model, _, _ = fitted(spark, sf_dir)
    return model.node_table().groupBy("tree_id").agg(
        F.count("*").alias("nodes"), F.max("depth").alias("depth"),
        F.max(F.when(F.col("node_id") == 0, F.col("n_samples"))).alias("samples"))


@check("iforest_scores")
def iforest_scores(spark, sf_dir):
    model, rows, _ = fitted(spark, sf_dir)
    return out(rows, "window_start", model.score().alias("anomaly_score"))


@check("iforest_flags")
def iforest_flags(spark, sf_dir):
    model, rows, _ = fitted(spark, sf_dir)
    return out(model.transform(rows), "window_start", "is_anomaly")


@check("anomaly_probability")
def anomaly_probability(spark, sf_dir):
    model, rows, _ = fitted(spark, sf_dir)
    return out(rows, "window_start", sigmoid_of_score(model.score()).alias("anomaly_probability"))


@check("anomaly_verdict")
def anomaly_verdict(spark, sf_dir):
    model, rows, _ = fitted(spark, sf_dir)
    return out(model.transform(rows), "window_start", "is_anomaly", "anomaly_score", "anomaly_probability", "confidence", "severity")


@check("iforest_normal_only")
def iforest_normal_only(spark, sf_dir):
    table = features(spark, sf_dir)
    names = scaling.present_features(table, optional=False)
    scaler, model = training.fit_forest(table, names, ForestConfig(n_estimators=50, contamination=0.15), normal_only=True)
    return out(model.transform(table.withColumn("features", scaler.vector())), "window_start", "is_attack", "is_anomaly", "anomaly_score")


@check("iforest_roundtrip")
def iforest_roundtrip(spark, sf_dir):
    model, rows, _ = fitted(spark, sf_dir)
    path = shared_dir(spark, "forest")
    model.save(path)
    again = iforest.IsolationForestModel.load(spark, path)
    return out(rows, "window_start", model.score().alias("before"), again.score().alias("after"))


@check("iforest_embeddings")
def iforest_embeddings(spark, sf_dir):
    """The forest on another wide matrix: the embedding table."""
    rows = session(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
    model = iforest.fit(rows, "features", ["vec_id"], SMALL)
    return out(model.transform(rows), "vec_id", "label", "anomaly_score", "is_anomaly")


@check("permutation_importance")
def permutation_importance(spark, sf_dir):
    """Importance of every feature over all windows, written as CSV; top 15."""
    model, rows, names = fitted(spark, sf_dir, SMALL)
    table = iforest.permutation_importance(model, rows, names, win.KEY)
    path = shared_dir(spark, "importance")
    tables.write_csv(table, path)
    saved = spark.read.schema("feature string, importance double").option("header", True).csv(path)
    return out(saved.orderBy(F.desc("importance")).limit(15))


@check("path_attribution")
def path_attribution(spark, sf_dir):
    model, rows, names = fitted(spark, sf_dir)
    labels = F.array(*[F.lit(n) for n in names])
    long = rows.select("window_start", model.attribution().alias("_a")).select(
        "window_start", F.posexplode("_a").alias("_i", "share"))
    return out(long, "window_start", F.element_at(labels, F.col("_i") + 1).alias("feature"), "share")


@check("top_factors")
def top_factors(spark, sf_dir):
    model, rows, names = fitted(spark, sf_dir)
    factors = ex.top_factors(F.col("features"), F.col("_a"), names)
    long = rows.withColumn("_a", model.attribution()).select("window_start", F.posexplode(factors).alias("rank", "_f"))
    return out(long, "window_start", "rank", "_f.factor", "_f.importance")


@check("method_comparison_forest")
def method_comparison_forest(spark, sf_dir):
    table = features(spark, sf_dir)
    shares = heaviest_user(log(spark, sf_dir), HOUR)
    rows = table.join(shares, win.KEY, "left").withColumn(
        "user_ratio", F.coalesce(F.col("user_requests") / F.col("total_requests"), F.lit(1.0)))
    return out(comparison.forest_comparison(rows, scaling.present_features(table, optional=False)))


# --- forecasts ----------------------------------------------------------------------------------------------

SEQ = 60


def counts(spark, sf_dir):
    return win.window_aggregates(log(spark, sf_dir), HOUR, measures=())


@check("lag_sequences", with_(LOG, sql.windows(), (
    f"s AS (SELECT pos, request_count AS target, list(request_count) OVER (ORDER BY pos ROWS BETWEEN {SEQ} PRECEDING AND 1 PRECEDING) AS q FROM wf)"),
    select=f"SELECT pos, target, array_to_string(q, ',') AS sequence FROM s WHERE len(q) = {SEQ}"))
def lag_sequences(spark, sf_dir):
    rows = fc.lag_sequences(counts(spark, sf_dir), SEQ)
    return rows.select("pos", "target", F.array_join(F.col("sequence").cast("array<string>"), ",").alias("sequence"))


@check("padded_sequence", with_(LOG, sql.windows(), (
    f"s AS (SELECT pos, list(request_count) OVER (ORDER BY pos ROWS BETWEEN {SEQ - 1} PRECEDING AND CURRENT ROW) AS q FROM wf)"),
    select=f"SELECT pos, array_to_string(list_concat([0 for i in range({SEQ} - len(q))], q), ',') AS sequence FROM s"))
def padded_sequence(spark, sf_dir):
    rows = fc.padded_sequence(counts(spark, sf_dir), SEQ)
    return rows.select("pos", F.array_join(F.col("sequence").cast("array<string>"), ",").alias("sequence"))


AR1 = """pv AS (SELECT *, lag(request_count) OVER (ORDER BY pos) AS prev FROM wf),
cf AS (SELECT regr_slope(request_count, prev) AS slope, regr_intercept(request_count, prev) AS icpt FROM pv),
ar AS (SELECT pv.*, greatest(0.0::DOUBLE, icpt + slope * prev) AS predicted FROM pv, cf WHERE prev IS NOT NULL)"""


def ar1(spark, sf_dir):
    table = counts(spark, sf_dir)
    return fc.ar1_forecast(table, fc.ar1_coefficients(table))


@check("ar1_forecast", with_(LOG, sql.windows(), AR1, select=f"SELECT pos, request_count, {r('predicted')} AS predicted FROM ar"))
def ar1_forecast(spark, sf_dir):
    return out(ar1(spark, sf_dir), "pos", "request_count", "predicted")


@check("forecast_metrics", with_(LOG, sql.windows(), AR1, (
    "sp AS (SELECT *, CASE WHEN pos - 1 < count(*) OVER () - ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM ar)"), select=(
    f"SELECT split, count(*) AS n, {r('avg(abs(predicted - request_count))')} AS mae, {r('avg((predicted - request_count) ** 2)')} AS mse FROM sp GROUP BY 1")))
def forecast_metrics(spark, sf_dir):
    return out(fc.forecast_errors(fc.chronological(ar1(spark, sf_dir), 0.2)))


@check("lag_regression_forecast")
def lag_regression_forecast(spark, sf_dir):
    """Fit on the first part, save, load, and predict every window."""
    rows = fc.chronological(fc.lag_sequences(counts(spark, sf_dir), SEQ), 0.2)
    model = fc.LagRegression.fit(rows.where(F.col("split") == "train"), SEQ)
    path = shared_dir(spark, "forecaster")
    model.save(path)
    return out(fc.LagRegression.load(path, SEQ).transform(rows), "pos", "split", "target", "predicted")
