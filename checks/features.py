"""Checks of sources, window features and rolling features."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.functions.columns import temporal
from trafficlens.operators import behavior, rolling, scaling, windows as win
from trafficlens.plans.feature_table import feature_table
from trafficlens.config import WindowConfig
from trafficlens.session import materialize, shared_dir
from trafficlens.sources import request_log, tables

from . import sql
from .fixture import GAP, HOUR, log, out
from .registry import check
from .sql import LOG, TEMPORAL, r, with_

REQUEST_COLUMNS = ["request_id", "ts", "user_id", "ip", "endpoint", "method", "status_code", "response_time",
                   "user_agent", "is_bot", "is_attack"]
HOURLY = WindowConfig(window_seconds=HOUR)
SELECT_LOG = (f"SELECT request_id, ts, user_id, ip, endpoint, method, status_code, {r('response_time')} AS response_time, "
              "user_agent, is_bot, is_attack FROM request_log")


def hourly(spark, sf_dir, *measures):
    return win.window_aggregates(log(spark, sf_dir), HOUR, measures=measures)


def windowed(cols: str, seconds: int = HOUR) -> str:
    return with_(LOG, sql.windows(seconds), select=f"SELECT window_start, {cols} FROM wf")


@check("request_log_scan", with_(LOG, select=SELECT_LOG))
def request_log_scan(spark, sf_dir):
    """Write the log as CSV with a header and read it back with its schema."""
    path = shared_dir(spark, "request-log")
    tables.write_csv(log(spark, sf_dir).withColumnRenamed("ts", "timestamp").withColumn("traffic_type", F.lit("normal")), path)
    from trafficlens.schema import REQUEST_LOG

    # CSV columns are positional, so the schema follows the written order
    order = [*REQUEST_COLUMNS, "traffic_type"]
    schema = type(REQUEST_LOG)([REQUEST_LOG["timestamp" if c == "ts" else c] for c in order])
    return out(request_log.read_request_log(spark, path, schema=schema), *REQUEST_COLUMNS)


@check("error_requests", with_(LOG, select="SELECT request_id, endpoint, status_code FROM request_log WHERE status_code >= 400"))
def error_requests(spark, sf_dir):
    return log(spark, sf_dir).where(F.col("status_code") >= 400).select("request_id", "endpoint", "status_code")


@check("bot_requests", with_(LOG, select="SELECT request_id, user_id, user_agent FROM request_log WHERE is_bot = 1"))
def bot_requests(spark, sf_dir):
    return log(spark, sf_dir).where(F.col("is_bot") == 1).select("request_id", "user_id", "user_agent")


def by_endpoint(spark, sf_dir):
    whole = log(spark, sf_dir)
    ends = ["/api/products", "/api/cart", "/api/checkout"]
    return [whole.where(F.col("endpoint") == e) for e in ends] + [whole.where(~F.col("endpoint").isin(ends))]


@check("merged_traffic", with_(LOG, select=SELECT_LOG))
def merged_traffic(spark, sf_dir):
    """Sources split by endpoint and merged again."""
    return out(request_log.merge_sources(*by_endpoint(spark, sf_dir)), *REQUEST_COLUMNS)


@check("merged_traffic_in_order", with_(LOG, select=(
    "SELECT request_id, ts, user_id, endpoint, row_number() OVER (ORDER BY ts, request_id) AS position FROM request_log")))
def merged_traffic_in_order(spark, sf_dir):
    """The sources merged into files in order of time; a row's position is its place in the files."""
    path = shared_dir(spark, "merged-log")
    request_log.write_merged(path, *by_endpoint(spark, sf_dir))
    return out(request_log.read_merged(spark, path), "request_id", "ts", "user_id", "endpoint", "position")


@check("dense_window_grid", with_(LOG, sql.windows(GAP), select="SELECT series_key, window_start, pos, request_count FROM wf"))
def dense_window_grid(spark, sf_dir):
    return out(win.window_aggregates(log(spark, sf_dir), GAP, measures=()), "series_key", "window_start", "pos", "request_count")


@check("window_request_count", windowed("request_count"))
def window_request_count(spark, sf_dir):
    return out(hourly(spark, sf_dir), "window_start", "request_count")


@check("window_unique_users", windowed("unique_users"))
def window_unique_users(spark, sf_dir):
    return out(hourly(spark, sf_dir, "distinct"), "window_start", "unique_users")


@check("window_unique_ips", windowed("unique_ips"))
def window_unique_ips(spark, sf_dir):
    return out(hourly(spark, sf_dir, "distinct"), "window_start", "unique_ips")


@check("path_entropy", windowed(f"{r('path_entropy')} AS path_entropy", GAP))
def path_entropy(spark, sf_dir):
    return out(win.window_aggregates(log(spark, sf_dir), GAP, measures=("entropy",)), "window_start", "path_entropy")


PIVOT = ["/api/products", "/api/cart", "/login", "/api/checkout", "/api/payment"]


@check("endpoint_pivot", with_(LOG, sql.windows(GAP), select="SELECT w.window_start, " + ", ".join(
    f"count(*) FILTER (r.endpoint = '{e}') AS \"{e}\"" for e in PIVOT)
    + " FROM wf w LEFT JOIN wr r USING (window_no) GROUP BY 1"))
def endpoint_pivot(spark, sf_dir):
    rows = win.assign_windows(log(spark, sf_dir), GAP)
    return out(win.endpoint_pivot(rows, GAP, PIVOT), "window_start", *PIVOT)


@check("window_error_rate", windowed(f"{r('error_rate')} AS error_rate"))
def window_error_rate(spark, sf_dir):
    return out(hourly(spark, sf_dir, "ratios"), "window_start", "error_rate")


@check("window_latency", windowed(
    f"{r('avg_response_time')} AS avg_response_time, {r('response_time_std')} AS response_time_std, "
    f"{r('p95_response_time')} AS p95_response_time", GAP))
def window_latency(spark, sf_dir):
    table = win.window_aggregates(log(spark, sf_dir), GAP, measures=("latency", "p95"))
    return out(table, "window_start", "avg_response_time", "response_time_std", "p95_response_time")


@check("window_bot_ratio", windowed(f"{r('bot_ratio')} AS bot_ratio"))
def window_bot_ratio(spark, sf_dir):
    return out(hourly(spark, sf_dir, "ratios"), "window_start", "bot_ratio")


@check("user_agent_diversity", windowed("user_agent_diversity"))
def user_agent_diversity(spark, sf_dir):
    return out(hourly(spark, sf_dir, "distinct"), "window_start", "user_agent_diversity")


@check("endpoint_ratios", windowed(f"{r('checkout_ratio')} AS checkout_ratio, {r('payment_ratio')} AS payment_ratio"))
def endpoint_ratios(spark, sf_dir):
    return out(hourly(spark, sf_dir, "ratios"), "window_start", "checkout_ratio", "payment_ratio")


@check("concentration", windowed(
    f"{r('ip_concentration')} AS ip_concentration, {r('user_concentration')} AS user_concentration"))
def concentration(spark, sf_dir):
    return out(hourly(spark, sf_dir, "distinct"), "window_start", "ip_concentration", "user_concentration")


@check("window_labels", windowed("is_attack, is_bot", GAP))
def window_labels(spark, sf_dir):
    return out(win.window_aggregates(log(spark, sf_dir), GAP, measures=("labels",)), "window_start", "is_attack", "is_bot")


@check("simple_window_features", with_(LOG, sql.simple_features(GAP), select=(
    f"SELECT window_start, request_count, unique_ips, {r('error_rate')} AS error_rate, "
    f"{r('avg_response_time')} AS avg_response_time, {r('ip_concentration')} AS ip_concentration, "
    "hour, is_business_hours, is_attack, is_bot FROM sf")))
def simple_window_features(spark, sf_dir):
    return out(win.simple_window_features(log(spark, sf_dir), GAP), "window_start", "request_count", "unique_ips",
               "error_rate", "avg_response_time", "ip_concentration", "hour", "is_business_hours", "is_attack", "is_bot")


SUMMARY = ["request_count", "unique_users", "error_rate", "avg_response_time", "ip_concentration"]


@check("feature_summary", with_(LOG, sql.windows(), select=" UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) AS count, {r(f'avg({f})')} AS mean, {r(f'stddev_samp({f})')} AS std, "
    f"{r(f'min({f})')} AS min, {r(f'max({f})')} AS max, " + ", ".join(
        f"{r(f'quantile_cont({f}::DOUBLE, 0.{q})')} AS q{q}" for q in (25, 50, 75)) + " FROM wf" for f in SUMMARY)))
def feature_summary(spark, sf_dir):
    return out(win.feature_summary(hourly(spark, sf_dir, "distinct", "latency", "ratios"), SUMMARY))


@check("traffic_mix", with_(LOG, select=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS count FROM request_log GROUP BY 2"
    for c in ("endpoint", "method", "status_code"))))
def traffic_mix(spark, sf_dir):
    return win.value_counts(log(spark, sf_dir), "endpoint", "method", "status_code")


@check("attack_rate", with_(LOG, sql.windows(), select=(
    f"SELECT sum(is_attack)::BIGINT AS attack_windows, count(*) AS windows, {r('avg(is_attack)')} AS attack_rate FROM wf")))
def attack_rate(spark, sf_dir):
    return out(win.attack_rate(hourly(spark, sf_dir, "labels")))


@check("user_time_delta", with_(LOG, select=(
    "SELECT request_id, lag(ts) OVER w AS prev_time, " + r("(t - lag(t) OVER w) / 1e6::DOUBLE") + " AS time_delta "
    "FROM request_log WINDOW w AS (PARTITION BY user_id ORDER BY ts, request_id)")))
def user_time_delta(spark, sf_dir):
    return out(behavior.user_time_delta(log(spark, sf_dir)), "request_id", "prev_time", "time_delta")


@check("window_gap_stats", with_(LOG, sql.windows(), (
    "g AS (SELECT window_no, (t - lag(t) OVER (PARTITION BY user_id ORDER BY ts, request_id)) / 1e6::DOUBLE AS gap FROM wr)"),
    select=f"SELECT window_no, {r('round(avg(gap), 2)')} AS avg_time_delta, {r('min(gap)')} AS min_time_delta FROM g GROUP BY 1"))
def window_gap_stats(spark, sf_dir):
    return out(behavior.window_gap_stats(log(spark, sf_dir), HOUR), "window_no",
               F.round("avg_time_delta", 2).alias("avg_time_delta"), "min_time_delta")


def rolled(*cols: str, whole: tuple = ()) -> str:
    return with_(LOG, sql.windows(GAP), sql.rolling(), select="SELECT window_start, " + ", ".join(
        [f"{r(c)} AS {c}" for c in cols] + list(whole)) + " FROM rf")


def gap_counts(spark, sf_dir):
    return win.window_aggregates(log(spark, sf_dir), GAP, measures=())


@check("burst_metrics", rolled("request_variance", "spike_ratio"))
def burst_metrics(spark, sf_dir):
    return out(rolling.burst_metrics(gap_counts(spark, sf_dir)), "window_start", "request_variance", "spike_ratio")


@check("spike_ratio_simple", with_(LOG, sql.simple_features(GAP), select=f"SELECT window_start, {r('spike_ratio')} AS spike_ratio FROM sf"))
def spike_ratio_simple(spark, sf_dir):
    return out(rolling.spike_ratio_simple(gap_counts(spark, sf_dir)), "window_start", "spike_ratio")


STATS = [f"request_count_{s}{k}" for k in (5, 10, 30) for s in ("ma", "std")]
MAXES = [f"request_count_max{k}" for k in (5, 10, 30)]


@check("rolling_stats", rolled(*STATS, whole=tuple(MAXES)))
def rolling_stats(spark, sf_dir):
    return out(rolling.rolling_stats(gap_counts(spark, sf_dir)), "window_start", *STATS, *MAXES)


DEVIATIONS = [f"deviation_ma{k}" for k in (5, 10, 30)]


@check("rolling_deviation", rolled(*DEVIATIONS))
def rolling_deviation(spark, sf_dir):
    return out(rolling.rolling_stats(gap_counts(spark, sf_dir)), "window_start", *DEVIATIONS)


@check("rate_of_change", rolled("request_pct_change", whole=("request_velocity", "request_acceleration")))
def rate_of_change(spark, sf_dir):
    return out(rolling.rate_of_change(gap_counts(spark, sf_dir)), "window_start", "request_velocity",
               "request_acceleration", "request_pct_change")


@check("ma_forecast", with_(LOG, sql.simple_features(GAP), select=f"SELECT window_start, {r('predicted')} AS predicted FROM sf"))
def ma_forecast(spark, sf_dir):
    return out(rolling.moving_average_forecast(gap_counts(spark, sf_dir), 20), "window_start", "predicted")


SIGNAL = ("greatest(0.0::DOUBLE, least(1.0::DOUBLE, (request_count / (avg(request_count) OVER "
          "(ORDER BY window_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + 1e-8::DOUBLE) - 1) / 5))")


@check("smoothed_traffic_signal", windowed(f"{r(SIGNAL)} AS traffic_signal", GAP))
def smoothed_traffic_signal(spark, sf_dir):
    return out(rolling.smoothed_signal(gap_counts(spark, sf_dir)), "window_start", "traffic_signal")


@check("first_windows", with_(LOG, sql.windows(), select="SELECT window_start, request_count FROM wf ORDER BY window_start LIMIT 50"))
def first_windows(spark, sf_dir):
    return out(rolling.first_windows(hourly(spark, sf_dir), 50), "window_start", "request_count")


@check("chronological_split", with_(LOG, sql.windows(GAP), select=(
    "SELECT window_start, request_count, CASE WHEN pos < floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM wf")))
def chronological_split(spark, sf_dir):
    return out(rolling.chronological_split(gap_counts(spark, sf_dir)), "window_start", "request_count", "split")


TEMPORAL_INT = ["hour", "minute", "day_of_week", "is_business_hours", "is_night", "is_weekend"]


@check("temporal_features", with_(LOG, sql.windows(GAP), TEMPORAL, select=(
    f"SELECT window_start, {', '.join(TEMPORAL_INT)}, {r('hour_sin')} AS hour_sin, {r('hour_cos')} AS hour_cos FROM tf")))
def temporal_features(spark, sf_dir):
    table = gap_counts(spark, sf_dir).withColumns(temporal(F.col("window_start")))
    return out(table, "window_start", *TEMPORAL_INT, "hour_sin", "hour_cos")


FULL_TABLE = (LOG, sql.windows(), TEMPORAL, sql.rolling("tf"))
NAMES = list(scaling.FEATURE_NAMES + scaling.OPTIONAL_FEATURE_NAMES)


@check("feature_matrix", with_(*FULL_TABLE, select="SELECT window_start, is_attack, " + ", ".join(
    f"{r(f'coalesce({n}, 0)')} AS {n}" for n in NAMES) + " FROM rf"))
def feature_matrix(spark, sf_dir):
    """The ordered feature list as wide columns."""
    table = feature_table(log(spark, sf_dir), HOURLY)
    names = scaling.present_features(table)
    vectors = table.select("window_start", "is_attack", scaling.feature_vector(names).alias("x"))
    return out(vectors, "window_start", "is_attack", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])


@check("scaled_features", with_(*FULL_TABLE, select="SELECT window_start, " + ", ".join(
    r(f"(coalesce({n}, 0) - avg(coalesce({n}, 0)) OVER ()) / CASE WHEN stddev_pop(coalesce({n}, 0)) OVER () = 0 "
      f"THEN 1 ELSE stddev_pop(coalesce({n}, 0)) OVER () END") + f" AS {n}" for n in NAMES) + " FROM rf"))
def scaled_features(spark, sf_dir):
    """Scaler fitted on the written feature table, saved, loaded and applied."""
    table = materialize(feature_table(log(spark, sf_dir), HOURLY), "features")
    path = shared_dir(spark, "scaler")
    scaling.fit_scaler(table, scaling.present_features(table)).save(spark, path)
    model = scaling.ScalerModel.load(spark, path)
    return out(table, "window_start", *[c.alias(n) for n, c in model.columns().items()])


@check("feature_table_roundtrip", windowed(
    f"window_no, request_count, unique_users, {r('error_rate')} AS error_rate, {r('p95_response_time')} AS p95_response_time, is_attack"))
def feature_table_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "features")
    tables.write_feature_table(feature_table(log(spark, sf_dir), HOURLY), path)
    return out(spark.read.parquet(path), "window_start", "window_no", "request_count", "unique_users", "error_rate",
               "p95_response_time", "is_attack")


@check("feature_matrix_roundtrip", with_(LOG, sql.windows(), select=(
    f"SELECT window_no, is_attack AS label, {r('request_count')} AS first_feature, {r('p95_response_time')} AS p95 FROM wf")))
def feature_matrix_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "matrix")
    table = feature_table(log(spark, sf_dir), HOURLY)
    tables.write_matrix(table, scaling.feature_vector(scaling.present_features(table)), "is_attack", path, win.KEY)
    x = F.col("features")
    return out(tables.read_matrix(spark, path), "window_no", "label", x[0].alias("first_feature"), x[9].alias("p95"))
