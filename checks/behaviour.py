"""Checks of histories, bot patterns, trailing statistics and heuristics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from trafficlens.functions.columns import severity
from trafficlens.operators import behavior, heuristics, trailing
from trafficlens.plans.decisions import simple_features

from . import sql
from .fixture import (
    CHECKOUT, DAY, FULL_LIMITS, HOUR, LOGINS, ONLINE_RULES, PARALLEL, RULES, SCAN, SHORT, TRAILING, log, only, out)
from .registry import check
from .sql import LOG, WINDOW_SCORE, add_score, d, r, with_


def history(seconds: int, rows: int | None = 100) -> str:
    """CTE hs: every request with its history h of (t, e), of at most ``rows`` requests."""
    oldest = f"{rows - 1} PRECEDING" if rows else "UNBOUNDED PRECEDING"
    return f"""h0 AS (
  SELECT *, list(struct_pack(t := t, e := endpoint)) OVER (
    PARTITION BY user_id ORDER BY ts, request_id ROWS BETWEEN {oldest} AND CURRENT ROW) AS h1 FROM request_log),
hs AS (SELECT * EXCLUDE (h1), list_filter(h1, lambda x: x.t >= t - {seconds * 1_000_000}) AS h FROM h0)"""


def sequence_hit(p, strict: bool | None = None) -> str:
    """SQL condition: some run of the history contains the pattern in time."""
    strict = p.strict if strict is None else strict
    n = len(p.endpoints)
    need = []
    for e in dict.fromkeys(p.endpoints):
        times = p.endpoints.count(e) if strict else 1
        need.append(f"len(list_filter(h[i:i + {n - 1}], lambda x: x.e = '{e}')) >= {times}")
    cond = " AND ".join(need) + f" AND h[i + {n - 1}].t - h[i].t <= {p.max_time_ms * 1000}"
    return f"(len(h) >= {n} AND len(list_filter(range(1, len(h) - {n - 2}), lambda i: {cond})) > 0)"


def parallel_hit(p) -> str:
    times = "list_transform(list_filter(h, lambda x: x.e = e), lambda x: x.t)"
    return (f"(len(list_filter(list_distinct(list_transform(h, lambda x: x.e)), lambda e: len({times}) >= {p.min_count} "
            f"AND list_max({times}) - list_min({times}) <= {p.max_time_ms * 1000})) > 0)")


def hits(cond: str, seconds: int = 86_400) -> str:
    return with_(LOG, history(seconds), select=f"SELECT request_id, user_id, {cond} AS hit FROM hs")


def pattern_query(pattern, cfg=None):
    def run(spark, sf_dir):
        rows = behavior.match_patterns(log(spark, sf_dir), cfg or only(pattern))
        return rows.select("request_id", "user_id", F.col(f"hit_{pattern.name}").alias("hit"))

    return run


@check("user_history", with_(LOG, history(21_600), select=(
    "SELECT request_id, len(h) AS history_size, h[1].t AS oldest, list_aggregate(list_transform(h, lambda x: x.e), 'string_agg', ',') AS endpoints FROM hs")))
def user_history(spark, sf_dir):
    rows = behavior.with_history(log(spark, sf_dir), SHORT)
    return rows.select(
        "request_id", F.size("history").cast("bigint").alias("history_size"), F.col("history")[0].t.alias("oldest"),
        F.array_join(F.transform("history", lambda x: x.endpoint), ",").alias("endpoints"))


check("bot_pattern_sequence", hits(sequence_hit(CHECKOUT), 21_600))(pattern_query(CHECKOUT, SHORT))
check("bot_rapid_checkout", hits(sequence_hit(CHECKOUT)))(pattern_query(CHECKOUT))
check("bot_endpoint_scan", hits(sequence_hit(SCAN)))(pattern_query(SCAN))
check("bot_parallel", hits(parallel_hit(PARALLEL)))(pattern_query(PARALLEL))
check("bot_credential_stuffing", hits(sequence_hit(LOGINS)))(pattern_query(LOGINS))

MATCHED = ((
    f"m AS (SELECT *, {sequence_hit(CHECKOUT)} AS a, {sequence_hit(SCAN)} AS b, {parallel_hit(PARALLEL)} AS c, "
    f"{sequence_hit(LOGINS)} AS l FROM hs)"), (
    "sus AS (SELECT *, greatest(CASE WHEN a THEN 0.9::DOUBLE ELSE 0 END, CASE WHEN b THEN 0.95::DOUBLE ELSE 0 END, "
    "CASE WHEN c THEN 0.85::DOUBLE ELSE 0 END, CASE WHEN l THEN 0.9::DOUBLE ELSE 0 END) AS score, "
    "concat_ws(',', CASE WHEN a THEN 'rapid_checkout' END, CASE WHEN b THEN 'endpoint_scanning' END, "
    "CASE WHEN c THEN 'parallel_requests' END, CASE WHEN l THEN 'credential_stuffing' END) AS names FROM m)"))
SUSPICION = (LOG, history(86_400), *MATCHED)
WHOLE = replace(DAY, max_history=None)


@check("suspicion_score", with_(*SUSPICION, select=(
    f"SELECT request_id, {r('score')} AS suspicion_score, names AS matched_patterns, names <> '' AS is_suspicious FROM sus")))
def suspicion_score(spark, sf_dir):
    return out(behavior.suspicion(log(spark, sf_dir), DAY), "request_id", "suspicion_score",
               F.array_join("matched_patterns", ",").alias("matched_patterns"), "is_suspicious")


@check("suspicion_of_whole_histories", with_(LOG, history(86_400, None), *MATCHED, select=(
    f"SELECT request_id, {r('score')} AS suspicion_score, names AS matched_patterns FROM sus")))
def suspicion_of_whole_histories(spark, sf_dir):
    """As ``suspicion_score``, with histories that no number of rows bounds."""
    return out(behavior.suspicion(log(spark, sf_dir), WHOLE), "request_id", "suspicion_score",
               F.array_join("matched_patterns", ",").alias("matched_patterns"))


BEHAVIOR = """gp AS (SELECT *, CASE WHEN len(h) >= 2 THEN list_transform(range(2, len(h) + 1), lambda i: (h[i].t - h[i - 1].t) / 1e6::DOUBLE) END AS g FROM {source}),
bf AS (SELECT *, list_avg(g) AS avg_gap, list_stddev_pop(g) AS std_gap, list_min(g) AS min_gap,
         len(list_distinct(list_transform(h, lambda x: x.e))) AS uniq, len(h) AS n,
         coalesce(len(list_filter(g, lambda x: x < 600)) > 0, false) AS rapid,
         CASE WHEN len(h) >= 2 AND h[len(h)].t > h[1].t THEN len(h) / ((h[len(h)].t - h[1].t) / 1e6::DOUBLE) END AS rate
       FROM gp)"""


@check("behavior_features", with_(LOG, history(86_400), BEHAVIOR.format(source="hs"), select=(
    f"SELECT request_id, {r('round(avg_gap, 1)')} AS avg_inter_request_time, {r('round(std_gap, 1)')} AS std_inter_request_time, "
    f"{r('min_gap')} AS min_inter_request_time, uniq::INT AS unique_endpoints, n::INT AS total_requests, "
    f"{r('uniq::DOUBLE / n')} AS endpoint_diversity, rapid AS has_rapid_sequence, {r('rate')} AS request_rate FROM bf")))
def behavior_features(spark, sf_dir):
    rows = behavior.behavior_features(log(spark, sf_dir), DAY)
    return out(rows, "request_id", F.round("avg_inter_request_time", 1).alias("avg_inter_request_time"),
               F.round("std_inter_request_time", 1).alias("std_inter_request_time"), "min_inter_request_time",
               "unique_endpoints", "total_requests", "endpoint_diversity", "has_rapid_sequence", "request_rate")


@check("features_of_whole_histories", with_(LOG, history(86_400, None), BEHAVIOR.format(source="hs"), select=(
    f"SELECT request_id, {r('round(std_gap, 1)')} AS std_inter_request_time, {r('min_gap')} AS min_inter_request_time, "
    "uniq::INT AS unique_endpoints, n::INT AS total_requests, rapid AS has_rapid_sequence FROM bf")))
def features_of_whole_histories(spark, sf_dir):
    rows = behavior.behavior_features(log(spark, sf_dir), WHOLE)
    return out(rows, "request_id", F.round("std_inter_request_time", 1).alias("std_inter_request_time"),
               "min_inter_request_time", "unique_endpoints", "total_requests", "has_rapid_sequence")


@check("realtime_features", with_(*SUSPICION, BEHAVIOR.format(source="sus"), select=(
    f"SELECT request_id, 0 AS requests_per_minute, {r('0')} AS error_rate, 0 AS hour, {r('score')} AS behavioral_suspicion_score, "
    f"{r('coalesce(round(avg_gap, 1), 0)')} AS avg_inter_request_time, "
    f"{r('CASE WHEN n < 2 THEN 0 ELSE uniq::DOUBLE / n END')} AS endpoint_diversity, rapid AS has_rapid_sequence FROM bf")))
def realtime_features(spark, sf_dir):
    rows = behavior.realtime_features(log(spark, sf_dir), DAY)
    return out(rows, "request_id", "requests_per_minute", "error_rate", "hour", "behavioral_suspicion_score",
               F.round("avg_inter_request_time", 1).alias("avg_inter_request_time"), "endpoint_diversity",
               "has_rapid_sequence")


@check("heuristic_behavior_risk", with_(LOG, history(86_400), BEHAVIOR.format(source="hs"), select=(
    "SELECT request_id, " + r(
        "coalesce(list_avg(list_filter([CASE WHEN coalesce(avg_gap, 1.0) < 0.1 THEN 0.8::DOUBLE END, "
        "CASE WHEN uniq::DOUBLE / n < 0.3::DOUBLE THEN 0.6::DOUBLE END, CASE WHEN rapid THEN 0.7::DOUBLE END], lambda x: x IS NOT NULL)), 0)")
    + " AS risk FROM bf")))
def heuristic_behavior_risk(spark, sf_dir):
    rows = behavior.behavior_features(log(spark, sf_dir), DAY)
    risk = behavior.heuristic_risk(
        F.col("avg_inter_request_time"), F.col("endpoint_diversity"), F.col("has_rapid_sequence"))
    return out(rows, "request_id", risk.alias("risk"))


@check("request_feature_defaults", with_(LOG, select=(
    f"SELECT request_id, 0 AS requests_per_minute, 0 AS unique_users, {r('0')} AS error_rate, "
    f"{r('CASE WHEN is_bot = 1 THEN 0 ELSE response_time END')} AS avg_response_time, {r('0')} AS ip_concentration, "
    "CASE WHEN is_bot = 1 THEN 0 ELSE hour(ts) END::INT AS hour FROM request_log")))
def request_feature_defaults(spark, sf_dir):
    from trafficlens.config import REQUEST_DEFAULTS
    from trafficlens.functions.columns import with_defaults

    known = F.col("is_bot") == 0
    rows = log(spark, sf_dir).select(
        "request_id", F.when(known, F.col("response_time")).alias("avg_response_time"),
        F.when(known, F.hour("ts")).alias("hour"))
    return out(with_defaults(rows, REQUEST_DEFAULTS), "request_id", "requests_per_minute", "unique_users", "error_rate",
               "avg_response_time", "ip_concentration", "hour")


US = TRAILING * 1_000_000
# the trailing window of each request by a plain self-join on the range
TRAIL = f"""tw AS (
  SELECT a.request_id, a.ts, count(*) AS n, count(DISTINCT b.user_id) AS users, count(DISTINCT b.ip) AS ips,
         count(*) FILTER (b.status_code >= 400) AS errors, avg(b.response_time) AS art,
         count(*) FILTER (b.user_id = a.user_id) AS own_user, count(*) FILTER (b.ip = a.ip) AS own_ip
  FROM request_log a JOIN request_log b ON b.t > a.t - {US} AND b.t <= a.t GROUP BY 1, 2),
tr AS (
  SELECT request_id, ts, n AS request_count, users AS unique_users, ips AS unique_ips, errors::DOUBLE / n AS error_rate,
         art AS avg_response_time, own_user AS user_request_count, own_ip AS ip_request_count,
         n::DOUBLE / ips AS ip_concentration, hour(ts)::INT AS hour,
         CAST(hour(ts) BETWEEN 9 AND 17 AS INT) AS is_business_hours FROM tw)"""


@check("trailing_60s_features", with_(LOG, TRAIL, select=(
    f"SELECT request_id, request_count, unique_users, unique_ips, {r('error_rate')} AS error_rate, "
    f"{r('avg_response_time')} AS avg_response_time, user_request_count, ip_request_count, "
    f"{r('ip_concentration')} AS ip_concentration, hour, is_business_hours FROM tr")))
def trailing_60s_features(spark, sf_dir):
    rows = trailing.trailing_features(log(spark, sf_dir), TRAILING)
    return out(rows, "request_id", "request_count", "unique_users", "unique_ips", "error_rate",
               "avg_response_time", "user_request_count", "ip_request_count",
               "ip_concentration", "hour", "is_business_hours")


@check("live_stats", with_(LOG, select=(
    f"SELECT count(*) AS requests_in_window, count(DISTINCT user_id) AS unique_users, count(DISTINCT ip) AS unique_ips, "
    f"{r(FULL_LIMITS.forecast_weight)} AS forecast_weight, {r(FULL_LIMITS.anomaly_weight)} AS anomaly_weight "
    f"FROM request_log WHERE t > (SELECT max(t) FROM request_log) - {US}")))
def live_stats(spark, sf_dir):
    rows = trailing.live_stats(log(spark, sf_dir), TRAILING)
    return out(rows.withColumns({"forecast_weight": F.lit(FULL_LIMITS.forecast_weight),
                                 "anomaly_weight": F.lit(FULL_LIMITS.anomaly_weight)}))


O = ONLINE_RULES
ONLINE_SCORE = add_score(
    (f"request_count > {d(O.request_count)}", 0.3), (f"ip_concentration > {d(O.ip_concentration)}", 0.3),
    (f"error_rate > {d(O.error_rate)}", 0.2), (f"user_request_count > {d(O.user_request_count)}", 0.2))


@check("heuristic_anomaly_online", with_(LOG, TRAIL, select=f"SELECT request_id, {r(ONLINE_SCORE)} AS anomaly_score FROM tr"))
def heuristic_anomaly_online(spark, sf_dir):
    rows = trailing.trailing_features(log(spark, sf_dir), TRAILING)
    return out(rows, "request_id", heuristics.online_score(ONLINE_RULES).alias("anomaly_score"))


@check("heuristic_anomaly_window", with_(LOG, sql.simple_features(), select=f"SELECT window_start, {r(WINDOW_SCORE)} AS anomaly_score FROM sf"))
def heuristic_anomaly_window(spark, sf_dir):
    return out(simple_features(log(spark, sf_dir), HOUR), "window_start", heuristics.window_score(RULES).alias("anomaly_score"))


LADDER = "CASE WHEN {x} > 5 THEN 0.9 WHEN {x} > 3 THEN 0.7 WHEN {x} > 2 THEN 0.4 ELSE 0.1 END::DOUBLE"


@check("heuristic_anomaly_ratio", with_(LOG, sql.windows(), select=(
    f"SELECT window_start, {r(LADDER.format(x='(request_count / 5.0::DOUBLE)'))} AS anomaly_score FROM wf")))
def heuristic_anomaly_ratio(spark, sf_dir):
    rows = simple_features(log(spark, sf_dir), HOUR)
    return out(rows, "window_start", heuristics.ratio_ladder(F.col("request_count"), 5).alias("anomaly_score"))


@check("severity_bucket", with_(LOG, sql.simple_features(), (
    f"s AS (SELECT window_start, {WINDOW_SCORE} AS p FROM sf)"), select=(
    "SELECT window_start, CASE WHEN p > 0.8 THEN 'high' WHEN p > 0.5 THEN 'medium' ELSE 'low' END AS severity FROM s")))
def severity_bucket(spark, sf_dir):
    rows = simple_features(log(spark, sf_dir), HOUR)
    return out(rows, "window_start", severity(heuristics.window_score(RULES)).alias("severity"))
