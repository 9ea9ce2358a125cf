"""Checks of the streaming operators: finite runs compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.operators import heuristics
from trafficlens.operators.windows import KEY
from trafficlens.schema import FEEDBACK as FEEDBACK_SCHEMA
from trafficlens.session import materialize, shared_dir
from trafficlens.sources.request_log import events_request_stream
from trafficlens.streaming import decisions as live, state, windows as sw
from trafficlens.streaming.runner import drain, drain_newest

from . import sql
from .behaviour import SUSPICION
from .fixture import DAY, HOUR, RULES, SIMPLE_LIMITS, decisions, feedback, out, session
from .policy_checks import CLAMPED
from .registry import check
from .sql import DECISIONS, FEEDBACK, LOG, WINDOW_SCORE, d, fold, r, with_

DELAY, DELAY_US = "10 minutes", 600_000_000
CLOSED = f"(SELECT (max(t) // 1000) * 1000 FROM request_log) - {DELAY_US}"


def stream(spark, sf_dir):
    return events_request_stream(session(spark), sf_dir)


def closed(seconds: int) -> str:
    return f"epoch_us(window_start) + {seconds * 1_000_000} <= {CLOSED}"


@check("stream_window_features", with_(LOG, sql.windows(), select=(
    f"SELECT window_start, request_count, unique_users, unique_ips, {r('error_rate')} AS error_rate, "
    f"{r('avg_response_time')} AS avg_response_time, {r('checkout_ratio')} AS checkout_ratio, "
    f"{r('ip_concentration')} AS ip_concentration, is_attack FROM wf WHERE request_count > 0 AND {closed(HOUR)}")))
def stream_window_features(spark, sf_dir):
    sink = drain(sw.window_features(stream(spark, sf_dir), HOUR, DELAY), "stream-windows")
    return out(sink, "window_start", "request_count", "unique_users", "unique_ips", "error_rate", "avg_response_time",
               "checkout_ratio", "ip_concentration", "is_attack")


WIDE, STEP = 6 * HOUR * 1_000_000, HOUR * 1_000_000


@check("stream_sliding_stats", with_(LOG, (
    f"sl AS (SELECT *, unnest(generate_series((t // {STEP}) * {STEP} - {WIDE - STEP}, (t // {STEP}) * {STEP}, {STEP})) AS s FROM request_log)"), (
    "sa AS (SELECT s, count(*) AS n, count(DISTINCT user_id) AS u, count(DISTINCT ip) AS i, count(*) FILTER (status_code >= 400) AS e, "
    "avg(response_time) AS a FROM sl GROUP BY 1)"), select=(
    f"SELECT make_timestamp(s) AS window_start, make_timestamp(s + {WIDE}) AS window_end, n AS request_count, u AS unique_users, i AS unique_ips, "
    f"{r('e::DOUBLE / n')} AS error_rate, {r('round(a * n, 3)')} AS total_response_time, {r('n::DOUBLE / i')} AS ip_concentration FROM sa WHERE s + {WIDE} <= {CLOSED}")))
def stream_sliding_stats(spark, sf_dir):
    sink = drain(sw.sliding_statistics(stream(spark, sf_dir), "6 hours", "1 hour", DELAY), "stream-sliding")
    total = F.round(F.col("avg_response_time") * F.col("request_count"), 3).alias("total_response_time")
    return out(sink, "window_start", "window_end", "request_count", "unique_users", "unique_ips", "error_rate", total,
               "ip_concentration")


STREAM_RAW = f"sw AS (SELECT *, {d(SIMPLE_LIMITS.base_limit)} * (1 - ({WINDOW_SCORE})) AS raw_limit FROM sf WHERE {closed(HOUR)})"


@check("stream_adaptive_limit", with_(LOG, sql.simple_features(), STREAM_RAW, fold("sw", "raw_limit", SIMPLE_LIMITS), select=(
    "SELECT sw.window_no, request_count, rate_limit, request_count < rate_limit AS allow FROM sw JOIN lim USING (pos) WHERE request_count > 0"), recursive=True))
def stream_adaptive_limit(spark, sf_dir):
    """Windows, then spike and limit state, in one query: the limits of the batch on closed windows."""
    rows = sw.window_features(stream(spark, sf_dir), HOUR, DELAY)
    n = F.col("request_count")
    rows = rows.withColumn("error_rate", F.round(F.col("error_rate") * (n + 1)) / n)
    rows = rows.withColumn("points", heuristics.window_score(RULES, spike=False))
    sink = drain(state.adaptive_limits(
        rows, SIMPLE_LIMITS, spike=(RULES.spike_ratio, heuristics.SPIKE_POINTS, 5)), "stream-limit")
    return sink.select("window_no", "request_count", "rate_limit", "allow")


@check("stream_bot_patterns", with_(*SUSPICION, select=(
    f"SELECT user_id, request_id, {r('score')} AS suspicion_score, names AS matched_patterns FROM sus WHERE names <> '' "
    f"AND request_id IN (SELECT request_id FROM request_log WHERE (t // 1000 + 1) * 1000 <= {CLOSED})")))
def stream_bot_patterns(spark, sf_dir):
    return out(drain(state.bot_patterns(stream(spark, sf_dir), DAY), "stream-patterns"))


@check("stream_weights", with_(LOG, FEEDBACK, CLAMPED, select=(
    f"SELECT policy_key, request_id, ts, {r('w')} AS anomaly_weight, {r('1 - w')} AS forecast_weight FROM nf JOIN cw USING (rn)"),
    recursive=True))
def stream_weights(spark, sf_dir):
    path = shared_dir(session(spark), "feedback")
    feedback(spark, sf_dir).write.parquet(path)
    arriving = spark.readStream.schema(FEEDBACK_SCHEMA).parquet(path)
    return out(drain(state.learned_weights(arriving, SIMPLE_LIMITS), "stream-weights"))


@check("stream_forecast", with_(LOG, sql.simple_features(), select=(
    f"SELECT series_key, window_no, request_count, {r('predicted')} AS predicted FROM sf WHERE request_count > 0 AND {closed(HOUR)}")))
def stream_forecast(spark, sf_dir):
    rows = sw.window_features(stream(spark, sf_dir), HOUR, DELAY)
    return out(drain(state.rolling_forecast(rows, SIMPLE_LIMITS.base_limit), "stream-forecast"))


def decided(spark, sf_dir):
    limits = materialize(
        decisions(spark, sf_dir).select(*KEY, "anomaly_score", "rate_limit", "allow"), "limits")
    return drain(sw.decide(stream(spark, sf_dir), limits, HOUR), "decisions")


@check("stream_decisions", with_(LOG, DECISIONS, select=(
    f"SELECT request_id, wr.window_no, endpoint, {r('anomaly_score')} AS anomaly_score, rate_limit, allow FROM wr JOIN dec USING (window_no)"), recursive=True))
def stream_decisions(spark, sf_dir):
    return out(decided(spark, sf_dir), "request_id", "window_no", "endpoint", "anomaly_score", "rate_limit", "allow")


@check("stream_decision_stats", with_(LOG, DECISIONS, select=(
    f"SELECT count(*) AS total_requests, count(*) FILTER (allow) AS allowed, count(*) FILTER (NOT allow) AS blocked, "
    f"{r('count(*) FILTER (NOT allow)::DOUBLE / count(*)')} AS block_rate FROM wr JOIN dec USING (window_no)"), recursive=True))
def stream_decision_stats(spark, sf_dir):
    """Counters over the decision log, itself a stream sink."""
    sink = decided(spark, sf_dir)
    path = shared_dir(spark, "decision-log")
    sink.write.parquet(path)
    arriving = spark.readStream.schema(sink.schema).parquet(path)
    return out(drain(sw.running_stats(arriving), "decision-stats", "complete"))


LIVE = f"lv AS (SELECT wr.*, anomaly_score, rate_limit, allow FROM wr JOIN dec USING (window_no) WHERE {closed(HOUR).replace('window_start', 'dec.window_start')})"


def live_log(spark, sf_dir):
    """The decision log of the stream: a Parquet sink that has each batch once."""
    path = shared_dir(session(spark), "live-log")
    return drain(live.live_decisions(stream(spark, sf_dir), HOUR, SIMPLE_LIMITS, RULES, DELAY), "live", path=path), path


@check("live_decisions", with_(LOG, DECISIONS, LIVE, select=(
    f"SELECT request_id, window_no, user_id, endpoint, {r('anomaly_score')} AS anomaly_score, rate_limit, allow FROM lv"), recursive=True))
def live_decisions(spark, sf_dir):
    """Requests decided by the limits of their own stream: those of the batch on closed windows."""
    return out(live_log(spark, sf_dir)[0], "request_id", "window_no", "user_id", "endpoint", "anomaly_score", "rate_limit", "allow")


@check("live_decision_stats", with_(LOG, DECISIONS, LIVE, select=(
    f"SELECT count(*) AS total_requests, count(*) FILTER (allow) AS allowed, count(*) FILTER (NOT allow) AS blocked, "
    f"{r('count(*) FILTER (NOT allow)::DOUBLE / count(*)')} AS block_rate FROM lv"), recursive=True))
def live_decision_stats(spark, sf_dir):
    """Counters of a stream that reads the decision log of another."""
    sink, path = live_log(spark, sf_dir)
    arriving = spark.readStream.schema(sink.schema).parquet(path)
    return out(drain(sw.running_stats(arriving), "live-stats", "complete"))


@check("live_recent_decisions", with_(LOG, DECISIONS, LIVE, select=(
    f"SELECT request_id, ts, user_id, endpoint, {r('anomaly_score')} AS anomaly_score, rate_limit, allow FROM lv "
    "ORDER BY ts DESC, request_id DESC LIMIT 20"), recursive=True))
def live_recent_decisions(spark, sf_dir):
    """The newest 20 decisions, kept in state while the decision log arrives."""
    sink, path = live_log(spark, sf_dir)
    arriving = spark.readStream.schema(sink.schema).parquet(path)
    return out(drain_newest(state.newest_rows(arriving, 20), "live-newest"), "request_id", "ts", "user_id", "endpoint",
               "anomaly_score", "rate_limit", "allow")


@check("stream_deduplicated", with_(LOG, select="SELECT request_id, user_id, endpoint, status_code FROM request_log"))
def stream_deduplicated(spark, sf_dir):
    """Every request delivered twice, in two files; each counts once."""
    path = shared_dir(session(spark), "twice")
    for _ in range(2):
        spark.read.parquet(f"{sf_dir}/events.parquet").coalesce(1).write.mode("append").parquet(path)
    twice = events_request_stream(spark, path, "*.parquet")
    return out(drain(sw.deduplicated(twice, "400 days"), "deduplicated"), "request_id", "user_id", "endpoint", "status_code")
