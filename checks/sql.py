"""DuckDB SQL building blocks of the oracles."""

from __future__ import annotations

from .fixture import (
    CPU_PER_REQUEST, FULL_LIMITS, HOUR, LATENCY_SCALE, RULES, SIMPLE_LIMITS)


def r(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0.0)"


def two(expr: str) -> str:
    return f"printf('%.2f', ({expr})::DOUBLE)"


def d(x) -> str:
    return f"{float(x)!r}::DOUBLE"


def with_(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


LOG = """k AS (SELECT *, CAST(json_extract(props,'$.k') AS INT) AS k FROM events),
request_log AS (
  SELECT event_id AS request_id, CAST(ts AS TIMESTAMP) AS ts, epoch_us(ts) AS t, 'U' || user_id AS user_id,
         '192.168.' || (k // 10) || '.' || k AS ip,
         CASE event_type WHEN 'view' THEN '/api/products' WHEN 'click' THEN '/api/cart'
              WHEN 'signup' THEN '/login' WHEN 'purchase' THEN '/api/checkout'
              ELSE '/api/payment' END AS endpoint,
         CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
         CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 503 ELSE 429 END
              WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status_code,
         value AS response_time,
         CASE WHEN k >= 97 THEN 'python-requests/2.28'
              ELSE 'Mozilla/5.0 (' || (user_id % 4) || ')' END AS user_agent,
         CAST(k >= 97 AS INT) AS is_bot,
         CAST(k >= 97 AND event_type IN ('purchase','error') AS INT) AS is_attack
  FROM k)"""


def windows(seconds: int = HOUR) -> str:
    """CTEs wr (requests with window_no) and wf (dense window table)."""
    us = seconds * 1_000_000
    return f"""wr AS (SELECT *, 'all' AS series_key, t // {us} AS window_no FROM request_log),
agg AS (
  SELECT window_no, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT ip) AS ips,
         count(DISTINCT user_agent) AS agents, avg(response_time) AS art, stddev_samp(response_time) AS std,
         quantile_cont(response_time, 0.95) AS p95, count(*) FILTER (status_code >= 400) AS errors,
         count(*) FILTER (endpoint = '/api/checkout') AS checkouts,
         count(*) FILTER (endpoint = '/api/payment') AS payments,
         count(*) FILTER (is_bot = 1) AS bots, max(is_attack) AS is_attack, max(is_bot) AS is_bot
  FROM wr GROUP BY 1),
ec AS (SELECT window_no, endpoint, count(*) AS c FROM wr GROUP BY 1, 2),
ep AS (SELECT *, c / (sum(c) OVER (PARTITION BY window_no) + 1e-6::DOUBLE) AS p FROM ec),
ent AS (SELECT window_no, -sum(p * log2(p + 1e-6::DOUBLE)) AS path_entropy FROM ep GROUP BY 1),
grid AS (SELECT unnest(generate_series((SELECT min(window_no) FROM agg), (SELECT max(window_no) FROM agg))) AS window_no),
wf AS (
  SELECT 'all' AS series_key, g.window_no::BIGINT AS window_no,
         (g.window_no - min(g.window_no) OVER ())::BIGINT AS pos,
         make_timestamp(g.window_no * {us}) AS window_start,
         coalesce(n, 0)::BIGINT AS request_count, coalesce(users, 0)::BIGINT AS unique_users,
         coalesce(ips, 0)::BIGINT AS unique_ips, coalesce(agents, 0)::BIGINT AS user_agent_diversity,
         coalesce(art, 0) AS avg_response_time, coalesce(std, 0) AS response_time_std, coalesce(p95, 0) AS p95_response_time,
         coalesce(errors, 0)::BIGINT AS errors,
         coalesce(errors, 0)::DOUBLE / (coalesce(n, 0) + 1) AS error_rate,
         coalesce(checkouts, 0)::DOUBLE / (coalesce(n, 0) + 1) AS checkout_ratio,
         coalesce(payments, 0)::DOUBLE / (coalesce(n, 0) + 1) AS payment_ratio,
         coalesce(bots, 0)::DOUBLE / (coalesce(n, 0) + 1) AS bot_ratio,
         coalesce(n, 0)::DOUBLE / (coalesce(ips, 0) + 1) AS ip_concentration,
         coalesce(n, 0)::DOUBLE / (coalesce(users, 0) + 1) AS user_concentration,
         coalesce(path_entropy, 0) AS path_entropy,
         coalesce(is_attack, 0)::INT AS is_attack, coalesce(is_bot, 0)::INT AS is_bot
  FROM grid g LEFT JOIN agg USING (window_no) LEFT JOIN ent USING (window_no))"""


TEMPORAL = """tf AS (
  SELECT *, hour(window_start)::INT AS hour, minute(window_start)::INT AS minute,
         (isodow(window_start) - 1)::INT AS day_of_week,
         CAST(hour(window_start) BETWEEN 9 AND 17 AS INT) AS is_business_hours,
         CAST(hour(window_start) BETWEEN 0 AND 6 AS INT) AS is_night,
         CAST(isodow(window_start) >= 6 AS INT) AS is_weekend,
         sin(2 * pi() * hour(window_start) / 24.0::DOUBLE) AS hour_sin,
         cos(2 * pi() * hour(window_start) / 24.0::DOUBLE) AS hour_cos
  FROM wf)"""


def rolling(source: str = "wf", name: str = "rf") -> str:
    """Burst, rolling and rate-of-change columns over a window table."""
    parts = []
    for k in (5, 10, 30):
        w = f"OVER (ORDER BY window_no ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        parts += [f"avg(request_count) {w} AS request_count_ma{k}",
                  f"stddev_samp(request_count) {w} AS request_count_std{k}",
                  f"max(request_count) {w} AS request_count_max{k}",
                  f"(request_count - avg(request_count) {w}) / (stddev_samp(request_count) {w} + 1) AS deviation_ma{k}"]
    five = "OVER (ORDER BY window_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    lag1, lag2 = "lag(request_count, 1) OVER (ORDER BY window_no)", "lag(request_count, 2) OVER (ORDER BY window_no)"
    return f"""{name} AS (
  SELECT *, {", ".join(parts)},
    CASE WHEN count(*) {five} = 5 THEN stddev_samp(request_count) {five} ELSE 0 END AS request_variance,
    CASE WHEN count(*) {five} = 5 THEN request_count / (avg(request_count) {five} + 1) ELSE 0 END AS spike_ratio,
    coalesce(request_count - {lag1}, 0)::BIGINT AS request_velocity,
    coalesce((request_count - {lag1}) - ({lag1} - {lag2}), 0)::BIGINT AS request_acceleration,
    coalesce(CASE WHEN {lag1} = 0 THEN NULL ELSE request_count::DOUBLE / {lag1} - 1 END, 0) AS request_pct_change
  FROM {source})"""


def simple_features(seconds: int = HOUR) -> str:
    """CTE sf: reduced window table with the lenient spike ratio."""
    five = "OVER (ORDER BY window_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    return windows(seconds) + f""",
sf AS (
  SELECT series_key, window_no, pos, window_start, request_count, unique_ips, errors,
         CASE WHEN request_count = 0 THEN 0 ELSE errors::DOUBLE / request_count END AS error_rate,
         avg_response_time, ip_concentration, is_attack, is_bot,
         hour(window_start)::INT AS hour, CAST(hour(window_start) BETWEEN 9 AND 17 AS INT) AS is_business_hours,
         CASE WHEN avg(request_count) {five} = 0 THEN 0
              ELSE request_count / avg(request_count) {five} END AS spike_ratio,
         coalesce(avg(request_count) OVER (ORDER BY window_no ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
                  {d(FULL_LIMITS.base_limit)}) AS predicted
  FROM wf)"""


def add_score(*rules: tuple[str, float]) -> str:
    total = " + ".join(f"CASE WHEN {cond} THEN {d(p)} ELSE 0.0::DOUBLE END" for cond, p in rules)
    return f"least(1.0::DOUBLE, 0.0::DOUBLE + {total})"


WINDOW_SCORE = add_score(
    (f"spike_ratio > {d(RULES.spike_ratio)}", 0.3), (f"ip_concentration > {d(RULES.ip_concentration)}", 0.3),
    (f"error_rate > {d(RULES.error_rate)}", 0.2), (f"request_count > {d(RULES.request_count)}", 0.2))


def fold(source: str, raw: str, limits, name: str = "lim") -> str:
    """Recursive CTE: (pos, rate_limit) of the smoothed limit."""
    def step(previous):
        return (f"trunc(least({d(limits.max_limit)}, greatest({d(limits.min_limit)}, "
                f"{d(limits.alpha)} * s.{raw} + (1 - {d(limits.alpha)}) * {previous})))::BIGINT")
    return f"""{name} AS (
  SELECT s.pos, {step(d(limits.base_limit))} AS rate_limit FROM {source} s WHERE s.pos = 0
  UNION ALL
  SELECT s.pos, {step('l.rate_limit')} FROM {name} l JOIN {source} s ON s.pos = l.pos + 1)"""


def reason_simple(score: str = "anomaly_score") -> str:
    return f"""CASE WHEN {score} > 0.5 THEN 'HIGH ANOMALY (score: ' || {two(score)} || ')'
      || CASE WHEN spike_ratio > {d(RULES.spike_ratio)} THEN ' - Traffic spike detected' ELSE '' END
      || CASE WHEN ip_concentration > {d(RULES.ip_concentration)} THEN ' - Concentrated IPs' ELSE '' END
    ELSE 'Normal traffic pattern' END"""


DECISIONS = simple_features() + f""",
sc AS (SELECT *, {WINDOW_SCORE} AS anomaly_score FROM sf),
sr AS (SELECT *, {d(SIMPLE_LIMITS.base_limit)} * (1 - anomaly_score) AS raw_limit FROM sc),
{fold('sr', 'raw_limit', SIMPLE_LIMITS)},
dec AS (
  SELECT sr.*, lim.rate_limit, request_count < rate_limit AS allow, {reason_simple()} AS reason
  FROM sr JOIN lim USING (pos))"""

FEEDBACK = DECISIONS + f""",
fb AS (
  SELECT 'all' AS policy_key, strftime(window_start, '%Y%m%d%H') AS request_id, window_start AS ts,
         CASE WHEN NOT allow AND is_attack = 1 THEN 'true_positive' WHEN NOT allow THEN 'false_positive'
              WHEN is_attack = 1 THEN 'false_negative' ELSE 'true_negative' END AS type,
         is_attack AS actual_label, CAST(NOT allow AS INT) AS predicted_label,
         least(100.0::DOUBLE, request_count * {d(CPU_PER_REQUEST)}) AS cpu_usage,
         round(avg_response_time, 6) * {d(LATENCY_SCALE)} AS rt, error_rate
  FROM dec),
rw AS (
  SELECT *, 0.7::DOUBLE * CASE type WHEN 'true_positive' THEN 1.0 WHEN 'true_negative' THEN 0.5
                                   WHEN 'false_positive' THEN -1.0 ELSE -2.0 END::DOUBLE
          + 0.3::DOUBLE * (CASE WHEN cpu_usage > 80 THEN -0.5 ELSE 0 END + CASE WHEN rt > 500 THEN -0.5 ELSE 0 END)::DOUBLE
            AS reward FROM fb)"""
