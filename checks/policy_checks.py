"""Checks of the limit policy, decisions, explanations and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.config import EXPLAIN_FEATURES
from trafficlens.operators import explain as ex, feedback as fb, forecast as fc, policy, windows as win
from trafficlens.plans import decisions as plans
from trafficlens.session import shared_dir
from trafficlens.sources import tables

from . import sql
from .behaviour import LADDER, SUSPICION
from .fixture import (
    CPU_PER_REQUEST, DAY, FULL_LIMITS, HOUR, ONLINE_RULES, SIMPLE_LIMITS, decisions, feedback, log, out, with_ids)
from .registry import check
from .sql import DECISIONS, FEEDBACK, LOG, add_score, d, fold, r, two, with_

LOW, HIGH = SIMPLE_LIMITS.min_limit, SIMPLE_LIMITS.max_limit
F_ = FULL_LIMITS


def clip(x, lo, hi):
    return f"greatest({d(lo)}, least({d(hi)}, {x}))"


def decided(cols: str, tail: str = "") -> str:
    return with_(LOG, DECISIONS, select=f"SELECT {cols} FROM dec {tail}", recursive=True)


@check("window_decisions", decided(
    f"series_key, window_start, request_count, unique_ips, {r('error_rate')} AS error_rate, {r('spike_ratio')} AS spike_ratio, "
    f"{r('ip_concentration')} AS ip_concentration, {r('anomaly_score')} AS anomaly_score, {r('raw_limit')} AS raw_limit, "
    "rate_limit, allow, reason, is_attack"))
def window_decisions(spark, sf_dir):
    return out(decisions(spark, sf_dir), "series_key", "window_start", "request_count", "unique_ips", "error_rate",
               "spike_ratio", "ip_concentration", "anomaly_score", "raw_limit", "rate_limit", "allow", "reason", "is_attack")


@check("adaptive_limit_trajectory", with_(LOG, sql.windows(), fold("wf", "request_count", SIMPLE_LIMITS), select=(
    "SELECT pos, rate_limit FROM lim"), recursive=True))
def adaptive_limit_trajectory(spark, sf_dir):
    """The fold alone, fed with the counts as raw limits."""
    table = win.window_aggregates(log(spark, sf_dir), HOUR, measures=())
    return out(policy.smoothed_limits(table, SIMPLE_LIMITS, raw="request_count"), "pos", "rate_limit")


@check("allow_block", decided("window_start, request_count, rate_limit, allow"))
def allow_block(spark, sf_dir):
    return out(decisions(spark, sf_dir), "window_start", "request_count", "rate_limit", "allow")


@check("limit_summary", decided(
    "series_key, arg_min(rate_limit, pos) AS first_limit, min(rate_limit) AS lowest_limit, arg_max(rate_limit, pos) AS last_limit",
    "GROUP BY 1"))
def limit_summary(spark, sf_dir):
    return policy.limit_summary(decisions(spark, sf_dir))


@check("decision_stats", decided(
    "count(*) AS total_requests, count(*) FILTER (allow) AS allowed, count(*) FILTER (NOT allow) AS blocked, "
    + r("count(*) FILTER (NOT allow) / count(*)::DOUBLE") + " AS block_rate"))
def decision_stats(spark, sf_dir):
    return out(policy.decision_stats(decisions(spark, sf_dir)))


@check("recent_decisions", decided("window_start, rate_limit, allow", "ORDER BY window_start DESC LIMIT 20"))
def recent_decisions(spark, sf_dir):
    return out(policy.recent_decisions(decisions(spark, sf_dir)), "window_start", "rate_limit", "allow")


@check("interesting_windows", decided(f"window_start, {r('anomaly_score')} AS anomaly_score, is_attack",
                                      "WHERE anomaly_score > 0.5 OR is_attack = 1"))
def interesting_windows(spark, sf_dir):
    from trafficlens.operators.evaluate import interesting

    return out(interesting(decisions(spark, sf_dir)), "window_start", "anomaly_score", "is_attack")


@check("request_window_join", with_(LOG, DECISIONS, select=(
    "SELECT request_id, wr.window_no, rate_limit, allow FROM wr LEFT JOIN dec USING (window_no)"), recursive=True))
def request_window_join(spark, sf_dir):
    limits = decisions(spark, sf_dir).select(*win.KEY, "rate_limit", "allow")
    return out(policy.join_windows(log(spark, sf_dir), limits, HOUR), "request_id", "window_no", "rate_limit", "allow")


@check("request_replay", with_(LOG, DECISIONS, select=(
    "SELECT request_id, position, rate_limit, position - 1 < rate_limit AS allow FROM (SELECT *, row_number() OVER "
    "(PARTITION BY window_no ORDER BY ts, request_id) AS position FROM wr) LEFT JOIN dec USING (window_no)"), recursive=True))
def request_replay(spark, sf_dir):
    return out(policy.replay_requests(log(spark, sf_dir), decisions(spark, sf_dir), HOUR),
               "request_id", "position", "rate_limit", "allow")


SHARES = """us AS (
  SELECT window_no, user_id, count(*) AS user_requests, max(is_bot) AS is_bot,
         count(*) FILTER (status_code >= 400) AS user_errors FROM wr GROUP BY 1, 2),
sh AS (SELECT *, (sum(user_requests) OVER w)::BIGINT AS total_requests, user_requests / sum(user_requests) OVER w AS user_ratio,
              sum(user_errors) OVER w / sum(user_requests) OVER w AS error_rate FROM us WINDOW w AS (PARTITION BY window_no))"""
FAIR = clip("1 + 0.3::DOUBLE * (1 - least(1.0::DOUBLE, {share})) * (1 - least(1.0::DOUBLE, {err})) * "
            "CASE WHEN {bot} = 1 THEN 0.5::DOUBLE ELSE 1 END", 0.5, 1.5)


@check("user_share", with_(LOG, sql.windows(), SHARES, select=(
    f"SELECT window_no, user_id, user_requests, total_requests, {r('user_ratio')} AS user_ratio FROM sh")))
def user_share(spark, sf_dir):
    return out(win.user_share(log(spark, sf_dir), HOUR), "window_no", "user_id", "user_requests", "total_requests", "user_ratio")


@check("fairness_multiplier", with_(LOG, sql.windows(), SHARES, select=(
    f"SELECT window_no, user_id, {r(FAIR.format(share='user_ratio', err='error_rate', bot='is_bot'))} AS fairness FROM sh")))
def fairness_multiplier(spark, sf_dir):
    rows = win.user_share(log(spark, sf_dir), HOUR)
    fair = policy.fairness(F.col("user_requests"), F.col("total_requests"), F.col("error_rate"), F.col("is_bot"), F_)
    return out(rows, "window_no", "user_id", fair.alias("fairness"))


CONTEXT = ("CASE WHEN {flash} = 1 THEN 2.0 WHEN is_business_hours = 1 THEN 1.0 WHEN hour BETWEEN 0 AND 6 THEN 0.6 "
           "WHEN hour BETWEEN 18 AND 22 THEN 0.8 ELSE 1.0 END::DOUBLE")
FLASH = "CAST(request_count > 22 AS INT)"


@check("context_multiplier", with_(LOG, sql.simple_features(), select=(
    f"SELECT window_start, {r(CONTEXT.format(flash=FLASH))} AS context FROM sf")))
def context_multiplier(spark, sf_dir):
    rows = win.simple_window_features(log(spark, sf_dir), HOUR)
    flash = (F.col("request_count") > 22).cast("int")
    return out(rows, "window_start", policy.context(F.col("hour"), F.col("is_business_hours"), flash, F_).alias("context"))


HEALTH = "CASE WHEN {cpu} > 80 THEN greatest(0.5::DOUBLE, 1 - ({cpu} - 80) / 20.0::DOUBLE * 0.5::DOUBLE) ELSE 1.0::DOUBLE END"
CPU = f"least(100.0::DOUBLE, request_count * {d(CPU_PER_REQUEST)})"


@check("health_multiplier", with_(LOG, sql.simple_features(), select=(
    f"SELECT window_start, {r(CPU)} AS cpu_usage, {r(HEALTH.format(cpu=CPU))} AS health FROM sf")))
def health_multiplier(spark, sf_dir):
    table = win.simple_window_features(log(spark, sf_dir), HOUR)
    joined = policy.attach_metrics(table, plans.metrics_from_load(table, CPU_PER_REQUEST))
    return out(joined, "window_start", "cpu_usage", policy.health(F.col("cpu_usage"), F_).alias("health"))


PRED = clip(f"predicted / {d(F_.base_limit)}", 0.5, 2.0)


@check("prediction_score", with_(LOG, sql.simple_features(), select=(
    f"SELECT window_start, {r(PRED)} AS prediction_score, {r(f'least(2.0::DOUBLE, predicted / {d(F_.base_limit)})')} AS online_score FROM sf")))
def prediction_score(spark, sf_dir):
    from trafficlens.operators.rolling import moving_average_forecast

    rows = moving_average_forecast(win.window_aggregates(log(spark, sf_dir), HOUR, measures=()), F_.base_limit)
    return out(rows, "window_start", policy.prediction_score(F.col("predicted"), F_).alias("prediction_score"),
               policy.online_prediction_score(F.col("predicted"), F_).alias("online_score"))


HEAVY = """tops AS (SELECT window_no, max(user_requests * 10 + is_bot) AS top, max(total_requests) AS total_requests FROM sh GROUP BY 1),
heavy AS (SELECT window_no, top // 10 AS user_requests, top % 10 AS user_is_bot, total_requests FROM tops)"""
FULL_CTES = (
    *SUSPICION, sql.simple_features(), SHARES, HEAVY,
    "risk AS (SELECT t // 3600000000 AS window_no, max(score) AS behavioral_risk FROM sus GROUP BY 1)",
    f"""fi AS (
  SELECT sf.*, {LADDER.format(x=f'(request_count / {d(F_.base_limit)})')} AS anomaly_score, {CPU} AS cpu_usage,
         coalesce(user_requests, 1) AS user_requests, coalesce(user_is_bot, 0) AS user_is_bot,
         coalesce(total_requests, 1) AS total_requests, coalesce(behavioral_risk, 0) AS behavioral_risk
  FROM sf LEFT JOIN heavy USING (window_no) LEFT JOIN risk USING (window_no)),
fs AS (
  SELECT *, {PRED} AS p, {FAIR.format(share='user_requests::DOUBLE / total_requests', err='error_rate', bot='user_is_bot')} AS f,
         {CONTEXT.format(flash='0')} AS c, {HEALTH.format(cpu='cpu_usage')} AS h FROM fi),
fe AS (SELECT *, 0.6::DOUBLE * p + 0.4::DOUBLE * ((1 - anomaly_score) * (1 - behavioral_risk)) AS ensemble_score FROM fs),
fr AS (SELECT *, {d(F_.base_limit)} * ensemble_score * f * c * h AS raw_limit FROM fe)""",
)
CONFIDENCE = clip("0.3::DOUBLE * greatest(anomaly_score, 1 - anomaly_score) + 0.25::DOUBLE * (1 - abs(p - 1)) "
                  "+ 0.25::DOUBLE * (1 - abs(f - 1)) + 0.2::DOUBLE * greatest(behavioral_risk, 1 - behavioral_risk)", 0, 1)


def full_rows(spark, sf_dir):
    requests = log(spark, sf_dir)
    table = win.window_aggregates(requests, HOUR, measures=())
    metrics = plans.metrics_from_load(table, CPU_PER_REQUEST)
    return plans.full_inputs(requests, metrics, HOUR, F_, DAY)


@check("ensemble_score", with_(*FULL_CTES, select=f"SELECT window_start, {r('ensemble_score')} AS ensemble_score FROM fe"))
def ensemble_score(spark, sf_dir):
    return out(policy.full_factors(full_rows(spark, sf_dir), F_), "window_start", "ensemble_score")


@check("raw_limit", with_(*FULL_CTES, select=f"SELECT window_start, {r('raw_limit')} AS raw_limit FROM fr"))
def raw_limit(spark, sf_dir):
    return out(policy.full_factors(full_rows(spark, sf_dir), F_), "window_start", "raw_limit")


@check("decision_confidence", with_(*FULL_CTES, select=f"SELECT window_start, {r(CONFIDENCE)} AS confidence FROM fr"))
def decision_confidence(spark, sf_dir):
    rows = policy.full_factors(full_rows(spark, sf_dir), F_)
    return out(rows, "window_start", policy.confidence(
        F.col("prediction_score"), F.col("anomaly_score"), F.col("fairness_multiplier"),
        F.col("behavioral_risk")).alias("confidence"))


FULL_REASON = """CASE WHEN request_count < rate_limit THEN 'Allowed: Within adaptive rate limit'
  WHEN behavioral_risk > 0.8 THEN 'Blocked: Bot pattern detected across endpoints'
  WHEN anomaly_score > 0.7 THEN 'Blocked: High anomaly score (suspected attack)'
  WHEN request_count > rate_limit * 1.5 THEN 'Blocked: Excessive traffic rate'
  ELSE 'Blocked: Rate ' || request_count || ' exceeds limit ' || rate_limit END"""
FULL_DECIDED = (*FULL_CTES, fold("fr", "raw_limit", F_))


@check("decision_reason", with_(*FULL_DECIDED, select=(
    f"SELECT window_start, rate_limit, {FULL_REASON} AS reason FROM fr JOIN lim USING (pos)"), recursive=True))
def decision_reason(spark, sf_dir):
    return out(policy.full_decisions(full_rows(spark, sf_dir), F_), "window_start", "rate_limit", "reason")


@check("full_window_decisions", with_(*FULL_DECIDED, select=(
    f"SELECT window_start, request_count, {r('anomaly_score')} AS anomaly_score, {r('behavioral_risk')} AS behavioral_risk, "
    f"{r('f')} AS fairness_multiplier, {r('raw_limit')} AS raw_limit, rate_limit, request_count < rate_limit AS allow, "
    f"{r(CONFIDENCE)} AS confidence, {FULL_REASON} AS reason FROM fr JOIN lim USING (pos)"), recursive=True))
def full_window_decisions(spark, sf_dir):
    return out(policy.full_decisions(full_rows(spark, sf_dir), F_), "window_start", "request_count", "anomaly_score",
               "behavioral_risk", "fairness_multiplier", "raw_limit", "rate_limit", "allow", "confidence", "reason")


O = ONLINE_RULES
ONLINE = (LOG, sql.simple_features(), SHARES, HEAVY, f"""oi AS (
  SELECT sf.* REPLACE (request_count::DOUBLE / unique_ips AS ip_concentration), user_requests AS user_request_count
  FROM sf LEFT JOIN heavy USING (window_no)),
os AS (SELECT *, {add_score((f"request_count > {d(O.request_count)}", 0.3), (f"ip_concentration > {d(O.ip_concentration)}", 0.3),
                            (f"error_rate > {d(O.error_rate)}", 0.2), (f"user_request_count > {d(O.user_request_count)}", 0.2))} AS anomaly_score FROM oi),
orw AS (SELECT *, {d(SIMPLE_LIMITS.base_limit)} * (0.6::DOUBLE * least(2.0::DOUBLE, request_count / {d(SIMPLE_LIMITS.base_limit)})
        + 0.4::DOUBLE * (1 - anomaly_score)) * CASE WHEN is_business_hours = 1 THEN 1.2 ELSE 0.8 END::DOUBLE AS raw_limit FROM os)""",
          fold("orw", "raw_limit", SIMPLE_LIMITS))


@check("online_window_decisions", with_(*ONLINE, select=(
    f"""SELECT window_start, {r('anomaly_score')} AS anomaly_score, {r('raw_limit')} AS raw_limit, rate_limit,
  request_count < rate_limit AS allow, CASE WHEN request_count < rate_limit THEN 'Traffic within normal limits'
    WHEN anomaly_score > 0.7 THEN 'High anomaly score (' || {two('anomaly_score')} || ') - suspected attack'
    WHEN request_count > rate_limit * 1.5 THEN 'Excessive traffic rate (' || request_count || ' req/min)'
    ELSE 'Rate ' || request_count || ' exceeds adaptive limit ' || rate_limit END AS reason
FROM orw JOIN lim USING (pos)"""), recursive=True))
def online_window_decisions(spark, sf_dir):
    rows = plans.online_window_decisions(log(spark, sf_dir), HOUR, SIMPLE_LIMITS, ONLINE_RULES)
    return out(rows, "window_start", "anomaly_score", "raw_limit", "rate_limit", "allow", "reason")


@check("persistence_forecast", with_(LOG, sql.windows(), select=(
    f"SELECT window_start, {r('request_count')} AS plain, {r('request_count * 1.1::DOUBLE')} AS with_model FROM wf")))
def persistence_forecast(spark, sf_dir):
    rows = win.window_aggregates(log(spark, sf_dir), HOUR, measures=())
    n = F.col("request_count")
    return out(rows, "window_start", fc.persistence(n).alias("plain"), fc.persistence(n, True).alias("with_model"))


# --- explanations -----------------------------------------------------------------------------------------

EXPLAIN = list(EXPLAIN_FEATURES)
VECTOR = "[request_count::DOUBLE, unique_ips::DOUBLE, error_rate, round(avg_response_time, 6), spike_ratio, ip_concentration]"
# a deterministic stand-in for model attributions: relative size of each value
WEIGHTS = "list_transform(v, lambda x: x / (1 + list_sum(v)))"
REASONS = ("CASE {n} WHEN 'requests_per_minute' THEN 'Abnormally high request rate' WHEN 'unique_ips' THEN 'Suspicious IP distribution' "
           "WHEN 'error_rate' THEN 'High error rate indicates probing' WHEN 'avg_response_time' THEN 'Response time degradation detected' "
           "WHEN 'spike_ratio' THEN 'Sudden traffic spike detected' WHEN 'ip_concentration' THEN 'Traffic concentrated from few IPs' "
           "WHEN 'request_variance' THEN 'Irregular request pattern' ELSE 'Anomalous behavior detected' END")
RECOMMEND = """CASE WHEN allow THEN 'Request pattern is normal. No action needed.'
  WHEN anomaly_score > 0.8 THEN 'Strong attack signature detected. Consider blacklisting this IP.'
  WHEN anomaly_score > 0.5 THEN 'Suspicious behavior detected. User should reduce request rate.'
  ELSE 'Minor anomaly detected. User should verify they''re not exceeding limits.' END"""
EXPLAINED = (LOG, DECISIONS, f"""v0 AS (SELECT *, {VECTOR} AS v FROM dec), v1 AS (SELECT *, {WEIGHTS} AS w FROM v0),
lf AS (
  SELECT pos, i, {EXPLAIN!r}[i] AS name, w[i] AS importance, {EXPLAIN!r}[i] || ': ' || {two('v[i]')} AS factor,
         row_number() OVER (PARTITION BY pos ORDER BY w[i] DESC, i) AS rank
  FROM v1, range(1, 7) t(i)),
best AS (
  SELECT pos, max(CASE WHEN rank = 1 THEN name END) AS top_name, max(CASE WHEN rank = 1 THEN factor END) AS f1,
         max(CASE WHEN rank = 2 THEN factor END) AS f2, max(CASE WHEN rank = 3 THEN factor END) AS f3,
         max(CASE WHEN rank = 1 THEN importance END) AS i1, max(CASE WHEN rank = 2 THEN importance END) AS i2,
         max(CASE WHEN rank = 3 THEN importance END) AS i3 FROM lf GROUP BY 1),
xp AS (SELECT v1.*, best.*, {REASONS.format(n='top_name')} AS primary_reason, {RECOMMEND} AS recommendation,
         CASE WHEN allow THEN 'ALLOWED' ELSE 'BLOCKED' END AS decision, strftime(window_start, '%Y-%m-%dT%H:%M:%S') AS stamp
       FROM v1 JOIN best USING (pos))""")


def explained(spark, sf_dir):
    rows = decisions(spark, sf_dir).withColumns({
        "requests_per_minute": F.col("request_count"), "avg_response_time": F.round("avg_response_time", 6)})
    vector = ex.explain_vector(rows)
    total = F.aggregate("explain_vector", F.lit(0.0), lambda a, x: a + x)
    weights = F.transform("explain_vector", lambda x: x / (F.lit(1.0) + total))
    return ex.explain(vector, weights)


@check("explain_vector", with_(LOG, DECISIONS, select=(
    f"SELECT window_start, {r('request_count')} AS requests_per_minute, {r('unique_ips')} AS unique_ips, {r('error_rate')} AS error_rate, "
    f"{r('avg_response_time')} AS avg_response_time, {r('1')} AS spike_ratio, {r('ip_concentration')} AS ip_concentration FROM dec"), recursive=True))
def explain_vector(spark, sf_dir):
    """The spike ratio is left out on purpose: its default applies."""
    rows = decisions(spark, sf_dir).withColumn("requests_per_minute", F.col("request_count")).drop("spike_ratio")
    v = ex.explain_vector(rows)
    return out(v, "window_start", *[F.col("explain_vector")[i].alias(n) for i, n in enumerate(EXPLAIN)])


@check("primary_reason", with_(*EXPLAINED, select="SELECT window_start, f1 AS factor, primary_reason FROM xp", recursive=True))
def primary_reason(spark, sf_dir):
    e = explained(spark, sf_dir)
    return out(e, "window_start", F.col("explanation.contributing_factors")[0].factor.alias("factor"),
               F.col("explanation.primary_reason").alias("primary_reason"))


@check("recommendation", decided(f"window_start, {RECOMMEND} AS recommendation"))
def recommendation(spark, sf_dir):
    return out(decisions(spark, sf_dir), "window_start",
               ex.recommendation(~F.col("allow"), F.col("anomaly_score")).alias("recommendation"))


@check("explained_decisions", with_(*EXPLAINED, select=(
    f"SELECT window_start, decision, {r('anomaly_score')} AS confidence, rate_limit AS adaptive_limit, primary_reason, "
    f"f1 || '|' || f2 || '|' || f3 AS factors, {r('i1')} AS top_importance, recommendation, stamp AS timestamp FROM xp"), recursive=True))
def explained_decisions(spark, sf_dir):
    e, x = explained(spark, sf_dir), F.col("explanation")
    return out(e, "window_start", x.decision.alias("decision"), x.confidence.alias("confidence"),
               x.adaptive_limit.alias("adaptive_limit"), x.primary_reason.alias("primary_reason"),
               F.array_join(F.transform(x.contributing_factors, lambda f: f.factor), "|").alias("factors"),
               x.contributing_factors[0].importance.alias("top_importance"), x.recommendation.alias("recommendation"),
               x.timestamp.alias("timestamp"))


AUDIT = f"""chr(10) || '[' || stamp || '] RATE LIMIT DECISION' || chr(10) || 'Decision: ' || decision || chr(10)
  || 'Confidence: ' || {two('anomaly_score * 100')} || '%' || chr(10) || 'Adaptive Limit: ' || rate_limit || ' req/min' || chr(10) || chr(10)
  || 'PRIMARY REASON: ' || primary_reason || chr(10) || chr(10) || 'CONTRIBUTING FACTORS:' || chr(10)
  || '  - ' || f1 || ' (importance: ' || {two('i1 * 100')} || '%)' || chr(10) || '  - ' || f2 || ' (importance: ' || {two('i2 * 100')} || '%)' || chr(10)
  || '  - ' || f3 || ' (importance: ' || {two('i3 * 100')} || '%)' || chr(10)
  || chr(10) || 'RECOMMENDATION: ' || recommendation || chr(10) || repeat('=', 60) || chr(10)"""


@check("audit_log", with_(*EXPLAINED, f"a AS (SELECT unnest(string_split({AUDIT}, chr(10))) AS line FROM xp)", select=(
    "SELECT line, count(*) AS n FROM a WHERE line <> '' GROUP BY 1"), recursive=True))
def audit_log(spark, sf_dir):
    """Audit text appended to files in two runs, read back line by line."""
    rows, path = explained(spark, sf_dir), shared_dir(spark, "audit")
    for part in (F.col("allow"), ~F.col("allow")):
        tables.append_audit(rows.where(part), ex.audit_text(), path)
    lines = spark.read.text(path).where(F.col("value") != "")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


# --- feedback -----------------------------------------------------------------------------------------

def fed(cols: str, *ctes: str, source: str = "rw") -> str:
    return with_(LOG, FEEDBACK, *ctes, select=f"SELECT {cols} FROM {source}", recursive=True)


@check("decision_outcomes", fed("request_id, type, actual_label, predicted_label"))
def decision_outcomes(spark, sf_dir):
    return feedback(spark, sf_dir).select("request_id", "type", "actual_label", "predicted_label")


@check("feedback_join", with_(LOG, FEEDBACK, select=(
    f"SELECT fb.request_id, fb.type, dec.rate_limit, {r('dec.anomaly_score')} AS anomaly_score FROM fb LEFT JOIN dec ON fb.ts = dec.window_start"),
    recursive=True))
def feedback_join(spark, sf_dir):
    made = with_ids(decisions(spark, sf_dir)).select("request_id", "rate_limit", "anomaly_score")
    return out(fb.join_decisions(feedback(spark, sf_dir), made), "request_id", "type", "rate_limit", "anomaly_score")


@check("feedback_reward", fed(f"request_id, type, {r('cpu_usage')} AS cpu_usage, {r('reward')} AS reward"))
def feedback_reward(spark, sf_dir):
    rows = fb.with_reward(feedback(spark, sf_dir), F_)
    return out(rows, "request_id", "type", F.col("system_metrics.cpu_usage").alias("cpu_usage"), "reward")


MOVED = ("sum(0.01::DOUBLE * abs(reward) * CASE type WHEN 'false_negative' THEN 1 WHEN 'false_positive' THEN -1 ELSE 0 END) "
         "OVER (ORDER BY ts, request_id)")


@check("weight_trajectory", fed(
    f"request_id, {r(f'0.4::DOUBLE + {MOVED}')} AS anomaly_weight, {r(f'0.6::DOUBLE - ({MOVED})')} AS forecast_weight"))
def weight_trajectory(spark, sf_dir):
    return out(fb.weight_trajectory(feedback(spark, sf_dir), F_), "request_id", "anomaly_weight", "forecast_weight")


CLAMPED = """nf AS (SELECT *, row_number() OVER (ORDER BY ts, request_id) AS rn FROM fb),
cw AS (
  SELECT rn, CASE type WHEN 'false_negative' THEN least(0.8::DOUBLE, 0.4::DOUBLE + 0.05::DOUBLE)
                       WHEN 'false_positive' THEN greatest(0.2::DOUBLE, 0.4::DOUBLE - 0.05::DOUBLE) ELSE 0.4::DOUBLE END AS w
  FROM nf WHERE rn = 1
  UNION ALL
  SELECT nf.rn, CASE type WHEN 'false_negative' THEN least(0.8::DOUBLE, w + 0.05::DOUBLE)
                          WHEN 'false_positive' THEN greatest(0.2::DOUBLE, w - 0.05::DOUBLE) ELSE w END
  FROM cw JOIN nf ON nf.rn = cw.rn + 1)"""


@check("clamped_weight_trajectory", fed(
    f"request_id, {r('w')} AS anomaly_weight, {r('1 - w')} AS forecast_weight", CLAMPED, source="nf JOIN cw USING (rn)"))
def clamped_weight_trajectory(spark, sf_dir):
    return out(fb.clamped_weight_trajectory(feedback(spark, sf_dir), F_), "request_id", "anomaly_weight", "forecast_weight")


STRESS = ("((greatest(0.0::DOUBLE, (cpu_usage - 50) / 50) + greatest(0.0::DOUBLE, (rt - 200) / 500)) / 2)")


@check("stress_adjustment", with_(LOG, FEEDBACK, f"st AS (SELECT fb.request_id, {STRESS} AS stress, rate_limit FROM fb JOIN dec ON fb.ts = dec.window_start)", select=(
    f"SELECT request_id, {r('stress')} AS stress, CASE WHEN stress > 0.5 THEN greatest({LOW}, trunc(rate_limit * (1 - stress * 0.5::DOUBLE))::BIGINT) "
    "ELSE rate_limit END AS adjusted FROM st"), recursive=True))
def stress_adjustment(spark, sf_dir):
    made = with_ids(decisions(spark, sf_dir)).select("request_id", "rate_limit")
    rows = fb.join_decisions(feedback(spark, sf_dir), made)
    stress = fb.stress_level(F.col("system_metrics.cpu_usage"), F.col("system_metrics.avg_response_time"))
    return out(rows, "request_id", stress.alias("stress"),
               fb.stress_adjusted(F.col("rate_limit"), stress, SIMPLE_LIMITS).alias("adjusted"))


COUNTS = ("c AS (SELECT count(*) FILTER (type = 'true_positive') AS tp, count(*) FILTER (type = 'true_negative') AS tn, "
          "count(*) FILTER (type = 'false_positive') AS fp, count(*) FILTER (type = 'false_negative') AS fn FROM fb)")


@check("learning_stats", fed(
    f"tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp + tn + fp + fn AS total_decisions, "
    f"{r('(tp + tn)::DOUBLE / (tp + tn + fp + fn)')} AS accuracy, {r('tp / (tp + fp + 1e-10::DOUBLE)')} AS precision, "
    f"{r('tp / (tp + fn + 1e-10::DOUBLE)')} AS recall", COUNTS, source="c"))
def learning_stats(spark, sf_dir):
    return out(fb.learning_stats(feedback(spark, sf_dir)))


@check("performance_summary", fed(
    f"tp + tn + fp + fn AS total_decisions, fp AS false_positives, fn AS false_negatives, "
    f"{r('fp::DOUBLE / (tp + tn + fp + fn)')} AS false_positive_rate, {r('fn::DOUBLE / (tp + tn + fp + fn)')} AS false_negative_rate",
    COUNTS, source="c"))
def performance_summary(spark, sf_dir):
    return out(fb.performance_summary(feedback(spark, sf_dir)))


@check("engine_state_snapshot", with_(LOG, FEEDBACK, select=(
    f"(SELECT 'decision' AS kind, window_no::VARCHAR AS id, recency, {r('rate_limit')} AS value FROM (SELECT *, row_number() OVER (ORDER BY window_no DESC) AS recency FROM dec) WHERE recency <= 500) UNION ALL "
    f"(SELECT 'feedback', request_id, recency, {r('w')} FROM (SELECT request_id, row_number() OVER (ORDER BY ts DESC, request_id DESC) AS recency, 0.4::DOUBLE + {MOVED} AS w FROM rw) WHERE recency <= 100)"), recursive=True))
def engine_state_snapshot(spark, sf_dir):
    path = shared_dir(spark, "state")
    weights = fb.weight_trajectory(feedback(spark, sf_dir), F_)
    tables.save_state(decisions(spark, sf_dir), weights, path, keep_decisions=500)
    state = tables.load_state(spark, path)
    recency = F.col("recency").cast("bigint").alias("recency")
    kept = state["decisions"].select(F.lit("decision").alias("kind"), F.col("window_no").cast("string").alias("id"),
                                     recency, F.col("rate_limit").cast("double").alias("value"))
    learned = state["feedback"].select(F.lit("feedback").alias("kind"), F.col("request_id").alias("id"), recency,
                                       F.col("anomaly_weight").alias("value"))
    return out(kept.unionByName(learned))
