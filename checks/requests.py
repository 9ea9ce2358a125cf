"""Checks of decisions per request."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.plans import requests

from .behaviour import LADDER, ONLINE_SCORE, SUSPICION, TRAIL
from .fixture import DAY, FULL_LIMITS, ONLINE_RULES, SIMPLE_LIMITS, TRAILING, log, out
from .policy_checks import CONFIDENCE, CONTEXT, FAIR, FULL_REASON, PRED
from .registry import check
from .sql import LOG, d, fold, r, two, with_

ORDER = "(row_number() OVER (ORDER BY ts, request_id) - 1)::BIGINT AS pos"
ONLINE = (LOG, TRAIL, f"""os AS (SELECT *, {ONLINE_SCORE} AS anomaly_score, {ORDER} FROM tr),
orw AS (SELECT *, {d(SIMPLE_LIMITS.base_limit)} * (0.6::DOUBLE * least(2.0::DOUBLE, request_count / {d(SIMPLE_LIMITS.base_limit)})
        + 0.4::DOUBLE * (1 - anomaly_score)) * CASE WHEN is_business_hours = 1 THEN 1.2 ELSE 0.8 END::DOUBLE AS raw_limit FROM os)""",
          fold("orw", "raw_limit", SIMPLE_LIMITS))


@check("request_decisions_online", with_(*ONLINE, select=(
    f"""SELECT request_id, request_count, {r('anomaly_score')} AS anomaly_score, {r('raw_limit')} AS raw_limit, rate_limit,
  request_count < rate_limit AS allow, CASE WHEN request_count < rate_limit THEN 'Traffic within normal limits'
    WHEN anomaly_score > 0.7 THEN 'High anomaly score (' || {two('anomaly_score')} || ') - suspected attack'
    WHEN request_count > rate_limit * 1.5 THEN 'Excessive traffic rate (' || request_count || ' req/min)'
    ELSE 'Rate ' || request_count || ' exceeds adaptive limit ' || rate_limit END AS reason
FROM orw JOIN lim USING (pos)"""), recursive=True))
def request_decisions_online(spark, sf_dir):
    slim = log(spark, sf_dir).select(*requests.ONLINE_COLUMNS)
    rows = requests.online_request_decisions(slim, TRAILING, SIMPLE_LIMITS, ONLINE_RULES)
    return out(rows, "request_id", "request_count", "anomaly_score", "raw_limit", "rate_limit", "allow", "reason")


# raw limits that end in a tie at the last place are nudged alike on both sides
FULL = (*SUSPICION, TRAIL, f"""fi AS (
  SELECT tr.*, is_bot AS user_is_bot, score AS behavioral_risk, request_count::DOUBLE AS predicted,
         {LADDER.format(x=f'(request_count / {d(FULL_LIMITS.base_limit)})')} AS anomaly_score,
         (row_number() OVER (ORDER BY tr.ts, tr.request_id) - 1)::BIGINT AS pos
  FROM tr JOIN (SELECT request_id, is_bot, score FROM sus) USING (request_id)),
fs AS (
  SELECT *, {PRED} AS p, {FAIR.format(share='user_request_count::DOUBLE / request_count', err='error_rate', bot='user_is_bot')} AS f,
         {CONTEXT.format(flash='0')} AS c FROM fi),
fr AS (SELECT *, {d(FULL_LIMITS.base_limit)} * (0.6::DOUBLE * p + 0.4::DOUBLE * ((1 - anomaly_score) * (1 - behavioral_risk))) * f * c AS raw_limit FROM fs)""",
        fold("fr", "raw_limit", FULL_LIMITS))


@check("request_decisions_full", with_(*FULL, select=(
    f"SELECT request_id, request_count, {r('anomaly_score')} AS anomaly_score, {r('behavioral_risk')} AS behavioral_risk, "
    f"{r('f')} AS fairness_multiplier, {r('raw_limit + 1e-9::DOUBLE')} AS raw_limit, rate_limit, request_count < rate_limit AS allow, "
    f"{r(CONFIDENCE)} AS confidence, {FULL_REASON} AS reason FROM fr JOIN lim USING (pos)"), recursive=True))
def request_decisions_full(spark, sf_dir):
    rows = requests.full_request_decisions(log(spark, sf_dir), TRAILING, FULL_LIMITS, DAY)
    return out(rows, "request_id", "request_count", "anomaly_score", "behavioral_risk", "fairness_multiplier",
               (F.col("raw_limit") + 1e-9).alias("raw_limit"), "rate_limit", "allow", "confidence", "reason")
