"""Checks of decisions that trained models feed: a fixed forest and a one-lag forecaster."""

from __future__ import annotations

from trafficlens.operators import forecast as fc, policy, windows as win
from trafficlens.operators.scaling import ScalerModel
from trafficlens.plans import decisions as plans
from trafficlens.plans.training import TrainedModels

from .fixture import CPU_PER_REQUEST, DAY, FULL_LIMITS, HOUR, log, out
from .forest_walk import NAMES, ONE_LAG, SCORED, model
from .models import counts
from .policy_checks import CONFIDENCE, CONTEXT, FAIR, FULL_CTES, FULL_REASON, HEALTH, PRED
from .registry import check
from .sql import d, fold, r, with_

# the forest's CTEs under names that the full formula does not use
FOREST = SCORED.replace("fs AS", "wt AS").replace("FROM fs)", "FROM wt)").replace("fp AS", "wp AS")
SCORES = f"""mi AS (
  SELECT fi.* REPLACE (prob AS anomaly_score, greatest(0.0::DOUBLE, icpt + slope * coalesce(prev, 0)) AS predicted)
  FROM fi JOIN wp ON wp.window_no = fi.window_no JOIN pv ON pv.window_no = fi.window_no, cf),
ms AS (
  SELECT *, {PRED} AS p, {FAIR.format(share='user_requests::DOUBLE / total_requests', err='error_rate', bot='user_is_bot')} AS f,
         {CONTEXT.format(flash='0')} AS c, {HEALTH.format(cpu='cpu_usage')} AS h FROM mi),
mr AS (SELECT *, {d(FULL_LIMITS.base_limit)} * (0.6::DOUBLE * p + 0.4::DOUBLE * ((1 - anomaly_score) * (1 - behavioral_risk))) * f * c * h AS raw_limit FROM ms)"""


def models(spark, sf_dir) -> TrainedModels:
    same = ScalerModel(tuple(NAMES), (0.0,) * len(NAMES), (1.0,) * len(NAMES))
    forecaster = fc.LagRegression.fit(fc.lag_sequences(counts(spark, sf_dir), 1), 1, reg=0.0)
    return TrainedModels(same, model(spark), forecaster)


@check("decisions_trained_models", with_(*FULL_CTES, FOREST, ONE_LAG, SCORES, fold("mr", "raw_limit", FULL_LIMITS), select=(
    f"SELECT window_start, {r('anomaly_score')} AS anomaly_score, {r('predicted')} AS predicted, {r('raw_limit + 1e-9::DOUBLE')} AS raw_limit, "
    f"rate_limit, request_count < rate_limit AS allow, {r(CONFIDENCE)} AS confidence, {FULL_REASON} AS reason FROM mr JOIN lim USING (pos)"),
    recursive=True))
def decisions_trained_models(spark, sf_dir):
    """The full formula with a forecaster's predictions and a forest's probabilities."""
    requests = log(spark, sf_dir)
    metrics = plans.metrics_from_load(win.window_aggregates(requests, HOUR, measures=()), CPU_PER_REQUEST)
    rows = plans.full_inputs(requests, metrics, HOUR, FULL_LIMITS, DAY, models(spark, sf_dir))
    decided = policy.full_decisions(rows, FULL_LIMITS)
    return out(decided, "window_start", "anomaly_score", "predicted", (decided.raw_limit + 1e-9).alias("raw_limit"), "rate_limit",
               "allow", "confidence", "reason")
