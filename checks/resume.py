"""Checks of resumed runs and of decisions with learned weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.operators import feedback as fb, policy
from trafficlens.operators.windows import START
from trafficlens.plans import decisions as plans, resume
from trafficlens.session import materialize, shared_dir
from trafficlens.sources import tables

from . import sql
from .fixture import FULL_LIMITS, HOUR, RULES, SIMPLE_LIMITS, feedback, log, out
from .policy_checks import CLAMPED, CONFIDENCE, F_, FULL_CTES, FULL_REASON, MOVED, decided, fed, full_rows
from .registry import check
from .sql import FEEDBACK, d, fold, r, with_

#: Midnight between the first and the second run.
SECOND = "2024-01-16"


@check("resumed_decisions", decided(
    f"window_start, pos, request_count, {r('spike_ratio')} AS spike_ratio, {r('anomaly_score')} AS anomaly_score, rate_limit, allow, reason"))
def resumed_decisions(spark, sf_dir):
    """One run, its state saved and loaded, and a second run on the later requests: the same rows as one run over all."""
    rows, path = log(spark, sf_dir), shared_dir(spark, "resume")
    first = materialize(plans.window_decisions(rows.where(F.col("ts") < SECOND), HOUR, SIMPLE_LIMITS, RULES), "first-run")
    tables.save_state(first, fb.weight_trajectory(feedback(spark, sf_dir), FULL_LIMITS), path)
    second = resume.resumed_window_decisions(
        rows.where(F.col("ts") >= SECOND), tables.load_state(spark, path), HOUR, SIMPLE_LIMITS, RULES)
    names = ["window_start", "pos", "request_count", "spike_ratio", "anomaly_score", "rate_limit", "allow", "reason"]
    return out(first.select(*names).union(second.select(*names)))


@check("resumed_weights", fed(
    f"nf.request_id, {r(f'w')} AS clamped_weight, {r('moved')} AS anomaly_weight", CLAMPED,
    f"mv AS (SELECT request_id, 0.4::DOUBLE + {MOVED} AS moved FROM rw)",
    source="nf JOIN cw USING (rn) JOIN mv ON mv.request_id = nf.request_id"))
def resumed_weights(spark, sf_dir):
    """Both weight paths, learned in two runs."""
    events = materialize(feedback(spark, sf_dir), "events")
    both = []
    for clamped in (True, False):
        learn = fb.clamped_weight_trajectory if clamped else fb.weight_trajectory
        path = shared_dir(spark, "resume")
        first = materialize(learn(events.where(F.col("ts") < SECOND), FULL_LIMITS), "first-run")
        tables.save_state(plans.window_decisions(log(spark, sf_dir), HOUR, SIMPLE_LIMITS, RULES), first, path)
        # the second run gets all events and leaves out those it has seen
        second = resume.resumed_weights(events, tables.load_state(spark, path), FULL_LIMITS, clamped=clamped)
        both.append(first.select("request_id", "anomaly_weight").union(second.select("request_id", "anomaly_weight")))
    return out(both[0].withColumnRenamed("anomaly_weight", "clamped_weight").join(both[1], "request_id"),
               "request_id", "clamped_weight", "anomaly_weight")


# the window and feature CTEs are those of the full formula
EVENTS = FEEDBACK.replace(sql.simple_features() + ",\n", "", 1)
LEARNED = (*FULL_CTES, EVENTS, f"""ws AS (SELECT ts, 0.4::DOUBLE + {MOVED} AS w FROM rw),
lw AS (SELECT fs.*, coalesce(ws.w, 0.4::DOUBLE) AS w FROM fs ASOF LEFT JOIN ws ON ws.ts <= fs.window_start),
lr AS (SELECT *, {d(F_.base_limit)} * ((1 - w) * p + w * ((1 - anomaly_score) * (1 - behavioral_risk))) * f * c * h AS raw_limit FROM lw)""",
           fold("lr", "raw_limit", F_, "lim2"))


@check("decisions_learned_weights", with_(*LEARNED, select=(
    f"SELECT window_start, {r('w')} AS anomaly_weight, {r('raw_limit + 1e-9::DOUBLE')} AS raw_limit, rate_limit, "
    f"request_count < rate_limit AS allow, {r(CONFIDENCE)} AS confidence, {FULL_REASON} AS reason FROM lr JOIN lim2 USING (pos)"),
    recursive=True))
def decisions_learned_weights(spark, sf_dir):
    """The full formula with the newest weights learned at or before each window."""
    path = fb.weight_trajectory(feedback(spark, sf_dir), FULL_LIMITS)
    rows = policy.full_decisions(policy.learned_weights(full_rows(spark, sf_dir), path), FULL_LIMITS)
    return out(rows, START, F.coalesce("anomaly_weight", F.lit(F_.anomaly_weight)).alias("anomaly_weight"),
               (F.col("raw_limit") + 1e-9).alias("raw_limit"), "rate_limit", "allow", "confidence", "reason")
