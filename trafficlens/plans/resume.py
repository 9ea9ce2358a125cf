"""Going on from saved state, so that a day's run reads that day only.

The state (see ``sources.tables``) holds the newest windows of each series with
their limits, and the newest feedback of each policy with its weights. The last
saved window is the watermark: later requests for it or an earlier one are left
out. Windows after it are decided as if the log had been read from its start:
positions count on, rolling features look back into the saved windows, and the
folds begin with the saved limits and weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import FULL, SIMPLE, HeuristicConfig, LearningConfig, LimitConfig
from ..operators import feedback as fb, heuristics, policy
from ..operators.rolling import spike_ratio_simple
from ..operators.windows import NO, POS, SERIES, simple_window_features

LOOK_BACK = 5


def last_windows(state: dict[str, DataFrame]) -> DataFrame:
    """series_key, _from (first window to decide), _first (first window of all), limit."""
    return state["decisions"].where("recency = 1").select(
        SERIES, (F.col(NO) + 1).alias("_from"), (F.col(NO) - F.col(POS)).alias("_first"), F.col("rate_limit").alias("limit"))


def resumed_window_decisions(log: DataFrame, state: dict[str, DataFrame], seconds: int = 60, limits: LimitConfig = SIMPLE,
                             rules: HeuristicConfig = HeuristicConfig()) -> DataFrame:
    """Decisions of the windows after the saved ones; series that the state does not know begin anew.

    The state has to hold the newest ``LOOK_BACK`` - 1 windows of a series at
    least, or all if there are fewer.
    """
    last = last_windows(state)
    table = simple_window_features(log, seconds, since=last.drop("limit"))
    back = state["decisions"].where(F.col("recency") < LOOK_BACK).select(
        SERIES, NO, POS, "request_count", F.lit(True).alias("_back"))
    rows = spike_ratio_simple(table.unionByName(back, allowMissingColumns=True), LOOK_BACK)
    rows = rows.where("_back is null").drop("_back")
    return policy.simple_decisions(rows, heuristics.window_score(rules), limits, rules, starts=last.select(SERIES, "limit"))


def last_weights(state: dict[str, DataFrame]) -> DataFrame:
    return state["feedback"].where("recency = 1").select(fb.POLICY, "anomaly_weight")


def resumed_weights(feedback: DataFrame, state: dict[str, DataFrame], cfg: LimitConfig = FULL,
                    learn: LearningConfig = LearningConfig(), *, clamped: bool = False) -> DataFrame:
    """Weight trajectory of new feedback; events up to the last saved one of their policy are left out."""
    seen = state["feedback"].where("recency = 1").select(fb.POLICY, F.struct("ts", "request_id").alias("_seen"))
    new = feedback.join(seen, fb.POLICY, "left").where(
        F.col("_seen").isNull() | (F.struct("ts", "request_id") > F.col("_seen"))).drop("_seen")
    path = fb.clamped_weight_trajectory if clamped else fb.weight_trajectory
    return path(new, cfg, learn, starts=last_weights(state))
