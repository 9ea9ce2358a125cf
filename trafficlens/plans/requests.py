"""A decision for every request, from the window that trails it and its own user."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import FULL, ONLINE, BehaviorConfig, LimitConfig, OnlineHeuristicConfig
from ..functions.chunks import CHUNK, running_sum
from ..functions.columns import floor_div, micros
from ..operators import behavior, heuristics, policy
from ..operators.trailing import trailing_features
from ..operators.windows import POS, SERIES

US = 1_000_000
#: Levels of the limit fold: chunks of 4,096 requests, twice composed by 1,024.
LEVELS = 2
#: Columns of a log that the online decision of a request reads; others travel along to the result.
ONLINE_COLUMNS = ("request_id", "ts", "user_id", "ip", "status_code", "response_time")


def in_order(rows: DataFrame, seconds: int) -> DataFrame:
    """Add ``pos``: the place of a request in its series, by time and id.

    Counted over slices of ``seconds``, so no task orders a whole series.
    """
    sliced = rows.withColumn(CHUNK, floor_div(micros(F.col("ts")), seconds * US))
    placed = running_sum(sliced, [SERIES], CHUNK, ["ts", "request_id"], {"_place": F.lit(1)})
    return placed.withColumn(POS, F.col("_place") - 1).drop("_place", CHUNK)


def online_request_decisions(log: DataFrame, seconds: int = 60, limits: LimitConfig = ONLINE,
                             rules: OnlineHeuristicConfig = OnlineHeuristicConfig(), *,
                             max_rows: int | None = None) -> DataFrame:
    """The online formula per request: the trailing window's load stands for the forecast.

    The limit of a request smooths that of the request before it.
    """
    rows = in_order(trailing_features(log, seconds, max_rows=max_rows), seconds)
    scored = rows.withColumn("anomaly_score", heuristics.online_score(rules)).withColumn(
        "predicted", F.col("request_count").cast("double"))
    return policy.online_decisions(scored, limits, levels=LEVELS)


def full_request_inputs(log: DataFrame, seconds: int, limits: LimitConfig = FULL,
                        cfg: BehaviorConfig = BehaviorConfig()) -> DataFrame:
    """Everything the full formula reads, per request: its own user's share, flag and risk."""
    # the risk travels with its request, so that repeated and missing ids need no join
    scored = behavior.suspicion(log, cfg).select(*log.columns, F.col("suspicion_score").alias("behavioral_risk"))
    rows = in_order(trailing_features(scored, seconds), seconds)
    columns = set(rows.columns)
    flag = F.col("is_bot") if "is_bot" in columns else F.lit(0)
    sale = (F.col("traffic_type") == "flash_sale").cast("int") if "traffic_type" in columns else F.lit(0)
    return rows.withColumns({
        "predicted": F.col("request_count").cast("double"),
        "anomaly_score": heuristics.ratio_ladder(F.col("request_count"), limits.base_limit),
        "behavioral_risk": F.coalesce("behavioral_risk", F.lit(0.0)),
        "user_requests": F.col("user_request_count"),
        "total_requests": F.col("request_count"),
        "user_is_bot": F.coalesce(flag, F.lit(0)),
        "is_flash_sale": F.coalesce(sale, F.lit(0)),
        "cpu_usage": F.col("cpu_usage") if "cpu_usage" in columns else F.lit(None).cast("double"),
    })


def full_request_decisions(log: DataFrame, seconds: int = 60, limits: LimitConfig = FULL,
                           cfg: BehaviorConfig = BehaviorConfig()) -> DataFrame:
    """The full formula per request, with fairness and behavioural risk of the request's user.

    A ``cpu_usage`` column of the log feeds the health factor; without one the
    system counts as healthy.
    """
    return policy.full_decisions(full_request_inputs(log, seconds, limits, cfg), limits, levels=LEVELS)
