"""Resumed runs and point-in-time joins, against one run over everything and brute force."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trafficlens.config import HeuristicConfig, LimitConfig
from trafficlens.functions.chunks import as_of
from trafficlens.functions.fold import limit_trajectory
from trafficlens.operators import feedback as fb, policy
from trafficlens.plans import decisions, resume
from trafficlens.session import shared_dir
from trafficlens.sources import tables

LIMITS, RULES = LimitConfig(base_limit=6, min_limit=2, max_limit=20, alpha=0.3), HeuristicConfig(request_count=4)
NAMES = ["series_key", "window_no", "pos", "request_count", "spike_ratio", "rate_limit", "allow", "reason"]


def run(log):
    return decisions.window_decisions(log, 60, LIMITS, RULES)


def no_feedback(spark):
    return spark.createDataFrame([], "policy_key string, ts timestamp, request_id long, anomaly_weight double")


def saved(spark, rows, weights=None):
    path = shared_dir(spark, "state")
    tables.save_state(rows, no_feedback(spark) if weights is None else weights, path)
    return tables.load_state(spark, path)


def test_three_runs_equal_one(spark, make_log):
    """Series that pause over a run, begin late or send late requests."""
    rng = random.Random(6)
    rows = [(rng.random() * 3000, f"u{rng.randint(0, 3)}", "/a", {}) for _ in range(400)]
    log = make_log(rows).withColumn("series_key", F.when(F.col("request_id") % 5 > 0, "hot").when(
        F.unix_timestamp("ts") - 1704067200 < 2000, F.when(F.unix_timestamp("ts") - 1704067200 < 900, "pausing").otherwise("hot")).otherwise("pausing"))
    log = log.withColumn("series_key", F.when((F.col("request_id") % 7 == 0) & (F.unix_timestamp("ts") - 1704067200 >= 1800), "late")
                         .otherwise(F.col("series_key")))
    whole = Counter(map(tuple, run(log).select(*NAMES).collect()))
    second = F.unix_timestamp("ts") - 1704067200
    parts = [log.where(second < 960), log.where((second >= 960) & (second < 1980)), log.where(second >= 1980)]
    made = run(parts[0])
    got, state = Counter(map(tuple, made.select(*NAMES).collect())), saved(spark, made)
    for part in parts[1:]:
        # requests of windows that were decided already come again, too
        more = resume.resumed_window_decisions(part.union(parts[0].where(F.col("series_key") == "hot")), state, 60, LIMITS, RULES)
        got += Counter(map(tuple, more.select(*NAMES).collect()))
        kept = state["decisions"].drop("recency").unionByName(more)
        state = saved(spark, kept)
    # a run ends each series at its last request, so one that pauses gets its empty windows from the run that sees it again
    assert got == whole


def test_a_saved_limit_outside_new_bounds_is_brought_inside(spark):
    rows = spark.createDataFrame([("a", 0, 10.0), ("b", 0, 10.0), ("c", 0, 10.0)], "k string, pos long, raw double")
    starts = spark.createDataFrame([("a", 500), ("b", 1)], "k string, limit long")
    got = {r.k: r.rate_limit for r in limit_trajectory(rows, "k", "pos", "raw", start=7, alpha=0.5, low=4, high=20, starts=starts).collect()}
    assert got == {"a": 15, "b": 7, "c": 8}


def test_as_of_equals_brute_force(spark):
    """One hot policy, ties in time, rows before any weight, slices without rows."""
    rng, start = random.Random(11), datetime(2024, 1, 1)
    weights = [(rng.choice(["hot"] * 9 + ["cold"]), start + timedelta(seconds=rng.randrange(500, 90_000, 50)), k, k / 7) for k in range(300)]
    rows = [(rng.choice(["hot"] * 9 + ["cold", "none"]), start + timedelta(seconds=rng.randrange(0, 200_000, 25)), k) for k in range(900)]
    right = spark.createDataFrame(weights, "key string, ts timestamp, request_id long, w double")
    left = spark.createDataFrame(rows, "key string, at timestamp, id long")
    want = []
    for key, at, i in rows:
        known = [(t, k, w) for own, t, k, w in weights if own == key and t <= at]
        want.append((key, at, i, max(known)[2] if known else None))
    for seconds in (700, 3600, 10**6):
        got = as_of(left, right, ["key"], "at", "ts", ["w"], order=("request_id",), seconds=seconds)
        assert got.columns == ["key", "at", "id", "w"] and Counter(map(tuple, got.collect())) == Counter(want)


def test_weights_go_on(spark):
    rng = random.Random(3)
    kinds = ["false_negative", "false_positive", "true_negative"]
    rows = [(f"p{rng.randint(0, 2)}", datetime(2024, 1, 1) + timedelta(minutes=k), k, rng.choice(kinds)) for k in range(200)]
    events = spark.createDataFrame(rows, "policy_key string, ts timestamp, request_id long, type string").withColumn(
        "system_metrics", F.struct(F.lit(90.0).alias("cpu_usage"), F.lit(100.0).alias("avg_response_time")))
    for clamped in (True, False):
        learn = fb.clamped_weight_trajectory if clamped else fb.weight_trajectory
        first = learn(events.where("request_id < 120"))
        state = saved(spark, spark.createDataFrame([("p0", 0)], "series_key string, window_no long"), first)
        both = first.union(resume.resumed_weights(events, state, clamped=clamped))
        got, want = ({r.request_id: (round(r.anomaly_weight, 9), round(r.forecast_weight, 9)) for r in x.collect()} for x in (both, learn(events)))
        assert got == want and len(got) == 200


def test_decisions_take_the_weights_of_their_time(spark, make_log):
    log = make_log([(60.0 * k, "u", "/a") for k in range(4)])
    table = decisions.online_inputs(log, 60)
    weights = spark.createDataFrame([("all", datetime(2024, 1, 1, 0, 1), 1, 0.1, 0.9), ("all", datetime(2024, 1, 1, 0, 2), 2, 0.7, 0.3)],
                                    "policy_key string, ts timestamp, request_id long, forecast_weight double, anomaly_weight double")
    rows = policy.online_decisions(policy.learned_weights(table, weights), LIMITS).orderBy("pos").collect()
    assert [r.anomaly_weight for r in rows] == [None, 0.9, 0.3, 0.3]
    p, s = rows[0].prediction_score, 1 - rows[0].anomaly_score
    assert [round(r.ensemble_score, 9) for r in rows] == [round(x, 9) for x in (
        LIMITS.forecast_weight * p + LIMITS.anomaly_weight * s, 0.1 * p + 0.9 * s, 0.7 * p + 0.3 * s, 0.7 * p + 0.3 * s)]
