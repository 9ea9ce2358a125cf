"""Worked examples of the limit formula, and the folds against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from trafficlens.config import FULL, LimitConfig
from trafficlens.functions.fold import clamped_sum, limit_trajectory
from trafficlens.operators import behavior, explain, feedback as fb, heuristics, policy
from trafficlens.plans import requests
from trafficlens.sources.request_log import events_request_log

ROW = ("series_key string, window_no bigint, pos bigint, request_count bigint, predicted double, anomaly_score double, "
       "behavioral_risk double, user_requests bigint, total_requests bigint, error_rate double, user_is_bot int, "
       "hour int, is_business_hours int, is_flash_sale int, cpu_usage double")


def test_normal_then_bot_request(spark):
    rows = spark.createDataFrame([
        ("a", 0, 0, 80, 100.0, 0.1, 0.0, 50, 1000, 0.02, 0, 14, 1, 0, 20.0),
        ("a", 1, 1, 500, 100.0, 0.7, 0.7, 500, 1000, 0.8, 1, 14, 1, 0, 20.0)], ROW)
    first, second = policy.full_decisions(rows, FULL).orderBy("pos").collect()
    assert (first.rate_limit, first.allow) == (104, True)
    assert first.ensemble_score == pytest.approx(0.96) and first.fairness_multiplier == pytest.approx(1.2793)
    assert first.raw_limit == pytest.approx(122.8128) and first.confidence == pytest.approx(0.900175)
    assert (second.rate_limit, second.allow, second.reason) == (96, False, "Blocked: Excessive traffic rate")
    assert second.raw_limit == pytest.approx(64.554) and second.confidence == pytest.approx(0.84625)


def test_ladder_and_risk_of_the_examples(spark):
    got = spark.range(1).select(
        heuristics.ratio_ladder(F.lit(80), 100), heuristics.ratio_ladder(F.lit(500), 100),
        behavior.heuristic_risk(F.lit(0.05), F.lit(0.2), F.lit(True))).first()
    assert got[0] == 0.1 and got[1] == 0.7 and got[2] == pytest.approx(0.7)


@pytest.mark.parametrize("hour,business,sale,want", [
    (14, 1, 1, 2.0), (14, 1, 0, 1.0), (3, 0, 0, 0.6), (20, 0, 0, 0.8), (8, 0, 0, 1.0)])
def test_context(spark, hour, business, sale, want):
    assert spark.range(1).select(policy.context(F.lit(hour), F.lit(business), F.lit(sale))).first()[0] == want


def test_health(spark):
    cpus = spark.createDataFrame([(50.0,), (80.0,), (90.0,), (100.0,), (None,)], "c double")
    assert [r[0] for r in cpus.select(policy.health(F.col("c"))).collect()] == [1.0, 1.0, 0.75, 0.5, 1.0]


@pytest.mark.parametrize("alpha,start,steady", [(0.2, 100.0, False), (0.3, 15.5, False), (0.2, 400.0, True)])
def test_chunked_limits_equal_a_loop(spark, alpha, start, steady):
    rng = random.Random(7)
    rows = [(key, i, 37.0 if steady else rng.choice([0.0, 20.0, 55.0, 500.0]))
            for key in ("a", "b") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, pos bigint, raw double")
    got = limit_trajectory(df, "k", "pos", "raw", start=start, alpha=alpha, low=5, high=60, size=13)
    by = {(r.k, r.pos): r.rate_limit for r in got.collect()}
    for key in ("a", "b"):
        limit = start
        for k, i, raw in rows:
            if k == key:
                limit = int(min(max(alpha * raw + (1 - alpha) * limit, 5), 60))
                assert by[(k, i)] == limit


@pytest.mark.parametrize("levels,fan", [(1, 4), (2, 4), (3, 2)])
def test_composed_chunks_equal_a_loop(spark, levels, fan):
    """Trees over chunks, a start out of the range, one of an earlier run, a series shorter than a chunk."""
    rng = random.Random(levels)
    rows = [(key, i, rng.choice([0.0, 20.0, 55.0, 500.0]), rng.choice([0.05, -0.05, 0.0]))
            for key, n in (("a", 500), ("b", 161), ("c", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, pos bigint, raw double, d double")
    known = spark.createDataFrame([("b", 17)], "k string, limit bigint")
    deep = dict(size=5, levels=levels, fan=fan)
    limits = {(r.k, r.pos): r.rate_limit for r in limit_trajectory(
        df, "k", "pos", "raw", start=400.0, alpha=0.2, low=5, high=60, starts=known, **deep).collect()}
    weights = {(r.k, r.pos): r.w for r in clamped_sum(
        df, "k", "pos", "d", start=0.4, low=0.2, high=0.8, out="w", **deep).collect()}
    assert len(limits) == len(weights) == len(rows)
    state = {}
    for k, i, raw, d in rows:
        limit, w = state.get(k, (17 if k == "b" else 400.0, 0.4))
        limit = int(min(max(0.2 * raw + 0.8 * limit, 5), 60))
        w = min(0.8, w + d) if d > 0 else max(0.2, w + d) if d < 0 else w
        state[k] = limit, w
        assert limits[(k, i)] == limit and weights[(k, i)] == pytest.approx(w, abs=1e-9)


def test_a_long_series_is_no_single_task(spark):
    """Two million requests of one series: its tables are composed 64 at a time."""
    n, size, fan = 2_000_000, 1024, 64
    rows = spark.range(n, numPartitions=8).select(
        F.lit("all").alias("k"), F.col("id").alias("pos"), (F.pmod(F.xxhash64("id"), F.lit(90)) * 1.0).alias("raw"))
    got = limit_trajectory(rows, "k", "pos", "raw", start=20.0, alpha=0.3, low=5, high=60, size=size, levels=2, fan=fan)
    last, total = got.agg(F.max_by("rate_limit", "pos"), F.sum("rate_limit")).first()
    limit, want = 20.0, 0
    for raw in rows.orderBy("pos").toPandas()["raw"]:
        limit = int(min(max(0.3 * raw + (1 - 0.3) * limit, 5), 60))
        want += limit
    assert (last, total) == (limit, want)


def test_clamped_sum_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [("p", i, rng.choice([0.05, -0.05, 0.0, 0.05])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, pos bigint, d double")
    got = {r.pos: r.w for r in clamped_sum(
        df, "k", "pos", "d", start=0.4, low=0.2, high=0.8, out="w", size=11).collect()}
    w = 0.4
    for _, i, d in rows:
        w = min(0.8, w + d) if d > 0 else max(0.2, w + d) if d < 0 else w
        assert got[i] == pytest.approx(w, abs=1e-9)


def test_replay_uses_arrival_order(make_log, spark):
    log = make_log([(float(i), "u", "/a") for i in range(6)] + [(70.0, "u", "/a")])
    no = policy.assign_windows(log, 60).first().window_no
    limits = spark.createDataFrame([("all", no, 4), ("all", no + 1, 0)], "series_key string, window_no bigint, rate_limit bigint")
    got = policy.replay_requests(log, limits, 60, slices=20).orderBy("request_id").collect()
    assert [r.position for r in got] == [1, 2, 3, 4, 5, 6, 1]
    assert [r.allow for r in got] == [True] * 4 + [False] * 3


def test_feedback_example(spark):
    """A false positive with healthy metrics: reward -0.7, weights .607 / .393."""
    rows = spark.sql("""SELECT 'p' AS policy_key, 'r1' AS request_id, timestamp'2024-01-01' AS ts, 'false_positive' AS type,
        0 AS actual_label, 1 AS predicted_label,
        named_struct('cpu_usage', 65D, 'avg_response_time', 180D, 'error_rate', 0D) AS system_metrics""")
    got = fb.weight_trajectory(rows).first()
    assert got.reward == pytest.approx(-0.7)
    assert got.forecast_weight == pytest.approx(0.607) and got.anomaly_weight == pytest.approx(0.393)
    stress = fb.stress_level(F.lit(65.0), F.lit(180.0))
    level, limit = spark.range(1).select(stress, fb.stress_adjusted(F.lit(100), stress)).first()
    assert level == pytest.approx(0.15) and limit == 100
    floor = fb.stress_adjusted(F.lit(100), fb.stress_level(F.lit(65.0), F.lit(5000.0)))
    assert spark.range(1).select(floor).first()[0] == FULL.min_limit


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        fb.weight_trajectory(spark.range(1), LimitConfig(forecast_weight=0.7))


def test_explanation_example(spark):
    row = spark.createDataFrame(
        [(950.0, 2.0, 0.15, 500.0, 8.5, 475.0, False, 0.87, 50, "2024-01-01 00:00:00")],
        "requests_per_minute double, unique_ips double, error_rate double, avg_response_time double, spike_ratio double, "
        "ip_concentration double, allow boolean, anomaly_score double, rate_limit bigint, window_start string")
    weights = F.array(*[F.lit(x) for x in (0.3, 0.1, 0.1, 0.1, 0.1, 0.3)])
    made = explain.explain(row, weights).select("explanation", explain.audit_text().alias("text")).first()
    e = made.explanation
    assert e.recommendation == "Strong attack signature detected. Consider blacklisting this IP."
    assert [f.factor for f in e.contributing_factors] == [
        "requests_per_minute: 950.00", "ip_concentration: 475.00", "unique_ips: 2.00"]
    assert e.primary_reason == "Abnormally high request rate"
    assert "Confidence: 87.00%\nAdaptive Limit: 50 req/min\n" in made.text
    assert "  - unique_ips: 2.00 (importance: 10.00%)\n" in made.text


def test_repeated_and_missing_ids_keep_their_own_risk(make_log):
    from trafficlens.plans.requests import full_request_inputs

    quick = [(i * 0.02, "bot", e, {"request_id": None}) for i, e in enumerate(("/api/products", "/api/cart", "/api/checkout"))]
    calm = [(i * 5.0, "calm", "/api/products", {"request_id": 7}) for i in range(3)]
    rows = full_request_inputs(make_log(quick + calm), 60).collect()
    assert len(rows) == 6
    assert sorted(r.behavioral_risk for r in rows if r.user_id == "bot") == [0.0, 0.0, 0.9]
    assert {r.behavioral_risk for r in rows if r.user_id == "calm"} == {0.0}


def test_long_series_hand_python_no_other_column(spark):
    """Only place and value of a request go through the fold; its other columns are joined to the chunks' limits."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "a").alias("k"), F.floor(F.col("id") / 3).alias("n"), F.col("id").alias("other"))
    rows = rows.withColumn("pos", F.when(F.col("k").isNull(), F.col("n") + 7).otherwise(2 * F.col("n") + F.col("other") % 3 - 1))
    rows = rows.withColumn("raw", F.when(F.col("pos") < 200, 40.0).otherwise(F.pmod(F.xxhash64("other"), F.lit(90)) * 1.0)).drop("n")
    got = limit_trajectory(rows, "k", "pos", "raw", start=20.0, alpha=0.2, low=5, high=60, size=100, levels=2, fan=4)
    plan = got._jdf.queryExecution().analyzed().toString()
    python = [line for line in plan.splitlines() if "FlatMap" in line]
    assert python and not any("other" in line for line in python)
    have = {(r.k, r.pos): (r.rate_limit, r.other) for r in got.collect()}
    assert len(have) == 3000
    for key in ("a", None):
        limit = 20.0
        for r in sorted((r for r in rows.collect() if r.k == key), key=lambda r: r.pos):
            limit = int(min(max(0.2 * r.raw + (1 - 0.2) * limit, 5), 60))
            assert have[(key, r.pos)] == (limit, r.other)


def test_larger_tables_have_more_tasks_not_larger_ones(spark):
    """A shuffle had as many parts as the setting said, 4 here, however many rows it carried."""
    rows = spark.range(2_000_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    parts = rows.groupBy("id").agg(F.max("text").alias("text")).where("length(text) = 64").groupBy(F.spark_partition_id().alias("p")).count()
    sizes = [r["count"] for r in parts.collect()]
    assert sum(sizes) == 2_000_000 and len(sizes) > 4 and max(sizes) < 400_000


def test_online_decisions_need_no_other_columns(spark, data):
    log = events_request_log(spark, data)
    whole, slim = (requests.online_request_decisions(rows, 3600).select("request_id", "request_count", "anomaly_score", "rate_limit", "reason")
                   for rows in (log, log.select(*requests.ONLINE_COLUMNS)))
    assert sorted(map(tuple, slim.collect())) == sorted(map(tuple, whole.collect()))
