"""Histories, patterns and trailing windows, against literals and brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trafficlens.config import CREDENTIAL_STUFFING, BehaviorConfig, ParallelPattern, SequencePattern
from trafficlens.operators import behavior
from trafficlens.operators.trailing import live_stats, trailing_features

FUNNEL = ["/api/products", "/api/cart", "/api/checkout"]


def scores(log, cfg=BehaviorConfig()):
    rows = behavior.suspicion(log, cfg).orderBy("request_id").collect()
    return [(r.is_suspicious, r.suspicion_score, list(r.matched_patterns)) for r in rows]


def test_rapid_checkout_fires_at_third_request(make_log):
    rows = [(0.05 * i, "u", e) for i, e in enumerate(FUNNEL)]
    assert scores(make_log(rows)) == [
        (False, 0.0, []), (False, 0.0, []), (True, 0.9, ["rapid_checkout"])]


def test_slow_funnel_is_not_suspicious(make_log):
    rows = [(5.0 * i, "u", e) for i, e in enumerate(FUNNEL)]
    assert not any(s[0] for s in scores(make_log(rows)))


def test_pattern_needs_equal_endpoints(make_log):
    cfg = BehaviorConfig(patterns=(SequencePattern("p", ("/products", "/cart", "/checkout"), 100, 0.9),))
    assert not any(s[0] for s in scores(make_log([(0.05 * i, "u", e) for i, e in enumerate(FUNNEL)]), cfg))


def test_login_multiplicity(make_log):
    rows = [(0.0, "u", "/login"), (0.1, "u", "/a"), (0.2, "u", "/b")]
    assert not any(s[0] for s in scores(make_log(rows), BehaviorConfig(patterns=(CREDENTIAL_STUFFING,))))
    loose = SequencePattern("credential_stuffing", CREDENTIAL_STUFFING.endpoints, 1000, 0.9, strict=False)
    assert scores(make_log(rows), BehaviorConfig(patterns=(loose,)))[-1][0]
    three = [(0.1 * i, "u", "/login") for i in range(3)]
    assert scores(make_log(three), BehaviorConfig(patterns=(CREDENTIAL_STUFFING,)))[-1][:2] == (True, 0.9)


def test_history_edges(make_log):
    """Exactly 60 s old is in; the 101st newest request is out."""
    rows = [(0.0, "u", "/a"), (60.0, "u", "/b"), (60.000001, "u", "/c")]
    got = behavior.with_history(make_log(rows)).orderBy("request_id").collect()
    assert [[h.endpoint for h in r.history] for r in got] == [["/a"], ["/a", "/b"], ["/b", "/c"]]
    many = [(0.1 * i, "u", f"/{i}") for i in range(101)]
    assert len(behavior.with_history(make_log(many)).where("request_id = 100").first().history) == 101
    last = behavior.with_history(make_log(many), BehaviorConfig(max_history=100)).where("request_id = 100").first()
    assert len(last.history) == 100 and last.history[0].endpoint == "/1"


def test_identical_timestamps(make_log):
    rows = [(1.0, "u", "/a"), (1.0, "u", "/b")]
    last = behavior.behavior_features(make_log(rows)).where("request_id = 1").first()
    assert last.request_rate is None and last.avg_inter_request_time == 0 and last.has_rapid_sequence


def test_blocks_do_not_change_features(make_log):
    rng = random.Random(9)
    rows = [(round(rng.random() * 300, 3), "u", rng.choice(["/a", "/b"])) for _ in range(300)]
    log = make_log(rows)
    plain, cut = (behavior.behavior_features(log, BehaviorConfig(max_history=20, **x)).drop("traffic_type")
                  .orderBy("request_id").collect() for x in ({}, {"block_rows": 25}))
    assert plain == cut and len(cut) == 300


def matches(pattern, history):
    """Whether a list of (microseconds, endpoint) holds the pattern, by trying every run."""
    if isinstance(pattern, ParallelPattern):
        for endpoint in {e for _, e in history}:
            times = [t for t, e in history if e == endpoint]
            if len(times) >= pattern.min_count and max(times) - min(times) <= pattern.max_time_ms * 1000:
                return True
        return False
    size = len(pattern.endpoints)
    for k in range(len(history) - size + 1):
        run = history[k:k + size]
        if run[-1][0] - run[0][0] > pattern.max_time_ms * 1000:
            continue
        own, asked = Counter(e for _, e in run), Counter(pattern.endpoints)
        if all(own[e] >= (n if pattern.strict else 1) for e, n in asked.items()):
            return True
    return False


def brute(rows, cfg):
    """Suspicion of each request by scanning its whole history."""
    seen, out = {}, []
    for t, user, endpoint in rows:
        history = seen.setdefault(user, [])
        history.append((round(t * 1e6), endpoint))
        recent = [h for h in history[-(cfg.max_history or 0):] if h[0] >= round(t * 1e6) - cfg.history_seconds * 10**6]
        out.append(sorted(p.name for p in cfg.patterns if len(recent) > 1 and matches(p, recent)))
    return out


@pytest.mark.parametrize("dense", [{}, {"block_rows": 8}, {"max_history": None}])
def test_patterns_equal_brute_force(make_log, dense):
    rng = random.Random(3)
    ends = ["/a", "/b", "/c", "/login"]
    rows, t = [], 0.0
    for _ in range(600):
        t += rng.choice([0.2, 1.0, 7.0, 90.0])
        rows.append((round(t, 3), rng.choice(["u", "v"]), rng.choice(ends)))
    cfg = BehaviorConfig(**{"history_seconds": 20, "max_history": 6, **dense}, patterns=(
        SequencePattern("seq", ("/a", "/b", "/c"), 9000, 0.9), SequencePattern("login", ("/login",) * 2, 5000, 0.8),
        ParallelPattern("par", 3, 6000, 0.7)))
    got = [sorted(s[2]) for s in scores(make_log(rows), cfg)]
    want = brute(rows, cfg)
    assert got == want and len({tuple(w) for w in want}) > 3


@pytest.mark.parametrize("max_rows", [None, 7])
def test_trailing_equals_brute_force(make_log, max_rows):
    rng = random.Random(5)
    rows, t = [], 0.0
    for _ in range(400):
        t += rng.choice([0.0, 0.5, 3.0, 20.0, 60.0])
        rows.append((t, f"u{rng.randint(0, 4)}", "/a", {
            "ip": f"i{rng.randint(0, 3)}", "status_code": rng.choice([200, 500]), "response_time": float(rng.randint(1, 50))}))
    got = trailing_features(make_log(rows), max_rows=max_rows).orderBy("request_id").collect()
    for i, (t, user, _, x) in enumerate(rows):
        inside = [r for r in rows if t - 60 < r[0] <= t][-(max_rows or len(rows)):]
        g = got[i]
        assert g.request_count == len(inside)
        assert g.unique_users == len({r[1] for r in inside}) and g.unique_ips == len({r[3]["ip"] for r in inside})
        assert g.user_request_count == sum(r[1] == user for r in inside)
        assert g.ip_request_count == sum(r[3]["ip"] == x["ip"] for r in inside)
        assert abs(g.error_rate - sum(r[3]["status_code"] >= 400 for r in inside) / len(inside)) < 1e-12
        assert abs(g.avg_response_time - sum(r[3]["response_time"] for r in inside) / len(inside)) < 1e-9


def test_busy_minute_is_many_tasks(spark):
    """90% of the requests in one minute: sums equal those of sorted arrays, and no task gets much more than another."""
    import numpy as np

    from trafficlens.operators import trailing

    n, width = 60_000, 60 * trailing.US
    ids = F.col("id")
    at = F.when(ids % 10 > 0, ids * 7919 % width + 40_000 * trailing.US).otherwise(ids * 104_729 % (86_400 * trailing.US))
    rows = spark.range(n).select(ids.alias("request_id"), F.timestamp_micros(at).alias("ts"), (ids % 37).cast("string").alias("user_id"),
                                 (ids % 11).cast("string").alias("ip"), F.lit(200).alias("status_code"), F.lit(1.5).alias("response_time"))
    got = trailing.trailing_features(rows).orderBy("request_id").toPandas()
    i = np.arange(n)
    t = np.where(i % 10 > 0, i * 7919 % width + 40_000 * trailing.US, i * 104_729 % (86_400 * trailing.US))
    whole = np.sort(t)
    assert (got.request_count == np.searchsorted(whole, t, "right") - np.searchsorted(whole, t - width, "right")).all()
    for user in range(37):
        own = i % 37 == user
        times = np.sort(t[own])
        want = np.searchsorted(times, t[own], "right") - np.searchsorted(times, t[own] - width, "right")
        assert (got.user_request_count[own] == want).all()
    assert (got.avg_response_time == 1.5).all() and got.unique_users.max() == 37
    events = spark.createDataFrame(np.concatenate([t, t + width]).tolist(), "long").toDF("at")
    tasks = events.groupBy(F.pmod(F.hash(F.lit("all"), F.floor(F.col("at") / (width // trailing.SLICES))), F.lit(16)).alias("task")).count()
    sizes = sorted(r["count"] for r in tasks.collect())
    assert len(sizes) == 16 and sizes[-1] <= 5 * sizes[8]


def test_sixty_seconds_old_is_outside_the_trailing_window(make_log):
    got = trailing_features(make_log([(0.0, "u", "/a"), (60.0, "v", "/a")])).orderBy("request_id").collect()
    assert [r.request_count for r in got] == [1, 1]
    assert live_stats(make_log([(0.0, "u", "/a"), (60.0, "v", "/a")])).first().requests_in_window == 1


def test_heavy_user_split_keeps_gaps(make_log):
    """One user with most rows, split into slices, has the same gaps."""
    rng = random.Random(1)
    rows, t = [], 0.0
    for _ in range(500):
        t += rng.choice([0.0, 1.0, 30.0, 200.0])
        rows.append((t, rng.choice(["hot"] * 9 + ["cold"]), "/a"))
    log = make_log(rows)
    split = behavior.user_time_delta(log, split_seconds=7).orderBy("request_id").collect()
    last, want = {}, []
    for t, user, _ in rows:
        want.append(None if user not in last else t - last[user])
        last[user] = t
    assert [r.time_delta for r in split] == want


def test_risk_signals(spark):
    cases = spark.createDataFrame(
        [(0.05, 0.2, True), (1.0, 0.2, False), (1.0, 1.0, False), (None, None, None)], "g double, v double, r boolean")
    got = [r[0] for r in cases.select(behavior.heuristic_risk(F.col("g"), F.col("v"), F.col("r"))).collect()]
    assert [round(x, 9) for x in got] == [0.7, 0.6, 0.0, 0.0]


def test_an_outlier_leaves_no_trace_in_the_mean(make_log):
    rows = [(0.0, "u", "/a", {"response_time": 1e15})] + [(70.0 + i, "u", "/a", {"response_time": 1.1}) for i in range(5)]
    got = trailing_features(make_log(rows)).orderBy("request_id").collect()
    assert [r.avg_response_time for r in got[1:]] == pytest.approx([1.1] * 5, abs=1e-12)


def test_lonely_request_has_no_parallel_pattern(make_log):
    cfg = BehaviorConfig(history_seconds=60, patterns=(ParallelPattern("par", 1, 1000, 0.7),))
    got = scores(make_log([(0.0, "u", "/a"), (1.0, "u", "/a")]), cfg)
    assert [list(s[2]) for s in got] == [[], ["par"]]


def test_other_columns_travel_once(make_log, monkeypatch):
    """Of the events of a request only its entry has the columns that no sum reads."""
    from trafficlens.operators import trailing

    seen, plain = [], trailing.sliced_sum
    monkeypatch.setattr(trailing, "sliced_sum", lambda df, *a, **k: (seen.append(df), plain(df, *a, **k))[1])
    log = make_log([(10.0 * i, f"u{i}", "/a") for i in range(30)])
    assert trailing_features(log).where("endpoint = '/a'").count() == 30
    assert "endpoint" not in seen[0].columns
    kinds = {r._kind: (r["count"], r.full) for r in seen[0].groupBy("_kind").agg(
        F.count("*").alias("count"), F.count("_rest").alias("full")).collect()}
    # users are new on entering; the one ip is taken over from the request before it until its last has left
    assert kinds["in"] == (30, 30) and kinds["out"] == (30, 0) and kinds["ip"] == (29, 0) and "user" not in kinds
