"""Streams in several micro-batches equal their batch twins on closed windows."""

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks.fixture import DAY, HOUR, SIMPLE_LIMITS, feedback
from trafficlens.operators import behavior, feedback as fb, policy, windows as win
from trafficlens.schema import FEEDBACK
from trafficlens.sources.request_log import events_request_log, events_request_stream
from trafficlens.streaming import state, windows as sw
from trafficlens.streaming.runner import drain


def write_events(frame, path):
    pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), path, coerce_timestamps="us")


@pytest.fixture(scope="module")
def parts(data, tmp_path_factory):
    """The event table as three files in time order."""
    frame = pd.read_parquet(f"{data}/events.parquet").sort_values(["ts", "event_id"])
    folder = tmp_path_factory.mktemp("events")
    cuts = [0, 400, 700, len(frame)]
    for i in range(3):
        write_events(frame.iloc[cuts[i]:cuts[i + 1]], folder / f"part{i}.parquet")
    return folder, frame, cuts


def arriving(spark, folder, glob="*.parquet"):
    return events_request_stream(spark, str(folder), glob, maxFilesPerTrigger=1)


def limits_of(stream):
    rows = sw.window_features(stream, HOUR).withColumn("raw_limit", F.col("request_count") * 3.0)
    return state.adaptive_limits(rows, SIMPLE_LIMITS, idle=0.0)


def batch_limits(spark, data):
    table = win.window_aggregates(events_request_log(spark, data), HOUR, measures=())
    rows = policy.smoothed_limits(table.withColumn("raw_limit", F.col("request_count") * 3.0), SIMPLE_LIMITS)
    return {r.window_no: r.rate_limit for r in rows.where("request_count > 0").collect()}


def test_windows_equal_batch(spark, data, parts):
    got = {r.window_no: r for r in drain(sw.window_features(arriving(spark, parts[0]), HOUR), "t").collect()}
    want = {r.window_no: r for r in win.window_aggregates(
        events_request_log(spark, data), HOUR, measures=("distinct", "ratios", "labels")).where("request_count > 0").collect()}
    assert len(want) - len(got) in (0, 1) and len(got) > 100
    for no, row in got.items():
        for name in ("request_count", "unique_users", "unique_ips", "error_rate", "checkout_ratio", "is_attack"):
            assert row[name] == want[no][name]


def test_limits_survive_a_restart(spark, data, parts, tmp_path):
    folder, frame, cuts = parts
    live, where = tmp_path / "live", dict(path=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    live.mkdir()
    for i in range(2):
        write_events(frame.iloc[cuts[i]:cuts[i + 1]], live / f"part{i}.parquet")
    first = drain(limits_of(arriving(spark, live)), "t", **where).count()
    write_events(frame.iloc[cuts[2]:], live / "part2.parquet")
    got = {r.window_no: r.rate_limit for r in drain(limits_of(arriving(spark, live)), "t", **where).collect()}
    want = batch_limits(spark, data)
    assert first < len(got) and len(want) - len(got) in (0, 1)
    assert all(want[no] == limit for no, limit in got.items())


def test_late_events_do_not_change_closed_windows(spark, parts, tmp_path):
    folder, frame, cuts = parts
    write_events(frame.iloc[:400], tmp_path / "part0.parquet")
    late = frame.iloc[[0, 1, 2]].assign(event_id=[9001, 9002, 9003])
    write_events(frame.iloc[400:450], tmp_path / "part1.parquet")  # rows are late by the watermark before this batch
    write_events(pd.concat([late, frame.iloc[450:500]]), tmp_path / "part2.parquet")
    got = {r.window_no: r.request_count for r in drain(sw.window_features(arriving(spark, tmp_path), HOUR), "t").collect()}
    on_time = tmp_path / "on-time"
    on_time.mkdir()
    write_events(frame.iloc[:500], on_time / "events.parquet")
    table = win.window_aggregates(events_request_log(spark, str(on_time)), HOUR, measures=())
    want = {r.window_no: r.request_count for r in table.where("request_count > 0").collect()}
    assert got == {no: want[no] for no in got} and len(want) - len(got) in (0, 1)


def test_duplicates_are_dropped(spark, parts, tmp_path):
    frame = parts[1]
    write_events(pd.concat([frame.iloc[:50], frame.iloc[:50]]), tmp_path / "part0.parquet")
    assert drain(sw.deduplicated(arriving(spark, tmp_path)), "t").count() == 50


def closed_patterns(spark, data, frame):
    """Batch results of the requests that the final watermark has passed."""
    mark = frame["ts"].max() - pd.Timedelta(minutes=10, milliseconds=1)
    rows = behavior.suspicion(events_request_log(spark, data), DAY).where("is_suspicious").where(F.col("ts") < F.lit(mark)).collect()
    return {r.request_id: (r.suspicion_score, ",".join(r.matched_patterns)) for r in rows}


@pytest.mark.parametrize("shuffled", [False, True])
def test_patterns_equal_batch(spark, data, parts, tmp_path, shuffled):
    """Also when requests arrive in any order, as long as none is later than the watermark."""
    folder, frame, cuts = parts
    if shuffled:
        folder, delay = tmp_path, "400 days"
        mixed = frame.sample(frac=1, random_state=4)
        for i in range(3):
            write_events(mixed.iloc[cuts[i]:cuts[i + 1]], folder / f"part{i}.parquet")
        # a last file far ahead lets the watermark pass all others
        ahead = frame.iloc[:1].assign(event_id=90_001, user_id=-1, ts=frame["ts"].max() + pd.Timedelta(days=800))
        write_events(ahead, folder / "part9.parquet")
    else:
        delay = "10 minutes"
    got = {r.request_id: (r.suspicion_score, r.matched_patterns)
           for r in drain(state.bot_patterns(arriving(spark, folder), DAY, delay), "t").collect()}
    rows = behavior.suspicion(events_request_log(spark, data), DAY).where("is_suspicious").collect()
    want = {r.request_id: (r.suspicion_score, ",".join(r.matched_patterns)) for r in rows}
    assert got == (want if shuffled else closed_patterns(spark, data, frame)) and got


def test_weights_equal_batch(spark, data, tmp_path):
    rows = feedback(spark, data)
    made = rows.toPandas().sort_values("ts")
    for i, part in enumerate((made.iloc[:200], made.iloc[200:])):
        spark.createDataFrame(part, FEEDBACK).coalesce(1).write.mode("append").parquet(str(tmp_path / f"f/b={i}"))
    stream = spark.readStream.schema(FEEDBACK).parquet(str(tmp_path / "f/b=*"))
    got = {r.request_id: r.anomaly_weight for r in drain(state.learned_weights(stream, SIMPLE_LIMITS), "t").collect()}
    want = {r.request_id: r.anomaly_weight for r in fb.clamped_weight_trajectory(rows, SIMPLE_LIMITS).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rolling_forecast_counts_idle_windows(spark, parts):
    rows = drain(state.rolling_forecast(sw.window_features(arriving(spark, parts[0]), HOUR), 20.0), "t")
    by = {r.window_no: r for r in rows.collect()}
    first = min(by)
    for no, row in by.items():
        before = [by[n].request_count if n in by else 0 for n in range(max(first, no - 10), no)]
        assert row.predicted == pytest.approx(sum(before) / len(before) if before else 20.0)


def test_waiting_requests_take_one_timer(spark, parts, tmp_path):
    """However many requests of a key wait, one timer looks at all that are due, and one clears the key."""
    class Handle:
        def __init__(self):
            self.timers = set()

        def getListState(self, *_):
            return Rows()

        def registerTimer(self, at):
            self.timers.add(at)

    class Rows(list):
        exists, get, appendList = (lambda self: bool(self)), (lambda self: iter(list(self))), list.extend

        def put(self, rows):
            self[:] = rows

    class Times:
        def __init__(self, mark):
            self.getCurrentWatermarkInMs = lambda: mark

    handle, made = Handle(), state._Patterns(DAY, "bigint")
    made.init(handle)
    n = 3000
    rows = pd.DataFrame({"user": [f"U{i % 30}" for i in range(n)], "t": [i * 1_000_000 for i in range(n)], "request_id": range(n),
                         "endpoint": "/login", "own": True})
    list(made.handleInputRows((0, 0), iter([rows]), None))
    assert len(handle.timers) == 2
    half = pd.concat(made.handleExpiredTimer((0, 0), Times(1_500_000), None))
    assert len(half) == 1500 - 2 * 30 and len(handle.timers) == 3 and len(made.waiting) == 1500
    rest = pd.concat(made.handleExpiredTimer((0, 0), Times(3_000_000), None))
    assert len(rest) == 1500 and not made.waiting and len(made.histories) == 30
    list(made.handleExpiredTimer((0, 0), Times(10 * 86_400_000), None))
    assert not made.histories


def test_state_is_saved_as_changes(spark, parts, tmp_path):
    """Each batch used to write whole snapshots of the state, and each write looked its key up again to count the keys."""
    stream = sw.sliding_statistics(arriving(spark, parts[0]), "6 hours", "1 hour", "10 minutes")
    drain(stream, "changes", path=f"{tmp_path}/data", checkpoint=f"{tmp_path}/checkpoint")
    saved = [f for f in (tmp_path / "checkpoint" / "state").rglob("*") if f.is_file()]
    assert any(f.suffix == ".changelog" for f in saved)
