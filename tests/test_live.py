"""Decisions by a stream's own limits, and the newest rows of a decision log."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks.fixture import HOUR, RULES, SIMPLE_LIMITS
from trafficlens.operators import policy
from trafficlens.plans import decisions as plans
from trafficlens.sources.request_log import events_request_log, events_request_stream
from trafficlens.streaming.decisions import live_decisions
from trafficlens.streaming.runner import drain, drain_newest
from trafficlens.streaming.state import newest_rows


def write_events(frame, path):
    pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), path, coerce_timestamps="us")


@pytest.fixture(scope="module")
def frame(data):
    return pd.read_parquet(f"{data}/events.parquet").sort_values(["ts", "event_id"])


@pytest.fixture(scope="module")
def want(spark, data):
    """Batch decisions of all requests: window, score, limit and decision by id."""
    log = events_request_log(spark, data)
    table = plans.window_decisions(log, HOUR, SIMPLE_LIMITS, RULES)
    rows = policy.join_windows(log, table.select("series_key", "window_no", "anomaly_score", "rate_limit", "allow"), HOUR)
    return {r.request_id: (r.window_no, round(r.anomaly_score, 9), r.rate_limit, r.allow) for r in rows.collect()}


def decided(spark, folder, delay="10 minutes", **where):
    stream = events_request_stream(spark, str(folder), "*.parquet", maxFilesPerTrigger=1)
    rows = drain(live_decisions(stream, HOUR, SIMPLE_LIMITS, RULES, delay), "live", **where).collect()
    got = {r.request_id: (r.window_no, round(r.anomaly_score, 9), r.rate_limit, r.allow) for r in rows}
    assert len(got) == len(rows)
    return got


def test_several_files_and_a_restart_equal_batch(spark, frame, want, tmp_path):
    live, where = tmp_path / "live", dict(path=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    live.mkdir()
    write_events(frame.iloc[:400], live / "part0.parquet")
    write_events(frame.iloc[400:700], live / "part1.parquet")
    first = decided(spark, live, **where)
    write_events(frame.iloc[700:], live / "part2.parquet")
    got = decided(spark, live, **where)
    mark = frame["ts"].max() - pd.Timedelta(minutes=10)
    closed = set(frame[frame["ts"].dt.floor("h") + pd.Timedelta(hours=1) <= mark]["event_id"])
    assert first.items() <= got.items() and 0 < len(first) < len(got)
    assert got == {i: want[i] for i in closed}


def test_requests_in_any_order_equal_batch(spark, frame, want, tmp_path):
    mixed = frame.sample(frac=1, random_state=5)
    for i, cut in enumerate((0, 300, 600)):
        write_events(mixed.iloc[cut:cut + 300 if i < 2 else None], tmp_path / f"part{i}.parquet")
    # a last file far ahead lets the watermark pass all others
    ahead = frame.iloc[:1].assign(event_id=90_001, ts=frame["ts"].max() + pd.Timedelta(days=800))
    write_events(ahead, tmp_path / "part9.parquet")
    assert decided(spark, tmp_path, "400 days") == want


def test_late_requests_are_not_decided_and_change_nothing(spark, frame, want, tmp_path):
    write_events(frame.iloc[:400], tmp_path / "part0.parquet")
    write_events(frame.iloc[400:450], tmp_path / "part1.parquet")
    late = frame.iloc[[0, 1, 2]].assign(event_id=[9001, 9002, 9003])
    write_events(pd.concat([late, frame.iloc[450:500]]), tmp_path / "part2.parquet")
    got = decided(spark, tmp_path)
    assert len(got) > 300 and got == {i: want[i] for i in got}


def test_newest_rows_after_every_batch(spark, tmp_path):
    """Ties in time, a missing id, rows without a time, batches that change nothing."""
    rng, live = random.Random(3), tmp_path / "live"
    live.mkdir()
    schema = "ts timestamp, request_id bigint, allow boolean, reason string"
    start, rows = datetime(2024, 1, 1), []
    where = dict(path=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    for batch in range(4):
        base = 500 if batch == 2 else 1000 * (batch + 1)
        times = [0] * 30 if batch == 3 else [base + rng.randrange(15) for _ in range(60)]
        new = [(start + timedelta(seconds=t), len(rows) + i, t % 2 == 0, None if i % 7 else "r") for i, t in enumerate(times)]
        if batch == 1:
            new += [(start + timedelta(seconds=1014), None, True, "none"), (None, 5000, True, "no time")]
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(str(live))
        stream = spark.readStream.schema(schema).parquet(str(live))
        got = drain_newest(newest_rows(stream, 8, parts=3), "newest", **where)
        order = [F.desc("ts"), F.desc("request_id")]
        best = spark.createDataFrame(rows, schema).orderBy(*order).limit(8)
        shown = [tuple(r) for r in got.select(*best.columns).orderBy(*order).collect()]
        assert shown == [tuple(r) for r in best.collect()]
    assert got.select("version").distinct().count() == 1
