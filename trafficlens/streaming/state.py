"""Keyed stream state: limits, weights, forecasts, newest rows and user histories.

Each processor folds the rows of one key in event order. Windows close in order,
so their rows are sorted inside the handler only; requests wait for the watermark.
"""

from __future__ import annotations

import heapq
import sys
from collections import Counter, deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config
from ..config import FULL, SIMPLE, BehaviorConfig, LearningConfig, LimitConfig, ParallelPattern
from ..functions.chunks import CHUNK, OWN, with_lookback
from ..functions.columns import micros
from ..operators.windows import NO, SERIES, START

# State processors also start in a helper process that gets no shipped files,
# so they travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(config)

US = 1_000_000
CHUNK_HISTORIES = 4


def _with(df: DataFrame, keys: list[str], rest: str) -> T.StructType:
    """Schema of the key columns as they are in the input, and further ones."""
    return T.StructType([*[df.schema[k] for k in keys], *T._parse_datatype_string(rest).fields])


def _gather(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(order)


class _Limits(StatefulProcessor):
    """Smoothed limit per series; missing windows fold in as empty ones.

    With ``spike`` (ratio, points, windows) the input has the points of the
    other rules, and a count above ``ratio`` times the mean of the last windows,
    its own included, adds ``points``. With ``width`` the rows carry ``closes``,
    the last microsecond of their window.
    """

    def __init__(self, cfg: LimitConfig, idle: float, spike: tuple | None, width: int | None = None):
        self.cfg, self.idle, self.spike, self.width = cfg, idle, spike, width
        self.keep = spike[2] - 1 if spike else 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("limit", "window_no bigint, rate_limit bigint, recent array<bigint>")

    def _raw(self, value, count, recent):
        """The score, if there is one, and the raw limit."""
        if not self.spike:
            return None, value
        ratio, points, _ = self.spike
        mean = (sum(recent) + count) / (len(recent) + 1)
        score = min(1.0, value + (points if mean and count / mean > ratio else 0.0))
        return score, self.cfg.base_limit * (1 - score)

    def _seen(self, recent, count):
        return (recent + [int(count)])[-self.keep:] if self.keep else []

    def _next(self, limit, raw):
        c = self.cfg
        return int(min(max(c.alpha * raw + (1 - c.alpha) * limit, c.min_limit), c.max_limit))

    def handleInputRows(self, key, rows, timerValues):
        pdf = _gather(rows, [NO])
        last, limit, recent = self.state.get() if self.state.exists() else (None, self.cfg.base_limit, [])
        recent, scores, out = list(recent), [], []
        for no, value, count in zip(pdf[NO], pdf["value"], pdf["request_count"]):
            for _ in range(0 if last is None else int(no - last - 1)):
                limit, recent = self._next(limit, self.idle), self._seen(recent, 0)
            score, raw = self._raw(value, count, recent)
            limit, last = self._next(limit, raw), no
            recent = self._seen(recent, count)
            scores.append(score)
            out.append(limit)
        self.state.update((int(last), int(limit), [int(n) for n in recent]))
        rows = pd.DataFrame({
            SERIES: key[0], NO: pdf[NO].to_numpy(), START: pdf[START].to_numpy(),
            "request_count": pdf["request_count"].to_numpy(), "anomaly_score": pd.Series(scores, dtype="float64"),
            "rate_limit": out, "allow": pdf["request_count"].to_numpy() < out})
        if self.width:
            rows["closes"] = rows[START] + pd.Timedelta(seconds=self.width) - pd.Timedelta(microseconds=1)
        yield rows

    def close(self) -> None:
        pass


def adaptive_limits(windows: DataFrame, cfg: LimitConfig = SIMPLE, idle: float | None = None,
                    spike: tuple[float, float, int] | None = None, width: int | None = None) -> DataFrame:
    """Limit and decision per closed window; needs ``raw_limit``, or ``points`` with ``spike``.

    The score is null without ``spike``. With the ``width`` of the windows in
    seconds there is a column ``closes`` in event time, so that stateful
    operators can follow.
    """
    slim = windows.select(SERIES, NO, START, "request_count", F.col("points" if spike else "raw_limit").alias("value"))
    return slim.groupBy(SERIES).transformWithStateInPandas(
        statefulProcessor=_Limits(cfg, cfg.base_limit if idle is None else idle, spike, width),
        outputStructType=_with(windows, [SERIES], f"{NO} bigint, {START} timestamp, request_count bigint, "
                                                  "anomaly_score double, rate_limit bigint, allow boolean"
                                                  + (", closes timestamp" if width else "")),
        outputMode="Append", timeMode="EventTime" if width else "None",
        eventTimeColumnName="closes" if width else "")


class _Weights(StatefulProcessor):
    """Clamped ensemble weights per policy."""

    def __init__(self, start: float, cfg: LearningConfig):
        self.start, self.cfg = start, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("weight", "anomaly_weight double")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _gather(rows, ["ts", "request_id"])
        weight = self.state.get()[0] if self.state.exists() else self.start
        c, out = self.cfg, []
        for kind in pdf["type"]:
            if kind == "false_negative":
                weight = min(c.clamp_high, weight + c.clamp_step)
            elif kind == "false_positive":
                weight = max(c.clamp_low, weight - c.clamp_step)
            out.append(weight)
        self.state.update((weight,))
        yield pd.DataFrame({
            "policy_key": key[0], "request_id": pdf["request_id"].to_numpy(), "ts": pdf["ts"].to_numpy(),
            "anomaly_weight": out, "forecast_weight": [1 - w for w in out]})

    def close(self) -> None:
        pass


def learned_weights(feedback: DataFrame, cfg: LimitConfig = FULL,
                    learn: LearningConfig = LearningConfig()) -> DataFrame:
    slim = feedback.select("policy_key", "request_id", "ts", "type")
    return slim.groupBy("policy_key").transformWithStateInPandas(
        statefulProcessor=_Weights(cfg.anomaly_weight, learn),
        outputStructType=_with(feedback, ["policy_key", "request_id"],
                               "ts timestamp, anomaly_weight double, forecast_weight double"),
        outputMode="Append", timeMode="None")


class _Forecast(StatefulProcessor):
    """Mean of the last windows before each window; keeps a bounded history."""

    def __init__(self, base: float, window: int, keep: int):
        self.base, self.window, self.keep = base, window, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", "window_no bigint, counts array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _gather(rows, [NO])
        last, seen = (None, [])
        if self.state.exists():
            last, seen = self.state.get()
            seen = list(seen)
        predicted = []
        for no, count in zip(pdf[NO], pdf["request_count"]):
            gap = 0 if last is None else int(no - last - 1)
            seen += [0] * min(gap, self.keep)
            recent = seen[-self.window:]
            predicted.append(sum(recent) / len(recent) if recent else float(self.base))
            seen = (seen + [int(count)])[-self.keep:]
            last = no
        self.state.update((int(last), [int(v) for v in seen]))
        yield pd.DataFrame({
            SERIES: key[0], NO: pdf[NO].to_numpy(), "request_count": pdf["request_count"].to_numpy(),
            "predicted": predicted})

    def close(self) -> None:
        pass


def rolling_forecast(windows: DataFrame, base: float, window: int = 10, length: int = 60) -> DataFrame:
    slim = windows.select(SERIES, NO, "request_count")
    return slim.groupBy(SERIES).transformWithStateInPandas(
        statefulProcessor=_Forecast(base, window, 2 * length),
        outputStructType=_with(windows, [SERIES], f"{NO} bigint, request_count bigint, predicted double"),
        outputMode="Append", timeMode="None")


class _Newest(StatefulProcessor):
    """The newest rows of a key; a heap of ``n`` rows is all its state.

    A part of a key passes on the rows that entered its heap, the whole
    (``whole``) its full heap with a version that counts its changes.
    """

    COLUMNS = ["t", "known", "request_id", "row"]

    def __init__(self, n: int, id_type: str, whole: bool):
        self.n, self.id_type, self.whole = n, id_type, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", f"t bigint, known boolean, request_id {self.id_type}, row string")
        self.version = handle.getValueState("version", "version bigint")

    def handleInputRows(self, key, rows, timerValues):
        held = [(*r, False) for r in self.rows.get()] if self.rows.exists() else []
        new = ((int(t), bool(k), i.item() if hasattr(i, "item") else i, row, True)
               for pdf in rows for t, k, i, row in zip(*(pdf[c] for c in self.COLUMNS)))
        # rows with one time and id differ in their content, so that no order of arrival decides
        newest = heapq.nlargest(self.n, [*held, *heapq.nlargest(self.n, new)])
        entered = [r[:4] for r in newest if r[4]]
        if entered:
            self.rows.put([r[:4] for r in newest])
        if not self.whole:
            yield pd.DataFrame(entered, columns=self.COLUMNS)
        elif entered:
            version = self.version.get()[0] + 1 if self.version.exists() else 0
            self.version.update((version,))
            yield pd.DataFrame([(version, *r[:4]) for r in newest], columns=["version", *self.COLUMNS])

    def close(self) -> None:
        pass


def newest_rows(stream: DataFrame, n: int = 20, parts: int = 64) -> DataFrame:
    """The newest ``n`` rows so far, by ``ts`` and ``request_id``, each time they change.

    ``parts`` heaps are kept side by side and merged by a last one, which sees
    at most ``parts * n`` rows of a batch. ``version`` counts the changes: the
    rows with the highest one are the newest. Rows without a time are left out,
    those without an id stand behind others of their time.
    """
    kind = stream.schema["request_id"].dataType.simpleString()
    slim = stream.where("ts is not null").select(
        F.pmod(F.xxhash64("ts", "request_id"), F.lit(parts)).alias("part"), F.unix_micros("ts").alias("t"),
        F.col("request_id").isNotNull().alias("known"), F.coalesce("request_id", F.lit(0).cast(kind)).alias("request_id"),
        F.to_json(F.struct(*[c for c in stream.columns if c not in ("ts", "request_id")])).alias("row"))
    fields = f"t bigint, known boolean, request_id {kind}, row string"
    parted = slim.groupBy("part").transformWithStateInPandas(
        statefulProcessor=_Newest(n, kind, False), outputStructType=fields, outputMode="Append", timeMode="None")
    whole = parted.withColumn("whole", F.lit(0)).groupBy("whole").transformWithStateInPandas(
        statefulProcessor=_Newest(n, kind, True), outputStructType=f"version bigint, {fields}",
        outputMode="Append", timeMode="None")
    rest = T.StructType([f for f in stream.schema.fields if f.name not in ("ts", "request_id")])
    return whole.withColumn("row", F.from_json("row", rest)).select(
        "version", F.timestamp_micros("t").alias("ts"), F.when(F.col("known"), F.col("request_id")).alias("request_id"), "row.*")


class _History:
    """The recent requests of a user and the latest match of each pattern, one request at a time."""

    def __init__(self, cfg: BehaviorConfig, times=(), endpoints=(), seen: int = 0, matches=()):
        self.cfg, self.seen = cfg, seen
        self.rows = deque(zip(times, endpoints))
        self.by_endpoint: dict = {}
        for t, endpoint in self.rows:
            self.by_endpoint.setdefault(endpoint, deque()).append(t)
        # start time and row of the latest match of each sequence; it starts last, so it alone matters
        self.matches = [tuple(m) for m in matches] or [(None, None)] * len(cfg.patterns)

    def _drop(self) -> None:
        _, endpoint = self.rows.popleft()
        times = self.by_endpoint[endpoint]
        times.popleft()
        if not times:
            del self.by_endpoint[endpoint]

    def add(self, t: int, endpoint: str) -> list:
        """Patterns that hold after this request; a history of one request has none."""
        cfg, cutoff = self.cfg, t - self.cfg.history_seconds * US
        self.rows.append((t, endpoint))
        self.by_endpoint.setdefault(endpoint, deque()).append(t)
        self.seen += 1
        while self.rows[0][0] < cutoff or len(self.rows) > (cfg.max_history or len(self.rows)):
            self._drop()
        oldest = self.seen - len(self.rows) + 1
        found = []
        for i, pattern in enumerate(cfg.patterns):
            limit = pattern.max_time_ms * 1000
            if isinstance(pattern, ParallelPattern):
                hit = any(len(v) >= pattern.min_count and v[-1] - v[0] <= limit for v in self.by_endpoint.values())
            else:
                size, need = len(pattern.endpoints), Counter(pattern.endpoints)
                run = list(islice(reversed(self.rows), size))
                need = need if pattern.strict else Counter(set(need))
                if len(run) == size and t - run[-1][0] <= limit and not need - Counter(e for _, e in run):
                    self.matches[i] = (run[-1][0], self.seen - size + 1)
                start, row = self.matches[i]
                hit = start is not None and start >= cutoff and row >= oldest
            if hit:
                found.append(pattern)
        return found if len(self.rows) > 1 else []


class _Patterns(StatefulProcessor):
    """Bot patterns over the histories of a part of the users (in one time chunk), in event order.

    Requests wait until the watermark has passed them, so that none can come in
    before them any more, and are then looked at in the order of their time. One
    timer, for the oldest waiting request, looks at all that are due.
    """

    COLUMNS = ["user", "request_id", "suspicion_score", "matched_patterns"]

    def __init__(self, cfg: BehaviorConfig, id_type: str):
        self.cfg, self.id_type = cfg, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState(
            "waiting", f"user string, t bigint, request_id {self.id_type}, endpoint string, own boolean")
        self.histories = handle.getListState(
            "histories", "user string, t array<bigint>, endpoint array<string>, seen bigint, start array<bigint>, row array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        oldest = []
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList(list(zip(*(pdf[c].tolist() for c in ("user", "t", "request_id", "endpoint", "own")))))
                oldest.append(int(pdf["t"].min()))
        if oldest:
            self.handle.registerTimer(self._due(min(oldest)))
            # nothing can look into a chunk after its end
            self.handle.registerTimer(self._end(key) + 1)
        yield pd.DataFrame([], columns=self.COLUMNS)

    def _due(self, t: int) -> int:
        return t // 1000 + 1

    def _end(self, key) -> int:
        return (int(key[1]) + 1) * CHUNK_HISTORIES * self.cfg.history_seconds * 1000

    def _look_at(self, due: list) -> tuple[list, list]:
        """Suspicious requests of ``due``, and the histories that follow from it."""
        histories = {user: _History(self.cfg, times, endpoints, seen, zip(start, row))
                     for user, times, endpoints, seen, start, row in (self.histories.get() if self.histories.exists() else ())}
        out = []
        for user, t, request_id, endpoint, own in sorted(due, key=lambda r: r[1:]):
            history = histories.get(user)
            if history is None:
                history = histories[user] = _History(self.cfg)
            found = history.add(int(t), endpoint)
            if own and found:
                out.append((user, request_id, max(p.severity for p in found), ",".join(p.name for p in found)))
        return out, [(user, [t for t, _ in h.rows], [e for _, e in h.rows], h.seen,
                      [m[0] for m in h.matches], [m[1] for m in h.matches]) for user, h in histories.items()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in waiting if self._due(r[1]) <= now]
        out = []
        if due:
            out, histories = self._look_at(due)
            rest = [r for r in waiting if self._due(r[1]) > now]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(self._due(min(r[1] for r in rest)))
            else:
                self.waiting.clear()
            if now <= self._end(key):
                self.histories.put(histories)
        if now > self._end(key):
            self.histories.clear()
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def bot_patterns(stream: DataFrame, cfg: BehaviorConfig = BehaviorConfig(), delay: str = "10 minutes",
                 parts: int = 512) -> DataFrame:
    """Suspicious requests with their patterns, once the watermark has passed them.

    Requests are looked at in event order whatever order they arrive in; those
    older than the watermark are late and left out. Time is cut into the same
    chunks as in the batch operator, users are dealt over ``parts`` keys of a
    chunk, so that a call of the state serves many requests. State of a chunk is
    dropped once the watermark passes its end, so it stays bounded by the
    active chunks.
    """
    reach = cfg.history_seconds * US
    timed = stream.withWatermark("ts", delay).withColumn("t", micros(F.col("ts")))
    cut = with_lookback(timed, F.col("t"), CHUNK_HISTORIES * reach, reach)
    slim = cut.select(F.pmod(F.xxhash64("user_id"), F.lit(parts)).alias("part"), CHUNK, F.col("user_id").cast("string").alias("user"),
                      "ts", "t", "request_id", "endpoint", F.col(OWN).alias("own"))
    found = slim.groupBy("part", CHUNK).transformWithStateInPandas(
        statefulProcessor=_Patterns(cfg, stream.schema["request_id"].dataType.simpleString()),
        outputStructType=_with(stream, ["request_id"], "user string, suspicion_score double, matched_patterns string"),
        outputMode="Append", timeMode="EventTime")
    return found.select(F.col("user").cast(stream.schema["user_id"].dataType).alias("user_id"),
                        "request_id", "suspicion_score", "matched_patterns")
