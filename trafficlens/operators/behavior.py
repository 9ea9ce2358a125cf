"""Cross-endpoint behaviour of users: request gaps, histories, bot patterns.

The history of a request is all requests of its user, itself included, that are
at most ``history_seconds`` old; with ``max_history`` only the newest of these. It
never reaches beyond that age, so users are cut into time chunks with a copied
look-back and even a user with most of the traffic spreads over many tasks. With
``max_history`` the chunks are cut into blocks of rows as well.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import REQUEST_DEFAULTS, BehaviorConfig, ParallelPattern, SequencePattern
from ..functions.chunks import BLOCK, CHUNK, carried_lag, own_rows, row_blocks, time_chunk, with_lookback
from ..functions.columns import micros, or_zero, with_defaults
from .windows import KEY, assign_windows

US = 1_000_000
CHUNK_HISTORIES = 4
SLICES = 64


def user_time_delta(log: DataFrame, split_seconds: int = 3600) -> DataFrame:
    """Seconds since the user's previous request (null on the first).

    Users are cut into slices of ``split_seconds``; each hands its last row on.
    """
    cut = time_chunk(log, "ts", split_seconds)
    out = carried_lag(cut, ["user_id"], CHUNK, ["ts", "request_id"], {"prev_time": "ts"})
    return out.withColumn("time_delta", (micros(F.col("ts")) - micros(F.col("prev_time"))) / US).drop(CHUNK)


def window_gap_stats(log: DataFrame, seconds: int) -> DataFrame:
    """Mean and minimum gap to the same user's previous request, per window."""
    rows = assign_windows(user_time_delta(log), seconds)
    return rows.groupBy(*KEY).agg(
        F.avg("time_delta").alias("avg_time_delta"), F.min("time_delta").alias("min_time_delta"))


def _chunked(log: DataFrame, cfg: BehaviorConfig) -> tuple[DataFrame, Window]:
    """Users in time chunks with look-back; with ``max_history`` in blocks of rows."""
    reach = cfg.history_seconds * US
    cut = with_lookback(log.withColumn("_t", micros(F.col("ts"))), F.col("_t"), CHUNK_HISTORIES * reach, reach)
    if cfg.max_history is None:
        cut = cut.withColumn(BLOCK, F.lit(0).cast("bigint"))
    else:
        cut = row_blocks(cut, ["user_id", CHUNK], "_t", ["_t", "request_id"], reach=cfg.max_history - 1,
                         slice_units=max(1, reach // SLICES), block=cfg.block_rows)
    return cut, Window.partitionBy("user_id", CHUNK, BLOCK).orderBy("_t", "request_id")


def _raw_history(w, cfg: BehaviorConfig) -> Column:
    oldest = Window.unboundedPreceding if cfg.max_history is None else 1 - cfg.max_history
    frame = w.rowsBetween(oldest, 0)
    return F.collect_list(F.struct(F.col("_t").alias("t"), "endpoint")).over(frame)


def _recent(cfg: BehaviorConfig) -> Column:
    cutoff = micros(F.col("ts")) - cfg.history_seconds * US
    return F.filter("_all", lambda x: x.t >= cutoff)


def with_history(log: DataFrame, cfg: BehaviorConfig = BehaviorConfig()) -> DataFrame:
    """Add ``history``: array of (t in micros, endpoint), oldest first."""
    cut, w = _chunked(log, cfg)
    rows = own_rows(cut.withColumn("_all", _raw_history(w, cfg)))
    return rows.withColumn("history", _recent(cfg)).drop("_all", "_t")


def _sequence_match(w, pattern: SequencePattern) -> Column:
    """Struct (start t, start row) when a run ending at this row matches."""
    size = len(pattern.endpoints)
    run = F.array(*[F.lag("endpoint", i).over(w) for i in range(size)])
    hit = F.lag("_t", size - 1).over(w).isNotNull()
    for endpoint, times in Counter(pattern.endpoints).items():
        need = times if pattern.strict else 1
        if need == 1:
            hit = hit & F.array_contains(run, endpoint)
        else:
            hits = sum((F.when(F.lag("endpoint", i).over(w) == endpoint, 1).otherwise(0) for i in range(size)), F.lit(0))
            hit = hit & (hits >= need)
    start = F.lag("_t", size - 1).over(w)
    hit = hit & (F.col("_t") - start <= pattern.max_time_ms * 1000)
    return F.when(hit, F.struct(start.alias("t"), (F.row_number().over(w) - size + 1).alias("row")))


def _parallel_match(pattern: ParallelPattern) -> Column:
    """Some endpoint of a history of two or more has enough hits, all of them close together.

    One pass over the history in the order of endpoint and time; a run of one
    endpoint counts where it ends.
    """
    ordered = F.array_sort(F.transform("history", lambda x: F.struct(x.endpoint.alias("e"), x.t.alias("t"))))
    limit = pattern.max_time_ms * 1000

    def crowded(run):
        return (run.n >= pattern.min_count) & (run.last - run.first <= limit)

    def step(run, x):
        same = run.e.eqNullSafe(x.e) & (run.n > 0)
        return F.struct(
            x.e.alias("e"), F.when(same, run.n + 1).otherwise(1).alias("n"),
            F.when(same, run.first).otherwise(x.t).alias("first"), x.t.alias("last"),
            (run.hit | (~same & crowded(run))).alias("hit"))

    start = F.struct(F.lit(None).cast("string").alias("e"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("first"),
                     F.lit(0).cast("bigint").alias("last"), F.lit(False).alias("hit"))
    return (F.size("history") >= 2) & F.aggregate(ordered, start, step, lambda run: run.hit | crowded(run))


def match_patterns(log: DataFrame, cfg: BehaviorConfig = BehaviorConfig(), *,
                   keep_history: bool = False) -> DataFrame:
    """Add one boolean ``hit_<name>`` column per pattern, in one sort per user.

    A sequence pattern holds when a matching run lies wholly inside the
    history. Only the latest run needs looking at: it starts last, so if it
    has left the history every earlier one has as well. That makes sequence
    matching constant work per request; only parallel patterns and
    ``keep_history`` build the history array.
    """
    sequences = [p for p in cfg.patterns if isinstance(p, SequencePattern)]
    parallels = [p for p in cfg.patterns if isinstance(p, ParallelPattern)]
    cut, w = _chunked(log, cfg)
    cut = cut.withColumns({
        "_row": F.row_number().over(w), **{f"_m_{p.name}": _sequence_match(w, p) for p in sequences}})
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({
        f"_m_{p.name}": F.last(f"_m_{p.name}", ignorenulls=True).over(seen) for p in sequences})
    if parallels or keep_history:
        cut = cut.withColumn("_all", _raw_history(w, cfg))
    rows = own_rows(cut)
    oldest_t = F.col("_t") - cfg.history_seconds * US
    oldest_row = F.lit(1) if cfg.max_history is None else F.col("_row") - cfg.max_history + 1
    rows = rows.withColumns({
        f"hit_{p.name}": F.coalesce(
            (F.col(f"_m_{p.name}.t") >= oldest_t) & (F.col(f"_m_{p.name}.row") >= oldest_row), F.lit(False))
        for p in sequences})
    if parallels or keep_history:
        rows = rows.withColumn("history", _recent(cfg))
    rows = rows.withColumns({f"hit_{p.name}": _parallel_match(p) for p in parallels})
    dropped = ["_t", "_row", "_all", *[f"_m_{p.name}" for p in sequences]]
    return rows.drop(*dropped, *([] if keep_history else ["history"]))


def suspicion(log: DataFrame, cfg: BehaviorConfig = BehaviorConfig(), *,
              keep_history: bool = False) -> DataFrame:
    """Matched pattern names, the highest severity among them, and a flag."""
    hits = match_patterns(log, cfg, keep_history=keep_history)
    found = F.filter(
        F.array(*[
            F.when(F.col(f"hit_{p.name}"), F.struct(F.lit(p.name).alias("name"), F.lit(p.severity).alias("severity")))
            for p in cfg.patterns]),
        lambda x: x.isNotNull())
    return (
        hits.withColumn("_found", found)
        .withColumns({
            "matched_patterns": F.transform("_found", lambda x: x["name"]),
            "suspicion_score": F.coalesce(F.array_max(F.transform("_found", lambda x: x.severity)), F.lit(0.0)),
        })
        .withColumn("is_suspicious", F.size("matched_patterns") > 0)
        .drop("_found", *[f"hit_{p.name}" for p in cfg.patterns])
    )


def behavior_features(log: DataFrame, cfg: BehaviorConfig = BehaviorConfig()) -> DataFrame:
    """Gap statistics and endpoint diversity of each request's history.

    Gap statistics and the rate are null for a history of one request; the
    rate is null as well when all its requests share one timestamp.
    """
    rows = log if "history" in log.columns else with_history(log, cfg)
    n = F.size("history")
    gaps = F.transform(
        F.sequence(F.lit(2), n),
        lambda i: (F.element_at("history", i).t - F.element_at("history", i - 1).t) / F.lit(float(US)))
    rows = rows.withColumn("_gaps", F.when(n >= 2, gaps))
    span = (F.element_at("history", -1).t - F.element_at("history", 1).t) / F.lit(float(US))
    # the gaps add up to the span of the history
    rows = rows.withColumn("avg_inter_request_time", F.when(n >= 2, span / (n - 1)))
    mean = F.col("avg_inter_request_time")
    spread = F.aggregate("_gaps", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    unique = F.size(F.array_distinct(F.transform("history", lambda x: x.endpoint)))
    return rows.withColumns({
        "std_inter_request_time": F.sqrt(spread / (n - 1)),
        "min_inter_request_time": F.array_min("_gaps"),
        "unique_endpoints": unique,
        "total_requests": n,
        "endpoint_diversity": unique / n,
        "has_rapid_sequence": F.coalesce(F.exists("_gaps", lambda g: g < cfg.rapid_gap_seconds), F.lit(False)),
        "request_rate": F.when(n >= 2, F.try_divide(n.cast("double"), span)),
    }).drop("_gaps", "history")


def heuristic_risk(avg_gap: Column, diversity: Column, rapid: Column) -> Column:
    """Mean of the signals that fire: short gaps, one endpoint, rapid run."""
    signals = F.array_compact(F.array(
        F.when(F.coalesce(avg_gap, F.lit(1.0)) < 0.1, F.lit(0.8)),
        F.when(F.coalesce(diversity, F.lit(1.0)) < 0.3, F.lit(0.6)),
        F.when(F.coalesce(rapid, F.lit(False)), F.lit(0.7))))
    total = F.aggregate(signals, F.lit(0.0), lambda a, x: a + x)
    return or_zero(F.try_divide(total, F.size(signals).cast("double")))


def realtime_features(log: DataFrame, cfg: BehaviorConfig = BehaviorConfig()) -> DataFrame:
    """Request feature row: defaulted basics plus behaviour and suspicion."""
    scored = suspicion(log, cfg, keep_history=True).withColumnRenamed("suspicion_score", "behavioral_suspicion_score")
    rows = behavior_features(scored, cfg)
    lonely = F.col("total_requests") < 2
    return with_defaults(rows, REQUEST_DEFAULTS).withColumns({
        "avg_inter_request_time": F.coalesce("avg_inter_request_time", F.lit(0.0)),
        "endpoint_diversity": F.when(lonely, 0.0).otherwise(F.col("endpoint_diversity")),
    })
