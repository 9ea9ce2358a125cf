"""Tumbling-window aggregates of a request log on a dense grid of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import floor_div, indicator, micros, or_zero, safe_ratio
from ..functions.quantile import exact_quantiles

SERIES, NO, START, POS = "series_key", "window_no", "window_start", "pos"
KEY = [SERIES, NO]
GRID_BLOCK = 10_000

ALL_MEASURES = ("volume", "distinct", "entropy", "latency", "p95", "ratios", "labels")


def check_width(seconds: int) -> None:
    """Windows align to midnight, which equals epoch alignment only for such widths."""
    if seconds <= 0 or 86_400 % seconds:
        raise ValueError(f"window_seconds must divide one day, got {seconds}")


def assign_windows(log: DataFrame, seconds: int, series: Column | None = None) -> DataFrame:
    """Add ``series_key`` and ``window_no`` (windows since the epoch)."""
    check_width(seconds)
    if series is not None or SERIES not in log.columns:
        log = log.withColumn(SERIES, series if series is not None else F.lit("all"))
    return log.withColumn(NO, floor_div(micros(F.col("ts")), seconds * 1_000_000))


def window_start(no: Column, seconds: int) -> Column:
    return F.timestamp_micros(no * F.lit(seconds * 1_000_000))


def dense_grid(aggregated: DataFrame, seconds: int, since: DataFrame | None = None) -> DataFrame:
    """Every window between the first and the last of each series.

    ``pos`` counts windows from the first of the series, so later operators
    split, take prefixes and look back by arithmetic instead of by ranking.
    The grid is exploded in blocks to keep the generated arrays short. Series in
    ``since`` (series_key, _from, _first) go on from window ``_from`` and count
    from window ``_first``.
    """
    span = aggregated.groupBy(SERIES).agg(F.min(NO).alias("_min"), F.max(NO).alias("_max"))
    if since is None:
        span = span.withColumn("_zero", F.col("_min"))
    else:
        span = span.join(since, SERIES, "left").select(
            SERIES, F.coalesce("_from", "_min").alias("_min"), "_max", F.coalesce("_first", "_min").alias("_zero"))
    blocks = span.withColumn("_b", F.explode(F.sequence(
        F.lit(0).cast("bigint"), floor_div(F.col("_max") - F.col("_min"), GRID_BLOCK))))
    start = F.col("_min") + F.col("_b") * GRID_BLOCK
    return (
        blocks.withColumn(NO, F.explode(F.sequence(start, F.least(start + GRID_BLOCK - 1, F.col("_max")))))
        .select(SERIES, NO, (F.col(NO) - F.col("_zero")).alias(POS), window_start(F.col(NO), seconds).alias(START))
    )


def densify(aggregated: DataFrame, seconds: int, zero: list[str] | None = None, since: DataFrame | None = None) -> DataFrame:
    """Left-join the aggregates to the grid; windows without requests get 0."""
    joined = dense_grid(aggregated, seconds, since).join(aggregated, KEY, "left")
    names = zero if zero is not None else [c for c in aggregated.columns if c not in KEY]
    return joined.fillna(0, subset=names)


def path_entropy(rows: DataFrame) -> DataFrame:
    """Entropy in bits of the endpoint mix per window, from per-endpoint counts."""
    per_endpoint = rows.groupBy(*KEY, "endpoint").agg(F.count("*").alias("c"))
    totals = per_endpoint.groupBy(*KEY).agg(F.sum("c").alias("n"))
    p = F.col("c") / (F.col("n") + F.lit(1e-6))
    return (
        per_endpoint.join(totals, KEY)
        .groupBy(*KEY).agg((-F.sum(p * F.log2(p + F.lit(1e-6)))).alias("path_entropy"))
    )


def endpoint_pivot(rows: DataFrame, seconds: int, endpoints: list[str]) -> DataFrame:
    """Request counts per window and endpoint, one column per endpoint."""
    counts = [F.count_if(F.col("endpoint") == e).alias(e) for e in endpoints]
    return densify(rows.groupBy(*KEY).agg(*counts), seconds)


def _labels(rows: DataFrame) -> list[Column]:
    """Labels of a window; logs without labels have none."""
    return [F.max(c).alias(c) for c in ("is_attack", "is_bot") if c in rows.columns]


def window_aggregates(log: DataFrame, seconds: int, *, series: Column | None = None,
                      measures: tuple[str, ...] = ALL_MEASURES) -> DataFrame:
    """The window table: one row per series and window, empty windows as 0.

    Measures that need their own pass (entropy, p95) are skipped unless asked
    for. Every group is pre-aggregated before its shuffle.
    """
    rows = assign_windows(log, seconds, series)
    cols = set(rows.columns)
    n = F.count("*")
    aggs: list[Column] = [n.alias("request_count")]
    derived: dict[str, Column] = {}
    count = F.col("request_count")
    if "distinct" in measures:
        aggs += [F.count_distinct("user_id").alias("unique_users"), F.count_distinct("ip").alias("unique_ips")]
        if "user_agent" in cols:
            aggs.append(F.count_distinct("user_agent").alias("user_agent_diversity"))
        derived["ip_concentration"] = count / (F.col("unique_ips") + 1)
        derived["user_concentration"] = count / (F.col("unique_users") + 1)
    if "latency" in measures:
        aggs += [F.avg("response_time").alias("avg_response_time"),
                 F.stddev_samp("response_time").alias("response_time_std")]
    if "ratios" in measures:
        aggs += [F.count_if(F.col("status_code") >= 400).alias("errors"),
                 F.count_if(F.col("endpoint") == "/api/checkout").alias("checkouts"),
                 F.count_if(F.col("endpoint") == "/api/payment").alias("payments")]
        derived["error_rate"] = F.col("errors") / (count + 1)
        derived["checkout_ratio"] = F.col("checkouts") / (count + 1)
        derived["payment_ratio"] = F.col("payments") / (count + 1)
        if "is_bot" in cols:
            aggs.append(F.count_if(F.col("is_bot") == 1).alias("bots"))
            derived["bot_ratio"] = F.col("bots") / (count + 1)
    if "labels" in measures:
        aggs += _labels(rows)
    table = rows.groupBy(*KEY).agg(*aggs)
    if "entropy" in measures:
        table = table.join(path_entropy(rows), KEY, "left")
    if "p95" in measures:
        table = table.join(exact_quantiles(rows, KEY, "response_time", {"p95_response_time": 0.95}), KEY, "left")
    return densify(table, seconds).withColumns(derived)


def simple_window_features(log: DataFrame, seconds: int, *, series: Column | None = None,
                           since: DataFrame | None = None) -> DataFrame:
    """Reduced window table: error rate over the plain count, no distinct users.

    ``since`` as for ``dense_grid``; requests of earlier windows are left out.
    """
    rows = assign_windows(log, seconds, series)
    if since is not None:
        known = since.select(SERIES, "_from")
        rows = rows.join(known, SERIES, "left").where(F.col(NO) >= F.coalesce("_from", NO)).drop("_from")
    table = densify(
        rows.groupBy(*KEY).agg(
            F.count("user_id").alias("request_count"),
            F.count_distinct("ip").alias("unique_ips"),
            F.count_if(F.col("status_code") >= 400).alias("errors"),
            F.avg("response_time").alias("avg_response_time"),
            *_labels(rows)),
        seconds, since=since)
    hour = F.hour(START)
    return table.withColumns({
        "error_rate": safe_ratio(F.col("errors"), F.col("request_count")),
        "ip_concentration": F.col("request_count") / (F.col("unique_ips") + 1),
        "hour": hour,
        "is_business_hours": indicator(hour.between(9, 17)),
    })


def user_share(log: DataFrame, seconds: int, *, by: str = "user_id", series: Column | None = None) -> DataFrame:
    """Requests of each user (or ip) per window and the share of the window total."""
    rows = assign_windows(log, seconds, series)
    per_user = rows.groupBy(*KEY, by).agg(
        F.count("*").alias("user_requests"),
        F.count_if(F.col("status_code") >= 400).alias("user_errors"),
        (F.max("is_bot") if "is_bot" in rows.columns else F.lit(0)).alias("is_bot"))
    totals = per_user.groupBy(*KEY).agg(
        F.sum("user_requests").alias("total_requests"), F.sum("user_errors").alias("total_errors"))
    return per_user.join(totals, KEY).withColumns({
        START: window_start(F.col(NO), seconds),
        "user_ratio": F.col("user_requests") / F.col("total_requests"),
        "error_rate": F.col("total_errors") / F.col("total_requests"),
    })


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Counts per value of each column, in long form."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_x"))
    return long.select("_x.*").groupBy("column", "value").agg(F.count("*").alias("count"))


def feature_summary(table: DataFrame, features: list[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max per feature, in long form."""
    long = table.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("_x")
    ).select("_x.*")
    basics = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = exact_quantiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basics.join(quartiles, "feature")


def attack_rate(table: DataFrame) -> DataFrame:
    return table.agg(
        F.sum("is_attack").cast("bigint").alias("attack_windows"),
        F.count("*").alias("windows"),
        or_zero(F.avg("is_attack")).alias("attack_rate"))
