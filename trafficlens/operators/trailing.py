"""Statistics over the trailing window of every request, in event time.

For each request at time t the features describe the requests in
``(t - width, t]`` of its series. A sliding frame would be re-aggregated for
every row; instead each request adds to running sums when it enters and
subtracts when it leaves, so the work is one ordered pass. The other columns of
a request travel with its entry alone.

* count, errors and response time: ``+`` at t, ``-`` at t + width;
* distinct users and ips: a request stands for its user from the moment the
  user's previous request has left until it leaves itself.

A user or ip is cut into time chunks; an entry that is still inside at the start
of a chunk is repeated there. The sums of a series run over slices far shorter
than the window. What earlier slices leave enters a slice as one seed row, so a
minute with most of the traffic is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.chunks import CHUNK, sliced_sum
from ..functions.columns import floor_div, indicator, micros, safe_ratio
from ..session import materialize
from .windows import SERIES

US = 1_000_000
#: Slices of a series per width, and widths that a chunk of one user or ip spans.
SLICES, CHUNK_WIDTHS = 64, 2


def _slice(width: int) -> int:
    return max(1, width // SLICES)


def _events(df: DataFrame, **times: Column) -> DataFrame:
    """One row per event (``_at``, ``_kind``) of each row; null times are none."""
    events = [F.struct(at.alias("at"), F.lit(kind).alias("kind")) for kind, at in times.items()]
    rows = df.withColumn("_e", F.explode(F.filter(F.array(*events), lambda e: e.at.isNotNull())))
    return rows.withColumns({"_at": F.col("_e.at"), "_kind": F.col("_e.kind")}).drop("_e")


def _light(rows: DataFrame, full: Column, *read: str) -> DataFrame:
    """Keep the columns that all rows are ``read`` for; ``_rest`` has the others, on the ``full`` rows only."""
    return rows.select(*read, F.when(full, F.struct(*[c for c in rows.columns if c not in read])).alias("_rest"))


def _key_statistics(df: DataFrame, key: str, width: int) -> DataFrame:
    """Add ``<key>_from`` (start as the key's representative) and the key's own count."""
    size = CHUNK_WIDTHS * width
    t, gone = F.col("_t"), F.col("_exit")
    rows = _events(df, **{"in": t, "out": gone})
    # of an entry whose exit lies in a later chunk, both events are repeated there
    own = floor_div(F.col("_at"), size)
    rows = rows.withColumn(CHUNK, F.explode(F.sequence(own, floor_div(gone, size))))
    entered = F.col("_kind") == "in"
    rows = _light(rows, entered & (F.col(CHUNK) == own), SERIES, key, "request_id", "_t", "_exit",
                  "_at", "_kind", CHUNK)
    chunk = Window.partitionBy(SERIES, key, CHUNK)
    previous = F.last(F.when(entered, gone), ignorenulls=True).over(
        chunk.orderBy("_at", F.desc("_kind"), "request_id").rowsBetween(Window.unboundedPreceding, -1))
    so_far = chunk.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    start = F.greatest(t, previous)
    return rows.withColumns({
        f"{key}_from": F.when(entered, F.when(start < gone, start)),
        f"{key}_requests": F.sum(F.when(entered, 1).otherwise(-1)).over(so_far),
    }).where("_rest is not null").select("*", "_rest.*").drop("_at", "_kind", CHUNK, "_rest")


def _exits(rows: DataFrame, width: int, max_rows: int | None) -> DataFrame:
    """Add ``_exit``: when a request leaves the window.

    With ``max_rows`` it also leaves when that many newer requests have
    arrived: the arrival of the row ``max_rows`` positions later, found by an
    equi-join on dense positions.
    """
    rows = rows.withColumn("_exit", F.col("_t") + width)
    if max_rows is None:
        return rows
    placed = sliced_sum(rows, [SERIES], "_t", _slice(width), {"_position": F.lit(1)}, order=["_t", "request_id"])
    pushing = placed.select(SERIES, (F.col("_position") - max_rows).alias("_position"), F.col("_t").alias("_pushed"))
    return placed.join(pushing, [SERIES, "_position"], "left").withColumn(
        "_exit", F.least("_exit", "_pushed")).drop("_position", "_pushed")


def trailing_features(log: DataFrame, seconds: int = 60, *, max_rows: int | None = None,
                      default_latency: float = 100.0) -> DataFrame:
    """Per request: count, distinct users and ips, error rate, mean latency,
    counts of its own user and ip, and requests per ip over ``(t - width, t]``.
    What users and ips contribute is written once to the shared folder.

    ``max_rows`` limits the window to its newest requests, as an online
    gateway with a bounded buffer sees it (10,000 there).
    """
    width = seconds * US
    rows = log if SERIES in log.columns else log.withColumn(SERIES, F.lit("all"))
    rows = _exits(rows.withColumn("_t", micros(F.col("ts"))), width, max_rows)
    rows = _key_statistics(_key_statistics(rows, "user_id", width), "ip", width)
    rows = materialize(rows, "trailing")  # totals, seeds and rows of the slices read it

    def later(start):
        return F.when(F.col(start) > F.col("_t"), F.col(start))  # one that starts on entering needs no event of its own

    rows = _events(rows, **{"in": F.col("_t"), "out": F.col("_exit"), "user": later("user_id_from"), "ip": later("ip_from")})
    kind = F.col("_kind")
    rows = _light(rows, kind == "in", SERIES, "_at", "_kind", "_t", "status_code", "response_time", "user_id_from", "ip_from")
    sign = F.when(kind == "in", 1).when(kind == "out", -1).otherwise(0)
    error = indicator(F.col("status_code") >= 400)
    exact = F.col("response_time").cast("decimal(38,12)")

    def distinct(name, start):
        return F.when((kind == name) | ((kind == "in") & (F.col(start) == F.col("_t"))), 1).when((kind == "out") & F.col(start).isNotNull(), -1).otherwise(0)

    rows = sliced_sum(rows, [SERIES], "_at", _slice(width), {
        "request_count": sign,
        "_errors": sign * error,
        # exact sums: what leaves the window takes away just what it added
        "_latency": F.when(kind == "in", exact).when(kind == "out", -exact),
        "unique_users": distinct("user", "user_id_from"),
        "unique_ips": distinct("ip", "ip_from"),
    }).where(kind == "in").select("*", "_rest.*").drop("_rest")
    n, hour = F.col("request_count"), F.hour("ts")
    return rows.withColumns({
        "error_rate": safe_ratio(F.col("_errors"), n),
        "avg_response_time": F.coalesce(F.try_divide(F.col("_latency").cast("double"), n.cast("double")), F.lit(default_latency)),
        "user_request_count": F.col("user_id_requests"),
        "ip_request_count": F.col("ip_requests"),
        "ip_concentration": safe_ratio(n, F.col("unique_ips")),
        "hour": hour,
        "is_business_hours": indicator(hour.between(9, 17)),
    }).drop("_at", "_kind", "_t", "_exit", "_errors", "_latency",
            "user_id_from", "ip_from", "user_id_requests", "ip_requests")


def live_stats(log: DataFrame, seconds: int = 60) -> DataFrame:
    """Rows, users and ips in the last ``seconds`` before the newest request."""
    newest = log.agg(F.max("ts").alias("m")).scalar()
    recent = log.where(F.col("ts") > newest - F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    return recent.agg(
        F.count("*").alias("requests_in_window"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("ip").alias("unique_ips"))
