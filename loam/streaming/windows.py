"""Event-time windows over telemetry, rate limits and deduplication. Each works on a stream and on a batch alike unless its
name says otherwise; a stream drops rows that come later than its watermark, which the batch twin counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loam.operators.telemetry import with_percentiles


def request_windows(requests: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(t, requests, server_errors, client_errors, p95_ms): tumbling windows; the percentile is the exact discrete one.

    On a stream the state of a window is one row with how often each duration came; where a window has too many different
    ones for that, stream ``duration_counts`` and finish them by ``of_counts``."""
    if not requests.isStreaming:
        return of_counts(duration_counts(requests, width))
    return requests.withWatermark("created_at", late).groupBy(F.window("created_at", width)).agg(*_statuses(), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").alias("p95_ms")).select(F.col("window.start").alias("t"), *REQUESTS, "p95_ms")


REQUESTS = ("requests", "server_errors", "client_errors")


def _statuses() -> list[Column]:
    status = F.col("status_code")
    return [F.count("*").alias("requests"), F.count_if(status >= 500).alias("server_errors"), F.count_if((status >= 400) & (status < 500)).alias("client_errors")]


def duration_counts(requests: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(t, duration_ms, requests, server_errors, client_errors): a row for each duration of a window."""
    rows = requests.withWatermark("created_at", late) if requests.isStreaming else requests
    return rows.groupBy(F.window("created_at", width), "duration_ms").agg(*_statuses()).select(F.col("window.start").alias("t"), "duration_ms", *REQUESTS)


def of_counts(counts: DataFrame) -> DataFrame:
    """The rows of ``request_windows``, of its ``duration_counts``."""
    groups = counts.groupBy("t").agg(*(F.sum(c).alias(c) for c in REQUESTS))
    return with_percentiles(groups, counts, ["t"], "duration_ms", {"p95_ms": 0.95}, discrete=True, times="requests")


def fixed_rate(requests: DataFrame, limit: int, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(key, t, seen, rejected): requests (key, created_at) in fixed windows, those above the limit rejected."""
    rows = requests.withWatermark("created_at", late) if requests.isStreaming else requests
    counts = rows.groupBy("key", F.window("created_at", width)).agg(F.count("*").alias("seen"))
    return counts.select("key", F.col("window.start").alias("t"), "seen", F.greatest(F.col("seen") - limit, F.lit(0)).alias("rejected"))


DECIDED = "key long, request_id long, created_at timestamp, allowed boolean"


def _decide(kept: list[float], times: list[float], limit: int, seconds: float) -> list[bool]:
    """Whether each request, in order, finds fewer than ``limit`` accepted ones in the window before it; ``kept`` is changed."""
    out = []
    for t in times:
        while kept and kept[0] <= t - seconds:
            kept.pop(0)
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def sliding_rate_stream(requests: DataFrame, limit: int, seconds: float = 60.0, late: str = "5 minutes") -> DataFrame:
    """Exact sliding limit on a stream (key, request_id, created_at): state holds the accepted times of the last window of
    each key, at most ``limit`` of them; it goes when the watermark has passed the window."""

    def task(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["created_at", "request_id"])
        times = [t.timestamp() for t in frame.created_at]
        allowed = _decide(kept, times, limit, seconds)
        state.update((kept,))
        state.setTimeoutTimestamp(max(int((times[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield frame.assign(allowed=allowed)[["key", "request_id", "created_at", "allowed"]]

    rows = requests.withWatermark("created_at", late).select("key", "request_id", "created_at")
    return rows.groupBy("key").applyInPandasWithState(task, DECIDED, "accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def sliding_rate(requests: DataFrame, limit: int, seconds: float = 60.0) -> DataFrame:
    """Batch twin. A decision depends on those before it, so rows run in order of time within a key; a pause of a whole
    window starts afresh, so a busy key is dealt to several tasks at its pauses. Pauses are found within a key's hours (or
    windows, if longer) and stitched at their ends by one row an hour. Rows stream through a task in sorted batches, and only
    the accepted times of one window are kept."""
    at = F.col("created_at").cast("double")
    timed = requests.select("key", "request_id", "created_at", at.alias("at"), F.floor(at / max(seconds, 3600.0)).alias("slot"))
    slots = timed.groupBy("key", "slot").agg(F.max("at").alias("last"))
    by_slot = Window.partitionBy("key").orderBy("slot")
    inside = Window.partitionBy("key", "slot").orderBy("created_at", "request_id")
    joined = timed.join(slots.select("key", "slot", F.lag("last").over(by_slot).alias("earlier")), ["key", "slot"])
    before = F.coalesce(F.lag("at").over(inside), "earlier")
    begun = joined.withColumn("begin", F.when(before.isNull() | (F.col("at") - before >= seconds), F.col("at")))
    latest = begun.groupBy("key", "slot").agg(F.max("begin").alias("begin"))
    carried = latest.select("key", "slot", F.max("begin").over(by_slot.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    stretched = begun.join(carried, ["key", "slot"]).select("key", "request_id", "created_at", F.coalesce(F.max("begin").over(inside), "carried").alias("stretch"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, own = [], None
        for frame in frames:
            allowed = []
            for key, stretch, at in zip(frame.key, frame.stretch, frame.created_at, strict=True):
                if (key, stretch) != own:
                    kept, own = [], (key, stretch)
                allowed += _decide(kept, [at.timestamp()], limit, seconds)
            yield frame.assign(allowed=allowed)[["key", "request_id", "created_at", "allowed"]]

    return stretched.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "created_at", "request_id").mapInPandas(work, DECIDED)


def inbox(notifications: DataFrame, keys: tuple[str, ...] = ("provider", "subscription_id", "payload_hash"), late: str = "1 hour") -> DataFrame:
    """Notifications once by their keys: on a stream within the watermark, in a batch the earliest."""
    if notifications.isStreaming:
        return notifications.withWatermark("received_at", late).dropDuplicatesWithinWatermark(list(keys))
    order = Window.partitionBy(*keys).orderBy("received_at", "notification_id")
    return notifications.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def fan_out(events: DataFrame, works: dict[str, list[str]], late: str = "1 hour") -> DataFrame:
    """(event_id, work, article_id): every event once, with each kind of work its type asks for."""
    once = events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    kinds: Any = F.array().cast("array<string>")
    for name, work in works.items():
        kinds = F.when(F.col("event_type") == name, F.array(*(F.lit(w) for w in work))).otherwise(kinds)
    return once.select("event_id", F.explode(kinds).alias("work"), "article_id")
