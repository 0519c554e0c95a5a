"""Reports on request and AI-usage telemetry, queues, retention and stuck work. Windows are half-open: [since, until)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
BUCKETS = (60, 300, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400)
MAX_POINTS, MAX_HOURS, TOP = 72, 168, 10
LEAST_REQUESTS, ERROR_TEXT = 5, 300
PROBES = ("/health", "/livez", "/metrics")
CRITICAL_RATE, WARNING_RATE, WARNING_P95, WARNING_RISE, LEAST_FOR_VERDICT = 5.0, 1.0, 3000.0, 2.0, 20


def bucket_width(hours: int) -> int:
    """The smallest width in seconds that shows a window in at most 72 points."""
    return next((w for w in BUCKETS if max(1, hours) * 3600 / w <= MAX_POINTS), BUCKETS[-1])


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """Half-even rounded percentage; 0 of an empty whole."""
    return F.when(whole > 0, F.bround(part / whole * 100.0, places)).otherwise(F.lit(0.0))


def change(now: Column, before: Column) -> Column:
    """Relative change in percent, null where there is nothing to compare with."""
    return F.when(before != 0, F.bround((now - before) / before * 100.0, 1))


def in_window(requests: DataFrame, since: Column, until: Column) -> DataFrame:
    """Requests of the window that aren't probes."""
    probe = F.lit(False)
    for prefix in PROBES:
        probe = probe | F.col("path").startswith(prefix)
    return requests.where((F.col("created_at") >= since) & (F.col("created_at") < until) & ~F.coalesce(probe, F.lit(False)))


def _rates() -> list[Column]:
    return [
        F.count("*").alias("requests"),
        F.count_if(F.col("status_code") >= 500).alias("server_errors"),
        F.count_if((F.col("status_code") >= 400) & (F.col("status_code") < 500)).alias("client_errors"),
    ]


def percentiles(rows: DataFrame, keys: list[str], value: str, places: dict[str, float], discrete: bool = False, times: str | None = None) -> DataFrame:
    """(keys, and a column for each of ``places``): exact percentiles, interpolated between neighbouring ranks or, if
    ``discrete``, the least value that so large a part of all doesn't exceed. ``times``: how often a row's value counts.

    Values are counted, first within ranges that grow with the value (some thousands in all), so that no task or buffer ever
    holds the values of a whole group: ranks are looked up in the ranges' running counts, and then in those ranges only.
    """
    n = F.count("*") if times is None else F.sum("n")
    named = rows.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("k"), F.col(value).cast("double").alias("v"), *([] if times is None else [F.col(times).alias("n")]))
    counts = named.withColumn("range", F.floor(F.signum("v") * F.log1p(F.abs("v")) * 64)).groupBy("k", "range", "v").agg(n.alias("n"))
    upto = Window.partitionBy("k").orderBy("range")
    sums = counts.groupBy("k", "range").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("end", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("k")))
    # a share is taken as the decimal it is written as: 0.95 of 20 is 19, whatever the next double is
    at = lambda q: F.greatest(F.ceil(F.col("all") * F.lit(Decimal(str(q)))).cast("long") - 1, F.lit(0))
    place = at if discrete else lambda q: (F.col("all") - 1) * F.lit(q)
    ranks = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), which(place(q)).cast("long").alias("rank"), place(q).alias("place")) for name, q in places.items() for side, which in (("low", F.floor), ("high", F.ceil))]
    here = F.filter(F.array(*ranks), lambda r: (r["rank"] < F.col("end")) & (r["rank"] >= F.col("end") - F.col("n")))
    asked = sums.select("k", "range", (F.col("end") - F.col("n")).alias("before"), here.alias("ranks")).where(F.size("ranks") > 0)
    inside = counts.join(asked, ["k", "range"]).withColumn("end", F.col("before") + F.sum("n").over(Window.partitionBy("k", "range").orderBy("v")))
    found = inside.select("k", "v", F.explode(F.filter("ranks", lambda r: (r["rank"] < F.col("end")) & (r["rank"] >= F.col("end") - F.col("n")))).alias("r")).select("k", "v", "r.*")
    pick = lambda name, side, c: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col(c)))
    per = found.groupBy("k").agg(*(pick(n, s, c).alias(f"{n}_{s}_{c}") for n in places for s, c in (("low", "v"), ("high", "v"), ("low", "rank"), ("high", "rank"), ("low", "place"))))

    def between(n: str) -> Column:
        low, high, at = F.col(f"{n}_low_v"), F.col(f"{n}_high_v"), F.col(f"{n}_low_place")
        return F.when(low == high, low).otherwise((F.col(f"{n}_high_rank") - at) * low + (at - F.col(f"{n}_low_rank")) * high).alias(n)

    return per.select("k.*", *(between(n) for n in places))


def with_percentiles(groups: DataFrame, rows: DataFrame, keys: list[str], value: str, places: dict[str, float], discrete: bool = False, times: str | None = None) -> DataFrame:
    """``groups`` (keys, ...), of ``rows``, with the percentiles of their values."""
    found = percentiles(rows, keys, value, places, discrete, times)
    for k in keys:
        found = found.withColumnRenamed(k, f"_{k}")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return groups.join(found, same, "left").drop(*(f"_{k}" for k in keys))


def request_totals(requests: DataFrame, until: Column, hours: int = 24) -> DataFrame:
    """One row: totals of the window and of the equal one before it, deltas, verdict level and reasons. One scan."""
    span = F.expr(f"INTERVAL {min(max(hours, 1), MAX_HOURS)} HOURS")
    rows = in_window(requests, until - span - span, until)
    rows = rows.withColumn("side", F.when(F.col("created_at") >= until - span, F.lit("now")).otherwise(F.lit("before")))
    each = with_percentiles(rows.groupBy("side").agg(*_rates()), rows, ["side"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}).withColumn("error_rate", percent(F.col("server_errors"), F.col("requests")))
    columns = ["requests", "server_errors", "client_errors", "p50_ms", "p95_ms", "p99_ms", "error_rate"]
    one = each.agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("now", "before") for c in columns))
    zero = [f"{s}_{c}" for s in ("now", "before") for c in ("requests", "server_errors", "client_errors", "error_rate")]
    one = one.fillna(0, zero)
    both = (F.col("now_requests") > 0) & (F.col("before_requests") > 0)
    one = one.withColumns({
        "requests_pct": change(F.col("now_requests"), F.col("before_requests")),
        "error_rate_pp": F.when(both, F.bround(F.col("now_error_rate") - F.col("before_error_rate"), 2)),
        "p95_pct": change(F.col("now_p95_ms"), F.col("before_p95_ms")),
    })
    enough = F.col("now_requests") >= LEAST_FOR_VERDICT
    rate, rise, slow = F.col("now_error_rate"), F.coalesce(F.col("error_rate_pp") >= WARNING_RISE, F.lit(False)), F.coalesce(F.col("now_p95_ms") >= WARNING_P95, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(enough & (rate >= CRITICAL_RATE), F.lit("error_rate_critical")).when(enough & (rate >= WARNING_RATE), F.lit("error_rate_high")),
        F.when(enough & rise, F.lit("error_rate_rising")), F.when(enough & slow, F.lit("latency_high")), F.when(F.col("now_requests") == 0, F.lit("no_traffic")),
    ))
    level = F.when(enough & (rate >= CRITICAL_RATE), "critical").when(enough & ((rate >= WARNING_RATE) | rise | slow), "warning").otherwise("ok")
    return one.withColumn("level", level).withColumn("reasons", F.array_join(reasons, ","))


def request_series(requests: DataFrame, until: Column, hours: int = 24, approximate: bool = False) -> DataFrame:
    """A row for each bucket of the window, empty ones included: bucket start, counts, p95.

    ``approximate`` takes a sketch for the percentile, which needs one pass less.
    """
    width, span = bucket_width(hours), F.expr(f"INTERVAL {hours} HOURS")
    index = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / width)
    rows = in_window(requests, until - span, until).withColumn("bucket", index(F.col("created_at")))
    if approximate:
        counts = rows.groupBy("bucket").agg(*_rates(), F.percentile_approx("duration_ms", F.lit(0.95)).alias("p95_ms"))
    else:
        counts = with_percentiles(rows.groupBy("bucket").agg(*_rates()), rows, ["bucket"], "duration_ms", {"p95_ms": 0.95})
    spine = requests.sparkSession.range(1).select(F.explode(F.sequence(index(until - span), index(until))).alias("bucket"))
    full = spine.join(counts, "bucket", "left").fillna(0, ["requests", "server_errors", "client_errors"])
    return full.select(F.timestamp_seconds(F.col("bucket") * width).alias("t"), "requests", "server_errors", "client_errors", "p95_ms")


def failure_groups(requests: DataFrame, since: Column, until: Column, least_status: int = 500, top: int = TOP) -> DataFrame:
    """The most frequent failures by (method, path, status, error): count, first and last seen, newest request."""
    rows = in_window(requests, since, until).where(F.col("status_code") >= least_status)
    groups = rows.groupBy("method", "path", "status_code", "error_type").agg(
        F.count("*").alias("count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        F.max_by("request_id", F.struct("created_at", "request_id")).alias("sample_request_id"),
    )
    return groups.orderBy(F.desc("count"), F.desc("last_seen"), "method", "path").limit(top)


def slow_routes(requests: DataFrame, since: Column, until: Column, top: int = TOP) -> DataFrame:
    """Routes of at least 5 requests by p95: requests, p95, average, server error percentage."""
    rows = in_window(requests, since, until)
    groups = rows.groupBy("method", "path").agg(F.count("*").alias("requests"), F.avg("duration_ms").alias("avg_ms"), F.count_if(F.col("status_code") >= 500).alias("errors"))
    groups = with_percentiles(groups, rows, ["method", "path"], "duration_ms", {"p95_ms": 0.95})
    kept = groups.where(F.col("requests") >= LEAST_REQUESTS).withColumn("error_rate", percent(F.col("errors"), F.col("requests")))
    return kept.drop("errors").orderBy(F.desc("p95_ms"), "method", "path").limit(top)


def ai_usage(usage: DataFrame, since: Column, until: Column) -> DataFrame:
    """Usage by model in the window: requests, tokens, average and p95 latency, cache-hit percentage, last seen."""
    rows = usage.where((F.col("created_at") >= since) & (F.col("created_at") < until))
    groups = rows.groupBy("llm_model").agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"), F.avg("latency_ms").alias("avg_ms"),
        F.count_if("cache_hit").alias("hits"),
    )
    groups = with_percentiles(groups, rows, ["llm_model"], "latency_ms", {"p95_ms": 0.95})
    return groups.withColumn("cache_hit_rate", percent(F.col("hits"), F.col("requests"))).drop("hits")


def ai_usage_series(usage: DataFrame, until: Column, hours: int = 24) -> DataFrame:
    """A row for each bucket of the window: AI requests and tokens, empty buckets included."""
    width, span = bucket_width(hours), F.expr(f"INTERVAL {hours} HOURS")
    index = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / width)
    rows = usage.where((F.col("created_at") >= until - span) & (F.col("created_at") < until))
    counts = rows.groupBy(index(F.col("created_at")).alias("bucket")).agg(F.count("*").alias("requests"), F.sum("tokens_used").alias("tokens"))
    spine = usage.sparkSession.range(1).select(F.explode(F.sequence(index(until - span), index(until))).alias("bucket"))
    full = spine.join(counts, "bucket", "left").fillna(0, ["requests", "tokens"])
    return full.select(F.timestamp_seconds(F.col("bucket") * width).alias("t"), "requests", "tokens")


def error_line(column: Column, width: int = ERROR_TEXT) -> Column:
    """An error message on one bounded line; null if nothing is left."""
    text = F.trim(F.regexp_replace(column, r"\s+", " "))
    return F.when(text != "", F.when(F.char_length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("…"))))


def pipeline_report(jobs: DataFrame, statuses: tuple[str, ...], waiting: tuple[str, ...] = ("queued", "pending")) -> DataFrame:
    """By queue: jobs of each status, oldest one waiting, failures, and attention codes.

    jobs (queue, status, created_at).
    """
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    per = jobs.groupBy("queue").agg(*counts, F.min(F.when(F.col("status").isin(*waiting), F.col("created_at"))).alias("oldest_waiting"), F.count("*").alias("total"))
    codes = F.array_compact(F.array(F.when(F.col("failed") > 0, F.lit("failed_jobs")), F.when(F.col("oldest_waiting").isNotNull(), F.lit("jobs_waiting"))))
    return per.withColumn("attention", F.array_join(codes, ","))


def recent_failures(jobs: DataFrame, top: int = 5) -> DataFrame:
    """The newest failed jobs of each queue, with their error on one line."""
    newest = Window.partitionBy("queue").orderBy(F.desc("created_at"), "job_id")
    ranked = jobs.where(F.col("status") == "failed").withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= top)
    return ranked.withColumn("error", error_line(F.col("error")))


def find_failures(requests: DataFrame, since: Column, until: Column, path: str | None = None, request_id: str | None = None, method: str | None = None, error_type: str | None = None, top: int = 50) -> DataFrame:
    """Failed requests by any of the filters, newest first."""
    rows = requests.where((F.col("created_at") >= since) & (F.col("created_at") < until) & (F.col("status_code") >= 400))
    if path:
        rows = rows.where(F.contains(F.lower("path"), F.lit(path.lower())))
    for column, value in (("request_id", request_id), ("method", method), ("error_type", error_type)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("created_at"), "request_id").limit(top)


def route_metrics(requests: DataFrame) -> DataFrame:
    """Counts and summed durations by (method, route, status); identifiers in a path become :id."""
    uuid = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    route = F.regexp_replace("path", rf"/({uuid}|[0-9]+)(?=/|$)", "/:id")
    return requests.groupBy("method", route.alias("route"), "status_code").agg(F.count("*").alias("requests"), F.sum("duration_ms").alias("duration_ms"))


def retention(tables: dict[str, DataFrame], rules: dict[str, tuple[Column, Column]], now: Column) -> DataFrame:
    """(table, rows) that each table's rule lets go: rules give (terminal condition, last date kept) by table."""
    counts = [df.where(rules[name][0] & (rules[name][1] < now)).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.union(other)
    return out


def stuck_jobs(jobs: DataFrame, now: Column, running_minutes: int = 60, queued_minutes: int = 30, most: int = 3) -> DataFrame:
    """Jobs that hang: running past the cutoff are requeued with one attempt more, or fail after ``most``; queued past
    theirs are stalled. jobs (job_id, status, attempts, updated_at)."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("updated_at")) / 60
    action = F.when(F.col("status").isin("processing", "running") & (age > running_minutes), F.when(F.col("attempts") + 1 >= most, "fail").otherwise("requeue")).when((F.col("status") == "queued") & (age > queued_minutes), "stalled")
    attempts = F.col("attempts") + F.when(action == "requeue", 1).otherwise(0)
    return jobs.withColumn("action", action).withColumn("next_attempts", attempts).where("action is not null")


def quota_use(writes: DataFrame, limit: int, seconds: int = 86400) -> DataFrame:
    """Every write with the user's writes in the 24 hours up to it and whether that passes the limit."""
    day = Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("created_at").cast("timestamp"))).rangeBetween(-seconds + 1, 0)
    return writes.withColumn("used", F.count("*").over(day)).withColumn("over", F.col("used") > limit)


def heat(requests: DataFrame) -> DataFrame:
    """Requests by weekday and hour."""
    return requests.groupBy(F.dayofweek("created_at").alias("weekday"), F.hour("created_at").alias("hour")).agg(F.count("*").alias("requests"))
