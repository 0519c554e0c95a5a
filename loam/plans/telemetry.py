"""Telemetry reports on ``events`` as requests: the type is the route, value the duration, errors are failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import telemetry as t
from loam.plans.registry import query
from loam.sources.tables import table

NOW = "2024-01-31 00:00:00"
HOURS = 168

REQUESTS = """
requests AS (SELECT event_id AS request_id, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
  CASE WHEN event_type = 'view' AND user_id % 7 = 0 THEN '/health/ready' ELSE '/' || event_type || '/' || CAST(user_id % 3 AS VARCHAR) END AS path,
  CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 404 WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
  CASE WHEN event_type = 'error' THEN 'E' || CAST(user_id % 2 AS VARCHAR) END AS error_type,
  value AS duration_ms, user_id, ts AS created_at FROM events)"""
WINDOW = f"""{REQUESTS}, seen AS (SELECT * FROM requests WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR
  AND created_at < TIMESTAMP '{NOW}' AND NOT starts_with(path, '/health'))"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.when(user % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.when((kind == "view") & (user % 7 == 0), "/health/ready").otherwise(F.concat(F.lit("/"), kind, F.lit("/"), (user % 3).cast("string"))).alias("path"),
        F.when((kind == "error") & (user % 3 == 0), 404).when(kind == "error", 500).otherwise(200).alias("status_code"),
        F.when(kind == "error", F.concat(F.lit("E"), (user % 2).cast("string"))).alias("error_type"),
        F.col("value").alias("duration_ms"), "user_id", F.col("ts").cast("timestamp").alias("created_at"),
    )


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


def since() -> F.Column:
    return now() - F.expr(f"INTERVAL {HOURS} HOURS")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("g10_request_totals", f"""
WITH {REQUESTS}, seen AS (SELECT *, CASE WHEN created_at >= TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR THEN 'now' ELSE 'before' END AS side
  FROM requests WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL {2 * HOURS} HOUR AND created_at < TIMESTAMP '{NOW}' AND NOT starts_with(path, '/health')),
s AS (SELECT side, count(*) AS n, count(*) FILTER (status_code >= 500) AS e5, count(*) FILTER (status_code BETWEEN 400 AND 499) AS e4,
  quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99 FROM seen GROUP BY side),
w AS (SELECT coalesce(max(n) FILTER (side = 'now'), 0) AS n1, coalesce(max(n) FILTER (side = 'before'), 0) AS n0,
  coalesce(max(e5) FILTER (side = 'now'), 0) AS a1, coalesce(max(e5) FILTER (side = 'before'), 0) AS a0,
  coalesce(max(e4) FILTER (side = 'now'), 0) AS b1, coalesce(max(e4) FILTER (side = 'before'), 0) AS b0,
  max(p50) FILTER (side = 'now') AS p501, max(p50) FILTER (side = 'before') AS p500, max(p95) FILTER (side = 'now') AS p951,
  max(p95) FILTER (side = 'before') AS p950, max(p99) FILTER (side = 'now') AS p991, max(p99) FILTER (side = 'before') AS p990 FROM s),
r AS (SELECT *, CASE WHEN n1 > 0 THEN round_even(a1 / n1 * 100.0, 2) ELSE 0.0 END AS r1, CASE WHEN n0 > 0 THEN round_even(a0 / n0 * 100.0, 2) ELSE 0.0 END AS r0 FROM w),
d AS (SELECT *, CASE WHEN n1 > 0 AND n0 > 0 THEN round_even(r1 - r0, 2) END AS pp FROM r)
SELECT n1 AS now_requests, a1 AS now_server_errors, b1 AS now_client_errors, round(p501, 6) AS now_p50_ms, round(p951, 6) AS now_p95_ms, round(p991, 6) AS now_p99_ms,
  r1 AS now_error_rate, n0 AS before_requests, a0 AS before_server_errors, b0 AS before_client_errors, round(p500, 6) AS before_p50_ms, round(p950, 6) AS before_p95_ms,
  round(p990, 6) AS before_p99_ms, r0 AS before_error_rate, CASE WHEN n0 <> 0 THEN round_even((n1 - n0) / n0 * 100.0, 1) END AS requests_pct, pp AS error_rate_pp,
  CASE WHEN p950 <> 0 THEN round_even((p951 - p950) / p950 * 100.0, 1) END AS p95_pct,
  CASE WHEN n1 >= 20 AND r1 >= 5 THEN 'critical' WHEN n1 >= 20 AND (r1 >= 1 OR coalesce(pp >= 2, false) OR coalesce(p951 >= 3000, false)) THEN 'warning' ELSE 'ok' END AS level,
  concat_ws(',', CASE WHEN n1 >= 20 AND r1 >= 5 THEN 'error_rate_critical' WHEN n1 >= 20 AND r1 >= 1 THEN 'error_rate_high' END,
    CASE WHEN n1 >= 20 AND pp >= 2 THEN 'error_rate_rising' END, CASE WHEN n1 >= 20 AND p951 >= 3000 THEN 'latency_high' END, CASE WHEN n1 = 0 THEN 'no_traffic' END) AS reasons
FROM d""")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.request_totals(requests(spark, sf_dir), now(), HOURS)
    return rounded(found, *(f"{s}_{p}_ms" for s in ("now", "before") for p in ("p50", "p95", "p99")))


@query("g11_request_series", f"""
WITH {WINDOW}, c AS (SELECT CAST(floor(epoch(created_at) / 10800) AS BIGINT) AS b, count(*) AS n, count(*) FILTER (status_code >= 500) AS e5,
  count(*) FILTER (status_code BETWEEN 400 AND 499) AS e4, quantile_cont(duration_ms, 0.95) AS p FROM seen GROUP BY 1),
s AS (SELECT unnest(generate_series(CAST(floor(epoch(TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR) / 10800) AS BIGINT), CAST(floor(epoch(TIMESTAMP '{NOW}') / 10800) AS BIGINT))) AS b)
SELECT make_timestamp(CAST(s.b * 10800 * 1000000 AS BIGINT)) AS t, coalesce(n, 0) AS requests, coalesce(e5, 0) AS server_errors, coalesce(e4, 0) AS client_errors, round(p, 6) AS p95_ms
FROM s LEFT JOIN c USING (b)""")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rounded(t.request_series(requests(spark, sf_dir), now(), HOURS), "p95_ms")
    return found.withColumn("t", F.col("t").cast("timestamp_ntz"))


@query("g12_failure_groups", f"""
WITH {WINDOW} SELECT method, path, status_code, error_type, count(*) AS count, min(created_at) AS first_seen, max(created_at) AS last_seen,
  arg_max(request_id, (created_at, request_id)) AS sample_request_id FROM seen WHERE status_code >= 500 GROUP BY 1, 2, 3, 4
ORDER BY count DESC, last_seen DESC, method, path LIMIT 10""")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.failure_groups(requests(spark, sf_dir), since(), now())
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


@query("g13_slow_routes", f"""
WITH {WINDOW}, g AS (SELECT method, path, count(*) AS requests, quantile_cont(duration_ms, 0.95) AS p, avg(duration_ms) AS a, count(*) FILTER (status_code >= 500) AS e
  FROM seen GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT method, path, requests, round(p, 6) AS p95_ms, round(a, 6) AS avg_ms, round_even(e / requests * 100.0, 2) AS error_rate FROM g ORDER BY p DESC, method, path LIMIT 10""")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(t.slow_routes(requests(spark, sf_dir), since(), now()), "p95_ms", "avg_ms")


USAGE = """usage AS (SELECT event_type AS llm_model, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens_used, value AS latency_ms, user_id % 4 = 0 AS cache_hit, ts AS created_at FROM events)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("llm_model"), F.get_json_object("props", "$.k").cast("long").alias("tokens_used"), F.col("value").alias("latency_ms"),
        (F.col("user_id") % 4 == 0).alias("cache_hit"), F.col("ts").cast("timestamp").alias("created_at"),
    )


@query("g14_ai_usage", f"""
WITH {USAGE} SELECT llm_model, count(*) AS requests, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS tokens, round(avg(latency_ms), 6) AS avg_ms,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round_even(count(*) FILTER (cache_hit) / count(*) * 100.0, 2) AS cache_hit_rate
FROM usage WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR AND created_at < TIMESTAMP '{NOW}' GROUP BY 1""")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(t.ai_usage(usage(spark, sf_dir), since(), now()), "avg_ms", "p95_ms")


@query("g14_ai_usage_series", f"""
WITH {USAGE}, c AS (SELECT CAST(floor(epoch(created_at) / 10800) AS BIGINT) AS b, count(*) AS n, sum(tokens_used) AS k FROM usage
  WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR AND created_at < TIMESTAMP '{NOW}' GROUP BY 1),
s AS (SELECT unnest(generate_series(CAST(floor(epoch(TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR) / 10800) AS BIGINT), CAST(floor(epoch(TIMESTAMP '{NOW}') / 10800) AS BIGINT))) AS b)
SELECT make_timestamp(CAST(s.b * 10800 * 1000000 AS BIGINT)) AS t, coalesce(n, 0) AS requests, CAST(coalesce(k, 0) AS BIGINT) AS tokens FROM s LEFT JOIN c USING (b)""")
def g14_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.ai_usage_series(usage(spark, sf_dir), now(), HOURS).withColumn("t", F.col("t").cast("timestamp_ntz"))


JOBS = """jobs AS (SELECT event_id AS job_id, 'queue' || CAST(user_id % 5 AS VARCHAR) AS queue,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'completed' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'queued' ELSE 'completed' END AS status,
  CAST(user_id % 4 AS INTEGER) AS attempts, ts AS created_at, props FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.concat(F.lit("queue"), (F.col("user_id") % 5).cast("string")).alias("queue"),
        F.when(kind == "error", "failed").when(kind == "click", "running").when(kind == "signup", "queued").otherwise("completed").alias("status"),
        (F.col("user_id") % 4).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("props").alias("error"),
    )


@query("g15_pipeline_report", f"""
WITH {JOBS} SELECT queue, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'failed') AS failed, min(created_at) FILTER (status = 'queued') AS oldest_waiting, count(*) AS total,
  concat_ws(',', CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed_jobs' END, CASE WHEN count(*) FILTER (status = 'queued') > 0 THEN 'jobs_waiting' END) AS attention
FROM jobs GROUP BY queue""")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.pipeline_report(jobs(spark, sf_dir), ("queued", "running", "completed", "failed"))
    return found.withColumn("oldest_waiting", F.col("oldest_waiting").cast("timestamp_ntz"))


@query("g15_recent_failures", f"""
WITH {JOBS} SELECT queue, job_id, props AS error, CAST(row_number() OVER (PARTITION BY queue ORDER BY created_at DESC, job_id) AS INTEGER) AS rank
FROM jobs WHERE status = 'failed' QUALIFY rank <= 5""")
def g15_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.recent_failures(jobs(spark, sf_dir)).select("queue", "job_id", "error", "rank")


@query("g16_find_failures", f"""
WITH {REQUESTS} SELECT request_id, method, path, status_code, error_type FROM requests
WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR AND created_at < TIMESTAMP '{NOW}' AND status_code >= 400 AND contains(lower(path), 'error') AND method = 'POST'
ORDER BY created_at DESC, request_id LIMIT 50""")
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.find_failures(requests(spark, sf_dir), since(), now(), path="ERROR", method="POST")
    return found.select("request_id", "method", "path", "status_code", "error_type")


@query("f17_route_metrics", f"""
WITH {REQUESTS} SELECT method, regexp_replace(path, '/[0-9]+$', '/:id') AS route, status_code, count(*) AS requests, round(sum(duration_ms), 4) AS duration_ms FROM requests GROUP BY 1, 2, 3""")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.route_metrics(requests(spark, sf_dir)).withColumn("duration_ms", F.round("duration_ms", 4))


@query("g29_retention", f"""
WITH {REQUESTS}, {JOBS}
SELECT 'requests' AS "table", count(*) AS rows FROM requests WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY
UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE status IN ('failed', 'completed') AND created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY
UNION ALL SELECT 'usage', count(*) FROM events WHERE user_id % 10 <> 0 AND ts < TIMESTAMP '{NOW}' - INTERVAL 20 DAY""")
def g29(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = lambda n: F.col("created_at") + F.expr(f"INTERVAL {n} DAYS")
    used = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("created_at"))
    rated = used.where("user_id % 10 = 0").select("user_id").distinct()  # usage rows stay while feedback on them exists
    tables = {"requests": requests(spark, sf_dir), "jobs": jobs(spark, sf_dir), "usage": used.join(rated, "user_id", "left_anti")}
    rules = {"requests": (F.lit(True), days(14)), "jobs": (F.col("status").isin("failed", "completed"), days(7)), "usage": (F.lit(True), days(20))}
    return t.retention(tables, rules, now())


@query("g31_stuck_jobs", f"""
WITH {JOBS}, a AS (SELECT job_id, status, attempts, (epoch(TIMESTAMP '{NOW}') - floor(epoch(created_at))) / 60 AS age FROM jobs),
b AS (SELECT *, CASE WHEN status = 'running' AND age > 60 THEN CASE WHEN attempts + 1 >= 3 THEN 'fail' ELSE 'requeue' END WHEN status = 'queued' AND age > 30 THEN 'stalled' END AS action FROM a)
SELECT job_id, action, CAST(attempts + CASE WHEN action = 'requeue' THEN 1 ELSE 0 END AS INTEGER) AS next_attempts FROM b WHERE action IS NOT NULL""")
def g31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.stuck_jobs(jobs(spark, sf_dir), now()).select("job_id", "action", "next_attempts")


@query("g32_quota_use", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS used,
  used > 3 AS over FROM events""")
def g32(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("created_at"))
    return t.quota_use(writes, 3).select("event_id", "used", "over")
