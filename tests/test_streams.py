"""Streams from files, run to their end, against their batch twins."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loam.streaming import folds as f
from loam.streaming import windows as w

START = datetime(2024, 1, 1)


def made(spark, path, n=200):
    """Requests of three keys in five files, in order of time."""
    rng = random.Random(2)
    rows, at = [], START
    for i in range(n):
        at += timedelta(seconds=rng.randint(1, 40))
        rows.append((i, rng.choice("abc"), at, rng.choice([200, 200, 404, 500]), float(rng.randint(1, 900))))
    schema = "request_id long, key string, created_at timestamp, status_code int, duration_ms double"
    for k in range(5):
        spark.createDataFrame(rows[k * n // 5 : (k + 1) * n // 5], schema).coalesce(1).write.mode("append").parquet(path)
    rows.sort()
    return schema


def run(stream, tmp_path, mode="append", name="out"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_equal_their_batch_twin(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = made(spark, path)
    batch = {tuple(r) for r in w.request_windows(spark.read.parquet(path)).collect()}
    got = run(w.request_windows(source(spark, path, schema), late="30 days"), tmp_path, "complete", "windows")
    assert {tuple(r) for r in got.collect()} == batch


def test_fixed_rate_equals_its_batch_twin(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = made(spark, path)
    got = run(w.fixed_rate(source(spark, path, schema), 2, late="30 days"), tmp_path, "complete", "fixed")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in w.fixed_rate(spark.read.parquet(path), 2).collect()}


def brute(rows, limit, seconds):
    accepted, out = {}, set()
    for r in sorted(rows, key=lambda r: (r.created_at, r.request_id)):
        own = [t for t in accepted.get(r.key, []) if t > r.created_at - timedelta(seconds=seconds)]
        if len(own) < limit:
            own.append(r.created_at)
        else:
            out.add(r.request_id)
        accepted[r.key] = own
    return out


@pytest.mark.parametrize("limit", [1, 3])
def test_sliding_rate_is_exact(spark, tmp_path, limit):
    path = str(tmp_path / "in")
    made(spark, path)
    rows = spark.read.parquet(path)
    codes = rows.withColumn("key", F.ascii("key").cast("long"))
    got = w.sliding_rate(codes, limit, 60.0).collect()
    assert len(got) == rows.count()
    assert {r.request_id for r in got if not r.allowed} == brute(rows.collect(), limit, 60)


def test_sliding_rate_stream(spark, tmp_path):
    """All of a key's requests in the order of the files, which is the order of time: the stream decides as the batch."""
    path = str(tmp_path / "in")
    schema = made(spark, path)
    codes = lambda df: df.withColumn("key", F.ascii("key").cast("long"))
    files = sorted((spark.read.parquet(path).withColumn("f", F.input_file_name()).groupBy("f").agg(F.min("created_at").alias("t")).collect()), key=lambda r: r.t)
    for k, r in enumerate(files):
        spark.read.parquet(r.f).coalesce(1).write.mode("append").parquet(str(tmp_path / "ordered"))
    got = run(w.sliding_rate_stream(codes(source(spark, str(tmp_path / "ordered"), schema)), 2, 60.0, "1 day"), tmp_path, name="sliding")
    assert {r.request_id for r in got.collect() if not r.allowed} == brute(spark.read.parquet(path).collect(), 2, 60)


def test_inbox_stream(spark, tmp_path):
    rows = [(1, "p", "s", "h", START), (2, "p", "s", "h", START + timedelta(seconds=5)), (3, "p", "s", "x", START), (4, "q", "s", "h", START)]
    schema = "notification_id long, provider string, subscription_id string, payload_hash string, received_at timestamp"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    want = {1, 3, 4}
    assert {r.notification_id for r in w.inbox(spark.read.parquet(path)).collect()} == want
    assert len(run(w.inbox(source(spark, path, schema)), tmp_path, name="inbox").collect()) == len(want)


def test_fan_out(spark):
    events = spark.createDataFrame([(1, "publish", 7, START), (1, "publish", 7, START), (2, "other", 8, START)], "event_id long, event_type string, article_id long, created_at timestamp")
    assert sorted(map(tuple, w.fan_out(events, {"publish": ["index", "notify"]}).collect())) == [(1, "index", 7), (1, "notify", 7)]


GAP_STATE = "company_domain string, query string, count long, department string, status string, last_at timestamp"


def test_gaps_kept_by_foreach_batch(spark, tmp_path):
    schema = "gap_id long, company_domain string, query string, department string, created_at timestamp"
    rows = [(i, "d", f"q{i % 3}", None if i < 3 else f"dept{i}", START + timedelta(minutes=i)) for i in range(12)]
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(path)
    step = f.keep_state(state, GAP_STATE, f.merge_gaps)
    query = source(spark, path, schema).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = {r["query"]: (r["count"], r.status, r.last_at) for r in spark.read.parquet(f"{state}/batch=2").collect()}
    assert found == {f"q{j}": (4, "open", START + timedelta(minutes=9 + j)) for j in range(3)}


def test_gap_merge_keeps_department_and_status(spark):
    state = spark.createDataFrame([("d", "q", 2, "first", "resolved", START)], GAP_STATE)
    batch = spark.createDataFrame([(1, "d", "q", "second", START + timedelta(days=1)), (2, "d", "n", None, START)], "gap_id long, company_domain string, query string, department string, created_at timestamp")
    found = {r["query"]: tuple(r)[2:] for r in f.merge_gaps(state, batch).collect()}
    assert found == {"q": (3, "first", "resolved", START + timedelta(days=1)), "n": (1, None, "open", START)}


def test_change_fold(spark):
    state = spark.createDataFrame([(1, 1, 1, "active", "a", 0, None), (1, 1, 2, "active", "a", 0, None), (1, 1, 3, "active", "a", 0, None), (1, 1, 4, "active", "a", 2, "b")], f.STATE)
    schema = "connector_id long, corpus_id long, external_id long, state string, revision string, failed boolean, received_at timestamp, change_id long"
    change = lambda i, s, r, failed=False, at=0: (1, 1, i, s, r, failed, START + timedelta(minutes=at), at)
    rows = [change(1, "active", "a"), change(2, "active", "b"), change(2, "deleted", None, at=1), change(3, "active", "c"), change(4, "active", "b", True), change(5, "active", "a"), change(6, "deleted", "a"), change(7, "active", "z", True)]
    found = {r.external_id: (r.state, r.revision, r.failures, r.action) for r in f.fold_changes(state, spark.createDataFrame(rows, schema)).collect()}
    assert found == {
        1: ("active", "a", 0, "unchanged"), 2: ("deleted", "a", 0, "deleted"), 3: ("active", "c", 0, "updated"), 4: ("quarantined", "a", 3, "quarantined"),
        5: ("active", "a", 0, "imported"), 7: ("pending", None, 1, "skipped"),
    }


def test_release_lets_a_revision_be_tried_again(spark):
    state = spark.createDataFrame([(1, 1, 1, "quarantined", "a", 3, "b"), (1, 1, 2, "quarantined", "a", 3, "b")], f.STATE)
    free = f.released(state, spark.createDataFrame([(1, 1, 1)], "connector_id long, corpus_id long, external_id long"))
    assert sorted((r.external_id, r.state, r.failures, r.failed_revision) for r in free.collect()) == [(1, "pending", 0, None), (2, "quarantined", 3, "b")]


def test_full_walk(spark):
    state = spark.createDataFrame([(1, 1, i, "active", "a", 0, None) for i in range(3)], f.STATE)
    states = lambda walked: [r.state for r in f.full_walk(state, walked).orderBy("external_id").collect()]
    assert states(state.where("external_id <> 1")) == ["active", "deleted", "active"]
    assert states(state.where("false")) == ["active"] * 3


def test_due_backoff(spark):
    at = START
    rows = [(1, "pending", 0, None, at), (2, "pending", 5, None, at), (3, "pending", 1, at + timedelta(days=9), at), (4, "sent", 0, None, at), (5, "pending", 2, at, at - timedelta(days=3))]
    queue = spark.createDataFrame(rows, "event_id long, status string, attempts int, next_attempt_at timestamp, created_at timestamp")
    now = F.lit(START + timedelta(hours=1)).cast("timestamp")
    found = {r.event_id: (r.action, r.next_attempt_at) for r in f.due(queue, now, 100, 5, 60, 1800, 24).collect()}
    assert found == {1: ("send", START + timedelta(hours=1, minutes=2)), 2: ("dead", None), 5: ("dead", None)}


def test_requests_are_coalesced(spark):
    schema = "connector_id long, scope string, priority int, available_at timestamp, reason string, requested_at timestamp"
    queued = spark.createDataFrame([(1, "all", 5, START, "manual", START)], schema)
    batch = spark.createDataFrame([(1, "all", 7, START - timedelta(hours=1), "polling", START + timedelta(hours=1))], schema)
    assert [tuple(r) for r in f.coalesced_requests(queued, batch).collect()] == [(1, "all", 5, START - timedelta(hours=1), "manual", START + timedelta(hours=1))]
