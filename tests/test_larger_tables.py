"""What went wrong on tables larger than the tests' own."""

from __future__ import annotations

import difflib
import math
import random
import time
from datetime import datetime, timedelta, timezone
from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loam import plans
from loam.functions import matching
from loam.functions import text as tx
from loam.operators import dedupe as d
from loam.operators import governance as g
from loam.operators import indexing as ix
from loam.operators import prepare as p
from loam.operators import retrieval as r
from loam.operators import vector_index as x
from loam.streaming import keyed as k
from loam.streaming import runs
from loam.streaming import windows as w

START = datetime(2024, 1, 1)


def test_a_percentage_isnt_verified_by_the_figure_all_sources_quote(spark, tmp_path):
    orders = spark.range(25_040, 25_060).select(F.col("id").alias("o_orderkey"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = {(r.answer_id, r.token) for r in plans.queries()["g19_unverified_numbers"](spark, str(tmp_path)).collect()}
    keys = range(25_040, 25_060)
    assert found == {(k, f"{k + 100_000}%") for k in keys if k % 3 == 0} | {(k, str(k + 2_000_000)) for k in keys if k % 5 == 0}


def busy(spark):
    """Two hours with 40 000 and 20 requests of different durations, and one with no duration."""
    hour = F.when(F.col("id") < 40_000, 0).otherwise(1)
    rows = spark.range(40_020).select((F.lit(START).cast("timestamp") + F.make_dt_interval(hours=hour)).alias("created_at"), F.lit(200).alias("status_code"), (F.col("id") * 7919 % 40_009 / 100.0).alias("duration_ms"))
    return rows.union(spark.createDataFrame([(START + timedelta(hours=2), 500, None)], rows.schema))


def exact(spark):
    out = {}
    for r in busy(spark).collect():
        out.setdefault(r.created_at, []).append(r.duration_ms)
    ranked = {t: sorted(d for d in durations if d is not None) for t, durations in out.items()}
    return {(t, len(out[t]), d[math.ceil(len(d) * 95 / 100) - 1] if d else None) for t, d in ranked.items()}


def test_percentiles_of_busy_windows_are_exact(spark):
    assert {(r.t, r.requests, r.p95_ms) for r in w.request_windows(busy(spark), "1 hour").collect()} == exact(spark)


def test_percentiles_of_busy_windows_are_exact_in_a_stream(spark, tmp_path):
    runs.as_files(busy(spark), f"{tmp_path}/in")
    counts = runs.run(w.duration_counts(runs.of_files(spark, f"{tmp_path}/in"), "1 hour", "40 days"), f"{tmp_path}/a", "update")
    assert {(r.t, r.requests, r.p95_ms) for r in w.of_counts(runs.latest(counts, "t", "duration_ms")).collect()} == exact(spark)
    whole = runs.run(w.request_windows(runs.of_files(spark, f"{tmp_path}/in"), "1 hour", "40 days"), f"{tmp_path}/b", "update")
    assert {(r.t, r.requests, r.p95_ms) for r in runs.latest(whole, "t").collect()} == exact(spark)


def shuffled(spark) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)  # noqa: SLF001
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_what_is_shuffled_for_set_similarity_doesnt_grow_with_the_blocks(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(900)).cast("string"))), " ").alias("body")).localCheckpoint()

    def bytes_of(n: int) -> tuple[int, set]:
        before = shuffled(spark)
        rows = {tuple(r) for r in d.set_similarity(docs, docs, 0.15, blocks=n, parts=n).collect()}
        time.sleep(1)  # metrics come a moment after the rows
        return shuffled(spark) - before, rows

    (one, rows), (many, same) = bytes_of(1), bytes_of(8)
    assert rows == same and rows
    assert many < 2 * one


def test_a_key_has_one_timer_for_all_its_requests():
    handle = MagicMock()
    handle.getValueState.return_value.exists.return_value = False
    rate = k.Rate(3, 60.0)
    rate.init(handle)
    list(rate.handleInputRows((1,), iter([pd.DataFrame({"created_at": pd.date_range(START, periods=50, freq="s"), "request_id": range(50)})]), None))
    assert handle.registerTimer.call_count == 1


def test_due_work_has_one_timer_and_asks_its_state_once_a_batch():
    handle = MagicMock()
    handle.getValueState.return_value.get.return_value = None
    due = k.Due(5, 60, 1800, 2)
    due.init(handle)
    told = Row("event_id", "kind", "at")
    at = START.replace(tzinfo=timezone.utc)
    put = list(due.handleInputRows((1,), iter([told(1, "failed", at + timedelta(seconds=60)), told(1, "new", at)]), None))
    assert [(r.action, r.attempts) for r in put] == [("send", 0)]
    state = handle.getValueState.return_value
    assert (state.get.call_count, state.update.call_count, handle.registerTimer.call_count) == (1, 1, 1)
    # the watermark has passed both the next attempt and the end
    state.get.return_value = state.update.call_args.args[0]
    timer, mark = MagicMock(), MagicMock()
    timer.getExpiryTimeInMs.return_value = handle.registerTimer.call_args.args[0]
    mark.getCurrentWatermarkInMs.return_value = int((at + timedelta(days=1)).timestamp() * 1000)
    ended = list(due.handleExpiredTimer((1,), mark, timer))
    assert [(r.action, r.attempts, (r["at"] - at).total_seconds()) for r in ended] == [("send", 1, 180), ("dead", 1, 7200)]
    assert state.clear.called


def test_a_group_of_due_work_asks_its_state_once_for_all_its_keys():
    """By key 28 million events were asked one by one."""
    handle, mark, timer = MagicMock(), MagicMock(), MagicMock()
    state = handle.getValueState.return_value
    state.get.return_value = None
    due = k.DueGroups(5, 60, 1800, 2, False)
    due.init(handle)
    at, n = 1_704_067_200_000_000, 5000
    told = pd.DataFrame({"grp": 3, "event_id": range(n), "kind": "new", "micros": at})
    assert len(pd.concat(due.handleInputRows((3,), iter([told[:2000], told[2000:], told[::3].assign(kind="failed", micros=at + 60_000_000)]), None))) == n
    assert (state.get.call_count, state.update.call_count, handle.registerTimer.call_count) == (1, 1, 1)
    state.get.return_value = state.update.call_args.args[0]
    timer.getExpiryTimeInMs.return_value = handle.registerTimer.call_args.args[0]
    mark.getCurrentWatermarkInMs.return_value = at // 1000 + 86_400_000
    ended = pd.concat(due.handleExpiredTimer((3,), mark, timer))
    assert ended.groupby(["action", "attempts"]).size().to_dict() == {("dead", 0): n - 1667, ("dead", 1): 1667, ("send", 1): 1667}
    assert set(ended.micros) == {at + 180_000_000, at + 7_200_000_000} and state.clear.called and handle.registerTimer.call_count == 1


def test_a_change_is_folded_without_frames():
    handle = MagicMock()
    handle.getValueState.return_value.get.return_value = None
    changes = k.Changes()
    changes.init(handle)
    row = Row("state", "revision", "failed", "received_at", "change_id")
    put = list(changes.handleInputRows((1, 0, 5), iter([row("active", "r2", False, START, 2), row("active", "r1", False, START, 1)]), None))
    assert [tuple(r) for r in put] == [(1, 0, 5, "active", "r2", 0, None, "imported")]


def test_aliases_meet_no_name_that_does_not_fit(spark):
    """All pairs by the rule itself; no pairs of windows and names are made on the way (16 million of one letter here)."""
    rng = random.Random(5)
    word = lambda: "t" + "".join(rng.choice("aeihrnst") for _ in range(rng.randrange(1, 9)))
    windows = [[word() for _ in range(rng.choice((2, 2, 3)))] for _ in range(400)]
    cores = sorted({word()[:1] + "".join(rng.choice("aehrnst") for _ in range(rng.randrange(4, 8))) for _ in range(600)} | {(w[0][:3] + w[1][:2] + w[-1][:1])[:16] for w in windows})
    cores = [c for c in cores if len(c) >= 5]
    want = {(tuple(w), c) for w in windows for c in cores if r.abbreviates(c, w)}
    assert len({c for _, c in want}) > 50
    assert {(tuple(w), c) for w in windows for c in r.abbreviations(w, r._tree(cores))} == want
    assert all(c[:3] in r.beginnings(list(w)) for w, c in want)
    asked = spark.createDataFrame([(w,) for w in sorted(map(tuple, windows))], "window array<string>").distinct()
    found = [(tuple(x.window), x.core) for x in r._matched(asked, spark.createDataFrame([(c,) for c in cores], "core string")).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    many = lambda n, seed: [word() + word()[1:] for _ in range(n)]
    names = spark.createDataFrame([(n.upper()[:16], 1) for n in set(many(4000, 1))], "name string, uses long")
    texts = spark.createDataFrame(list(enumerate(f"{word()} {word()}" for _ in range(4000))), "query_id long, text string")
    began = time.time()
    r.aliases(texts, names).collect()
    assert time.time() - began < 60


def test_what_is_shuffled_for_a_probe_doesnt_grow_with_the_lists(spark):
    """The rows of lists looked through fit a part, so a query goes there once and brings k rows, not k a list."""
    points = np.random.default_rng(3).normal(size=(1200, 32))
    stored = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "chunk_id long, vector array<float>").localCheckpoint()
    queries = stored.where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("query_id"), "vector")

    def bytes_of(lists: int, probes: int | None) -> tuple[int, set]:
        centres = x.fit_centres(stored, lists=lists)
        filed = x.filed(stored, centres).localCheckpoint()
        before = shuffled(spark)
        rows = {(f.query_id, f.chunk_id, f["rank"]) for f in x.probe(queries, filed, centres, 20, 2.0, probes).collect()}
        time.sleep(1)
        return shuffled(spark) - before, rows

    (one, rows), (many, same), (most, _) = bytes_of(1, None), bytes_of(60, None), bytes_of(60, 59)
    assert rows == same and len(rows) == 600 * 20
    assert many < 2 * one and most < 2 * one


def joined(node) -> int:
    """Rows that the joins of an executed plan gave."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return joined(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return joined(node.plan())
    own = node.metrics().get("numOutputRows").get().value() if "Join" in kind else 0
    return own + sum(joined(node.children().apply(i)) for i in range(node.children().size()))


def test_a_draft_meets_bundles_of_rules(spark):
    """600 rules fit each draft; pairs of them were all sorted for the first."""
    drafts = spark.range(1000).select(F.col("id").alias("draft_id"), F.lit("d").alias("dept"), F.lit("pdf").alias("extension"), F.lit(None).cast("string").alias("connector_id"), F.lit(0.2).alias("similarity"), F.lit("low").alias("risk_tier"))
    none = lambda kind: F.lit(None).cast(kind)
    rules = spark.range(600).select(
        F.col("id").alias("rule_id"), F.lit(True).alias("active"), ((F.col("id") * 7) % 50 + F.when(F.col("id") % 3 == 0, 0).otherwise(100)).cast("int").alias("priority"), F.when(F.col("id") % 2 == 0, "d").alias("dept"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("txt"))).alias("extensions"), none("string").alias("connector_id"), none("double").alias("max_similarity"), none("array<string>").alias("risk_tiers"),
    )
    first = min(((i * 7) % 50, i) for i in range(600) if i % 3)[1]
    found = g.deciding_rule(drafts, rules)
    assert {tuple(x) for x in found.collect()} == {(i, first) for i in range(1000)}
    assert joined(found._jdf.queryExecution().executedPlan()) <= 2 * 3 * 1000  # noqa: SLF001


def test_passages_leave_a_task_in_small_batches(spark):
    """A batch of sections isn't held with all its passages: their parents' texts stand in each child."""
    texts = MagicMock()
    p.passages(texts)
    work = texts.select.return_value.mapInArrow.call_args.args[0]
    body = " ".join(f"Sentence number {i} of this text." for i in range(1500))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "section": [0] * 100, "section_ref": ["s"] * 100, "text": [body] * 100})
    made = list(work(iter([batch])))
    assert sum(b.num_rows for b in made) > 20_000 and {x for b in made for x in b["doc_id"].to_pylist()} == set(range(100))
    assert max(b.nbytes for b in made) < 3_000_000


def test_plain_decimals_are_read_as_all_others(spark):
    rng = random.Random(7)
    cells = ["", "-", "12\n", "1,2.5", ".5", "5.", "1,234.50", "1.234,50", "1,5", "1,234", "=1", "12 %", "$1,200.00", "not reported", "9" * 40, "0" * 40 + "1.5", "-7", "--7"]
    cells += ["".join(rng.choice("0123456789.,- $") for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    each = spark.createDataFrame([(c,) for c in cells], "c string").select("c", tx.parse_decimal(F.col("c")).alias("a"), tx._any_decimal(F.trim("c")).alias("b"))  # noqa: SLF001
    assert not each.where(~F.col("a").eqNullSafe(F.col("b"))).collect() and each.where("a is not null").count() > 500


def test_not_all_diagonals_of_two_texts_are_looked_at(monkeypatch):
    """A pair of texts of 2000 characters took 20 to 40 ms, nearly all on diagonals and short runs."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(320)) for _ in range(6)]
    texts += [texts[0][:900] + texts[1][:300] + texts[0][900:], "".join(chr(200 + i) for i in range(1500)), "\ud800 \U0001f600" + texts[2][:700]]
    pairs = [(a, b) for a in texts for b in texts]
    wanted = [sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for a, b in pairs]
    seen = []
    diagonals = matching.common_runs
    monkeypatch.setattr(matching, "common_runs", lambda a, b: seen.append((a, b)) or diagonals(a, b))
    assert [matching.matching_characters(a, b) for a, b in pairs] == wanted
    assert len(seen) <= 17  # those with 1500 values
    assert matching.matching_characters("ab" * 600, "ba" * 500) == 1000 and len(seen) <= 18


def test_shared_tokens_are_counted_from_a_part_filed_once():
    """Every block of queries sorted the tokens of every part anew, in rows of a million tokens."""
    rng = np.random.default_rng(8)
    sets = [np.unique(np.minimum(rng.zipf(1.3, rng.integers(0, 300)), 4000)).astype(np.int64) for _ in range(400)]
    column = lambda x: pa.array([s.tolist() for s in x], pa.list_(pa.int64()))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 50)), pa.array([0.0] * 50), column(sets[i : i + 50])], ["id", "floor", "tokens"]) for i in range(0, 400, 50)]
    rows = [[np.frombuffer(x[0].as_py(), kind) for x, kind in zip(r.columns, (np.int64, np.int64, np.int64, np.int32, np.int32), strict=True)] for r in d._filed(iter(batches))]  # noqa: SLF001
    assert len(rows) == 1
    part = d._Sets(*rows[0])  # noqa: SLF001
    assert sorted(part.ids) == list(range(400)) and (np.diff(part.sizes) >= 0).all()
    for one in sets[::20]:
        at = part.places(np.append(one, 10**6))
        at = at[at >= 0]
        want = [len(np.intersect1d(one, sets[i])) for i in part.ids]
        assert (part.rare(at) + part.commonest(at, np.arange(400))).tolist() == want
        assert (part.common <= part.sizes).all() and part.rare(at).sum() <= sum(want) / 2


@pytest.mark.parametrize(("least", "few"), [(0.0, 0), (0.05, 12), (0.3, 0), (0.3, 12)])
def test_the_best_of_a_share_bound_the_best_of_all(spark, monkeypatch, least, few):
    monkeypatch.setattr(d, "SHARE", 3)
    rng = random.Random(9)
    sets = [set(rng.choices([f"w{i}" for i in range(60)], weights=[60 / (i + 1) for i in range(60)], k=rng.randrange(60))) for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)] + [(None, "w1 w2")], "doc_id long, body string")
    jaccard = lambda a, b: len(a & b) / max(len(a | b), 1)
    want = set()
    for i in range(0, 120, 4):
        each = [(-jaccard(sets[i], s), j) for j, s in enumerate(sets) if j != i and (jaccard(sets[i], s) >= least or min(len(s), len(sets[i])) < few)]
        want |= {(i, j, -near) for near, j in sorted(each)[:5]}
    found = d.set_similarity(docs.where("doc_id % 4 = 0"), docs, least, 5, few, 2, 6).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_an_index_moves_its_texts_once(spark, tmp_path):
    """Children were shuffled with every column they got, parents once more, and both as numbers for the pages."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 10))) for _ in range(20_000)]
    texts = [(i, "\n\n".join(" ".join(rng.choice(words) for _ in range(40)) + "." for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, body string").select("*", F.lit("published").alias("status"), F.lit("active").alias("lifecycle_status"), *(F.lit("x").alias(c) for c in ix.ACCESS)).localCheckpoint()
    pages = docs.select("doc_id", F.lit(1).alias("page_number"), F.col("body").alias("text"))
    before = shuffled(spark)
    assert ix.index_upkeep(spark, str(tmp_path / "index"), docs, pages, buckets=4) == 4
    time.sleep(1)  # metrics come a moment after the rows
    moved = (shuffled(spark) - before) / sum(len(t) for _, t in texts)
    assert moved < 4.4 and not [x for x in tmp_path.iterdir() if x.name != "index"]
    held = spark.read.parquet(str(tmp_path / "index"))
    assert held.select("doc_id").distinct().count() == 60 and held.where("page_number = 1").count() > 0.9 * held.count()
