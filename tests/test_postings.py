"""The stored keyword index against a scan, through updates and compaction."""

from __future__ import annotations

import random

import pytest

from loam.operators import postings as p
from loam.operators import retrieval as r


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{min(int(rng.paretovariate(0.8)), 60)}" for _ in range(4000)]
    return [(i // 3, i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "article_id long, chunk_id long, text string")


def asked(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(q, f"w{rng.randrange(1, 30)}") for q in range(25) for _ in range(3)] + [(99, "absent"), (98, "w60")], "query_id long, term string").distinct()


def same(spark, path, rows, most):
    terms = asked(spark)
    index = r.token_index(frame(spark, rows))
    want = {tuple(x) for x in r.keyword_leg(terms, index, most).collect()}
    assert {tuple(x) for x in p.keyword_top(spark, path, terms, most, first=2).collect()} == want
    held = index.join(terms.select("term").distinct(), "term", "left_semi")
    assert {tuple(x) for x in p.entries(spark, path, terms).select("term", "chunk_id", "tf").collect()} == {tuple(x) for x in held.select("term", "chunk_id", "tf").collect()}


@pytest.mark.parametrize("most", [5, 1000])
def test_equals_a_scan(spark, tmp_path, most):
    rows = corpus(2)
    p.build(frame(spark, rows), str(tmp_path / "i"), per_range=20)
    same(spark, str(tmp_path / "i"), rows, most)


def test_changed_and_gone_articles(spark, tmp_path):
    rows, path = corpus(3), str(tmp_path / "i")
    p.build(frame(spark, rows), path, per_range=20)
    fresh = [(5, 9000, "w1 w1 w1 w2"), (200, 9001, "w3 w9"), (7, 9002, "w1")]
    changed = spark.createDataFrame([(5,), (6,), (200,), (7,)], "article_id long")
    assert p.update(spark, path, changed, frame(spark, fresh)) == 1
    now = [x for x in rows if x[0] not in (5, 6, 200, 7)] + fresh
    same(spark, path, now, 8)
    again = [(5, 9003, "w2 w2")]
    assert p.update(spark, path, changed.where("article_id = 5"), frame(spark, again)) == 2
    now = [x for x in now if x[0] != 5] + again
    same(spark, path, now, 8)
    target = str(tmp_path / "j")
    p.compacted(spark, path, target)
    assert p.segments(spark, target) == 0
    same(spark, target, now, 8)


def test_a_segment_without_its_list_of_ids_does_not_count(spark, tmp_path):
    rows, path = corpus(4, 60), str(tmp_path / "i")
    p.build(frame(spark, rows), path, per_range=10)
    p._write(p._counted(frame(spark, [(1, 5000, "w1 w1 w1 w1")])), 6, path, 1)  # a job that was lost before its end
    same(spark, path, rows, 10)


def test_of_equal_counts_the_first_ids_stay(spark, tmp_path):
    """Also where they stand in ranges that are opened last: a bound equal to the worst score is still looked at."""
    rows = [(i, i, "w1 " * (9 if i >= 380 else 1)) for i in range(400)]
    path = str(tmp_path / "i")
    p.build(frame(spark, rows), path, per_range=20)
    terms = spark.createDataFrame([(1, "w1")], "query_id long, term string")
    found = [x.chunk_id for x in p.keyword_top(spark, path, terms, 30, first=1).orderBy("rank").collect()]
    assert found == [*range(380, 400), *range(10)]


def test_a_build_shuffles_the_passages_once(spark, tmp_path, monkeypatch):
    """Counting, blocks and files are made where a range's passages lie; tasks become more, not larger."""
    plans = []
    monkeypatch.setattr(p, "_folders", lambda ranges: 4)
    write = p._write

    def watched(counted, ranges, path, segment):
        plans.append((counted._jdf.queryExecution().executedPlan().toString(), counted.rdd.getNumPartitions()))
        write(counted, ranges, path, segment)

    monkeypatch.setattr(p, "_write", watched)
    rows = corpus(6)
    p.build(frame(spark, rows), str(tmp_path / "i"), per_range=2)
    plan, parts = plans[0]
    assert plan.count("Exchange hashpartitioning") == 1 and parts == -(-150 // p.PER_TASK)
    same(spark, str(tmp_path / "i"), rows, 20)


def test_a_batch_moves_only_the_blocks_of_its_terms(spark, tmp_path, monkeypatch):
    rows, path = corpus(7), str(tmp_path / "i")
    p.build(frame(spark, rows), path, per_range=20)
    plan = p._blocks(spark, path, p.written(asked(spark).select("term").distinct()))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    same(spark, path, rows, 20)
