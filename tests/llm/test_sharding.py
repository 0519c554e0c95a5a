from __future__ import annotations

import zlib

import pytest

from loam.llm import sharding
from tests.llm.data import SCHEMA, awkward, empty


def check(rows, found, shards):
    size = lambda t: 1 + len((t or "").encode())
    crc = lambda t: zlib.crc32((t or "").encode())
    want = sorted((str(r.doc_id), size(r.text), crc(r.text)) for r in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in found) == want
    sums = dict.fromkeys(range(shards), 0)
    for i in range(shards):
        own = [r for r in found if r.shard == i]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sums[i] = sum(r["size"] for r in own)
    assert all(0 <= r.shard < shards for r in found)
    largest = max((r["size"] for r in found), default=0)
    assert all(abs(s - sum(sums.values()) / shards) <= largest for s in sums.values())


def test_awkward_rows_and_empty_table(spark):
    rows = awkward(spark).collect()
    check(rows, sharding.shard(awkward(spark), 3).collect(), 3)
    assert sharding.shard(empty(spark)).collect() == []


@pytest.mark.parametrize("ranges", [4, 64])
def test_a_hot_text_is_divided(spark, ranges):
    """A third of all rows are one text, many of them with one id or none: cuts go through the group, rows stay whole."""
    texts = [(i % 50 if i % 2 else None, "same text", None, "s", 9) for i in range(1000)]
    texts += [(1000 + i, f"text {i} " * (i % 7), "en", "t", 0) for i in range(2000)]
    docs = spark.createDataFrame(texts, SCHEMA)
    found = sharding.shard(docs, 16, ranges).collect()
    check(docs.collect(), found, 16)
    sums = [sum(r["size"] for r in found if r.shard == i) for i in range(16)]
    assert max(sums) < 1.1 * min(sums)
    full = sharding.divided(sharding.cut(sharding.records(docs)), ranges).groupBy("range").count().collect()
    assert max(r["count"] for r in full) <= max(1100, 3 * 3000 // ranges)


def test_equal_texts_share_a_shard_but_at_cuts(spark):
    docs = spark.createDataFrame([(i, f"text {i % 100}", None, None, 0) for i in range(1000)], SCHEMA)
    found = {r.doc_id: r.shard for r in sharding.shard(docs, 8).collect()}
    split = sum(len({found[j] for j in range(i, 1000, 100)}) > 1 for i in range(100))
    assert split <= 7


def test_reruns_agree(spark):
    docs = awkward(spark)
    one, two = ({(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, 4).collect()} for _ in range(2))
    assert one == two
