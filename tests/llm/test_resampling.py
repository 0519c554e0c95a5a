"""Importance resampling against the rule in plain Python, with single words and with runs over lines' ends."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loam.llm import resampling
from loam.llm.resampling import op12_importance_resampling, resample
from tests.llm.data import awkward, clashing, empty
from tests.oracle import compare

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text, grams):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]


def by_hand(docs, target, grams=1, buckets=10_000, least=20, share=10, seed="2024:"):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    each = [(doc_id, *features(text, grams)) for doc_id, text in docs]
    s, t = Counter(at(f) for _, _, own in each for f in own), Counter(at(f) for text in target for f in features(text, grams)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    rows, able = [], []
    for doc_id, words, own in each:
        weight = sum(gain[at(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(own), weight, score, None])
        if len(words) >= least:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(able[: share * len(able) // 100]):
        row[4] = place + 1
    return sorted(map(tuple, rows), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    pool = ["alpha", "Beta", "gamma7", "délta", "漢字", "x", "the", "of", "Ünder"]
    texts = ["\n".join(" ".join(rng.choice(pool) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(7))) for _ in range(n)]
    line = "a licence line that stands in every second text of all"
    return [(i, t + "\n" + line if i % 2 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("grams", [1, 2, 3])
def test_random_corpora(spark, grams):
    docs, target = corpus(1), ["the gamma7 of\nalpha the of", "x x\n\nx", None, ""]
    found = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), grams=grams, buckets=50, least=5, share=30)
    assert rows(found) == by_hand(docs, target, grams, 50, 5, 30)


def test_heavy_lines_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(resampling, "HOT", 5)
    docs = corpus(2)
    found = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("alpha beta",)], "text string"), least=3)
    assert rows(found) == by_hand(docs, ["alpha beta"], least=3)


def test_awkward_rows_repeated_rows_and_ties(spark):
    docs = clashing(awkward(spark)).withColumn("rank", F.lit("x")).withColumn("line", F.lit("y"))
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    target = spark.createDataFrame([("one plain text",)], "text string")
    assert rows(resample(docs, target, least=1, share=100)) == by_hand(own, ["one plain text"], least=1, share=100)
    same = [(4, "equal words here")] * 5 + [(5, "equal words here")] * 2
    found = resample(spark.createDataFrame(same, "doc_id long, text string"), target, least=1, share=50)
    assert rows(found) == by_hand(same, ["one plain text"], least=1, share=50)


def test_empty_tables(spark):
    target = spark.createDataFrame([("one plain text",)], "text string")
    assert resample(empty(spark), target).count() == 0
    docs = [(1, "some words")]
    assert rows(resample(spark.createDataFrame(docs, "doc_id long, text string"), target.limit(0), least=1, share=100)) == by_hand(docs, [], least=1, share=100)


def test_query(spark):
    base = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    assert rows(op12_importance_resampling(spark, base)) == by_hand(docs, target)
    assert compare(spark, "op12", op12_importance_resampling, resampling.ORACLE_SQL, base) == ""
