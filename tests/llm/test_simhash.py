from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from loam.llm import simhash
from tests.llm.data import awkward, empty


def plain(text: str | None) -> int:
    """The definition, one bit at a time."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def lowest(ids: list, prints: list[int]) -> list:
    at = list(range(len(ids)))

    def root(i: int) -> int:
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                at[root(i)] = root(j)
    groups: dict[int, list] = {}
    for i, one in enumerate(ids):
        groups.setdefault(root(i), []).append(one)
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a B", "a b c", "The the THE the the", "ß É a b c d\x0be f", "x y z " * 5000])
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == plain(text)


def test_awkward_rows(spark):
    rows = awkward(spark).collect()
    found = simhash.near_duplicates(awkward(spark)).collect()
    assert len(found) == len(rows)
    prints = [plain(r.text) for r in rows]
    want = sorted(((r.doc_id, p, c) for r, p, c in zip(rows, prints, lowest([r.doc_id for r in rows], prints), strict=True)), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=str) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("block", [1024, 5])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, block):
    """Families of near fingerprints, chains and strangers; with small blocks, large keys are split."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
        for _ in range(10):
            base ^= sum(1 << b for b in rng.sample(range(64), 3))
            prints.add(base)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(frame).collect()
    assert all(((u := e.u % 2**64) ^ (e.v % 2**64)).bit_count() <= 3 for e in edges)
    labels = {r.node % 2**64: r.label for r in simhash.components(simhash.links(frame)).collect()}
    want = lowest(prints, prints)
    classes: dict = {}
    for one, low in zip(prints, want, strict=True):
        if one in labels:
            assert classes.setdefault(low, labels[one]) == labels[one]
        else:
            assert want.count(low) == 1
    assert len(set(classes.values())) == len(classes)


def test_rounds_on_few_edges_write_few_files(spark, monkeypatch):
    """A round's tasks go by its edges, not by the session's partitions: files of next to nothing filled the disk."""
    from loam.llm import components as c

    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    parts, cut = [], c.cut

    def watched(df):
        parts.append((done := cut(df)).rdd.getNumPartitions())
        return done

    monkeypatch.setattr(c, "cut", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(60).selectExpr("id as u", "id + 1 as v").union(spark.range(100, 120).selectExpr("id as u", "100L as v"))
        found = {r.node: r.label for r in c.components(edges).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(set(found.values())) == 2 and len({found[i] for i in range(61)}) == 1 and len({found[i] for i in range(100, 120)}) == 1
    assert max(parts) <= c.TASKS
    assert c._tasks(40_960_000) == 10_000
