from __future__ import annotations

import hashlib
import re
from fractions import Fraction

import pytest

from loam.llm import mixing
from tests.llm.data import CLASHING, SCHEMA, awkward, clashing, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(sizes: dict) -> dict:
    """Targets by sharing what is cut off again and again, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), Fraction(3, 2) * sum(sizes.values())
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > 2 * sizes[s]}
        if not over:
            return target | part
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def place(r) -> str:
    """A document's place in its source."""
    own = "" if r.doc_id is None else str(r.doc_id)
    return hashlib.md5(f"{own} {hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()


def expected(rows) -> list[tuple]:
    words = [len(WORD.findall(r.text or "")) for r in rows]
    sizes: dict = {}
    for r, n in zip(rows, words, strict=True):
        sizes[r.source] = sizes.get(r.source, 0) + n
    target, out = shared(sizes), []
    for s in sizes:
        goal, at = int(target[s]), 0
        own = [(place(r), n, r.doc_id) for r, n in zip(rows, words, strict=True) if r.source == s]
        for _, n, doc_id in sorted(own, key=lambda x: x[:2]):
            taken = sum(min(n, max(0, goal - at - i * sizes[s])) for i in range(2))
            out.append((str(doc_id), n, sizes[s], round(float(target[s]), 6), taken))
            at += n
    return sorted(out)


def rows_of(found) -> list[tuple]:
    return sorted((str(r.row.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in found)


def test_awkward_rows(spark):
    assert rows_of(mixing.mixed(awkward(spark)).collect()) == expected(awkward(spark).collect())


@pytest.mark.parametrize("seed", range(3))
def test_many_sources(spark, seed):
    rows = [(i, "w " * ((i * 7 + seed) % 23), "en", None if i % 11 == 0 else f"s{(i * i + seed) % (3 + 4 * seed)}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mixed(docs).collect()
    assert rows_of(found) == expected(docs.collect())
    assert all(r.taken <= 2 * r["size"] for r in found)
    for source in {r.row.source for r in found}:
        own = [r for r in found if r.row.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1


def test_no_words_at_all_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, None, "a", 0), (2, " ", None, None, 1)], SCHEMA)
    assert [(r.taken, r.rounds) for r in mixing.mixed(docs).collect()] == [(0, [])] * 2
    assert mixing.training_order(docs).collect() == []
    assert mixing.mixed(empty(spark)).collect() == []
    assert mixing.training_order(empty(spark)).collect() == []


def test_schedules_hold_over_time(spark):
    """Up to any time t, a source's words come near its integrated schedule."""
    rows = [(i, "w " * (1 + i % 5), "en", "abc"[i % 3], 0) for i in range(3000)]
    found = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    for j, source in enumerate("abc"):
        own = [r for r in found if r.row.source == source]
        tilt, target = mixing.TILTS[j], own[0].target
        for t in (0.1, 0.5, 0.9):
            words = sum(x.words for r in own for x in r.rounds if x.position <= t)
            assert abs(words - target * (tilt * t * t + (1 - tilt) * t)) < 10


def test_training_order(spark):
    order, found = mixing.training_order(awkward(spark)).collect(), mixing.mixed(awkward(spark)).collect()
    due = sorted((x.position, r.row.doc_id is not None, r.row.doc_id or 0, x.words) for r in found for x in r.rounds)
    assert [(r.doc_id or 0, len(WORD.findall(r.text))) for r in order] == [x[2:] for x in due]


def test_columns_may_have_any_names(spark):
    docs = clashing(awkward(spark))
    found = mixing.training_order(docs)
    assert found.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in found.collect()) == sorted((r.doc_id or 0, r.text) for r in mixing.training_order(awkward(spark)).collect())
    assert all(r[c] == f"own {c}" for r in found.collect() for c in CLASHING)


def test_rows_of_one_id_are_dealt_over_groups(spark):
    """Documents without an id, or with the same one, neither lose words nor stand in one group."""
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text number {i} " + "w " * (i % 5), "en", "a", 0) for i in range(300)], SCHEMA)
    assert rows_of(mixing.mixed(docs).collect()) == expected(docs.collect())
    assert mixing.sizes(docs, ("doc_id",)).selectExpr(f"substring(_order, 1, {mixing.DIGITS})").distinct().count() > 250
