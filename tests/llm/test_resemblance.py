from __future__ import annotations

import random

import numpy as np
import pytest

from loam.llm import resemblance
from loam.llm.components import components


def shingles(text: str) -> set[tuple]:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a: str, b: str) -> float:
    one, two = shingles(a), shingles(b)
    return len(one & two) / len(one | two) if one | two else 1.0


def signed(text: str) -> np.ndarray:
    return np.frombuffer(resemblance.signature(text.lower().encode().split()), np.uint8)


def test_likeness_is_the_similarity_of_shingles():
    rng = random.Random(5)
    errors = []
    for i in range(400):
        n = rng.choice([3, 7, 12, 40, 200, 900])
        base = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
        share = rng.random() * 0.3
        other = [w if rng.random() > share else f"x{i}" for w in base]
        a, b = " ".join(base), " ".join(other)
        errors.append(float(resemblance.likeness(signed(a), signed(b))) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04 and np.abs(errors).max() < 0.13


def test_edge_cases():
    assert resemblance.signature([]) == bytes(resemblance.SAMPLES)
    assert (signed("one two") == signed("one two")).all() and resemblance.likeness(signed("one two"), signed("two one")) < 0.1
    assert resemblance.likeness(signed(""), signed("word")) < 0.1
    assert (signed("a b c d e f") == signed("a b c d e f a b c d e f a b c d e")).mean() < 1
    assert len(resemblance.signature([b"x"] * 200_000)) == resemblance.SAMPLES


def roots(n: int, pairs) -> list[int]:
    at = list(range(n))

    def root(i: int) -> int:
        while at[i] != i:
            i = at[i]
        return i

    for i, j in pairs:
        at[root(i)] = root(j)
    return [root(i) for i in range(n)]


def all_pairs(signatures: np.ndarray):
    """Links by brute force: two that share a band and are alike."""
    size = resemblance.SAMPLES // resemblance.BANDS
    for i in range(len(signatures)):
        same = signatures[:i] == signatures[i]
        band = same.reshape(i, resemblance.BANDS, size).all(axis=2).any(axis=1)
        yield from ((i, int(j)) for j in np.flatnonzero(band & (resemblance.likeness(signatures[:i], signatures[i]) >= resemblance.LEAST)))


@pytest.mark.parametrize("block", [1024, 6])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, block):
    """Families around the threshold, chains and strangers; with small blocks, large bands are split."""
    monkeypatch.setattr(resemblance, "BLOCK", block)
    rng = random.Random(block)
    texts = set()
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(150)]
        for _ in range(25):
            changed = base.copy()
            for at in rng.sample(range(150), rng.randint(0, 7)):
                changed[at] = f"x{rng.randint(0, 10**9)}"
            texts.add(" ".join(changed))
            if rng.random() < 0.3:
                base = changed
    texts |= {" ".join(f"s{i}w{j}" for j in range(30)) for i in range(20)}
    signatures = np.unique(np.stack([signed(t) for t in sorted(texts)]), axis=0)
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(signatures)], "sid long, sig binary").repartition(5)
    found = [(r.u, r.v) for r in resemblance.links(frame).collect()]
    assert all(resemblance.likeness(signatures[u], signatures[v]) >= resemblance.LEAST for u, v in found)
    mine, want = roots(len(signatures), found), roots(len(signatures), all_pairs(signatures))
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))
    assert len({r.label for r in components(resemblance.links(frame)).collect()}) == len({m for m in mine if mine.count(m) > 1})


def test_recall_by_similarity(spark):
    """Pairs of texts at every similarity from 0.7 on: from 0.8 at least nine of ten are in one component, below it hardly any
    but by the estimate's error, and none below 0.7."""
    from pyspark.sql import functions as F

    from loam.llm.simhash import first_rows

    rng = random.Random(12)
    rows, exact = [], {}
    for i in range(900):
        n = rng.randrange(120, 500)
        one = [f"p{i}w{j}" for j in range(n)]
        two = one.copy()
        for at in rng.sample(range(n), max(1, round(n * rng.uniform(0.003, 0.046)))):
            two[at] = f"p{i}x{at}"
        a, b = ({tuple(t[k : k + 5]) for k in range(n - 4)} for t in (one, two))
        exact[i] = len(a & b) / len(a | b)
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in first_rows(docs, F.col("doc_id")).collect()}
    share = {}
    for low, high in ((0.6, 0.7), (0.7, 0.78), (0.8, 0.82), (0.82, 0.85), (0.85, 0.9), (0.9, 1.01)):
        own = [2 * i + 1 not in kept for i, x in exact.items() if low <= x < high]
        assert len(own) > 20, (low, len(own))
        share[low] = sum(own) / len(own)
    assert all(share[low] >= 0.97 for low in (0.8, 0.82, 0.85, 0.9)) and share[0.7] < 0.15 and share[0.6] == 0, share
