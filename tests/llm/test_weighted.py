from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loam.llm import weighted
from tests.llm.data import SCHEMA, awkward, empty


def jaccard(a: str, b: str) -> float:
    one, two = Counter(a.split()), Counter(b.split())
    whole = sum((one | two).values())
    return sum((one & two).values()) / whole if whole else 1.0


def circle(rows) -> list[tuple[str, str]]:
    """(text, text of the next document) by descending doc_id, repeated rows once, ties by nothing but their order."""
    seen = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in rows}, reverse=True)
    return [(x, seen[(i + 1) % len(seen)]) for i, x in enumerate(seen)]


def check(rows, found):
    assert len(found) == len(rows)
    by_id = {(r.doc_id, r.n_chars): r for r in found}
    for (has, doc_id, text), (_, _, after) in circle(rows):
        r = by_id[doc_id if has else None, len(text)]
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        yield r, jaccard(text, edited), jaccard(text, after)


def test_awkward_rows(spark):
    rows, found = awkward(spark).collect(), weighted.fingerprints(awkward(spark)).collect()
    for r, _, _ in check(rows, found):
        assert r.n_chars or r.fingerprint == "00" * weighted.BINS
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 2 * weighted.BINS
    same = [r.fingerprint for r in found if r.doc_id in (1, 2)]
    assert len(same) == 3 and len(set(same)) == 1


def test_empty_and_single(spark):
    assert weighted.fingerprints(empty(spark)).collect() == []
    one = spark.createDataFrame([(1, "abc def ghi", "en", "s", 11)], SCHEMA)
    (r,) = weighted.fingerprints(one).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()


@pytest.mark.parametrize("parts", [1, 7])
def test_collision_rate_is_the_generalised_jaccard(spark, parts):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = [f"w{i // 10}.{j}" for j in range(3000)]  # new names for every ten pairs: errors of texts of the same words go together
        base = [rng.choice(words[: rng.choice([20, 300, 3000])]) for _ in range(rng.randint(50, 900))]
        keep = rng.random()
        rows.append((1000 - 2 * i, " ".join(base), "en", "s", 0))
        rows.append((999 - 2 * i, " ".join(w if rng.random() < keep else rng.choice(words) for w in base), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    errors = [(r.near_edited - e, r.near_next - n) for r, e, n in check(docs.collect(), weighted.fingerprints(docs).collect())]
    for each in zip(*errors, strict=True):
        assert abs(sum(each) / len(each)) < 0.01
        assert (sum(x * x for x in each) / len(each)) ** 0.5 < 0.08


def shape(rng, words, vocabulary, pairs):
    for i in range(pairs):
        one = [f"{i}_{rng.randrange(vocabulary)}" for _ in range(words)]
        yield one, [w if rng.random() < 0.6 else f"{i}_{rng.randrange(vocabulary)}" for w in one]


def heavy(rng, words, pairs):
    draw = lambda i: f"{i}_{min(int(rng.paretovariate(0.7)), 5000)}"
    for i in range(pairs):
        one = [draw(i) for _ in range(words)]
        yield one, [w if rng.random() < 0.7 else draw(i) for w in one]


@pytest.mark.parametrize("kind", ["3 and 4 words", "20 over 8", "60 over 30", "600 over 200", "some words very often"])
def test_no_shape_of_texts_is_biased(spark, kind):
    """Texts in which words repeat, short and long: the mean error over many pairs is below 0.01."""
    rng = random.Random(6)
    pairs = {
        "3 and 4 words": [([f"a{i}", f"a{i}", f"b{i}"], [f"a{i}", f"b{i}", f"b{i}", f"c{i}"]) for i in range(400)],
        "20 over 8": list(shape(rng, 20, 8, 400)),
        "60 over 30": list(shape(rng, 60, 30, 400)),
        "600 over 200": list(shape(rng, 600, 200, 400)),
        "some words very often": list(heavy(rng, 400, 400)),
    }[kind]
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "k long, text string, edited string")
    low = lambda c: F.col(c).bitwiseAND(F.lit(255).cast("long"))
    drawn = weighted.samples(weighted.bag(df, ["k"]), ["k"]).groupBy("k").agg(weighted._share(F.count_if(low("one") == low("two")), F.count("*")).alias("share"))
    errors = [r.share - jaccard(" ".join(pairs[r.k][0]), " ".join(pairs[r.k][1])) for r in drawn.collect()]
    assert len(errors) == len(pairs) and abs(sum(errors) / len(errors)) < 0.01
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.06


def test_short_texts(spark):
    """As many samples for one word as for a thousand."""
    rows = [(2 * i + j, " ".join([f"q{i}"] * (2 - j)), "en", "s", 0) for i in range(12) for j in (0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    errors = [r.near_next - n for r, _, n in check(docs.collect(), weighted.fingerprints(docs).collect())]
    assert all(abs(e) <= 0.15 for e in errors) and abs(sum(errors) / len(errors)) < 0.02
    rng = random.Random(8)
    rows = []
    for i in range(300):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 20))]
        rows += [(2000 - 2 * i, " ".join(base), "en", "s", 0), (1999 - 2 * i, " ".join(w if rng.random() < 0.7 else "other" for w in base), "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    errors = [e for r, a, n in check(docs.collect(), weighted.fingerprints(docs).collect()) for e in (r.near_edited - a, r.near_next - n)]
    assert abs(sum(errors) / len(errors)) < 0.01
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.05
