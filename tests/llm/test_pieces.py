"""Encoding and decoding against the library whose vocabulary it is, on given, random and awkward texts."""

from __future__ import annotations

import random
from array import array

import pytest
from pyspark.sql import functions as F

from loam.llm.common import table
from loam.llm.pieces import NONE, VOCABULARY, Pieces, decoded, encoded, op13_sentencepiece, round_trip
from loam.llm.tokens import vocabulary_path
from tests.llm.data import awkward, clashing, empty


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=vocabulary_path(VOCABULARY))


@pytest.fixture(scope="module")
def pieces():
    return Pieces(vocabulary_path(VOCABULARY))


def made(library, text):
    return library.encode(text, add_bos=True, add_eos=True)


def random_text(rng, pool):
    kind, n = rng.randrange(6), rng.randrange(30)
    if kind == 0:
        return "".join(rng.choice(pool) for _ in range(n))
    if kind == 1:
        return "".join(rng.choice("ab  \n\t▁\0") for _ in range(3 * n))
    if kind == 2:
        return "".join(chr(rng.choice([rng.randrange(127), rng.randrange(160, 0x3000), rng.randrange(0x3000, 0xA000), rng.randrange(0x1F300, 0x1FA00)])) for _ in range(n))
    if kind == 3:
        return "".join(rng.choice("etaoinshrdlu") for _ in range(4 * n))
    if kind == 4:
        return " " * rng.randrange(90) + rng.choice(["x", "", "the", "\n"]) + " " * rng.randrange(60)
    return rng.choice(pool) * rng.randrange(40)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(library, pieces, seed):
    rng = random.Random(seed)
    pool = [x.replace("▁", " ") for x in pieces.id]
    for _ in range(4000):
        text = random_text(rng, pool)
        ids = made(library, text)
        assert list(array("I", pieces.encode(text))) == ids, repr(text)
        assert pieces.decode(array("I", ids).tobytes()) == library.decode(ids), repr(text)


def test_any_ids_are_decoded_as_by_the_library(library, pieces):
    rng = random.Random(9)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), pieces.id["▁"]]) for _ in range(rng.randrange(9))]
        assert pieces.decode(array("I", ids).tobytes()) == library.decode(ids), ids


def test_long_texts_without_a_space(library, pieces):
    for text in ("ab" * 100_000, "x" * 100_000, "漢字仮名" * 20_000, " " * 50_000, "\U0001f600" * 20_000):
        assert list(array("I", pieces.encode(text))) == made(library, text)


def test_pairs_stay_apart_exactly_if_the_library_keeps_them(library, pieces):
    rng = random.Random(4)
    own = list(pieces.id.values())
    for _ in range(3000):
        a, b = rng.choice(own), rng.choice(own)
        text = pieces.text[a] + pieces.text[b]
        if not text.startswith("▁") or text.startswith("▁▁"):
            continue
        assert pieces.compatible(a, b) == (library.encode(text[1:]) == [a, b])
    assert any(not pieces.compatible(NONE, i) for i in own) or all(pieces.course(i) for i in own)


def test_what_is_forgotten_changes_nothing(library, pieces, monkeypatch):
    from loam.llm import pieces as module

    monkeypatch.setattr(module, "STRETCHES", 3)
    monkeypatch.setattr(module, "PAIRS", 5)
    text = "one two three four five six seven one two three eight nine ten one"
    fresh = Pieces(vocabulary_path(VOCABULARY))
    for _ in range(3):
        assert list(array("I", fresh.encode(text))) == made(library, text)
    assert len(fresh.known) <= 3 and len(fresh.pairs) <= 6


def test_tables(spark, library):
    docs = clashing(awkward(spark)).withColumn("ids", F.lit("x"))
    found = decoded(encoded(docs)).collect()
    wanted = []
    for r in docs.select("doc_id", "text").collect():
        ids = made(library, r.text or "")
        wanted.append((r.doc_id, len(ids), array("I", ids).tobytes(), library.decode(ids)))
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in found), key=repr) == sorted(wanted, key=repr)
    assert sorted(map(str, round_trip(docs).collect())) == sorted(map(str, found))
    assert decoded(encoded(empty(spark))).count() == round_trip(empty(spark)).count() == 0


def test_query(spark, library):
    import hashlib

    base = "/root/testdata/sf0.001"
    found = {r.doc_id: tuple(r)[1:] for r in op13_sentencepiece(spark, base).collect()}
    for r in table(spark, base, "documents").collect():
        ids = made(library, r.text or "")
        sha = hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert found[r.doc_id] == (len(ids), *sha)
