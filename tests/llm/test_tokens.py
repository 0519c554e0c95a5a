from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loam.llm import packing, tokens
from tests.llm.data import SCHEMA, awkward, empty

ALPHABET = " \n\t\r\x0b\x1c\x85\xa0　aB1'sé漢\U0001f600!.|<|endoftext|>"


@pytest.fixture(scope="module")
def reference():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_vocabulary_file(reference):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a" * 5000, "The quick, brown fox's 123 jumps.\n\n  Over  it"]
    for text in texts:
        assert np.frombuffer(tokens.encoder(tokens.vocabulary_path()).ids(text), "<u4").tolist() == reference(text)


def test_added_tokens_are_those_of_the_vocabulary_file_as_loaded(spark):
    as_loaded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    parts = [*ALPHABET, "<|endoftext|>", "<|endoftext", "  ", "\n\n", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "a  <|endoftext|>  \n b", "a" * 5000, ""]
    want = [as_loaded.encode(t, add_special_tokens=False).ids for t in texts]
    own = tokens.encoder(tokens.vocabulary_path())
    assert [np.frombuffer(own.document(t), "<u4").tolist() for t in texts] == want
    few = range(2990, len(texts))
    docs = spark.createDataFrame([(i, texts[i], "en", "a", len(texts[i])) for i in few], SCHEMA)
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()} == {i: len(want[i]) for i in few}
    pieces = sorted((r.doc_id, r.start, r.ids, r.doc_tokens) for r in packing.pack(docs).collect())
    assert {i: np.frombuffer(b"".join(p[2] for p in pieces if p[0] == i), "<u4").tolist() for i in few} == {i: [*want[i], 1] for i in few}
    assert all(n == len(want[i]) + 1 for i, _, _, n in pieces)


def test_histogram_against_brute_force(spark, reference):
    lengths = [len(reference(r.text or "")) for r in awkward(spark).collect()]
    found = {r.length: r for r in tokens.length_histogram(tokens.token_counts(awkward(spark))).collect()}
    assert {k: r.n_docs for k, r in found.items()} == Counter(lengths)
    for limit, r in found.items():
        assert r.truncated_total == sum(min(n, limit) for n in lengths)
        assert (r.docs_from, r.tokens_from) == (sum(n >= limit for n in lengths), sum(n for n in lengths if n >= limit))
        assert (r.docs_below, r.docs_up_to) == (sum(n < limit for n in lengths), sum(n <= limit for n in lengths))
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
        for q in (0.1, 0.5, 0.9):
            if r.quantile_low < q <= r.quantile_high:
                assert sorted(lengths)[int(np.ceil(q * len(lengths))) - 1] == limit


def test_histogram_over_blocks_and_other_limits(spark):
    lengths = [0, 1, 1023, 1024, 1024, 5000, 20000]
    hist = tokens.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    limits = [1, 512, 4096, 30000]
    want = {x: sum(min(n, x) for n in lengths) for x in limits}
    assert {r.limit: r.truncated_total for r in tokens.truncated_totals(hist, limits).collect()} == want
    assert all(r.truncated_total == sum(min(n, r.length) for n in lengths) for r in hist.collect())


def test_empty_tables(spark):
    assert tokens.length_histogram(tokens.token_counts(empty(spark))).collect() == []
    assert packing.pack(empty(spark)).collect() == []


def test_buckets_are_folders(spark, tmp_path):
    packing.write_buckets(packing.pack(awkward(spark)), str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert sorted((r.length, bytes(r.ids)) for r in back.collect()) == sorted((r.length, bytes(r.ids)) for r in packing.pack(awkward(spark)).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 4096, 10_000, 99_999])
def test_cuts(n):
    found = packing.cuts(n)
    assert [at for at, _ in found] == [sum(size for _, size in found[:i]) for i in range(len(found))]
    assert sum(size for _, size in found) == n
    assert all(size & (size - 1) == 0 and size <= 2048 for _, size in found)
    assert sum(size < 2048 for _, size in found) == (n % 2048).bit_count()


def test_packing_is_a_round_trip(spark, reference):
    rows = awkward(spark).collect()
    found = packing.pack(awkward(spark)).collect()
    assert len({r.sequence_id for r in found}) == len(found)
    assert [r.length for r in sorted(found, key=lambda r: r.sequence_id)] == sorted((r.length for r in found), reverse=True)
    assert all(r.offset == 0 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in found)
    for doc_id in {r.doc_id for r in rows}:
        texts = [r.text or "" for r in rows if r.doc_id == doc_id]
        own = sorted((r.start, r.ids) for r in found if r.doc_id == doc_id)
        whole = b"".join(ids for i, (_, ids) in enumerate(own) if i % len(texts) == 0)
        assert np.frombuffer(whole, "<u4").tolist() == [*reference(texts[0]), 1]
        assert all(own[i][1] == own[i - i % len(texts)][1] for i in range(len(own)))
