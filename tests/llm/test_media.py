from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from loam.llm import media
from tests.llm.data import awkward, empty


def image(seed: int, height: int) -> bytes:
    return np.random.default_rng(seed).integers(0, 256, height * 64, dtype=np.uint8).tobytes()


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("height", [1, 2, 33])
def test_every_filter_is_a_round_trip(kind, height):
    data = image(kind, height)
    assert media.read_png(media.write_png(data, kind)).tobytes() == data


def test_mixed_filters():
    """A filter of its own for each row, built line by line from whole images of one filter."""
    data = image(9, 10)
    lines = []
    for y in range(10):
        raw = zlib.decompress(media.chunks(media.write_png(data, y % 5))[1][1])
        lines.append(raw[65 * y : 65 * (y + 1)])
    parts = dict(media.chunks(media.write_png(data)))
    made = media.SIGNATURE + media._chunk(b"IHDR", parts[b"IHDR"]) + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert media.read_png(made).tobytes() == data


@pytest.mark.parametrize("spoil", [lambda b: b[:-1], lambda b: b[:40] + bytes([b[40] ^ 1]) + b[41:], lambda b: b"x" + b[1:], lambda b: b[:8], lambda b: b""])
def test_unsound_images_are_told(spoil):
    with pytest.raises(ValueError):
        media.read_png(spoil(media.write_png(image(1, 5))))


def test_dimensions_must_fit():
    parts = dict(media.chunks(media.write_png(image(1, 5))))
    head = struct.pack(">II", 64, 6) + parts[b"IHDR"][8:]
    with pytest.raises(ValueError):
        media.read_png(media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", parts[b"IDAT"]) + media._chunk(b"IEND", b""))


def test_hash_is_stable_under_small_changes():
    a = np.frombuffer(image(3, 40), np.uint8).reshape(-1, 64)
    b = np.clip(a.astype(int) + np.random.default_rng(1).integers(-3, 4, a.shape), 0, 255).astype(np.uint8)
    far = np.frombuffer(image(4, 40), np.uint8).reshape(-1, 64)
    distance = lambda x, y: (int(media.cosine_hash(x), 16) ^ int(media.cosine_hash(y), 16)).bit_count()
    assert distance(a, b) < 10 < distance(a, far)


def test_cosines_against_the_definition():
    """An image of 32 x 32 isn't shrunk: the bits are those of a plain double sum."""
    x = np.random.default_rng(2).integers(0, 256, (32, 32))
    low = np.array([[sum(x[i, j] * np.cos(np.pi * (2 * i + 1) * u / 64) * np.cos(np.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)]).ravel()
    assert media.cosine_hash(x.astype(np.uint8)) == np.packbits(low > np.median(low[1:])).tobytes().hex()


def test_features_and_stored_images(spark):
    rows = awkward(spark).collect()
    found = media.features(awkward(spark)).collect()
    for r, f in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(found, key=lambda r: str(r.doc_id)), strict=True):
        data = (r.text or "").encode()
        whole = data + bytes(64 - len(data) % 64 if len(data) % 64 or not data else 0)
        assert (f.n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    images = media.stored(awkward(spark))
    assert {(r.doc_id, hashlib.sha256(r.media).hexdigest(), len(r.media)) for r in images.collect()} == {(r.doc_id, r.media_sha256, r.media_bytes) for r in found}
    assert sorted((bytes(r.payload) for r in media.read_back(images).collect())) == sorted((r.text or "").encode() for r in rows)


def test_unsound_rows_and_empty_tables(spark):
    bad = spark.createDataFrame([(1, 5, b"no image"), (2, None, None)], "doc_id long, n_bytes long, media binary")
    assert [(r.payload, r.feature, bool(r.error)) for r in media.read_back(bad).collect()] == [(None, None, True)] * 2
    assert media.features(empty(spark)).collect() == []
