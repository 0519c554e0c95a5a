"""Texts as PNG images in binary columns: written with checksummed chunks, read back, unfiltered, hashed by cosines."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import spread, table
from loam.llm.tokens import map_texts

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: PNG row filters.
NONE, SUB, UP, AVERAGE, PAETH = range(5)
LEVEL = 1
#: Side of the image that cosines are taken of, and of the block of low frequencies kept.
SIDE, LOW = 32, 8


def payload(data: bytes) -> bytes:
    """The bytes with zeros appended up to a positive multiple of the width."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    up, left, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    up[1:], left[:, 1:], corner[1:, 1:] = rows[:-1], rows[:, :-1], rows[:-1, :-1]
    if kind == NONE:
        return rows
    if kind == SUB:
        return rows - left
    if kind == UP:
        return rows - up
    if kind == AVERAGE:
        return rows - ((left.astype(np.int32) + up) // 2).astype(np.uint8)
    return rows - _paeth(left.astype(np.int32), up.astype(np.int32), corner.astype(np.int32)).astype(np.uint8)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def write_png(samples: bytes, kind: int = UP, level: int = LEVEL) -> bytes:
    """A grey 8-bit PNG, ``WIDTH`` samples a row, every row under the given filter."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.full((len(rows), 1), kind, np.uint8), _filtered(rows, kind)], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, body) of every chunk; a wrong signature, checksum or length raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, found = 8, []
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", data, at)
        if at + 12 + size > len(data):
            raise ValueError("a chunk is cut off")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(data[at + 4 : at + 8 + size]):
            raise ValueError(f"checksum of chunk {kind!r}")
        found.append((kind, body))
        at += 12 + size
    if not found or found[0][0] != b"IHDR" or found[-1][0] != b"IEND":
        raise ValueError("IHDR or IEND is missing")
    return found


def read_png(data: bytes) -> np.ndarray:
    """The samples (rows, columns) of a grey 8-bit PNG without interlacing; anything else raises ValueError."""
    parts = chunks(data)
    width, height, depth, color, method, filters, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if (depth, color, method, filters, interlace) != (8, 0, 0, 0, 0):
        raise ValueError("only grey 8-bit images without interlacing")
    try:
        raw = zlib.decompress(b"".join(body for kind, body in parts if kind == b"IDAT"))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width + 1):
        raise ValueError("samples are missing or too many")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    kinds, rows = lines[:, 0], lines[:, 1:]
    if kinds.max(initial=0) > PAETH:
        raise ValueError("unknown row filter")
    if (kinds == kinds[:1]).all() and (not height or kinds[0] in (NONE, SUB, UP)):
        same = kinds[0] if height else NONE
        return rows.copy() if same == NONE else np.cumsum(rows, axis=1 if same == SUB else 0, dtype=np.uint8)
    return _unfiltered(kinds, rows)


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row by row, as the filters may differ."""
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for i, kind in enumerate(kinds):
        line = rows[i]
        if kind == NONE:
            above = line
        elif kind == SUB:
            above = np.cumsum(line, dtype=np.uint8)
        elif kind == UP:
            above = line + above
        else:
            made, left, corner = bytearray(len(line)), 0, 0
            for x, (v, b) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
                if kind == AVERAGE:
                    guess = (left + b) // 2
                else:
                    p, q, r = abs(b - corner), abs(left - corner), abs(left + b - 2 * corner)
                    guess = left if p <= q and p <= r else b if q <= r else corner
                made[x] = left = v + guess & 255
                corner = b
            above = np.frombuffer(bytes(made), np.uint8)
        out[i] = above
    return out


def _cosines(n: int) -> np.ndarray:
    k, x = np.meshgrid(np.arange(LOW), np.arange(n), indexing="ij")
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


_BASIS = _cosines(SIDE)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: which low frequencies of the image, shrunk to 32 x 32, lie over their median."""
    sums = np.zeros((samples.shape[0] + 1, samples.shape[1] + 1))
    np.cumsum(np.cumsum(samples, axis=0, dtype=np.int64), axis=1, out=sums[1:, 1:])
    edges = [(np.arange(SIDE) * n // SIDE, np.maximum((np.arange(SIDE) + 1) * n // SIDE, np.arange(SIDE) * n // SIDE + 1)) for n in samples.shape]
    (r0, r1), (c0, c1) = edges
    area = sums[r1][:, c1] - sums[r0][:, c1] - sums[r1][:, c0] + sums[r0][:, c0]
    small = area / np.outer(r1 - r0, c1 - c0)
    low = (_BASIS @ small @ _BASIS.T).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): each text's UTF-8 bytes as a PNG. Null and empty texts give one row of zeros."""

    def row(doc_id: object, text: str) -> list[tuple]:
        data = text.encode()
        return [(doc_id, len(data), write_png(payload(data)))]

    return map_texts(docs, row, "doc_id long, n_bytes long, media binary")


def features(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the stored bytes back and describes them; one row for each row of ``docs``.

    doc_id, n_bytes (of the text), payload_bytes, payload_sha256 and tail_crc32 (of the samples read back; the crc of
    the last 64), media_bytes and media_sha256 (of the PNG), feature. Writing and reading share a task, so no image
    is shuffled; ``stored`` has the images themselves. A null text counts as empty, very long ones are stored whole, equal
    texts have equal values. Other columns are left out whatever their names; an empty table gives an empty table.
    """

    def row(doc_id: object, text: str) -> list[tuple]:
        data = text.encode()
        media = write_png(payload(data))
        samples = read_png(media)
        back = samples.tobytes()
        digest = hashlib.sha256
        return [(doc_id, len(data), len(back), digest(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), digest(media).hexdigest(), cosine_hash(samples))]

    return map_texts(docs, row, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def read_back(media: DataFrame) -> DataFrame:
    """(doc_id, payload, feature) of a table of stored images (doc_id, n_bytes, media); padding is cut off.

    A row that isn't a sound image gives a null payload and feature, and the error's text in ``error``.
    """

    def one(image: bytes | None, n: int | None) -> tuple:
        try:
            samples = read_png(image or b"")
        except ValueError as e:
            return None, None, str(e)
        return samples.tobytes()[:n], cosine_hash(samples), None

    names = ["doc_id", "payload", "feature", "error"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [one(image, n) for image, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = [pa.array([r[i] for r in read], kind) for i, kind in enumerate((pa.binary(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", F.col("n_bytes").cast("long"), "media").mapInArrow(work, f"doc_id {kind}, payload binary, feature string, error string")


def op6_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spread(table(spark, sf_dir, "documents")))
