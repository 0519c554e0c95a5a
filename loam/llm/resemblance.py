"""Near copies by resemblance: the Jaccard similarity of five-word shingles, estimated from signatures of 256 samples.

A signature is made like a minwise one, but each shingle visits the samples in turns (one a turn, all of them in an order of
its own), and a sample is the least hash among the shingles that came in the first turn that brought any. So a long text is
done in a turn or few, and a text of one shingle fills all samples too. Eight bits are kept of each; chance hits are taken off.

Texts meet if one of 32 bands of 8 samples is equal: two of similarity 0.8 do with a chance of 0.997. Where a band is equal,
every text is held against the band's first one. What isn't like that one is held against all others of the band too, in
blocks, and gives back a spanning forest. So a family of near copies costs about one comparison a text and band, every link of
two texts that meet is found, and no task holds more than two blocks.

An estimate has a standard deviation of 0.025 at 0.8, so below the threshold, from ``DOUBT`` on, links are told apart by the exact
similarity of the texts' shingles: ``doubts`` are such pairs (of a family that only they tie together, a forest of them), and
``confirmed`` keeps those that are alike indeed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import cut, partitions
from loam.llm.grouped import forest, groups

WORDS, LEAST, DOUBT = 5, 0.8, 0.72
SAMPLES, BANDS = 256, 32
BLOCK = 1024
_PRIME, _GOLD = np.uint64(0x9E3779B185EBCA87), 0x9E3779B97F4A7C15
#: Equal samples from which two signatures are alike, chance hits counted in.
_EQUAL = SAMPLES * (LEAST * 254 + 1) / 255
_UNSURE = SAMPLES * (DOUBT * 254 + 1) / 255


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingled(words: list[bytes]) -> np.ndarray:
    """Distinct hashes, in order, of the shingles of a text's words; fewer than five words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    shingles = own[: max(1, len(own) - WORDS + 1)].copy()
    for i in range(1, min(WORDS, len(own))):
        shingles = shingles * _PRIME + own[i : i + len(shingles)]
    return np.unique(_mixed(shingles))


def signature(words: list[bytes]) -> bytes:
    """Signature of a text's words in order; fewer than five are one shingle, none give zeros."""
    if not words:
        return bytes(SAMPLES)
    shingles = shingled(words)
    order = _mixed(shingles ^ np.uint64(_GOLD))
    start, step = order & np.uint64(SAMPLES - 1), (order >> np.uint64(8)) | np.uint64(1)
    least = np.full(SAMPLES, np.iinfo(np.uint64).max)
    open_ = np.ones(SAMPLES, bool)
    for turn in range(SAMPLES):  # by the last one every sample is filled
        at = ((start + step * np.uint64(turn)) & np.uint64(SAMPLES - 1)).astype(np.int64)
        came = open_[at] if turn else slice(None)
        np.minimum.at(least, at[came], _mixed(shingles[came] + np.uint64(_GOLD * (turn + 1) % 2**64)))
        open_[at] = False
        if not open_.any():
            break
    return ((least >> np.uint64(16)) & np.uint64(255)).astype(np.uint8).tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures (bytes in the last axis)."""
    return np.maximum(((a == b).mean(axis=-1) * 255 - 1) / 254, 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SAMPLES)


def _near(rest: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (rest == one).sum(axis=1) >= _EQUAL


def _perhaps(rest: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (rest == one).sum(axis=1) >= _UNSURE


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, alike, perhaps) of (u, v, a, b)."""
    for batch in batches:
        equal = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal >= _EQUAL), pa.array(equal >= _UNSURE)], names=["u", "v", "alike", "perhaps"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, alike) of rows (key, left, right, sid, sig) sorted by the first three: a forest of the links, and of a forest of what
    may be links those that aren't."""
    for group in groups(batches, 3):
        ids = group.column("sid").to_pylist()
        values = _matrix(group.column("sig"))
        sure = [(a, b, True) for a, b in forest(values, _near)]
        more = [(a, b, False) for a, b in forest(values, _perhaps) if not _near(values[[a]], values[b])[0]]
        rows = [(ids[a], ids[b], alike) for a, b, alike in sure + more if ids[a] != ids[b]]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["u", "v", "alike"])


def links(signed: DataFrame) -> DataFrame:
    """Edges (u, v) among distinct signatures (sid long, sig binary): of every two that share a band and are alike, both
    are in one component of the edges."""
    return judged(signed).where("alike").select("u", "v")


def judged(signed: DataFrame) -> DataFrame:
    """(u, v, alike) of distinct signatures: the edges of ``links``, and pairs that may be alike though their estimate isn't."""
    dealt = cut(signed.repartition(partitions(signed), "sid"))
    size = SAMPLES // BANDS
    bands = F.array(*(F.xxhash64(F.substring("sig", i * size + 1, size), F.lit(i)) for i in range(BANDS)))
    filed = dealt.select("sid", F.explode(bands).alias("key"))
    company = filed.groupBy("key").agg(F.count("*").alias("n"), F.min("sid").alias("first")).where("n > 1")
    met = cut(filed.join(company, "key"))
    pairs = met.where("sid <> first").select(F.col("sid").alias("u"), F.col("first").alias("v")).distinct()
    one, two = (dealt.select(F.col("sid").alias(c), F.col("sig").alias(f"sig_{c}")) for c in ("u", "v"))
    checked = cut(pairs.join(one, "u").join(two, "v").select("u", "v", "sig_u", "sig_v").mapInArrow(_checked, "u long, v long, alike boolean, perhaps boolean"))
    direct = checked.where("perhaps").select("u", "v", "alike")
    # what isn't like its band's first one meets all others of the band
    unlike = checked.where("not alike").select(F.col("u").alias("sid"), F.col("v").alias("first"))
    left_over = cut(met.where("n > 2").join(unlike, ["sid", "first"]).select("key", "sid"))
    if left_over.isEmpty():
        return direct
    open_bands = left_over.groupBy("key").agg(F.count("*").alias("over"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    block_of = lambda n: F.pmod(F.xxhash64("sid", F.lit(7)), F.col(n)).cast("int")
    every = met.join(open_bands, "key").select("key", "sid", blocks("n").alias("lefts"), blocks("over").alias("rights"))
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = every.select("key", block_of("lefts").alias("left"), all_("rights").alias("right"), "sid")
    right = every.join(left_over, ["key", "sid"], "left_semi").select("key", all_("lefts").alias("left"), block_of("rights").alias("right"), "sid")
    together = left.unionByName(right).join(dealt, "sid").select("key", "left", "right", "sid", "sig")
    ordered = together.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return direct.unionByName(ordered.mapInArrow(_forests, "u long, v long, alike boolean"))


def confirmed(doubts: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``doubts`` (u, v) whose texts (sid, shingles as 64-bit bytes, in order) have an exact similarity of ``LEAST``."""
    one, two = (texts.select(F.col("sid").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("u", "v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= LEAST * (len(x) + len(y) - both))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    return doubts.join(one, "u").join(two, "v").select("u", "v", "of_u", "of_v").mapInArrow(work, "u long, v long")
