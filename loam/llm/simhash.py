"""SimHash near-duplicates: fingerprints, pigeonring candidates, exact links, components.

The 64 bits form a ring of 16 segments of 4 bits. If two fingerprints differ in at most 3 bits, then from some start
on the ring every chain of l segments differs in at most floor(3 l / 16) bits: none in the first 5 segments, at most 1
in 10, 2 in 15, 3 in 16. Of the segments 6 to 10 of such a chain, either the first two or the last three are free of
differences, so the pair meets under a key of 28 or of 32 equal bits. Each fingerprint is filed under 16 x 2 keys; only
keys with company go on, and inside a key the exact Hamming distance is taken.

A key held by many fingerprints (a family of near copies) is split into blocks of about ``BLOCK``; every two blocks meet
in one group, which returns a spanning forest of its links, never all pairs. So no task holds more than about two
blocks, the rows made stay linear in a block's size, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import resemblance
from loam.llm.common import cut, partitions, spread, table
from loam.llm.components import components
from loam.llm.grouped import edge_batch, forest, groups

WORDS = 3
SEED = 42
DISTANCE = 3
SEGMENTS, BITS = 16, 4
BLOCK = 1024
#: Over how many groups the fingerprints of a key larger than a block are dealt when they meet its count.
SALTS = 64


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Fingerprint of UTF-8 text: A-Z lowered, words split at ASCII white space, shingles with their repeats."""
    return _print(words_of(text), words)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _print(found: list[bytes], words: int) -> int:
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        return digest(b" ".join(found), SEED)
    runs = zip(*(found[i:] for i in range(words)), strict=False)
    hashes = np.fromiter((digest(b" ".join(run), SEED) for run in runs), np.uint64, len(found) - words + 1)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, key: Column | None = None) -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``; a null text counts as empty. Bits are read as a signed long.

    With ``key`` (a long column) its value, and the text's signature of ``resemblance``, follow as key and sig.
    """
    rest = [] if key is None else ["key"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            prints = np.fromiter((_print(f, words) for f in found), np.uint64, batch.num_rows)
            more = [batch.column("key"), pa.array(map(resemblance.signature, found), pa.binary())] if rest else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64)), *more], names=["doc_id", "fp", *rest, "sig"][: 2 + len(more)])

    keys = [] if key is None else [key.alias("key")]
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keys)
    return read.mapInArrow(work, "doc_id long, fp long" + ", key long, sig binary" * len(keys))


def _turned(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def ring_keys(fp: Column) -> Column:
    """The 32 keys of a fingerprint: for each start of a chain 28 leading bits, and 20 leading bits with bits 29 to 40."""
    keys = []
    for i in range(SEGMENTS):
        ring = _turned(fp, BITS * i)
        near = F.shiftrightunsigned(ring, 36)
        far = F.shiftleft(F.shiftrightunsigned(ring, 44), 12).bitwiseOR(F.shiftrightunsigned(ring, 24).bitwiseAND(F.lit(0xFFF).cast("long")))
        for half, value in enumerate((near, far)):
            keys.append(value.bitwiseOR(F.lit((2 * i + half) << 40).cast("long")))
    return F.array(*keys)


def _near(rest: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rest ^ one) <= DISTANCE


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, b1, b2, fp) come sorted: one forest for each group of the first three."""
    for group in groups(batches, 3):
        values = group.column(3).to_numpy()
        edges = forest(values.view(np.uint64), _near)
        yield edge_batch([(values[a], values[b]) for a, b in edges])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) among distinct fingerprints (fp): spanning forests whose union has the components of all links.

    Fingerprints are few bytes, so they are dealt over all partitions before their keys are made. A key with two of them is
    decided where it is counted. Those of a large key are dealt by a salt before they meet the key's count.
    """
    filed = distinct.repartition(partitions(distinct), "fp").select("fp", F.explode(ring_keys(F.col("fp"))).alias("key"))
    company = cut(filed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"))
    pairs = company.where((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)).select("u", "v")
    more = company.where("n > 2").select("key", "n")
    meet = filed.join(more.where(F.col("n") <= BLOCK), "key")
    large = more.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        salted = filed.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(SALTS)))
        meet = meet.unionByName(salted.join(large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"]).drop("salt"))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = meet.select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    grouped = dealt.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grouped = grouped.select("key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "fp")
    ordered = grouped.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    return pairs.unionByName(ordered.mapInArrow(_forests, "u long, v long")).distinct()


def _labelled(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``distinct`` (fp, ...) with label, equal within a component of the edges."""
    labels = components(edges).withColumnRenamed("node", "fp")
    return distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", F.xxhash64("fp")))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over links of at most 3 differing bits.

    Null and empty texts have fingerprint zero and link to each other. Repeated rows stay, one row out for each. Rows
    with a null doc_id keep it; their component is the smallest doc_id that isn't null, or null if there is none. An
    empty table gives an empty table; other columns are left out.
    """
    rows = cut(fingerprints(docs, words))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    classes = _labelled(distinct, cut(links(distinct.select("fp"))))
    lowest = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    return rows.join(classes.join(lowest, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _shingles(docs: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """(sid, shingles) of the texts that stand for the signatures of ``wanted`` (sid, key)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [resemblance.shingled(words_of(t.as_py())).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["sid", "shingles"])

    texts = docs.select(key.alias("key"), F.col("text").cast("string").alias("text")).join(wanted, "key").select("sid", "text")
    return texts.groupBy("sid").agg(F.first("text").alias("text")).mapInArrow(work, "sid long, shingles binary")


def first_rows(docs: DataFrame, key: Column, words: int = WORDS) -> DataFrame:
    """(doc_id, key) of exactly one row of each component: the smallest doc_id, rows without one last, then the
    smallest ``key``, a long that tells the rows of one doc_id apart.

    Components are those of ``near_duplicates``, joined where texts are alike by ``resemblance`` (five-word shingles, 0.8; where the
    estimate is a little less, by their exact similarity): fingerprints within 3 bits are few among texts that are less
    than all but equal.
    """
    rows = cut(fingerprints(docs, words, key).withColumn("sid", F.xxhash64("sig")))
    signed = cut(rows.groupBy("sid").agg(F.first("sig").alias("sig"), F.min("fp").alias("u"), F.max("fp").alias("v"), F.min("key").alias("key")))
    judged = cut(resemblance.judged(signed.select("sid", "sig")))
    alike, doubts = judged.where("alike").select("u", "v"), cut(judged.where("not alike").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if not doubts.isEmpty():
        # within a component of sure links a doubt changes nothing: of a large family hardly any are left
        of = cut(components(alike))
        label = lambda c: of.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        placed = doubts.join(label("u"), "u", "left").join(label("v"), "v", "left")
        doubts = cut(placed.where(F.coalesce("u_label", F.xxhash64("u")) != F.coalesce("v_label", F.xxhash64("v"))).select("u", "v"))
        ends = doubts.select(F.col("u").alias("sid")).union(doubts.select("v")).distinct()
        alike = cut(alike.union(resemblance.confirmed(doubts, _shingles(docs, key, signed.join(ends, "sid").select("sid", "key")))))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    distinct = cut(rows.groupBy("fp").agg(F.min(rank).alias("low")))
    # a signature ties its texts' fingerprints together where it has several of them or is alike to another
    touched = alike.select(F.col("u").alias("sid")).union(alike.select("v")).union(signed.where("u <> v").select("sid")).distinct()
    ties = rows.select("fp", "sid").distinct().join(touched, "sid").select(F.col("fp").alias("u"), F.col("sid").alias("v"))
    classes = _labelled(distinct, cut(links(distinct.select("fp")).union(alike).union(ties)))
    return classes.groupBy("label").agg(F.min("low").alias("low")).select("low.doc_id", "low.key")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
