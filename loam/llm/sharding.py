"""Size-balanced sharding by sampled splitters, in DataFrame operations only.

Records are ordered by key: the hash of the text, then doc_id, so that equal texts lie side by side, then a row number. A sample drawn with
chances in proportion to size gives splitters for many ranges; each record finds its range by a decision tree of
comparisons. Exact sizes of the ranges show the overfull ones, which are subdivided by splitters of their own until no
range holds more than a fixed share of all sizes or of all rows. Then exact running sizes, within a range and over the
ranges before it, place each record, and the shards are equal cuts of the whole size: they differ by less than one
document. Texts are read once; only (doc_id, size, crc, hash) is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import cut, table, text_of

SHARDS = 16
#: Ranges of the first division, sample keys drawn for each range, and how often overfull ranges are divided again.
RANGES, PER_RANGE, ROUNDS = 256, 24, 3
#: A range is overfull beyond this many times its even share of sizes or rows.
OVERFULL = 2.0


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h, d, u): d is doc_id with null last; u tells repeated rows apart."""
    text = F.encode(text_of(), "UTF-8")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("text").isNull(), F.lit(1)).otherwise(F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"),
        F.monotonically_increasing_id().alias("u"),
    )


KEY = ("h", "d", "u")


def _below(key: tuple) -> Column:
    h, d, u = (F.col(c) for c in KEY)
    return (h < key[0]) | ((h == key[0]) & ((d < key[1]) | ((d == key[1]) & (u < key[2]))))


def range_of(splitters: list[tuple], first: int = 0) -> Column:
    """Number of splitters at or below the key, as nested comparisons: about log2 of them for a record."""
    if not splitters:
        return F.lit(first)
    mid = len(splitters) // 2
    return F.when(_below(splitters[mid]), range_of(splitters[:mid], first)).otherwise(range_of(splitters[mid + 1 :], first + mid + 1))


def splitters(keyed: DataFrame, weight: Column, total: float, ranges: int) -> list[tuple]:
    """At most ``ranges`` - 1 keys at the quantiles of a sample, in which a record is kept with a chance in proportion
    to its weight. The chance is a hash of the key, so a rerun draws the same. The driver gets the sample's keys: about
    ``ranges`` times ``PER_RANGE`` of them, whatever the input."""
    chance = weight * F.lit(ranges * PER_RANGE / max(total, 1))
    drawn = F.shiftrightunsigned(F.xxhash64(*KEY), 11) / F.lit(float(2**53))
    sample = sorted(tuple(r) for r in keyed.where(drawn < chance).select(*KEY).collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def divided(keyed: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Adds ``range`` (long, in key order, numbers with gaps) to records; overfull ranges are divided further.

    Only sums over ranges, at most ``ranges`` for each round, and samples reach the driver.
    """
    sums = keyed.agg(F.sum("size").alias("size"), F.count("*").alias("rows")).first()
    total, rows = sums["size"] or 0, sums["rows"]
    ranged = keyed.withColumn("range", range_of(splitters(keyed, F.col("size"), total, ranges)).cast("long"))
    mean = total / max(rows, 1)
    for _ in range(ROUNDS):
        full = ranged.groupBy("range").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        over = full.where((F.col("n") > 1) & ((F.col("s") > OVERFULL * total / ranges) | (F.col("n") > OVERFULL * max(rows / ranges, 500)))).collect()
        ids = [r["range"] for r in over]
        inside = ranged.where(F.col("range").isin(ids)) if ids else None
        # weighed by size and by row alike, so that ranges of many small records divide too
        parts = splitters(inside, F.col("size") + F.lit(mean), sum(r["s"] + r["n"] * mean for r in over), ranges) if ids else []
        if not parts:
            break
        sub = F.when(F.col("range").isin(ids), range_of(parts)).otherwise(F.lit(0))
        ranged = ranged.withColumn("range", F.col("range") * F.lit(ranges) + sub.cast("long"))
    return ranged


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``; shards are near equal in bytes.

    size: UTF-8 bytes of the text plus 1, a null text counting as none. A shard is the cut of the total that the middle
    of the record falls in; slot numbers a shard's records from 0 in key order. Repeated rows are records of their own.
    Equal texts share a shard but where a cut falls between them; very long ones are one record. Other
    columns are left out whatever their names; an empty table gives an empty table.
    """
    ranged = cut(divided(cut(records(docs)), ranges))
    inside = Window.partitionBy("range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("s"))
    starts = sums.select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"), F.sum("s").over(whole).alias("total"))
    placed = ranged.withColumn("end", F.sum("size").over(inside)).withColumn("at", F.row_number().over(inside)).join(F.broadcast(starts), "range")
    placed = placed.withColumn("shard", F.expr(f"cast(least({shards} * (2 * (start + end) - size) div (2 * total), {shards - 1}) as int)"))
    pieces = placed.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.select("shard", "range", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(shifts), ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))


def op8_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
