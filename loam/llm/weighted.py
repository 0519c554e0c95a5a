"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is its words with their counts as weights. For a weight of S a consistent sample draws r and c from Gamma(2, 1) and b
from the unit interval, all by hash, takes t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1), and the least a of all
terms wins. Two texts get the same sample with a chance equal to their generalised Jaccard similarity, the sum of lesser
weights over that of greater. As counts are whole, a term of weight S is here S units of weight 1 with draws of their own,
units 1 to S of the term: a is exponential with rate S, and so is the least of S such of rate 1. A text that has the term less
often has the first ones of the same units.

There are ``BINS`` samples. Drawing each over all units would cost a draw a unit and sample, so units visit the samples in
turns: every unit goes through all of them, one a turn, in an order of its own by hash, and a sample is taken of the units
that came in the first turn that brought any, which in a long text is the first turn already. As every unit of the union of
two texts is as likely as any other to be among those and to win, and is one of both texts with a chance equal to their
similarity, the collision rate of each sample stays the generalised Jaccard similarity, whatever the weights. A short
text takes as many turns as fill its samples, a text of one word all ``BINS``. The likeness of two fingerprints is the share
of equal samples among those that are filled in either; as samples are kept as 8 bits, chance hits are taken off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import cut, partitions, table, text_of

BINS = 128
#: Units that have to visit the samples, over all turns, so that about 2 in 100 stay empty.
VISITS = 500
SPACE = r"[\x20\x09-\x0D]+"
#: Places after the point that ln a keeps, and how far it is shifted to be positive.
SCALE, SHIFT = 2.0**32, 128.0


def _unit(column: Column, shift: int, bits: int) -> Column:
    """A number in (0, 1) from some bits of a hash."""
    cut_out = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return (cut_out.cast("double") + F.lit(0.5)) / F.lit(float(1 << bits))


def turns(words: Column) -> Column:
    """How many turns a text of so many words (an array, with the empty string at an end that is white space) takes."""
    return F.least(F.lit(BINS), F.ceil(F.lit(VISITS) / F.greatest(F.size(words) - 1, F.lit(1)))).cast("int")


def _sample(here: Column) -> Column:
    """Turn and ln a as one ordered integer with 8 bits of the unit's hash below, never all 0; null for a text without the unit.

    Two uniforms multiplied make a Gamma(2, 1) draw: minus the logarithm of their product. At weight 1 t is 0.
    """
    g1, g2 = F.col("g1"), F.col("g2")
    r = -F.ln(_unit(g1, 0, 28) * _unit(g1, 28, 28))
    c = -F.ln(_unit(g2, 0, 21) * _unit(g2, 21, 21))
    ln_a = F.ln(c) - r * (F.lit(1.0) - _unit(g2, 42, 22))
    place = ((F.greatest(ln_a, F.lit(-100.0)) + F.lit(SHIFT)) * F.lit(SCALE)).cast("long")
    mark = F.pmod(F.shiftrightunsigned(g1, 3), F.lit(255)) + F.lit(1)
    return F.when(here, F.shiftleft(place, 8).bitwiseOR(mark).bitwiseOR(F.shiftleft(F.col("turn").cast("long"), 48)))


def samples(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, one, two) from (keys, turns_one, turns_two, term long, n_one, n_two): the samples of two bags of words at once."""
    units = words.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("n_one", "n_two") - 1)))
    own = lambda side: F.when(F.col("unit") < F.col(f"n_{side}"), F.col(f"turns_{side}")).otherwise(0)
    timed = units.select(*keys, own("one").alias("t1"), own("two").alias("t2"), F.xxhash64("term", "unit").alias("way"))
    visits = timed.select("*", F.explode(F.sequence(F.lit(0), F.greatest("t1", "t2") - 1)).alias("turn"))
    # the order of a unit's visits: a start and an odd step, so that it meets every bin once
    step = F.shiftrightunsigned("way", 7).bitwiseAND(F.lit(BINS - 1).cast("long")).bitwiseOR(F.lit(1).cast("long"))
    drawn = visits.select(
        *keys, "turn", (F.col("way") + step * F.col("turn")).bitwiseAND(F.lit(BINS - 1).cast("long")).cast("int").alias("bin"),
        (F.col("turn") < F.col("t1")).alias("in_one"), (F.col("turn") < F.col("t2")).alias("in_two"), F.xxhash64("way", "turn").alias("g1"), F.xxhash64("turn", "way").alias("g2"),
    )
    valued = drawn.select(*keys, "bin", "in_one", "in_two", _sample(F.lit(True)).alias("sample"))
    return valued.groupBy(*keys, "bin").agg(F.min(F.when(F.col("in_one"), F.col("sample"))).alias("one"), F.min(F.when(F.col("in_two"), F.col("sample"))).alias("two"))


def _packed(column: str) -> Column:
    """A byte for each bin: the sample's low 8 bits, which are never 0, or 0 where the bin is empty."""
    entry = F.when(F.col(column).isNotNull(), F.shiftleft(F.col("bin"), 8) + F.col(column).bitwiseAND(F.lit(255).cast("long")).cast("int"))
    entries = F.array_sort(F.collect_list(entry))
    byte = lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(255))), 2, "0")
    bins = F.transform(entries, lambda x: F.shiftright(x, 8))
    # each entry brings the zeros of the empty bins before it
    before = F.concat(F.array(F.lit(-1)), bins)
    padded = F.zip_with(F.slice(before, 1, F.size(bins)), entries, lambda p, x: F.concat(F.repeat(F.lit("00"), F.shiftright(x, 8) - p - 1), byte(x)))
    return F.unhex(F.rpad(F.array_join(padded, ""), 2 * BINS, "0"))


def _share(equal: Column, filled: Column) -> Column:
    """Share of equal samples without chance hits; two fingerprints without samples are alike."""
    rate = equal.cast("double") / filled.cast("double")
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.greatest((rate * 255 - 1) / 254, F.lit(0.0)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness (0 to 1) of two fingerprints in their hex form."""
    one, two = F.regexp_extract_all(a, F.lit("(..)")), F.regexp_extract_all(b, F.lit("(..)"))
    both = F.zip_with(one, two, lambda x, y: F.when(x != y, 1).when(x != "00", 2))
    return _share(F.size(F.filter(both, lambda x: x == 2)), F.size(F.filter(both, lambda x: x.isNotNull())))


def order(docs: DataFrame) -> DataFrame:
    """The circle of documents by descending doc_id (null last; then by the text's hash), one row for each (d, h).

    (d, h, copies, next_d, next_h, prev_d, prev_h, prev_n): d is doc_id, or the least long for null; h the text's hash, n its
    code points. Rows are range-partitioned; leads and lags go within a range, and only the ranges' ends, one row a
    range, are put in order in one place.
    """
    rows = docs.groupBy("d", "h").agg(F.count("*").alias("copies"), F.max(F.char_length("text")).alias("n"))
    ranged = cut(rows.repartitionByRange(partitions(docs), F.desc("d"), "h").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(F.desc("d"), "h")
    me = F.struct("d", "h", "n")
    led = ranged.select("*", F.lead(me).over(inside).alias("next"), F.lag(me).over(inside).alias("prev"))
    ends = led.groupBy("range").agg(F.first(F.when(F.col("prev").isNull(), me), ignorenulls=True).alias("head"), F.first(F.when(F.col("next").isNull(), me), ignorenulls=True).alias("tail"))
    line = Window.orderBy("range")
    circle = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("head").over(line), F.first("head").over(circle))
    before = F.coalesce(F.lag("tail").over(line), F.last("tail").over(circle))
    ends = ends.select("range", after.alias("after"), before.alias("before"))
    full = led.join(F.broadcast(ends), "range").withColumn("next", F.coalesce("next", "after")).withColumn("prev", F.coalesce("prev", "before"))
    at = lambda side, c: F.col(f"{side}.{c}").alias(f"{side}_{c}")
    return full.select("d", "h", "copies", at("next", "d"), at("next", "h"), at("prev", "d"), at("prev", "h"), at("prev", "n"))


#: Stands for a null doc_id: the least long, so last in descending order.
NULL_ID = -(2**63)


def edited(docs: DataFrame) -> DataFrame:
    """(d, h, copies, text, edited, next_d, next_h): each text and its edited form, one row for each (d, h).

    Of the edited form the last floor(n / 3) code points are those that the next document begins with. A text is
    shuffled once, and once more the part of it that the document before needs. Partitions are small: what follows
    counts the words of each document in them.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.xxhash64(text_of()).alias("h"), text_of().cast("string").alias("text"))
    whole = rows.repartition(4 * partitions(docs), "d", "h").groupBy("d", "h").agg(F.first("text").alias("text"))
    known = whole.join(order(rows).hint("merge"), ["d", "h"])  # both grow with the table: never broadcast
    third = lambda n: F.floor(n / F.lit(3)).cast("int")
    lent = known.select(F.col("prev_d").alias("d"), F.col("prev_h").alias("h"), F.substring("text", F.lit(1), third(F.col("prev_n"))).alias("lent"))
    n = F.char_length("text")
    made = F.concat(F.substring("text", F.lit(1), n - third(n)), "lent")
    return known.join(lent.hint("merge"), ["d", "h"]).select("d", "h", "copies", "text", made.alias("edited"), "next_d", "next_h")


def bag(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, turns_one, turns_two, term, n_one, n_two) from (keys, text, edited): how often each word stands in either."""
    split = texts.select(*keys, F.split("text", SPACE).alias("one"), F.split("edited", SPACE).alias("two"))
    split = split.select(*keys, turns(F.col("one")).alias("turns_one"), turns(F.col("two")).alias("turns_two"), "one", "two")
    keys = [*keys, "turns_one", "turns_two"]
    sides = F.array(F.struct(F.lit(True).alias("first"), F.col("one").alias("words")), F.struct(F.lit(False).alias("first"), F.col("two").alias("words")))
    each = split.select(*keys, F.inline(sides)).select(*keys, "first", F.explode("words").alias("word")).where("word <> ''")
    return each.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.count_if("first").alias("n_one"), F.count_if(~F.col("first")).alias("n_two"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next.

    A null text counts as empty; a text without words has a fingerprint of zeros, and two such are alike (1). Repeated
    rows (same doc_id and text) count once in the order of documents and come out as often as they go in. A single
    document is its own next one. Very long texts count whole; other columns are left out whatever their names; an empty
    table gives an empty table.
    """
    keys = ["d", "h"]
    texts = edited(docs)
    drawn = samples(bag(texts, keys), keys)
    signed = drawn.groupBy(*keys).agg(
        _packed("one").alias("one"), _packed("two").alias("two"), F.count("*").alias("filled"),
        F.count_if(F.col("one").bitwiseAND(F.lit(255).cast("long")) == F.col("two").bitwiseAND(F.lit(255).cast("long"))).alias("equal"),
    )
    facts = texts.select(*keys, "copies", F.char_length("text").cast("long").alias("n_chars"), F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)).alias("sha"), "next_d", "next_h")
    none = F.unhex(F.lit("00" * BINS))
    whole = cut(facts.join(signed.hint("merge"), keys, "left").select(
        *keys, "copies", "n_chars", "sha", "next_d", "next_h", F.coalesce("one", none).alias("one"), F.coalesce("two", none).alias("two"),
        _share(F.coalesce("equal", F.lit(0)), F.coalesce("filled", F.lit(0))).alias("near_edited"),
    ))
    after = whole.select(F.col("d").alias("next_d"), F.col("h").alias("next_h"), F.col("one").alias("after"))
    hexed = lambda c: F.lower(F.hex(c))
    out = whole.join(after.hint("merge"), ["next_d", "next_h"]).select(
        F.when(F.col("d") != NULL_ID, F.col("d")).alias("doc_id"), "n_chars", hexed("sha").alias("edited_sha256"), hexed("one").alias("fingerprint"), hexed("two").alias("edited_fingerprint"), "near_edited",
        likeness(hexed("one"), hexed("after")).alias("near_next"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")


def op1_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
