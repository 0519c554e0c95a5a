"""Importance resampling towards a target: hashed n-gram counts of two corpora, a gain a bucket, Gumbel draws by score.

Texts are cut at newlines into lines, and every distinct line's features are counted once: its words' runs of up to
``grams`` words, as buckets. A corpus's counts are the distinct lines' counts times their occurrences; runs of words that
go over a line's end are counted for each text and added separately (with single words there are none). A text's weight is
put together from its lines' gains in the same way. What is joined are hashes and sums, never texts.

Lines that make up more than one in ``HOT`` of all lines (license lines, separators) are at most ``HOT`` rows: their sums
go to all tasks, so no key of the join has more than that share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import cut, table, text_of

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, GRAMS, LEAST, SHARE = 10_000, 1, 20, 10
HOT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(line: Column) -> Column:
    return F.regexp_extract_all(F.translate(line, UPPER, LOWER), F.lit(WORDS), F.lit(0))


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


NO_RUNS = "CAST(array() AS array<string>)"


def _slices(of: Column, k: int) -> Column:
    """The slices of ``k`` neighbours of an array; none of a shorter one."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(of) - (k - 1), F.lit(1))), lambda i: i <= F.size(of) - (k - 1))
    return F.transform(starts, lambda i: F.slice(of, i, k))


def runs(own: Column, grams: int) -> Column:
    """All runs of 1 to ``grams`` words of an array, joined by a space."""
    longer = (F.transform(_slices(own, k), lambda r: F.array_join(r, " ")) for k in range(2, grams + 1))
    return F.concat(own, *longer) if grams > 1 else own


def crossing(text: Column, grams: int) -> Column:
    """Runs of 2 to ``grams`` words that begin in one line and end in a later one.

    Of each line only the words near its ends are kept, with a null between them; a run without null over two or more
    lines is one that crosses.
    """
    edge = grams - 1

    def ends(line: Column, at: Column) -> Column:
        own = F.transform(words(line), lambda w: F.struct(at.alias("line"), w.alias("word")))
        return F.when(F.size(own) <= 2 * edge, own).otherwise(F.concat(F.slice(own, 1, edge), F.array(F.lit(None)), F.slice(own, -edge, edge)))

    def over(k: int) -> Column:
        whole = F.filter(_slices(F.flatten(F.transform(F.split(text, "\n"), ends)), k), lambda r: F.forall(r, lambda x: x.isNotNull()))
        crossed = F.filter(whole, lambda r: F.element_at(r, 1)["line"] < F.element_at(r, -1)["line"])
        return F.transform(crossed, lambda r: F.array_join(F.transform(r, lambda x: x["word"]), " "))

    return F.concat(F.expr(NO_RUNS), *(over(k) for k in range(2, grams + 1)))


def _hashes(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("l1"), F.xxhash64(F.lit(1), line).alias("l2")]


def lines(texts: DataFrame, grams: int, buckets: int) -> DataFrame:
    """(l1, l2, times, n_words, owned array of buckets) of the distinct lines of ``texts`` (text); lines without words are left out."""
    each = texts.select(F.explode(F.split(text_of(), "\n")).alias("line")).where(F.col("line").rlike(WORDS) | F.col("line").rlike("[A-Z]"))
    once = each.groupBy("line").agg(F.count("*").alias("times"))
    own = words(F.col("line"))
    return once.select(*_hashes(F.col("line")), "times", F.size(own).cast("long").alias("n_words"), F.transform(runs(own, grams), lambda f: bucket(f, buckets)).alias("owned"))


def counts(texts: DataFrame, held: DataFrame, grams: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all ``texts``, from their distinct lines ``held`` and from the runs that cross lines."""
    within = held.select(F.explode("owned").alias("bucket"), "times").groupBy("bucket").agg(F.sum("times").alias("n"))
    if grams == 1:
        return within
    over = texts.select(F.explode(F.transform(crossing(text_of(), grams), lambda f: bucket(f, buckets))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return within.unionByName(over).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket: floor of 1000 times the logarithm of the target's smoothed share over the source's."""
    session = source.sparkSession
    s, t = source.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    sums = s.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")).crossJoin(t.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")))  # one row each
    real = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = (real("t") + 1.0) * (real("all_s") + float(buckets)) / ((real("s") + 1.0) * (real("all_t") + float(buckets)))
    every = session.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").crossJoin(F.broadcast(sums))
    return every.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def weighed(texts: DataFrame, held: DataFrame, gain: DataFrame, grams: int, buckets: int) -> DataFrame:
    """(d, h, copies, n_words, n_features, weight) of ``texts`` (d, h, text), one row for each (d, h).

    ``gain`` is brought to all tasks as one map of ``buckets`` numbers.
    """
    one = gain.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))
    owned_sum = lambda owned: F.aggregate(owned, F.lit(0).cast("long"), lambda total, b: total + F.element_at("gains", b + 1))
    known = held.crossJoin(F.broadcast(one)).select("l1", "l2", "times", "n_words", F.size("owned").cast("long").alias("n"), owned_sum(F.col("owned")).alias("g"))
    known = cut(known)
    total = F.broadcast(known.agg(F.sum("times").alias("all_times")))
    split = known.crossJoin(total).withColumn("hot", F.col("times") * HOT > F.col("all_times")).drop("times", "all_times")
    hot = split.where("hot").select("l1", "l2", *(F.col(c).alias(f"hot_{c}") for c in ("n_words", "n", "g")))
    rare = split.where("not hot").drop("hot")
    each = texts.select("d", "h", F.explode(F.split("text", "\n")).alias("line")).select("d", "h", *_hashes(F.col("line")))
    met = each.join(F.broadcast(hot), ["l1", "l2"], "left")  # at most HOT rows
    columns = ("n_words", "n", "g")
    commons = met.where("hot_n is not null").groupBy("d", "h").agg(*(F.sum(f"hot_{c}").alias(c) for c in columns))
    others = met.where("hot_n is null").select("d", "h", "l1", "l2").join(rare.hint("shuffle_hash"), ["l1", "l2"]).groupBy("d", "h").agg(*(F.sum(c).alias(c) for c in columns))
    parts = [commons, others, texts.groupBy("d", "h").agg(F.count("*").alias("copies"))]
    if grams > 1:
        own = texts.crossJoin(F.broadcast(one)).select("d", "h", "gains", F.transform(crossing(F.col("text"), grams), lambda f: bucket(f, buckets)).alias("owned"))
        parts.append(own.select("d", "h", F.size("owned").cast("long").alias("n"), owned_sum(F.col("owned")).alias("g")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    total_of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    summed = whole.groupBy("d", "h").agg(F.sum("copies").alias("copies"), *(total_of(c).alias(c) for c in columns))
    # sums over equal rows: divided by their number they are one row's
    return summed.select("d", "h", "copies", F.expr("n_words div copies").alias("n_words"), F.expr("n div copies").alias("n_features"),
        F.when(F.col("n") > 0, F.expr("(g - pmod(g, n)) div n")).otherwise(F.lit(0).cast("long")).alias("weight"))


def drawn(scored: DataFrame, least: int, share: int) -> DataFrame:
    """``scored`` (d, h, copies, n_words, score ...) with first, the rank of the first of its copies, and most, how many are drawn.

    Scores are whole numbers between about -60 000 and 80 000, as logarithms of counts are small; so the table of how many
    documents have each score is short, and its running sum is taken in one task. Places among equal scores go by doc_id.
    """
    able = scored.where(F.col("n_words") >= least)
    per = able.groupBy("score").agg(F.sum("copies").alias("n"))
    line = Window.orderBy(F.desc("score"))
    above = per.select("score", F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"),
        F.floor(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share / 100).alias("most"))
    near = scored.join(F.broadcast(above), "score", "left")
    within = F.col("n_words") >= least
    equal = Window.partitionBy("score").orderBy(F.asc_nulls_last("d"), "h").rowsBetween(Window.unboundedPreceding, -1)
    winners = near.where(within & (F.col("above") < F.col("most"))).withColumn("first", F.col("above") + F.coalesce(F.sum("copies").over(equal), F.lit(0)) + 1)
    losers = near.where(~within | (F.col("above") >= F.col("most"))).withColumn("first", F.lit(None).cast("long"))
    return winners.unionByName(losers)


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, least: int = LEAST, share: int = SHARE, seed: str = "2024:") -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    score is the weight plus a Gumbel draw by sha256 of ``seed`` and doc_id; of the texts with ``least`` words or more the
    ``share`` in a hundred with the highest scores are drawn, ties to the smaller doc_id; rank is null for the others. Null
    texts count as empty, and an empty text has weight 0. A null doc_id is hashed as an empty one and comes last of ties. Rows
    equal in both are documents of their own with following ranks. Very long texts count whole; other columns are
    left out whatever their names; an empty table gives an empty table, an empty target the smoothed one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_of()).alias("h"), text_of().cast("string").alias("text"))
    held = cut(lines(texts, grams, buckets))
    wanted = target.select(text_of().cast("string").alias("text"))
    gain = gains(counts(texts, held, grams, buckets), counts(wanted, lines(wanted, grams, buckets), grams, buckets), buckets)
    weights = weighed(texts, held, gain, grams, buckets)
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("d").cast("string"), F.lit(""))).cast("binary"), 256)
    unit = (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = cut(weights.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.ln(-F.ln(unit)))))
    ranked = drawn(scored, least, share)
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    out = ranked.select("d", "n_features", "weight", "score", "first", "most", copy)
    place = F.col("first") + F.col("copy")
    return out.select(F.col("d").alias("doc_id"), "n_features", "weight", "score", F.when(place <= F.col("most"), place).alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 by its table, made from its rule, over the bytes of each distinct word.
ORACLE_SQL = r"""
WITH bits AS (SELECT i, list_reduce(list_prepend(i, [CAST(0 AS BIGINT) FOR _ IN range(8)]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
dw AS (SELECT r, unnest(words) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
y AS (SELECT word, [CAST(instr('0123456789ABCDEF', h[2 * i - 1]) * 16 + instr('0123456789ABCDEF', h[2 * i]) - 17 AS BIGINT) FOR i IN generate_series(1, length(h) // 2)] AS bytes FROM v),
k AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM y, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (word) GROUP BY 1),
sums AS (SELECT CAST((SELECT count(*) FROM dw) AS DOUBLE) AS all_s, CAST((SELECT count(*) FROM bw) AS DOUBLE) AS all_t),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + CAST(1 AS DOUBLE)) * (all_s + 10000) / ((coalesce(s, 0) + CAST(1 AS DOUBLE)) * (all_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
w AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - (((g % n) + n) % n)) // n ELSE 0 END AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM x),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, (SELECT count(*) FROM z WHERE n_features >= 20) * 10 // 100 AS most FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM o
"""
