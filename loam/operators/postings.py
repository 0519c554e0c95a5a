"""A stored keyword index: postings in blocks of a term and a range of passages, in segments, kept by article.

A block holds what one term has in one range of passages, and the greatest count in it. The counts of a range's blocks, added up
over a query's terms, bound what any passage there can score; so once a query's best ranges have given it ``most`` passages,
ranges whose bound is below the worst of them aren't opened. The rows found are exactly those of a scan.

Changed articles come as a further segment with the list of their ids: what older segments hold of them no longer counts. When
segments have become many, ``compacted`` writes them as one. Folders of a segment are by hash of the term, so a batch of queries
reads the folders of its terms alone, and of the blocks it doesn't open only terms and bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions.text import tokens
from loam.sources.tables import bucket_of, cut, written

#: Passages in a range, ranges to a folder of a segment, folders at most (each task writes a file to each), ranges to a task that
#: writes, ranges that a query opens first.
RANGE, PER_FOLDER, BUCKETS, PER_TASK, FIRST = 1024, 64, 8, 16, 4
BLOCKS = "term string, `range` int, top int, entries array<struct<chunk_id: long, article_id: long, tf: int>>, segment int, bucket int"
CHANGED = "article_id long, segment int"


def _folders(ranges: int) -> int:
    return max(1, min(BUCKETS, ranges // PER_FOLDER))


def _dealt(rows: DataFrame, ranges: int) -> DataFrame:
    """``rows`` (chunk_id ...) with their range; a range lies in one task, and ``PER_TASK`` of them to a task, so that tasks are no
    larger where the table is, and nothing spills. All that follows up to the files is done where the rows lie."""
    return rows.withColumn("range", F.pmod(F.xxhash64("chunk_id"), F.lit(ranges)).cast("int")).repartition(-(-ranges // PER_TASK), "range")


def _write(counted: DataFrame, ranges: int, path: str, segment: int) -> None:
    counted = counted if "range" in counted.columns else _dealt(counted, ranges)
    entry = F.struct("chunk_id", "article_id", "tf")
    blocks = counted.groupBy("term", "range").agg(F.max("tf").alias("top"), F.collect_list(entry).alias("entries"))
    keyed = blocks.withColumn("bucket", bucket_of(F.col("term"), _folders(ranges)))
    keyed.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks/segment={segment}")


def _counted(passages: DataFrame) -> DataFrame:
    keys = [c for c in ("range", "chunk_id", "article_id") if c in passages.columns]
    return passages.select(*keys, F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", *keys).agg(F.count("*").cast("int").alias("tf"))


def build(passages: DataFrame, path: str, per_range: int = RANGE) -> None:
    """Writes the index of ``passages`` (article_id, chunk_id, text) to ``path``, as its first segment. What is shuffled is the
    passages' text, once."""
    ranges = max(1, -(-passages.select("chunk_id").count() // per_range))
    passages.sparkSession.range(1).select(F.lit(ranges).cast("long").alias("ranges")).write.mode("overwrite").parquet(f"{path}/ranges")
    _write(_counted(_dealt(passages.select("article_id", "chunk_id", "text"), ranges)), ranges, path, 0)
    passages.limit(0).select("article_id").write.mode("overwrite").parquet(f"{path}/changed/segment=0")


def segments(spark: SparkSession, path: str) -> int:
    """Segments of a stored index; their numbers go from 0."""
    return spark.read.schema(CHANGED).parquet(f"{path}/changed").agg(F.max("segment")).first()[0] or 0


def _ranges(spark: SparkSession, path: str) -> int:
    return spark.read.schema("ranges long").parquet(f"{path}/ranges").first()[0]


def update(spark: SparkSession, path: str, changed: DataFrame, passages: DataFrame) -> int:
    """Adds a segment: of the articles in ``changed`` (article_id) only ``passages`` (article_id, chunk_id, text) count from now on,
    none for one that is gone. Returns its number. Reads nothing of older segments but their number."""
    segment = segments(spark, path) + 1
    ranges = _ranges(spark, path)
    new = passages.join(changed.select("article_id").distinct(), "article_id", "left_semi").select("article_id", "chunk_id", "text")
    _write(_counted(_dealt(new, ranges)), ranges, path, segment)
    # the list of ids comes last: a segment counts from then on
    changed.select("article_id").distinct().write.mode("overwrite").parquet(f"{path}/changed/segment={segment}")
    return segment


def _blocks(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """Blocks of ``terms`` (term, distinct, a stored table), from their folders; of a segment whose list of ids isn't there yet none.
    Other terms' blocks go where they are read: a batch's terms are a small file, whose size Spark knows. One look at the
    driver: the number of segments and the numbers of folders, ``BUCKETS`` at most."""
    count = _folders(_ranges(spark, path))
    folders = terms.agg(F.collect_set(bucket_of(F.col("term"), count)).alias("b")).first().b if count > 1 else [0]
    held = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.col("bucket").isin(folders or [-1]) & (F.col("segment") <= segments(spark, path)))
    return held.drop("bucket").join(terms, "term", "left_semi")


def _live(found: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Entries (segment, article_id ...) that no later segment replaces."""
    if segments(spark, path) == 0:
        return found
    last = spark.read.schema(CHANGED).parquet(f"{path}/changed").where("segment > 0").groupBy("article_id").agg(F.max("segment").alias("last"))
    return found.join(last, "article_id", "left").where(F.col("last").isNull() | (F.col("segment") >= F.col("last"))).drop("last")


def entries(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """(term, chunk_id, tf) of all passages that hold one of ``terms`` (term)."""
    met = _blocks(spark, path, written(terms.select("term").distinct())).select("segment", "term", F.inline("entries"))
    return _live(met, spark, path).select("term", "chunk_id", F.col("tf").cast("long").alias("tf"))


def keyword_top(spark: SparkSession, path: str, terms: DataFrame, most: int = 240, first: int = FIRST) -> DataFrame:
    """(query_id, chunk_id, rank from 0): for each query the ``most`` passages with most occurrences of its ``terms`` (query_id,
    term), ties by chunk_id."""
    terms = written(terms.select("query_id", "term").distinct())
    blocks = _blocks(spark, path, written(terms.select("term").distinct()))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    if _ranges(spark, path) <= first:  # all of them are opened
        each = _live(blocks.select("segment", "term", F.inline("entries")), spark, path)
        every = terms.join(each, "term").groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("score"))
        return every.withColumn("place", place).where(F.col("place") <= most).select("query_id", "chunk_id", (F.col("place") - 1).alias("rank"))
    heads = blocks.select("segment", "term", "range", "top").join(terms, "term")
    at = ["query_id", "segment", "range"]
    bounds = heads.groupBy(*at).agg(F.sum("top").alias("bound"))
    bounds = cut(bounds.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "range"))))

    def scored(opened: DataFrame) -> DataFrame:
        """Scores of the passages in the ranges of ``opened``; a block is read once and met by the queries that opened its range."""
        asked = opened.select(*at).join(terms, "query_id")
        held = blocks.join(asked.select("segment", "range", "term").distinct(), ["segment", "range", "term"], "left_semi")
        each = _live(held.select("segment", "range", "term", F.inline("entries")), spark, path)
        return asked.join(each, ["segment", "range", "term"]).groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("score"))

    best = cut(scored(bounds.where(F.col("r") <= first)).withColumn("place", place).where(F.col("place") <= most))
    worst = best.where(F.col("place") == most).select("query_id", F.col("score").alias("worst"))
    rest = bounds.where(F.col("r") > first).join(worst, "query_id", "left").where(F.col("worst").isNull() | (F.col("bound") >= F.col("worst")))
    every = best.select("query_id", "chunk_id", "score").unionByName(scored(rest))
    return every.withColumn("place", place).where(F.col("place") <= most).select("query_id", "chunk_id", (F.col("place") - 1).alias("rank"))


def compacted(spark: SparkSession, path: str, target: str) -> None:
    """Writes the live entries of all segments to ``target`` as one segment."""
    found = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.col("segment") <= segments(spark, path)).select("segment", "term", F.inline("entries"))
    ranges = _ranges(spark, path)
    spark.range(1).select(F.lit(ranges).cast("long").alias("ranges")).write.mode("overwrite").parquet(f"{target}/ranges")
    _write(_live(found, spark, path).select("term", "chunk_id", "article_id", "tf"), ranges, target, 0)
    spark.read.schema(CHANGED).parquet(f"{path}/changed").select("article_id").limit(0).write.mode("overwrite").parquet(f"{target}/changed/segment=0")
