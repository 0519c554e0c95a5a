"""Mixing sources to target weights under a time-varying curriculum, in DataFrame operations only.

Targets: the sources share a multiple of all words by weight, none above a cap; what is cut off is shared again by
weight. Within a source documents stand in a fixed order (the md5 of doc_id and text); the mix takes the source's words in
that order, over and over, up to the target, so whole documents are taken the same number of times but for one round's end.

Curriculum: a source's weight at training time t in [0, 1] is in proportion to 1 + tilt (2 t - 1). Its integral is the
source's cumulative demand; a document taken at some share u of the demand is due at the t where the integral reaches u,
the root of tilt t^2 + (1 - tilt) t = u. Sorting by t interleaves the sources as their schedules say.

Running sums go by (source, first three digits of the md5), so a source that holds a third of all rows is dealt over
4096 groups, and so are rows that share an id or have none; only the groups' sums are added up for each source. Rows equal in
id and text stand side by side. A document's own columns travel in one struct, so they may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import WORD, cut, table, text_of

#: By a source's place in code point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
TILTS = (-0.5, 0.0, 0.8)
#: All targets together are SHARE_NUM / SHARE_DEN of all sizes; a target is at most CAP times its source's size.
SHARE_NUM, SHARE_DEN, CAP = 3, 2, 2
DIGITS = 3


def sizes(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(row, _size, _null, _source, _order): the columns ``keep`` as a struct, words (null: 0), source (null: empty) and place."""
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.md5(text_of())))
    return docs.select(
        F.struct(*keep).alias("row"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("_size"),
        F.col("source").isNull().alias("_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        order.alias("_order"),
    )


def targets(source_sizes: DataFrame) -> DataFrame:
    """Adds weight, tilt and target to one row a source (_null, _source, source_size).

    Sources by cap over weight: each in turn is capped while its weighted part of what is left exceeds its cap. That is
    where sharing again and again ends, in one pass. The windows hold a row for each source.
    """
    by_name = Window.orderBy("_null", "_source")
    everywhere = Window.partitionBy(F.lit(0))
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("_place") + 1).cast("int"))
    named = source_sizes.withColumn("_place", place).withColumn("weight", pick(WEIGHTS).cast("long")).withColumn("tilt", pick(TILTS))
    named = named.withColumn("_cap", F.col("source_size") * CAP).withColumn("_all", F.sum("source_size").over(everywhere))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_null", "_source")
    past, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.lit(SHARE_NUM) * F.col("_all") - F.lit(SHARE_DEN) * F.coalesce(F.sum("_cap").over(past), F.lit(0))
    capped = (left * F.col("weight")) >= (F.lit(SHARE_DEN) * F.col("_cap") * F.sum("weight").over(rest))
    named = named.withColumn("_capped", capped)
    left = F.lit(SHARE_NUM) * F.col("_all") - F.lit(SHARE_DEN) * F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0)).over(everywhere)
    weights = F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("weight"))).over(everywhere)
    shared = (left * F.col("weight")).cast("double") / (F.lit(SHARE_DEN) * weights).cast("double")
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(shared)
    return named.select("_null", "_source", "source_size", "weight", "tilt", target.alias("target"))


def due(share: Column, tilt: Column) -> Column:
    """Training time in [0, 1] at which a source's demand reaches ``share`` of its whole."""
    even = F.lit(1.0) - tilt
    return F.lit(2.0) * share / (even + F.sqrt(even * even + F.lit(4.0) * tilt * share))


def mixed(docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """(row, size, source_size, target, taken, rounds) for every row of ``docs``: row is a struct of the columns ``keep`` (all,
    unless told), rounds has words and position (due time) of each round that takes words of it.

    taken counts words, repeats included. A text without words, null ones among them, is never taken. Repeated rows are
    documents of their own. A null source is a source. An empty table gives an empty table.
    """
    kept = tuple(docs.columns if keep is None else keep)
    sized = sizes(docs, kept)
    if "text" not in kept:
        sized = cut(sized)  # short rows: words are counted once
    sized = sized.withColumn("_group", F.substring("_order", 1, DIGITS))
    groups = cut(sized.groupBy("_null", "_source", "_group").agg(F.sum("_size").alias("_sum")))
    before = Window.partitionBy("_null", "_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    plan = cut(targets(groups.groupBy("_null", "_source").agg(F.sum("_sum").alias("source_size"))))
    known = starts.join(plan, ["_null", "_source"])
    inside = Window.partitionBy("_null", "_source", "_group").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("_end", F.sum("_size").over(inside)).join(known, ["_null", "_source", "_group"])
    start = F.col("_start") + F.col("_end") - F.col("_size")
    goal = F.floor("target")
    rounds = []
    for i in range(CAP):
        at = F.lit(i) * F.col("source_size") + start
        words = F.least(F.col("_size"), F.greatest(goal - at, F.lit(0)))
        share = (at.cast("double") + words.cast("double") / F.lit(2.0)) / F.col("target")
        rounds.append(F.when(words > 0, F.struct(words.alias("words"), due(share, F.col("tilt")).alias("position"))))
    taken = F.filter(F.array(*rounds), lambda x: x.isNotNull())
    out = placed.withColumn("rounds", taken)
    words = F.aggregate("rounds", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return out.select("row", F.col("_size").alias("size"), "source_size", "target", words.alias("taken"), "rounds")


def training_order(docs: DataFrame) -> DataFrame:
    """The mix itself: a row of ``docs`` (its columns, whatever their names) for each time it is taken, in order of its position.

    Where a target ends within a document, its text is cut after the words taken, single spaces between them. Null and
    empty texts are never taken; repeated rows are taken each on its own; an empty table gives an empty table.
    """
    each = mixed(docs).select("row", "size", F.explode("rounds").alias("round"))
    words = F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("round.words") < F.col("size"), F.array_join(F.slice(words, 1, F.col("round.words").cast("int")), " ")).otherwise(F.col("row.text"))
    columns = [(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return each.orderBy("round.position", "row.doc_id").select(*columns)


def op10_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=("doc_id",))
    at = lambda i: F.get("rounds", F.lit(i))["position"]
    return found.select("row.doc_id", "size", "source_size", "target", "taken", at(0).alias("position"), at(1).alias("position_again")).orderBy("position", "doc_id")


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS o,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, (row_number() OVER (ORDER BY (source IS NULL), coalesce(source, '')) - 1) % 3 AS place,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM per),
weighed AS (
  SELECT *, CASE place WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         CASE place WHEN 0 THEN CAST(-0.5 AS DOUBLE) WHEN 1 THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS tilt
  FROM named),
marked AS (
  SELECT *,
         (3 * total - 2 * coalesce(sum(2 * source_size) OVER past, 0)) * w >= 4 * source_size * sum(w) OVER rest AS capped
  FROM weighed
  WINDOW past AS (ORDER BY 2 * source_size / w, (source IS NULL), coalesce(source, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY 2 * source_size / w, (source IS NULL), coalesce(source, '') ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
plan AS (
  SELECT source, source_size, tilt,
         CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST((3 * total - 2 * sum(CASE WHEN capped THEN 2 * source_size ELSE 0 END) OVER ()) * w AS DOUBLE)
                   / CAST(2 * sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
  FROM marked),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.tilt, p.target, CAST(floor(p.target) AS BIGINT) AS goal,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
rounds AS (
  SELECT *, least(size, greatest(goal - start, 0)) AS w0, least(size, greatest(goal - source_size - start, 0)) AS w1 FROM placed),
shares AS (
  SELECT *, (CAST(start AS DOUBLE) + CAST(w0 AS DOUBLE) / 2.0) / target AS u0,
         (CAST(source_size + start AS DOUBLE) + CAST(w1 AS DOUBLE) / 2.0) / target AS u1, CAST(1.0 AS DOUBLE) - tilt AS e
  FROM rounds)
SELECT doc_id, size, source_size, target, CAST(w0 + w1 AS BIGINT) AS taken,
       CASE WHEN w0 > 0 THEN CAST(2.0 AS DOUBLE) * u0 / (e + sqrt(e * e + CAST(4.0 AS DOUBLE) * tilt * u0)) END AS position,
       CASE WHEN w1 > 0 THEN CAST(2.0 AS DOUBLE) * u1 / (e + sqrt(e * e + CAST(4.0 AS DOUBLE) * tilt * u1)) END AS position_again
FROM shares
"""
