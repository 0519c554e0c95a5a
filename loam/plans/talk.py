"""Conversation work on ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import talk as k
from loam.plans.registry import query
from loam.sources.tables import table


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("v1_history", """
WITH n AS (SELECT conv_id, turn, role, substr(text, 1, 300) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s FROM n WHERE n <= 12)
SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM s WHERE n = 1 OR s <= 700 GROUP BY 1""")
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.history(turns(spark, sf_dir), cut=300, budget=700)


@query("v2_follow_up_text", """
WITH u AS (SELECT conv_id, turn, text, list(substr(text, 1, 500)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS past FROM conversations WHERE role = 'user')
SELECT conv_id, turn, array_to_string(list_append(coalesce(past, []), text), chr(10)) AS retrieval_text FROM u""")
def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.follow_up_text(turns(spark, sf_dir))


@query("v3_verified_turns", """
SELECT conv_id, turn, role FROM conversations WHERE role <> 'assistant' OR NOT (turn % 4 = 3 OR (conv_id * 10 + turn) % 5 = 0)""")
def v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.col("conv_id") * 10 + F.col("turn")
    plain = F.regexp_replace("text", r"[\[\]]", "")
    cited = turns(spark, sf_dir).select(
        "conv_id", "turn", "role", F.concat(plain, F.lit(" [C1]"), F.when(F.col("turn") % 4 == 3, " [C2]").otherwise("")).alias("text"),
        F.array(F.struct(F.lit(1).alias("number"), chunk.cast("long").alias("chunk_id"))).alias("citations"),
    )
    visible = turns(spark, sf_dir).select("conv_id", chunk.cast("long").alias("chunk_id")).where("chunk_id % 5 <> 0")
    return k.verified_turns(cited, visible).select("conv_id", "turn", "role")


@query("v4_distinct_wordings", r"""
WITH w AS (SELECT conv_id AS query_id, turn AS position, trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '\s+', ' ', 'g')) AS key FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY position) AS n FROM w)
SELECT query_id, position, CAST(row_number() OVER (PARTITION BY query_id ORDER BY position) AS INTEGER) AS rank FROM f WHERE n = 1 AND position > 0 AND key <> '' QUALIFY rank <= 2""")
def v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    wordings = turns(spark, sf_dir).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), "text")
    return k.distinct_wordings(wordings, 2).select("query_id", "position", "rank")
