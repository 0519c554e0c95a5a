"""Conversation tables: history within a budget, follow-up text, verified turns, distinct wordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import citation_numbers, fold


def history(turns: DataFrame, most: int = 12, cut: int = 3000, budget: int = 9000) -> DataFrame:
    """(conv_id, turns, history): the newest turns (conv_id, turn, role, text), each cut, until the budget is first
    passed (the newest always stays), in time order. It stops at the first overflow, so a running sum is exact."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    cut_turns = turns.withColumn("text", F.substring("text", 1, cut)).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    kept = cut_turns.withColumn("_sum", F.sum(F.char_length("text")).over(newest)).where((F.col("_n") == 1) | (F.col("_sum") <= budget))
    ordered = kept.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    return ordered.select("conv_id", "turns", F.array_join(F.transform("l", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("history"))


def follow_up_text(turns: DataFrame, last: int = 3, cut: int = 500) -> DataFrame:
    """(conv_id, turn, retrieval_text): for each user turn the user turns before it (cut) and its own text."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last, -1)
    users = turns.where(F.col("role") == "user")
    past = F.collect_list(F.substring("text", 1, cut)).over(before)
    return users.select("conv_id", "turn", F.array_join(F.concat(past, F.array("text")), "\n").alias("retrieval_text"))


def verified_turns(turns: DataFrame, visible: DataFrame) -> DataFrame:
    """Turns without assistant turns whose markers differ from their stored citations or cite something not visible.

    turns (conv_id, turn, role, text, citations array<struct<number:int,chunk_id:bigint>>); visible (conv_id, chunk_id).
    """
    assistant = turns.where(F.col("role") == "assistant")
    numbers = F.array_sort(F.array_distinct(F.transform(F.coalesce("citations", F.array().cast("array<struct<number:int,chunk_id:bigint>>")), lambda c: c["number"])))
    wrong = assistant.where(~citation_numbers(F.col("text")).eqNullSafe(numbers)).select("conv_id", "turn")
    cited = assistant.select("conv_id", "turn", F.explode("citations.chunk_id").alias("chunk_id"))
    unseen = cited.join(visible, ["conv_id", "chunk_id"], "left_anti").select("conv_id", "turn")
    return turns.join(wrong.union(unseen).distinct(), ["conv_id", "turn"], "left_anti")


def distinct_wordings(wordings: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` wordings (query_id, position, text; position 0 is the original) that differ, folded, from the
    original and from earlier ones."""
    key = F.trim(F.regexp_replace(fold(F.col("text")), r"\s+", " "))
    firsts = wordings.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_key").orderBy("position"))).where("_n = 1 and position > 0 and _key <> ''")
    order = Window.partitionBy("query_id").orderBy("position")
    return firsts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("_key", "_n")
