"""Classes of linked rows: connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.sources.tables import cut


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, class_id) for every row of ``nodes`` (id long) under ``edges`` (u long, v long): the least id that can be reached.

    Every node starts as its own class. In each round a class takes the least class among those its edges lead to, and edges
    are redrawn between what their ends became; an edge whose ends are of one class goes. Classes are compared by a one to
    one hash, so a long chain halves about each round and doesn't shrink by one; the least id of each is found at last. The
    driver sees only whether edges are left.
    """
    start = nodes.select("id", F.xxhash64("id").alias("at"))
    left = cut(edges.select(F.xxhash64("u").alias("a"), F.xxhash64("v").alias("b")).where("a <> b").distinct())
    taken: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.union(left.select("b", "a"))
        least = cut(ends.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        taken.append(least)
        redrawn = ends.where("a < b").join(least, "a").select(F.col("to").alias("x"), "b").join(least.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = cut(redrawn.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    for least in taken:
        start = start.join(least.withColumnRenamed("a", "at"), "at", "left").select("id", F.coalesce("to", "at").alias("at"))
    named = cut(start)
    return named.join(named.groupBy("at").agg(F.min("id").alias("class_id")), "at").select("id", "class_id")
