"""Connected components of an edge table by contraction, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import cut


#: Edges to a task in a round, and tasks at least.
EDGES, TASKS = 4096, 8


def _tasks(edges: int) -> int:
    return max(TASKS, edges // EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u long, v long); label is some node of its component.

    Each round points every node at the smallest of itself and its neighbours and replaces the edges by those between
    the nodes pointed at; the edge (u, p(u)) becomes (p(u), p(p(u))), so nothing comes apart. Nodes are compared by
    a bijective hash, which keeps long monotone chains from shrinking by one node a round. Work per round is linear
    in the edges left; rounds are about logarithmic. Nothing but the number of edges reaches the driver: a round has as many
    tasks as its edges need, as each writes files of its own, which for a few edges in each take more room than the edges.
    """
    named = edges.select(F.xxhash64("u").alias("a"), F.xxhash64("v").alias("b")).where("a <> b")
    left = cut(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(_tasks(edges.count())))
    nodes = edges.select("u").union(edges.select("v")).distinct().select(F.col("u").alias("node"), F.xxhash64("u").alias("at"))
    steps: list[DataFrame] = []
    while count := left.count():
        both = left.union(left.select("b", "a"))
        to = cut(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("p")).coalesce(_tasks(count)))
        steps.append(to)
        moved = left.join(to, "a").select(F.col("p").alias("pa"), "b").join(to.withColumnRenamed("a", "b"), "b")
        pairs = moved.where("pa <> p").select(F.least("pa", "p").alias("a"), F.greatest("pa", "p").alias("b"))
        left = cut(pairs.distinct().coalesce(_tasks(count)))
    for to in steps:
        nodes = nodes.join(to.withColumnRenamed("a", "at"), "at", "left").select("node", F.coalesce("p", "at").alias("at"))
    return nodes.withColumnRenamed("at", "label")
