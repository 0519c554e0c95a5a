"""The entity graph: cleaning extractions, merging documents, neighbourhoods, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import entity_key_column

TYPES = ("person", "team", "system", "policy", "process", "product", "location", "organization", "concept")
DEPTH = 3


NAME, RELATION, DESCRIPTION = 200, 100, 500


def clean_extraction(entities: DataFrame, relations: DataFrame, types: tuple[str, ...] = TYPES) -> tuple[DataFrame, DataFrame]:
    """Entities (article_id, position, name, type, description) of known types, once a key and document; relations
    (article_id, source, relation, target, description) between them, in snake case, without loops and repeats.

    A name of more than 200 characters drops its row, on either side of a relation too, as does a relation of more than 100;
    descriptions are cut at 500.
    """
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    fits = lambda c: F.char_length(c).between(1, NAME)
    described = F.substring(squeezed(F.col("description")), 1, DESCRIPTION)
    named = entities.withColumns({"name": squeezed(F.col("name")), "type": F.lower(F.trim("type")), "description": described})
    good = named.where(F.col("type").isin(*types) & fits(F.col("name"))).withColumn("key", entity_key_column(F.col("name")))
    once = good.withColumn("_n", F.row_number().over(Window.partitionBy("article_id", "key").orderBy("position"))).where("_n = 1").drop("_n")
    snake = F.regexp_replace(F.regexp_replace(F.lower(F.trim("relation")), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    spelled = relations.withColumns({"source": squeezed(F.col("source")), "target": squeezed(F.col("target")), "relation": snake, "description": described})
    able = spelled.where(fits(F.col("source")) & fits(F.col("target")) & F.char_length("relation").between(1, RELATION))
    ends = able.select("article_id", entity_key_column(F.col("source")).alias("source"), "relation", entity_key_column(F.col("target")).alias("target"), "description").where("source <> target")
    for end in ("source", "target"):
        ends = ends.join(once.select("article_id", F.col("key").alias(end)), ["article_id", end], "left_semi")
    return once, ends.dropDuplicates(["article_id", "source", "relation", "target"])


def merged_nodes(entities: DataFrame) -> DataFrame:
    """(company_domain, key, type, name, description, mention_count): documents' entities (company_domain, article_id, key,
    type, name, description) merged by natural key; the first description that isn't empty, distinct articles."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col("article_id")))
    return entities.groupBy("company_domain", "key", "type").agg(F.min_by("name", "article_id").alias("name"), first("description").alias("description"), F.count_distinct("article_id").alias("mention_count"))


def merged_edges(relations: DataFrame) -> DataFrame:
    """(company_domain, source, target, relation, article_id, description): one edge a triple, its latest article and its
    first description."""
    return relations.groupBy("company_domain", "source", "target", "relation").agg(F.max("article_id").alias("article_id"), F.min_by("description", F.when(F.coalesce(F.trim("description"), F.lit("")) != "", F.col("article_id"))).alias("description"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node, hop): nodes within at most 3 hops of seeds (seed), both directions; a node counts at its first hop."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("next")).union(edges.select("target", "source")).distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    frontier = seen
    for i in range(1, min(hops, DEPTH) + 1):
        step = frontier.select("seed", "node").join(both, "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(i))
        seen = seen.unionByName(frontier)
    return seen


def touched_edges(edges: DataFrame, near: DataFrame) -> DataFrame:
    """(seed, source, target) of edges with both ends in a seed's neighbourhood."""
    met = near.select("seed", F.col("node").alias("source")).join(edges.select("source", "target").distinct(), "source")
    return met.join(near.select("seed", F.col("node").alias("target")), ["seed", "target"], "left_semi").select("seed", "source", "target")


def entity_detail(edges: DataFrame) -> DataFrame:
    """(entity, direction, relation, other) of every edge, seen from both ends."""
    out = edges.select(F.col("source").alias("entity"), F.lit("out").alias("direction"), "relation", F.col("target").alias("other"))
    return out.union(edges.select(F.col("target").alias("entity"), F.lit("in").alias("direction"), "relation", F.col("source").alias("other")))


def entity_list(nodes: DataFrame, contains: Column | None = None, top: int = 50) -> DataFrame:
    """Entities by mentions, with names that contain a folded text."""
    rows = nodes if contains is None else nodes.where(F.contains("key", contains))
    return rows.orderBy(F.desc("mention_count"), "key", "type").limit(top)


def without_mentions(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """Published articles that no mention names: what a backfill has to read."""
    return articles.where(F.col("status") == "published").join(mentions.select("article_id").distinct(), "article_id", "left_anti")
