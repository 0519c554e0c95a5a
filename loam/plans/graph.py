"""The entity graph of parts and suppliers: line items as mentions and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import graph as k
from loam.plans.registry import query
from loam.sources.tables import table

#: An order's lines as its extraction: suppliers as systems or an unknown type, a chain of relations between them. Names come with
#: marks, as full-width digits, with sharp s or in capitals and are one key; every seventh name and ninth relation is too long.
EXTRACTED = """x AS (SELECT l_orderkey AS article_id, l_suppkey, l_linenumber, lag(l_suppkey) OVER w AS prev FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
e AS (SELECT DISTINCT article_id, 'supplier strasse ' || CAST(l_suppkey AS VARCHAR) AS key FROM x WHERE l_suppkey % 6 <> 0 AND l_suppkey % 7 <> 0),
r AS (SELECT DISTINCT article_id, 'supplier strasse ' || CAST(prev AS VARCHAR) AS source, 'depends_on' AS relation, 'supplier strasse ' || CAST(l_suppkey AS VARCHAR) AS target FROM x
  WHERE prev <> l_suppkey AND prev % 6 <> 0 AND l_suppkey % 6 <> 0 AND prev % 7 <> 0 AND l_suppkey % 7 <> 0 AND (prev + l_suppkey) % 9 <> 0)"""


def extraction(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    def name(c: str) -> Column:
        number, wide = F.col(c).cast("string"), F.translate(F.col(c).cast("string"), "0123456789", "０１２３４５６７８９")
        spelled = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" Supplie\u0301r  Straße "), number)).otherwise(F.concat(F.lit("SUPPLIÉR\u00a0STRASSE "), wide))
        return F.when(F.col(c) % 7 == 0, F.rpad(spelled, 230, "x")).otherwise(spelled)

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = table(spark, sf_dir, "lineitem").withColumn("prev", F.lag("l_suppkey").over(order)).withColumn("article_id", F.col("l_orderkey"))
    entities = line.select("article_id", F.struct("l_linenumber", "l_partkey").alias("position"), name("l_suppkey").alias("name"), F.when(F.col("l_suppkey") % 6 == 0, "gadget").otherwise("System").alias("type"), F.lit("").alias("description"))
    verb = F.when((F.col("prev") + F.col("l_suppkey")) % 9 == 0, F.repeat(F.lit("on"), F.lit(51))).otherwise("Depends on!")
    relations = line.where("prev is not null").select("article_id", name("prev").alias("source"), verb.alias("relation"), name("l_suppkey").alias("target"), F.lit("d").alias("description"))
    return k.clean_extraction(entities, relations)


@query("k1_clean_entities", f"WITH {EXTRACTED} SELECT article_id, key, 'system' AS type FROM e")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction(spark, sf_dir)[0].select("article_id", "key", "type")


@query("k1_clean_relations", f"WITH {EXTRACTED} SELECT article_id, source, relation, target FROM r")
def k1_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction(spark, sf_dir)[1].select("article_id", "source", "relation", "target")


@query("k2_merged_nodes", f"WITH {EXTRACTED} SELECT article_id % 3 AS company_domain, key, count(DISTINCT article_id) AS mention_count FROM e GROUP BY 1, 2")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, _ = extraction(spark, sf_dir)
    return k.merged_nodes(entities.withColumn("company_domain", F.col("article_id") % 3)).select("company_domain", "key", "mention_count")


@query("k2_merged_edges", f"WITH {EXTRACTED} SELECT article_id % 3 AS company_domain, source, target, relation, max(article_id) AS article_id FROM r GROUP BY 1, 2, 3, 4")
def k2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, relations = extraction(spark, sf_dir)
    return k.merged_edges(relations.withColumn("company_domain", F.col("article_id") % 3)).drop("description")


EDGES = "edges AS (SELECT DISTINCT s_suppkey AS source, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS target FROM supplier)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    total = supplier.agg(F.count("*").alias("n"))
    return supplier.join(F.broadcast(total)).select(F.col("s_suppkey").alias("source"), ((F.col("s_suppkey") * 7 + 3) % F.col("n")).alias("target"), F.lit("supplies").alias("relation"))


@query("k3_neighbourhood", f"""
WITH {EDGES}, b AS (SELECT source AS node, target AS nxt FROM edges UNION SELECT target, source FROM edges), s AS (SELECT s_suppkey AS seed FROM supplier WHERE s_suppkey % 5 = 0),
h1 AS (SELECT DISTINCT seed, nxt AS node FROM s JOIN b ON seed = node), h2 AS (SELECT DISTINCT seed, nxt AS node FROM h1 JOIN b USING (node)), h3 AS (SELECT DISTINCT seed, nxt AS node FROM h2 JOIN b USING (node)),
a AS (SELECT seed, seed AS node, 0 AS hop FROM s UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2 UNION ALL SELECT seed, node, 3 FROM h3) SELECT seed, node, min(hop) AS hop FROM a GROUP BY 1, 2""")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.neighbourhood(edges(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("seed")), 3)


@query("k3_touched_edges", f"""
WITH {EDGES}, b AS (SELECT source AS node, target AS nxt FROM edges UNION SELECT target, source FROM edges), s AS (SELECT s_suppkey AS seed FROM supplier WHERE s_suppkey % 5 = 0),
n AS (SELECT seed, seed AS node FROM s UNION SELECT seed, nxt FROM s JOIN b ON seed = node) SELECT a.seed, source, target FROM edges JOIN n a ON a.node = source JOIN n c ON c.node = target AND c.seed = a.seed""")
def k3_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = k.neighbourhood(edges(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("seed")), 1)
    return k.touched_edges(edges(spark, sf_dir), near)


@query("k4_entity_detail", f"WITH {EDGES} SELECT source AS entity, 'out' AS direction, 'supplies' AS relation, target AS other FROM edges UNION ALL SELECT target, 'in', 'supplies', source FROM edges")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.entity_detail(edges(spark, sf_dir))


@query("k4_entity_list", f"WITH {EXTRACTED} SELECT key, count(DISTINCT article_id) AS mention_count FROM e WHERE contains(key, '1') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def k4_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, _ = extraction(spark, sf_dir)
    return k.entity_list(k.merged_nodes(entities.withColumn("company_domain", F.lit(0))), F.lit("1")).select("key", "mention_count")


@query("k5_without_mentions", "SELECT o_orderkey AS article_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft").alias("status"))
    return k.without_mentions(articles, table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("article_id"))).select("article_id")
