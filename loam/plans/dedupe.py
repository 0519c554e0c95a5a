"""Copies on ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import passage_key
from loam.operators import dedupe as d
from loam.operators import vector_index as x
from loam.operators import vectors as v
from loam.plans.registry import query
from loam.sources.tables import table


@query("d1_first_files", """
WITH f AS (SELECT doc_id AS file_id, lang AS company_domain, sha256(text) AS source_hash FROM documents),
held AS (SELECT DISTINCT company_domain, source_hash FROM f WHERE file_id % 10 = 3 AND file_id % 20 <> 3)
SELECT file_id, company_domain FROM (SELECT *, row_number() OVER (PARTITION BY company_domain, source_hash ORDER BY file_id) AS n FROM f)
WHERE n = 1 AND (company_domain, source_hash) NOT IN (SELECT company_domain, source_hash FROM held)""")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("company_domain"), F.sha2("text", 256).alias("source_hash"), F.lit(0).alias("created_at"))
    stored = files.where("file_id % 10 = 3").withColumnRenamed("file_id", "subject_id")
    live = stored.where("subject_id % 20 <> 3").select("subject_id")
    return d.first_files(files, stored, live).select("file_id", "company_domain")


LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
passages AS (SELECT doc_id * 100000 + pos AS chunk_id, doc_id AS article_id, trim(regexp_replace(replace(lower(line), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key, length(line) AS n, (doc_id * 7 % 100) / 100.0 AS score, doc_id % 13 AS updated FROM lines)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return each.select((F.col("doc_id") * 100000 + F.col("pos")).alias("chunk_id"), F.col("doc_id").alias("article_id"), F.col("line").alias("text"))


COPIES = f"""{LINES}, g AS (SELECT key, arg_max(chunk_id, (round(score, 2), updated, -chunk_id)) AS chunk_id, count(*) AS copies, count(DISTINCT article_id) AS articles FROM passages WHERE n >= 60 GROUP BY key HAVING count(DISTINCT article_id) > 1)"""


def copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    each = lines(spark, sf_dir).withColumn("key", passage_key(F.col("text"))).withColumn("n_chars", F.char_length("text"))
    return d.collapse_exact(each.withColumn("score", (F.col("article_id") * 7 % 100) / 100.0).withColumn("updated", F.col("article_id") % 13))


@query("d2_collapse_exact", f"WITH {COPIES} SELECT key, chunk_id, CAST(floor(chunk_id / 100000) AS BIGINT) AS article_id, copies, articles FROM g")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spark, sf_dir)[0]


@query("d2_copy_members", f"WITH {COPIES} SELECT DISTINCT key, article_id FROM passages JOIN g USING (key) WHERE n >= 60")
def d2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spark, sf_dir)[1]


@query("d3_d4_collapse_near", """
WITH RECURSIVE n AS (SELECT vec_id, CAST(label AS BIGINT) AS article_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), u AS MATERIALIZED (SELECT vec_id, article_id, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS v FROM n),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.article_id, c.vec_id % 97 AS key, c.v, 1 - list_dot_product(q.v, c.v) AS distance FROM u q, u c WHERE q.vec_id % 20 = 0),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS i FROM d WHERE distance <= 1 QUALIFY i <= 240),
p AS (SELECT a.query_id, a.i, b.i AS j, a.key = b.key AS same, list_dot_product(a.v, b.v) AS c FROM r a JOIN r b ON a.query_id = b.query_id AND b.i < a.i AND a.article_id <> b.article_id),
m AS (SELECT query_id, i, list(j ORDER BY j) FILTER (same) AS equal, list(j ORDER BY c DESC, j) FILTER (c >= 0.97) AS close FROM p WHERE same OR c >= 0.97 GROUP BY 1, 2),
f AS MATERIALIZED (SELECT query_id, i, equal, close FROM r LEFT JOIN m USING (query_id, i)),
st AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS slot FROM r
  UNION ALL SELECT query_id, i, CASE WHEN slot IS NULL THEN list_append(kept, i) ELSE kept END, slot
  FROM (SELECT st.query_id, f.i, kept, coalesce(list_filter(equal, lambda x: list_contains(kept, x))[1], list_filter(close, lambda x: list_contains(kept, x))[1]) AS slot FROM st JOIN f ON f.query_id = st.query_id AND f.i = st.i + 1)),
a AS (SELECT query_id, slot, article_id, min(i) AS first FROM st JOIN r USING (query_id, i) WHERE slot IS NOT NULL GROUP BY 1, 2, 3),
l AS (SELECT query_id, slot AS i, list(article_id ORDER BY first) AS also_in FROM a GROUP BY 1, 2)
SELECT query_id, chunk_id, article_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS INTEGER) AS place, round(1 - distance, 4) AS score, coalesce(also_in, []) AS also_in
FROM r JOIN st USING (query_id, i) LEFT JOIN l USING (query_id, i) WHERE slot IS NULL""")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result lists of the vector leg, at most 240 rows each, by distance; vectors of one label are an article."""
    from loam.plans.retrieval import vector_leg

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("article_id"), "embedding")
    ranked = vector_leg(spark, sf_dir, most=1.0).join(vectors, "chunk_id").select(
        "query_id", F.col("rank").alias("position"), "chunk_id", "article_id", F.concat(F.lit("k"), (F.col("chunk_id") % 97).cast("string")).alias("key"), F.lit(80).alias("n_chars"),
        (1 - F.col("distance")).alias("score"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(0.0).alias("updated"),
    )
    return v.collapse_copies(ranked).withColumn("score", F.round("score", 4))


SETS = r"""t AS (SELECT doc_id, list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS s FROM documents)"""


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every twentieth document as a new one, and all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return docs.where("doc_id % 20 = 0"), docs


def counts(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    new, docs = asked(spark, sf_dir)
    return d.set_blocks(new.select("doc_id").count(), docs.select("doc_id").count())


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.set_similarity(*asked(spark, sf_dir), d.MATCH, None, 0, *counts(spark, sf_dir))


BEST = f"""{SETS}, u AS (SELECT doc_id, list_filter(s, lambda x: x <> '') AS s FROM t),
p AS (SELECT q.doc_id AS query_id, d.doc_id AS article_id, len(list_intersect(q.s, d.s)) AS c, len(q.s) AS a, len(d.s) AS b FROM u q JOIN u d ON q.doc_id <> d.doc_id WHERE q.doc_id % 20 = 0),
j AS (SELECT query_id, article_id, c / greatest(a + b - c, 1) AS jaccard, a, b FROM p),
k AS (SELECT query_id, article_id, jaccard FROM j WHERE jaccard >= 0.02 OR a < 30 OR b < 30 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, article_id) <= 50)"""


@query("d5_best_candidates", f"WITH {BEST} SELECT query_id, article_id, round(jaccard, 9) AS jaccard FROM k")
def d5_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates whose texts are compared."""
    return d.set_similarity(*asked(spark, sf_dir), d.FLOOR, d.COMPARED, d.FEW_TOKENS, *counts(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9))


@query("d5_token_jaccard", f"""
WITH {SETS}, p AS (SELECT q.doc_id AS query_id, d.doc_id AS article_id, len(list_intersect(q.s, d.s)) AS c, len(q.s) AS a, len(d.s) AS b FROM t q JOIN t d ON q.doc_id <> d.doc_id WHERE q.doc_id % 20 = 0)
SELECT query_id, article_id, round(c / (a + b - c), 9) AS jaccard FROM p WHERE c / (a + b - c) >= 0.25""")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark, sf_dir).withColumn("jaccard", F.round("jaccard", 9))


@query("d5_d6_similar_documents")
def d5_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, parts = counts(spark, sf_dir)
    return d.similar_documents(*asked(spark, sf_dir), blocks=blocks, parts=parts).withColumn("level", d.similarity_level(F.col("score")))


@query("d6_similarity_level", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.999 THEN 'exact' WHEN l_discount * 10 >= 0.85 THEN 'very_high' WHEN l_discount * 10 >= 0.25 THEN 'partial' ELSE 'none' END AS level FROM lineitem""")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d.similarity_level(F.col("l_discount") * 10).alias("level"))


@query("d7_topical_links", """
WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2),
q AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1), u AS (SELECT label, [y / sqrt(list_sum([z * z FOR z IN v])) FOR y IN v] AS v FROM q),
n AS (SELECT label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), c AS (SELECT label, [y / sqrt(list_sum([z * z FOR z IN v])) FOR y IN v] AS v FROM n),
d AS (SELECT u.label AS article_id, c.label AS related, min(1 - list_dot_product(u.v, c.v)) AS distance FROM u JOIN c ON u.label <> c.label GROUP BY 1, 2)
SELECT CAST(article_id AS BIGINT) AS article_id, CAST(related AS BIGINT) AS related, CAST(row_number() OVER (PARTITION BY article_id ORDER BY distance, related) AS INTEGER) AS rank FROM d WHERE distance <= 0.9 QUALIFY rank <= 5""")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("article_id"), "embedding")
    blocks, parts = v.block_counts(vectors.select("article_id").distinct().count(), vectors.count())
    return v.topical_links(vectors, 5, 0.9, blocks, parts).select("article_id", "related", "rank")


#: Articles are the vectors of one remainder; a seventh are drafts, an eleventh retired, half changed in the last day.
@query("d7_article_links", """
WITH a AS (SELECT DISTINCT vec_id % 90 AS article_id FROM embeddings), b AS (SELECT article_id, article_id % 3 AS tenant, CASE WHEN article_id % 7 = 0 THEN 'draft' ELSE 'published' END AS status, article_id % 11 <> 0 AS active,
  article_id % 2 = 0 AS changed, CASE WHEN article_id % 5 = 0 THEN [article_id + 1] ELSE CAST([] AS BIGINT[]) END AS related FROM a),
live AS (SELECT * FROM b WHERE status = 'published' AND active), cur AS (SELECT vec_id, vec_id % 90 AS article_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE vec_id % 9 <> 0),
e AS (SELECT article_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM cur WHERE article_id IN (SELECT article_id FROM live WHERE changed)), m AS (SELECT article_id, i, avg(x) AS x FROM e GROUP BY 1, 2),
q AS (SELECT article_id, list(x ORDER BY i) AS v FROM m GROUP BY 1), u AS (SELECT article_id, [y / sqrt(list_sum([z * z FOR z IN v])) FOR y IN v] AS v FROM q), c AS (SELECT article_id, [y / sqrt(list_sum([z * z FOR z IN v])) FOR y IN v] AS v FROM cur),
d AS (SELECT u.article_id, c.article_id AS other, min(1 - list_dot_product(u.v, c.v)) AS distance FROM u JOIN live lu USING (article_id) JOIN c ON c.article_id <> u.article_id JOIN live lc ON lc.article_id = c.article_id AND lc.tenant = lu.tenant GROUP BY 1, 2),
k AS (SELECT article_id, other FROM d WHERE distance <= 0.9 QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY distance, other) <= 5), f AS (SELECT article_id, list(other) AS found FROM k GROUP BY 1)
SELECT article_id, list_sort(list_distinct(list_concat(related, found))) AS related, list_sort(list_filter(found, lambda x: NOT list_contains(related, x))) AS added
FROM f JOIN b USING (article_id) WHERE len(list_filter(found, lambda x: NOT list_contains(related, x))) > 0""")
def d7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 90).alias("article_id"), "embedding", F.when(F.col("vec_id") % 9 == 0, "v1").otherwise("v2").alias("embedding_version"))
    now, own = F.lit("2026-01-02 00:00:00").cast("timestamp"), F.col("article_id")
    articles = vectors.select("article_id").distinct().select(
        "article_id", (own % 3).alias("company_domain"), F.when(own % 7 == 0, "draft").otherwise("published").alias("status"), F.when(own % 11 == 0, "retired").otherwise("active").alias("lifecycle_status"),
        (now - F.when(own % 2 == 0, F.expr("INTERVAL 24 HOURS")).otherwise(F.expr("INTERVAL 25 HOURS"))).alias("updated_at"), F.when(own % 5 == 0, F.array(own + 1)).alias("related"),
    )
    return x.article_links(articles, vectors, now, "v2", most=0.9)


#: Every vector with two near copies, one of them equal up to scale in all but some places; all rows meet all rows.
@query("d3_near_classes", """
WITH RECURSIVE b AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e, unnest([0, 1, 2]) AS j FROM embeddings),
r AS MATERIALIZED (SELECT vec_id * 10 + j AS id, [CAST(CAST(e[i] * (1 + (CASE WHEN j > 0 THEN (i * 7 + vec_id * 3 + j * 5) % 7 ELSE 3 END - 3) * 0.04 * j) AS FLOAT) AS DOUBLE) FOR i IN generate_series(1, len(e))] AS v FROM b),
u AS MATERIALIZED (SELECT id, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS v FROM r),
l AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.id <> q.id WHERE list_dot_product(p.v, q.v) >= 0.97),
c AS (SELECT id AS a, id AS b FROM u UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT a AS id, min(b) AS class_id FROM c GROUP BY 1""")
def d3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.array(*(F.lit(j) for j in range(3)))).alias("j"))
    shift = lambda i: F.when(F.col("j") > 0, ((i + 1) * 7 + F.col("vec_id") * 3 + F.col("j") * 5) % 7).otherwise(3) - 3
    moved = F.transform("embedding", lambda e, i: (e.cast("double") * (1 + shift(i) * F.lit(0.04) * F.col("j"))).cast("float"))
    return x.near_classes(three.select((F.col("vec_id") * 10 + F.col("j")).alias("id"), moved.alias("vector")))


@query("d7_centroids", """
SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, unnest(embedding) AS x FROM embeddings""".join(["WITH e AS (", ") SELECT label, i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM e GROUP BY 1, 2"]))
def d7_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = v.centroids(table(spark, sf_dir, "embeddings"), "label")
    return found.select("label", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("d8_same_topic", r"""
WITH w AS (SELECT doc_id, source, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 2)) AS s FROM documents),
p AS (SELECT *, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS other, lead(s) OVER (PARTITION BY source ORDER BY doc_id) AS o FROM w)
SELECT doc_id, other, CASE WHEN len(list_distinct(list_concat(s, o))) > 0 THEN len(list_intersect(s, o)) / len(list_distinct(list_concat(s, o))) >= 0.34 ELSE false END AS same FROM p WHERE other IS NOT NULL""")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy("doc_id")
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"), F.lead("doc_id").over(order).alias("other"), F.lead("text").over(order).alias("b")).where("other is not null")
    return pairs.select("doc_id", "other", d.same_topic(F.col("a"), F.col("b")).alias("same"))


@query("d9_lesson_triage", f"""
WITH {SETS}, p AS (SELECT q.doc_id AS query_id, d.doc_id AS article_id, len(list_intersect(q.s, d.s)) AS c, len(q.s) AS a, len(d.s) AS b FROM t q JOIN t d ON q.doc_id <> d.doc_id WHERE q.doc_id % 20 = 0),
j AS (SELECT query_id, article_id, c / (a + b - c) AS score FROM p WHERE c / (a + b - c) >= 0.25), m AS (SELECT query_id, arg_max(article_id, (score, -article_id)) AS article_id, max(score) AS score FROM j GROUP BY 1)
SELECT query_id, CASE WHEN score >= 0.6 THEN 'update' ELSE 'add' END AS action, CASE WHEN score >= 0.6 THEN article_id END AS target FROM m""")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.lesson_triage(similar(spark, sf_dir).withColumnRenamed("jaccard", "score"))
