"""Batch retrieval: ``benchmark`` texts as queries, lines of ``documents`` as passages, first lines as titles.

``embeddings`` are the vectors of the queries and of the first lines of documents of that number. A query's first long word
names an entity, which every fiftieth document mentions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import postings
from loam.operators import retrieval as r
from loam.operators import vector_index as x
from loam.operators import vectors as v
from loam.plans.dedupe import lines
from loam.plans.registry import query
from loam.sources.tables import cut, shared_folder, table


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words each, with a name in capitals in every fourth."""
    words = F.filter(F.split("text", r"\s+"), lambda w: F.char_length(w) > 6)
    fourth = F.coalesce(F.get(words, F.lit(3)), F.lit(""))
    name = F.when(F.col("item_id") % 4 == 0, F.upper(F.when(fourth.rlike("^[A-Za-z]+$"), fourth).otherwise("none"))).otherwise("")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.lit("what is the"), F.array_join(F.slice(words, 1, 3), " "), name).alias("text"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where(F.trim("text") != "")


#: Stored passages and keyword index of a session's tables, by application and folder: built by the first query that asks.
_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, anew: bool = False) -> tuple[DataFrame, str]:
    """Passages as a stored table (chunk_id, article_id, text), and the folder of their keyword index."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if anew or key not in _STORED:
        path = f"{shared_folder(spark)}/passages-{uuid.uuid4().hex}"
        passages(spark, sf_dir).write.parquet(f"{path}/passages")
        postings.build(spark.read.parquet(f"{path}/passages"), f"{path}/index")
        _STORED[key] = path
    return spark.read.parquet(f"{_STORED[key]}/passages"), f"{_STORED[key]}/index"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("source").alias("dept"))


FOLD = lambda x: f"replace(strip_accents(lower({x})), 'đ', 'd')"
TOKENS = lambda x: f"regexp_extract_all({FOLD(x)}, '[\\p{{L}}\\p{{N}}_''-]+')"
STOP = ", ".join(f"'{w}'" for w in sorted({*r._pool()[0], *r._pool()[1]}))
QUERIES = r"""qw AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 6) AS w FROM benchmark),
queries AS (SELECT item_id AS query_id, 'what is the ' || array_to_string(w[1:3], ' ') || ' ' || CASE WHEN item_id % 4 = 0 THEN upper(CASE WHEN regexp_full_match(coalesce(w[4], ''), '[A-Za-z]+') THEN w[4] ELSE 'none' END) ELSE '' END AS text FROM qw)"""
PASSAGES = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
passages AS (SELECT doc_id * 100000 + pos AS chunk_id, doc_id AS article_id, line AS text FROM lines WHERE trim(line) <> ''),
toks AS (SELECT chunk_id, article_id, unnest({TOKENS('text')}) AS term FROM passages), idx AS (SELECT term, chunk_id, count(*) AS tf FROM toks GROUP BY 1, 2)"""
TERMS = f"""qt AS (SELECT query_id, unnest({TOKENS('text')}) AS term FROM queries), terms AS (SELECT DISTINCT query_id, term FROM qt WHERE length(term) > 1 AND term NOT IN ({STOP}))"""
#: Names: the queries hold capitals only where one was put in, and numbers nowhere.
NAMES = """names AS (SELECT query_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: length(w) > 1 AND w = upper(w) AND regexp_matches(w, '[A-Z]'))) AS w FROM queries)"""
KEYWORD = f"""{QUERIES}, {PASSAGES}, {TERMS},
kw AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sum(tf) DESC, chunk_id) - 1 AS rank FROM terms JOIN idx USING (term) GROUP BY 1, 2 QUALIFY rank < 240)"""
TITLE = f"""{KEYWORD}, tt AS (SELECT DISTINCT query_id, doc_id AS article_id FROM documents JOIN terms ON contains({FOLD('string_split(text, chr(10))[1]')}, term)),
tn AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) - 1 AS rank FROM tt JOIN passages USING (article_id) WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM kw) QUALIFY rank < 240),
tl AS (SELECT tn.query_id, tn.chunk_id, rank + coalesce(n, 0) AS rank FROM tn LEFT JOIN (SELECT query_id, count(*) AS n FROM kw GROUP BY 1) USING (query_id) WHERE rank + coalesce(n, 0) < 240)"""
IDENT = f"""{NAMES}, nd AS (SELECT DISTINCT query_id, lower(w) AS term FROM names WHERE lower(w) NOT IN ({STOP})), ns AS (SELECT query_id, ceil(48 / count(*)) AS share FROM nd GROUP BY 1),
ni AS (SELECT query_id, term, chunk_id, row_number() OVER (PARTITION BY query_id, term ORDER BY tf DESC, chunk_id) AS r FROM nd JOIN idx USING (term) JOIN ns USING (query_id) QUALIFY r <= any_value(share) OVER (PARTITION BY query_id)),
il AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(r), chunk_id) - 1 AS rank FROM ni GROUP BY 1, 2 QUALIFY rank < 48)"""
VECTOR = """vu AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), vn AS (SELECT vec_id, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS v FROM vu),
vd AS (SELECT q.vec_id AS query_id, c.vec_id * 100000 AS chunk_id, 1 - list_dot_product(q.v, c.v) AS distance FROM vn q JOIN benchmark ON item_id = q.vec_id, vn c WHERE c.vec_id * 100000 IN (SELECT chunk_id FROM passages)),
vl AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM vd WHERE distance <= 0.45 QUALIFY rank <= 240)"""
GRAPH = f"""en AS (SELECT item_id AS e, {FOLD('w[1]')} AS name FROM qw WHERE len(w) > 0), gw AS (SELECT query_id, {FOLD('text')} AS q FROM queries), ge AS (SELECT query_id, e FROM gw JOIN en ON contains(q, name)),
gn AS (SELECT query_id, e FROM ge UNION SELECT query_id, e + 1 FROM ge UNION SELECT query_id, e - 1 FROM ge WHERE e > 0),
gc AS (SELECT doc_id % 50 AS k, count(*) AS mentioned FROM documents GROUP BY 1),
ga AS (SELECT query_id, doc_id AS article_id, max(mentioned) AS best FROM gn JOIN en USING (e) JOIN gc ON k = e % 50 JOIN documents ON doc_id % 50 = e % 50 GROUP BY 1, 2),
gl AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, chunk_id % 100000, chunk_id) - 1 AS rank FROM ga JOIN passages USING (article_id) QUALIFY rank < 30)"""
FUSED = f"""{TITLE}, {IDENT}, {VECTOR}, {GRAPH},
legs AS (SELECT * FROM kw UNION ALL SELECT * FROM tl UNION ALL SELECT * FROM il UNION ALL SELECT query_id, chunk_id, rank - 1 FROM vl UNION ALL SELECT * FROM gl),
fu AS (SELECT query_id, chunk_id, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS rrf FROM legs GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, chunk_id) - 1 AS rank FROM fu)"""
RERANK = rf"""{FUSED}, qq AS (SELECT query_id, list_filter({TOKENS('text')}, lambda w: w NOT IN ({STOP}) AND length(w) > 1) AS list FROM queries),
qd AS (SELECT query_id, array_to_string(list, ' ') AS phrase, list_distinct(list) AS terms FROM qq),
po AS (SELECT fr.query_id, fr.chunk_id, fr.rank, {TOKENS('text')} AS words, {FOLD('text')} AS passage FROM fr JOIN passages USING (chunk_id) WHERE @READ@),
fo AS (SELECT po.query_id, chunk_id, rank, terms, phrase, passage, array_to_string(words, ' ') AS run, list_intersect(terms, words) AS found FROM po JOIN qd USING (query_id)),
df AS (SELECT query_id, term, count(*) AS df FROM (SELECT query_id, unnest(found) AS term FROM fo) GROUP BY 1, 2), sz AS (SELECT query_id, count(*) AS size FROM fo GROUP BY 1),
fi AS (SELECT query_id, list(term) AS findable FROM df GROUP BY 1),
nx AS (SELECT nd.query_id, nd.term, 11 * CASE WHEN size < 2 THEN 1 ELSE ln(CAST(size AS DOUBLE) / coalesce(df, 1)) / ln(CAST(size AS DOUBLE)) END AS extra FROM nd JOIN sz USING (query_id) JOIN df USING (query_id, term)),
ag AS (SELECT fo.query_id, chunk_id, rank, phrase, passage, run, list_intersect(coalesce(findable, terms), found) AS hit, coalesce(findable, terms) AS scored,
  coalesce((SELECT sum(extra) FROM nx WHERE nx.query_id = fo.query_id AND list_contains(found, nx.term)), 0) AS hx, coalesce((SELECT sum(extra) FROM nx WHERE nx.query_id = fo.query_id), 0) AS ax FROM fo LEFT JOIN fi USING (query_id)),
sv AS (SELECT query_id, chunk_id, rank, round((len(hit) + hx) / greatest(len(scored) + ax, 1) + CASE WHEN length(phrase) > 2 AND contains(run, phrase) THEN 0.35 ELSE 0 END
  + CASE WHEN regexp_matches(passage, '\b(?:is|are|means|refers to|defined as|describes)\b|\b(?:la|duoc goi la|co nghia la|dung de chi|duoc dinh nghia la)\b') THEN 0.75 ELSE 0 END
  - CASE WHEN regexp_matches(passage, 'reference|helpful documents|sources|bibliography|tai lieu tham khao|nguon tham khao|https?://|www\.') THEN 1 ELSE 0 END
  - CASE WHEN len(regexp_extract_all(passage, 'https?://|www\.')) >= 2 THEN 0.5 ELSE 0 END, 9) AS score FROM ag),
sc AS (SELECT sv.query_id, sv.chunk_id, sv.rank, CASE WHEN vl.rank <= 5 THEN greatest(score, 0.4) ELSE score END AS score FROM sv LEFT JOIN vl ON vl.query_id = sv.query_id AND vl.chunk_id = sv.chunk_id),
rr AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) - 1 AS place FROM sc)"""
#: A query reads three of four groups of sources.
READS = """CAST(coalesce(nullif(regexp_extract((SELECT source FROM documents WHERE doc_id = article_id), '[0-9]+'), ''), '0') AS BIGINT) % 4 <> query_id % 4"""
#: Copies collapse: of a key's passages those of other articles than the first one's go.
COLLAPSED = rf"""ck AS (SELECT rr.query_id, chunk_id, article_id, score, place, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS key, length(text) AS n FROM rr JOIN passages USING (chunk_id) WHERE score >= 0.12),
cf AS (SELECT *, first_value(article_id) OVER (PARTITION BY query_id, key, n >= 60 ORDER BY place) AS lead FROM ck),
co AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS INTEGER) AS place FROM cf WHERE n < 60 OR article_id = lead)"""
OPEN, FULL = RERANK.replace("@READ@", "true"), RERANK.replace("@READ@", READS) + ", " + COLLAPSED


@query("r1_query_terms", rf"""WITH {QUERIES} SELECT query_id, list_filter({TOKENS('text')}, lambda w: w NOT IN ({STOP}) AND length(w) > 1) AS terms FROM queries""")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", r.query_terms(F.col("text")).alias("terms"))


@query("r2_identifiers", f"WITH {QUERIES}, {NAMES} SELECT query_id, lower(w) AS name FROM names WHERE lower(w) NOT IN ({STOP})")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", F.explode(r.identifiers(F.col("text"))).alias("name"))


@query("r3_vocabulary", rf"""
WITH {PASSAGES}, w AS (SELECT article_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS name FROM passages), n AS (SELECT DISTINCT article_id, name FROM w WHERE regexp_full_match(name, '[A-Z][A-Z0-9_]{{3,15}}'))
SELECT name, count(*) AS uses FROM n GROUP BY 1""")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.vocabulary(passages(spark, sf_dir))


@query("r4_aliases")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = cut(r.vocabulary(passages(spark, sf_dir)))
    asked = questions(spark, sf_dir).where("query_id % 4 <> 0").unionByName(names.select(F.xxhash64("name").alias("query_id"), F.concat(F.lower("name"), F.lit(" "), F.reverse(F.lower("name"))).alias("text")))
    return r.aliases(asked, names.unionByName(names.select(F.concat(F.substring("name", 1, 4), F.substring(F.reverse("name"), 1, 1)).alias("name"), "uses")))


@query("r5_merge_aliases", f"""
WITH {KEYWORD}, e AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) - 1 AS rank FROM kw WHERE chunk_id % 3 = 0
  UNION ALL SELECT query_id, -query_id * 10 - s, 1000 + s FROM queries, generate_series(1, 5) t(s)),
o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM kw),
b AS (SELECT coalesce(o.query_id, e.query_id) AS query_id, coalesce(o.chunk_id, e.chunk_id) AS chunk_id, o.rank AS o, e.rank AS e FROM o FULL JOIN e ON o.query_id = e.query_id AND o.chunk_id = e.chunk_id),
n AS (SELECT *, CASE WHEN o IS NULL THEN row_number() OVER (PARTITION BY query_id, o IS NULL ORDER BY e) END AS new FROM b),
g AS (SELECT *, CASE WHEN o < 2 THEN 0 WHEN o IS NULL AND new <= 3 THEN 1 WHEN o IS NOT NULL THEN 2 ELSE 3 END AS grp FROM n)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY grp, coalesce(o, e)) - 1 AS INTEGER) AS place FROM g""")
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    asked = questions(spark, sf_dir)
    keyword = r.keyword_leg(r.asked_terms(asked), r.token_index(passages(spark, sf_dir)))
    again = keyword.where("chunk_id % 3 = 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")) - 1)
    extra = asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("s")).select("query_id", (-F.col("query_id") * 10 - F.col("s")).alias("chunk_id"), (F.lit(1000) + F.col("s")).alias("rank"))
    return r.merged_aliases(keyword, again.unionByName(extra))


def vector_leg(spark: SparkSession, sf_dir: str, k: int = 240, most: float = 0.45) -> DataFrame:
    """Every twentieth vector against all."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    stored = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return v.nearest(asked, stored, k, most, *v.block_counts(asked.count(), vectors.count()))


@query("r6_vector_leg", """
WITH n AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), u AS (SELECT vec_id, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS v FROM n),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, 1 - list_dot_product(q.v, c.v) AS distance FROM u q, u c WHERE q.vec_id % 20 = 0)
SELECT query_id, chunk_id, round(distance, 4) AS distance FROM d WHERE distance <= 0.45 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 240""")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_leg(spark, sf_dir).select("query_id", "chunk_id", F.round("distance", 4).alias("distance"))


@query("r6_indexed_leg")
def r6_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 240 nearest of every twentieth vector by a stored inverted file; how many lists are looked through is measured for a
    recall of 0.93 (tests hold it against all rows). Approximate, so without SQL."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("article_id"), F.col("embedding").alias("vector"))
    path = f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}"
    x.build(vectors, path)
    rows, centres = x.load(spark, path)
    asked = vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return x.probe(asked, rows, centres, r.POOL, 2.0, x.probes_for(rows, centres, r.POOL, 2.0, 0.93)).withColumn("distance", F.round("distance", 4))


@query("r7_keyword_leg", f"WITH {KEYWORD} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM kw")
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.keyword_top(spark, stored(spark, sf_dir)[1], r.asked_terms(questions(spark, sf_dir)), r.POOL)


@query("r7_index_build", f"""WITH {PASSAGES} SELECT term, count(*) AS passages, CAST(sum(tf) AS BIGINT) AS occurrences FROM idx GROUP BY 1""")
def r7_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds passages and index anew; what the index holds of every term."""
    blocks = spark.read.parquet(f"{stored(spark, sf_dir, anew=True)[1]}/blocks")
    each = blocks.select("term", F.size("entries").cast("long").alias("n"), F.aggregate("entries", F.lit(0).cast("long"), lambda t, e: t + e["tf"]).alias("tf"))
    return each.groupBy("term").agg(F.sum("n").alias("passages"), F.sum("tf").alias("occurrences"))


@query("r7_counted_leg", f"WITH {KEYWORD} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM kw")
def r7_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows without a stored index: the batch's words are counted in all passages."""
    terms = r.asked_terms(questions(spark, sf_dir))
    return r.keyword_leg(terms, r.token_index(passages(spark, sf_dir), terms))


@query("r8_title_leg", f"WITH {TITLE} SELECT query_id, chunk_id, rank FROM tl")
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, (chunks, index) = cut(r.asked_terms(questions(spark, sf_dir))), stored(spark, sf_dir)
    return r.title_leg(terms, titles(spark, sf_dir), chunks, cut(postings.keyword_top(spark, index, terms, r.POOL)))


@query("r9_identifier_leg", f"WITH {KEYWORD}, {IDENT} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM il")
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    named = asked.select(F.explode(r.identifiers(F.col("text"))).alias("term"))
    return r.identifier_leg(asked, postings.entries(spark, stored(spark, sf_dir)[1], named))


#: Names inside words: every third supplier goes by its number alone, the queries run the whole name into other letters.
@query("r10_graph_leg", """
WITH q AS (SELECT s_suppkey AS query_id, s_nationkey % 3 AS company_domain, 'about pre' || lower(s_name) || 'post and the rest' AS text FROM supplier),
en AS (SELECT s_suppkey AS e, s_nationkey % 3 AS company_domain, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE lower(s_name) END AS name FROM supplier),
m AS (SELECT DISTINCT l_partkey AS article_id, l_suppkey AS entity_id FROM lineitem), mc AS (SELECT entity_id, count(*) AS mentioned FROM m GROUP BY 1),
seeds AS (SELECT query_id, q.company_domain, e FROM q JOIN en ON q.company_domain = en.company_domain AND contains(text, name)),
rel AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b, s_nationkey % 3 AS company_domain FROM supplier WHERE s_suppkey % 2 = 0), hops AS (SELECT a, b, company_domain FROM rel UNION ALL SELECT b, a, company_domain FROM rel),
near AS (SELECT query_id, company_domain, e FROM seeds UNION SELECT query_id, company_domain, b FROM seeds JOIN hops USING (company_domain) WHERE e = a),
h AS (SELECT query_id, near.company_domain, article_id, max(mentioned) AS best FROM near JOIN en USING (e, company_domain) JOIN mc ON e = mc.entity_id JOIN m ON e = m.entity_id WHERE article_id % 3 = near.company_domain GROUP BY 1, 2, 3),
c AS (SELECT *, unnest([0, 1]) AS i FROM h)
SELECT query_id, article_id * 10 + i AS chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best DESC, i, article_id * 10 + i) - 1 AS INTEGER) AS rank FROM c QUALIFY rank < 30""")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenant = (F.col("s_nationkey") % 3).alias("company_domain")
    supplier, line = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    asked = supplier.select(F.col("s_suppkey").alias("query_id"), tenant, F.concat(F.lit("about pre"), "s_name", F.lit("post and the rest")).alias("text"))
    mentions = line.select(F.col("l_partkey").alias("article_id"), F.col("l_suppkey").alias("entity_id")).distinct()
    counted = mentions.groupBy("entity_id").agg(F.count("*").alias("mention_count"))
    name = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string")).otherwise(F.lower("s_name"))
    entities = supplier.select(F.col("s_suppkey").alias("entity_id"), tenant, name.alias("normalized_name")).join(counted, "entity_id")
    relations = supplier.where("s_suppkey % 2 = 0").select(tenant, F.col("s_suppkey").alias("source"), (F.col("s_suppkey") + 1).alias("target"))
    articles = line.select("l_partkey").distinct().select(F.col("l_partkey").alias("article_id"), (F.col("l_partkey") % 3).alias("company_domain"))
    chunks = articles.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index")).withColumn("chunk_id", F.col("article_id") * 10 + F.col("chunk_index"))
    return r.graph_leg(asked, entities, relations, mentions, chunks)


def near(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """The vector leg of the queries."""
    vectors, asked = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    mine = vectors.join(asked, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    stored = vectors.select((F.col("vec_id") * 100000).alias("chunk_id"), F.col("embedding").alias("vector")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return v.nearest(mine, stored, r.POOL, 0.45, *v.block_counts(asked.count(), vectors.count()))


def graph(spark: SparkSession, sf_dir: str, asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The graph leg of the queries, all of one tenant."""
    tenant = F.lit("all").alias("company_domain")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.get(F.filter(F.split("text", r"\s+"), lambda w: F.char_length(w) > 6), F.lit(0)).alias("w"))
    fiftieth = items.select(F.col("item_id").alias("entity_id"), (F.col("item_id") % 50).alias("k"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), (F.col("doc_id") % 50).alias("k"))
    counted = docs.groupBy("k").agg(F.count("*").alias("mention_count"))
    entities = items.where("w is not null").select(F.col("item_id").alias("entity_id"), r.fold(F.col("w")).alias("normalized_name"), (F.col("item_id") % 50).alias("k"), tenant).join(counted, "k")
    relations = items.select(tenant, F.col("item_id").alias("source"), (F.col("item_id") + 1).alias("target"))
    mentions = docs.join(fiftieth, "k").select("article_id", "entity_id")
    named = asked.select("query_id", "text", tenant)
    return r.graph_leg(named, entities, relations, mentions, chunks.select(tenant, "chunk_id", "article_id", (F.col("chunk_id") % 100000).alias("chunk_index")))


@query("r11_fused", f"WITH {FUSED} SELECT query_id, chunk_id, round(rrf, 12) AS rrf, CAST(rank AS INTEGER) AS rank FROM fr")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, (chunks, index) = questions(spark, sf_dir), stored(spark, sf_dir)
    found = r.legs(asked, chunks, titles(spark, sf_dir), near(spark, sf_dir, chunks), graph(spark, sf_dir, asked, chunks), postings=index)
    return found.withColumn("rrf", F.round("rrf", 12))


def results(spark: SparkSession, sf_dir: str, limit: int | None = 10, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """The search of all queries; ``full`` with copies collapsed and for readers of three of four groups of sources."""
    asked, (chunks, index), named = questions(spark, sf_dir), stored(spark, sf_dir), titles(spark, sf_dir)
    readers = None
    if full:
        number = F.coalesce(F.try_to_number(F.regexp_extract("dept", "[0-9]+", 0), F.lit("999999999")).cast("long"), F.lit(0))
        named = named.withColumn("dept", (number % 4).cast("string"))
        groups = asked.select("query_id", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("g"))
        readers = groups.where(F.col("g") != F.col("query_id") % 4).select("query_id", F.col("g").cast("string").alias("dept"))
    vector = near(spark, sf_dir, chunks)
    return r.search(asked, chunks, named, limit, vector, graph(spark, sf_dir, asked, chunks), readers=readers, collapse=full, postings=index)


@query("r12_rerank", f"WITH {OPEN} SELECT query_id, chunk_id, score, CAST(place AS INTEGER) AS place FROM rr WHERE score >= 0.12")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir, None)[0].select("query_id", "chunk_id", "score", "place")


@query("r13_vector_assist", f"""
WITH {OPEN}, vv AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id DESC) AS rank FROM fr)
SELECT sv.query_id, sv.chunk_id, CASE WHEN vv.rank <= 5 THEN greatest(score, 0.4) ELSE score END AS score FROM sv JOIN vv USING (query_id, chunk_id)""")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    asked, chunks = questions(spark, sf_dir), passages(spark, sf_dir)
    found = r.legs(asked, chunks, titles(spark, sf_dir), near(spark, sf_dir, chunks), graph(spark, sf_dir, asked, chunks))
    pool = cut(found.join(chunks.select("chunk_id", "text"), "chunk_id"))
    latest = pool.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("chunk_id"))).alias("rank"))
    return r.rerank(asked, pool, latest).select("query_id", "chunk_id", "score")


@query("r14_wordings", f"""
WITH {KEYWORD} SELECT query_id, chunk_id, max(score) AS score FROM (SELECT query_id, chunk_id, 1.0 / (rank + 1) AS score FROM kw UNION ALL SELECT query_id, chunk_id, (chunk_id % 7) / 10.0 FROM kw) GROUP BY 1, 2""")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword = r7(spark, sf_dir)
    one = keyword.select("query_id", "chunk_id", (F.lit(1.0) / (F.col("rank") + 1)).alias("score"))
    return r.merged_wordings(one, keyword.select("query_id", "chunk_id", (F.col("chunk_id") % 7 / 10.0).alias("score")))


@query("r15_second_stage", f"""
WITH {OPEN}, w AS (SELECT * FROM rr WHERE score >= 0.12), v AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS v FROM w QUALIFY v <= 50),
c AS (SELECT w.*, w.place < 10 OR (v IS NOT NULL AND row_number() OVER (PARTITION BY w.query_id ORDER BY v NULLS LAST, place) <= 5) AS c, (w.chunk_id * 37 % 101) / 100.0 AS p FROM w LEFT JOIN v USING (query_id, chunk_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY p DESC, place) AS h FROM c)
SELECT query_id, chunk_id, CASE WHEN c AND h <= 3 AND p >= 0.05 THEN greatest(score, 0.4) ELSE score END AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, CASE WHEN c THEN p END DESC NULLS LAST, place) - 1 AS INTEGER) AS place FROM h""")
def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ranked = cut(results(spark, sf_dir, None)[0].select("query_id", "chunk_id", "score", "place"))
    first = ranked.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")).alias("rank")).where("rank <= 50")
    second = ranked.select("query_id", "chunk_id", (F.col("chunk_id") * 37 % 101 / 100).alias("probability"))
    return r.promoted(ranked, second, first)


@query("r16_hybrid_search", f"WITH {FULL} SELECT query_id, chunk_id, score, place FROM co WHERE place < 10")
def r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir, full=True)[0].select("query_id", "chunk_id", "score", "place")


@query("r17_parents", f"""
WITH {KEYWORD} SELECT query_id, CAST(floor(chunk_id / 100000) AS BIGINT) AS parent_id, arg_max(chunk_id, (240 - rank, -chunk_id)) AS chunk_id, max(240 - rank) AS score, list_sort(list(DISTINCT chunk_id)) AS children FROM kw GROUP BY 1, 2""")
def r17(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword = r7(spark, sf_dir)
    return r.parents(keyword.select("query_id", F.floor(F.col("chunk_id") / 100000).alias("parent_id"), "chunk_id", (F.lit(240) - F.col("rank")).alias("score")))


@query("r18_select_context", rf"""
WITH RECURSIVE {OPEN}, best AS (SELECT query_id, CAST(floor(chunk_id / 100000) AS BIGINT) AS parent_id, max(score) AS score FROM rr WHERE score >= 0.35 AND place < 200 GROUP BY 1, 2),
tr AS (SELECT doc_id AS parent_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 4000) AS h FROM documents WHERE doc_id IN (SELECT parent_id FROM best)),
la AS (SELECT *, greatest(CASE WHEN contains(h, chr(10)) THEN 4000 - position(chr(10) IN reverse(h)) ELSE -1 END, CASE WHEN contains(h, '. ') THEN 4000 - position(' .' IN reverse(h)) - 1 ELSE -1 END) AS last FROM tr),
cx AS (SELECT parent_id, CASE WHEN length(t) <= 4000 THEN t ELSE regexp_replace(substr(h, 1, CASE WHEN last > 2000 THEN last + 1 ELSE 4000 END), '\s+$', '') || ' …' END AS text FROM la),
od AS (SELECT *, length(text) AS n, greatest(1, (length(text) + 3) // 4) AS own, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS r FROM best JOIN cx USING (parent_id) WHERE text <> ''),
st AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS taken, false AS fits FROM od
  UNION ALL SELECT query_id, r, size + CASE WHEN fit THEN n ELSE 0 END, spent + CASE WHEN fit THEN own ELSE 0 END, taken + CASE WHEN fit THEN 1 ELSE 0 END, fit
  FROM (SELECT st.query_id, od.r, size, spent, taken, n, own, taken < 40 AND (size = 0 OR (size + n <= 70000 AND spent + own <= 17500)) AS fit FROM st JOIN od ON od.query_id = st.query_id AND od.r = st.r + 1))
SELECT query_id, parent_id, parent_id AS article_id, score, 'C' || taken AS label, text AS context FROM st JOIN od USING (query_id, r) WHERE fits""")
def r18(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.parents(results(spark, sf_dir, 200)[0].select("query_id", "chunk_id", "score").withColumn("parent_id", F.floor(F.col("chunk_id") / 100000)))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), F.col("doc_id").alias("article_id"), "text")
    return r.select_context(found.join(texts, "parent_id"))


ORDERS = """o AS (SELECT o_custkey % 50 AS query_id, o_orderkey AS article_id, CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS INTEGER) AS place, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS k FROM orders)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_orderkey").alias("article_id"), F.row_number().over(order).alias("place"), F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 5).alias("k"))


@query("r19_as_of", f"""
WITH {ORDERS}, v AS (SELECT article_id, CASE WHEN k IN (0, 1, 2) THEN d END AS issued, CASE WHEN k IN (1, 3) THEN d + 365 END AS expires FROM o),
e AS (SELECT a.article_id, v.issued - 1 AS e FROM o a JOIN v ON v.article_id = a.article_id + 5 WHERE a.k = 0 AND v.issued IS NOT NULL AND a.article_id % 2 = 0),
w AS (SELECT v.article_id, issued, CASE WHEN e IS NULL THEN expires WHEN expires IS NULL THEN e ELSE least(expires, e) END AS expires FROM v LEFT JOIN e USING (article_id)),
b AS (SELECT query_id, o.article_id, place, CASE WHEN issued IS NULL AND expires IS NULL THEN 1 WHEN issued > DATE '1998-06-01' OR expires < DATE '1998-06-01' THEN 2 WHEN issued IS NOT NULL THEN 0 ELSE 1 END AS bucket FROM o JOIN w USING (article_id))
SELECT query_id, article_id, bucket, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bucket, place) - 1 AS INTEGER) AS place FROM b""")
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    validity = o.select("article_id", F.when(F.col("k").isin(0, 1, 2), F.col("d")).alias("issued"), F.when(F.col("k").isin(1, 3), F.date_add("d", 365)).alias("expires"))
    decisions = o.where("k = 0 and article_id % 2 = 0").select("article_id", (F.col("article_id") + 5).alias("kept"))
    return r.as_of(o.select("query_id", "article_id", "place"), validity, decisions, F.lit("1998-06-01").cast("date"))


@query("r20_superseded", f"""
WITH {ORDERS} SELECT query_id, article_id FROM o WHERE NOT (k = 0 AND article_id % 2 = 0 AND EXISTS (SELECT 1 FROM o x WHERE x.query_id = o.query_id AND x.article_id = o.article_id + 50))""")
def r20(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    decisions = o.where("k = 0 and article_id % 2 = 0").select("article_id", (F.col("article_id") + 50).alias("kept"))
    return r.without_superseded(o.select("query_id", "article_id"), decisions)


@query("r21_page_evidence", """
WITH c AS (SELECT o_custkey AS query_id, o_orderkey AS position, o_orderkey AS article_id, CAST(o_custkey % 7 + 1 AS INTEGER) AS page_number FROM orders),
e AS (SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_orderkey AS article_id, l_linenumber AS page_number, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS img FROM lineitem),
m AS (SELECT *, min(img) OVER (PARTITION BY query_id, position) AS least FROM c JOIN e USING (article_id, page_number)), k AS (SELECT * FROM m WHERE img = least),
n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY position) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, position ORDER BY img, evidence_id) AS r FROM n QUALIFY r <= 2)
SELECT query_id, position, evidence_id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position, r) <= 4""")
def r21(spark: SparkSession, sf_dir: str) -> DataFrame:
    citations = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("article_id"), (F.col("o_custkey") % 7 + 1).cast("int").alias("page_number"))
    evidence = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("page_number"), F.when(F.col("l_quantity") > 25, "page_visual").otherwise("table").alias("kind"))
    return r.page_evidence(citations, evidence)


@query("r22_routing", rf"""
WITH t AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' vs other one' WHEN 1 THEN '? Really?' WHEN 2 THEN ' So sánh A and B' ELSE '' END AS text FROM conversations),
c AS (SELECT *, regexp_matches({FOLD('text')}, 'so sanh|khac nhau|khac biet|hay la|nen chon|compare|comparison|difference between|differences between|versus') OR regexp_matches(text, '(?i)\bvs\b') AS comparison FROM t)
SELECT conv_id, turn, comparison, comparison OR length(text) - length(replace(text, '?', '')) >= 2 AS deep FROM c""")
def r22(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("turn") % 4 == 0, " vs other one").when(F.col("turn") % 4 == 1, "? Really?").when(F.col("turn") % 4 == 2, " So sánh A and B").otherwise("")
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("text"))
    return r.routing(asked).select("conv_id", "turn", "comparison", "deep")


@query("r22_ambiguous_departments", f"""
WITH {OPEN}, f AS (SELECT rr.*, source AS dept FROM rr JOIN documents ON doc_id = CAST(floor(chunk_id / 100000) AS BIGINT) WHERE score >= 0.12 AND place < 5),
n AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, count(*) OVER (PARTITION BY query_id) AS c FROM f), k AS (SELECT * FROM n WHERE c >= 2 AND top > 0 AND score >= top * 0.85),
d AS (SELECT query_id, dept, min((-score, place)) AS o FROM k GROUP BY 1, 2) SELECT query_id, list(dept ORDER BY o) AS departments FROM d GROUP BY 1 HAVING count(*) > 1""")
def r22_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results(spark, sf_dir)[0].withColumn("article_id", F.floor(F.col("chunk_id") / 100000))
    return r.ambiguous_departments(found.join(titles(spark, sf_dir).select("article_id", "dept"), "article_id"))


@query("r23_related_articles", """
WITH a AS (SELECT o_orderkey AS article_id, o_custkey AS dept, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS domain, o_orderdate AS ts FROM orders), t AS (SELECT DISTINCT l_orderkey AS article_id, l_partkey AS tag FROM lineitem WHERE l_linenumber = 1),
p AS (SELECT x.article_id, y.article_id AS related, y.ts FROM a x JOIN a y ON x.dept = y.dept UNION SELECT x.article_id, y.article_id, y.ts FROM a x JOIN a y ON x.domain = y.domain
  UNION SELECT x.article_id, y.article_id, a.ts FROM t x JOIN t y ON x.tag = y.tag JOIN a ON a.article_id = y.article_id WHERE x.article_id IN (SELECT article_id FROM a))
SELECT article_id, related, CAST(row_number() OVER (PARTITION BY article_id ORDER BY ts DESC, related) AS INTEGER) AS rank FROM p WHERE article_id <> related QUALIFY rank <= 6""")
def r23(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_custkey").alias("dept"), (F.floor("o_totalprice") % 5000).alias("domain"), F.col("o_orderdate").alias("created_at"))
    tags = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("tag")).distinct()
    return r.related_articles(articles, tags)


@query("r24_listing", """
WITH a AS (SELECT p_partkey AS article_id, p_name AS title, p_size AS created_at FROM part WHERE p_brand = 'Brand#2' AND contains(lower(p_name), 'r'))
SELECT article_id, title, (SELECT count(*) FROM a) AS total FROM a ORDER BY created_at DESC, article_id LIMIT 3 OFFSET 3""")
def r24(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_size").alias("created_at"))
    return r.listing(articles, "R", 1, 3, brand="Brand#2").select("article_id", "title", "total")


@query("r25_document_scope", """
WITH RECURSIVE asked AS (SELECT vec_id AS question_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS q FROM embeddings WHERE vec_id % 20 = 0),
ready AS (SELECT vec_id AS article_id, CASE WHEN vec_id % 11 <> 0 THEN [CAST(x AS DOUBLE) FOR x IN embedding] END AS v FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 13 <> 0 AND vec_id % 17 <> 0),
near AS (SELECT question_id, article_id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)), 9) AS cosine FROM asked, ready),
lines AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM documents),
firsts AS (SELECT doc_id AS article_id, min(doc_id * 100000 + pos) AS first_chunk FROM lines WHERE (doc_id * 100000 + pos) % 3 <> 0 GROUP BY 1),
scope AS (SELECT question_id, article_id, cosine, first_chunk, n_chars // 4 AS tokens, CAST(row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC NULLS LAST, article_id) AS INTEGER) AS place
  FROM near JOIN documents ON doc_id = article_id LEFT JOIN firsts USING (article_id) QUALIFY place <= 120),
fold AS (SELECT question_id, place, tokens AS used, 0 AS batch FROM scope WHERE place = 1
  UNION ALL SELECT s.question_id, s.place, CASE WHEN used > 0 AND used + tokens > 6000 THEN tokens ELSE used + tokens END, batch + CASE WHEN used > 0 AND used + tokens > 6000 THEN 1 ELSE 0 END FROM fold JOIN scope s ON s.question_id = fold.question_id AND s.place = fold.place + 1),
t AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM ready) AS with_digest)
SELECT question_id, article_id, batch, cosine, first_chunk, place, total, with_digest, total - with_digest AS without_digest FROM scope JOIN fold USING (question_id, place), t""")
def r25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a question; of the digests every thirteenth failed, every seventeenth is empty, every eleventh
    of the others has no vector yet."""
    vectors = table(spark, sf_dir, "embeddings")
    articles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), (-F.col("doc_id")).alias("created_at"))
    status, summary = F.when(F.col("vec_id") % 13 == 0, "failed").otherwise("ready"), F.when(F.col("vec_id") % 17 == 0, " ").otherwise("about")
    digests = vectors.select(F.col("vec_id").alias("article_id"), F.when(F.col("vec_id") % 11 != 0, F.col("embedding")).alias("vector"), status.alias("status"), summary.alias("summary"))
    chunks = lines(spark, sf_dir).select("article_id", (F.col("chunk_id") % 100000).alias("chunk_index"), "chunk_id", (F.col("chunk_id") % 3 == 0).alias("evidence"))
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    scope = cut(r.document_scopes(articles, digests, asked, chunks, places=9))
    sized = scope.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.floor(F.col("n_chars") / 4).alias("tokens")), "article_id")
    return r.token_batches(sized.select("question_id", "place", "article_id", "tokens")).join(scope, ["question_id", "article_id"])


@query("r26_coverage", f"""
WITH {OPEN}, h AS (SELECT query_id AS question_id, chunk_id % 3 AS sub_id, chunk_id, score FROM rr WHERE score >= 0.12 AND place < 10), f AS (SELECT * FROM h WHERE floor(chunk_id / 100000) % 2 = 0),
c AS (SELECT question_id, sub_id FROM f GROUP BY 1, 2 HAVING max(score) >= 0.35), a AS (SELECT * FROM f UNION SELECT * FROM h WHERE (question_id, sub_id) NOT IN (SELECT question_id, sub_id FROM c))
SELECT question_id, sub_id, count(*) AS hits, max(score) AS best, max(score) >= 0.35 AS covered FROM a GROUP BY 1, 2""")
def r26(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = cut(results(spark, sf_dir)[0].select(F.col("query_id").alias("question_id"), (F.col("chunk_id") % 3).alias("sub_id"), "chunk_id", "score"))
    subs = questions(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("sub_id"))
    return r.coverage(r.retried(subs, again.where("floor(chunk_id / 100000) % 2 = 0"), again))
