"""Access rules: customers as users, nations as departments, regions as tenants, orders as articles and grants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import access as a
from loam.plans.registry import query
from loam.sources.tables import table

TABLES = """users AS (SELECT c_custkey AS user_id, n_regionkey AS company_domain, c_custkey % 50 = 0 AS reviewer, c_nationkey AS dept FROM customer JOIN nation ON n_nationkey = c_nationkey),
articles AS (SELECT o_orderkey AS article_id, n_regionkey AS company_domain, n_nationkey AS dept, CASE o_orderkey % 7 WHEN 0 THEN 'users' WHEN 1 THEN 'public' ELSE 'company' END AS visibility, o_custkey AS owner_id,
  CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'published' END AS status, o_orderkey % 11 <> 0 AS active, o_orderkey % 5 = 0 AS governed FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
permissions AS (SELECT l_orderkey AS article_id, l_suppkey * 10 AS user_id, CASE WHEN l_linenumber = 1 THEN 'deny' ELSE 'allow' END AS effect, CASE WHEN l_linenumber > 4 THEN 'provider' ELSE 'internal' END AS source FROM lineitem),
shares AS (SELECT article_id, (dept + 1) % 25 AS dept FROM articles WHERE article_id % 13 = 0)"""
ALLOWED = f"""{TABLES}, live AS (SELECT * FROM articles WHERE active AND dept % 9 <> 8),
mine AS (SELECT article_id, dept FROM live UNION SELECT article_id, dept FROM shares WHERE article_id IN (SELECT article_id FROM live)),
asked AS (SELECT o_custkey AS user_id, o_orderkey AS article_id FROM orders UNION SELECT o_custkey + o_orderkey % 40, o_orderkey FROM orders UNION SELECT l_suppkey * 10, l_orderkey FROM lineitem),
paths AS (SELECT q.user_id, q.article_id FROM asked q JOIN users u ON u.user_id = q.user_id JOIN mine m ON m.article_id = q.article_id AND m.dept = u.dept JOIN live ON live.article_id = q.article_id WHERE visibility <> 'users'
  UNION SELECT q.user_id, q.article_id FROM asked q JOIN users u ON u.user_id = q.user_id JOIN live l ON l.article_id = q.article_id AND l.company_domain = u.company_domain WHERE visibility = 'public'
  UNION SELECT q.user_id, q.article_id FROM asked q JOIN live l ON l.article_id = q.article_id AND l.owner_id = q.user_id
  UNION SELECT p.user_id, p.article_id FROM permissions p JOIN live l ON l.article_id = p.article_id JOIN asked q ON q.article_id = p.article_id AND q.user_id = p.user_id WHERE effect = 'allow'),
src AS (SELECT user_id, article_id FROM permissions WHERE effect = 'allow' AND source = 'provider' UNION SELECT user_id, article_id FROM users JOIN mine USING (dept)),
allowed AS (SELECT p.user_id, p.article_id FROM paths p JOIN live l ON l.article_id = p.article_id JOIN users u ON u.user_id = p.user_id AND u.company_domain = l.company_domain
  WHERE NOT EXISTS (SELECT 1 FROM permissions d WHERE d.effect = 'deny' AND d.user_id = p.user_id AND d.article_id = p.article_id) AND (status = 'published' OR reviewer OR owner_id = p.user_id)
  AND (NOT governed OR EXISTS (SELECT 1 FROM src WHERE src.user_id = p.user_id AND src.article_id = p.article_id)))"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("c_custkey").alias("user_id"), F.col("n_regionkey").alias("company_domain"), (F.col("c_custkey") % 50 == 0).alias("reviewer"), F.col("c_nationkey").alias("dept"), F.col("c_name").alias("name"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        key.alias("article_id"), F.col("n_regionkey").alias("company_domain"), F.col("n_nationkey").alias("dept"), F.when(key % 7 == 0, "users").when(key % 7 == 1, "public").otherwise("company").alias("visibility"),
        F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("published").alias("status"), (key % 11 != 0).alias("active"), (key % 5 == 0).alias("governed"),
    )


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("article_id"), (F.col("l_suppkey") * 10).alias("user_id"), F.when(F.col("l_linenumber") == 1, "deny").otherwise("allow").alias("effect"),
        F.when(F.col("l_linenumber") > 4, "provider").otherwise("internal").alias("source"),
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are looked up: buyers and their orders, other customers and orders, and whoever has a grant or a denial."""
    orders = table(spark, sf_dir, "orders")
    own = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("article_id"))
    other = orders.select((F.col("o_custkey") + F.col("o_orderkey") % 40).alias("user_id"), F.col("o_orderkey").alias("article_id"))
    return own.union(other).union(permissions(spark, sf_dir).select("user_id", "article_id")).distinct()


def allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, rows = users(spark, sf_dir), articles(spark, sf_dir)
    departments = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("dept"), (F.col("n_nationkey") % 9 != 8).alias("active"))
    shares = rows.where("article_id % 13 = 0").select("article_id", ((F.col("dept") + 1) % 25).alias("dept"))
    return a.entitlements(people, rows, departments, people.select("user_id", "dept"), shares, permissions(spark, sf_dir), asked(spark, sf_dir))


@query("a1_entitlements", f"WITH {ALLOWED} SELECT user_id, article_id FROM allowed")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allowed(spark, sf_dir)


@query("a2_retrieval_filter", """
SELECT o_orderkey AS article_id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 9 <> 0 AND o_orderpriority = '5-LOW' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("article_id"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("published").alias("status"), F.when(F.col("o_orderkey") % 9 == 0, "stale").otherwise("ready").alias("index_status"),
        F.col("o_orderpriority").alias("sensitivity"), F.col("o_orderdate").alias("created_at"),
    )
    tags = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_returnflag").alias("tag"))
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return a.retrieval_filter(chunks, tags, "R", day("1996-01-01 00:00:00"), day("1998-12-31 00:00:00"), sensitivity="5-LOW").select("article_id")


def permission_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: the buyer as a user, the priority as a group, every fourth with a link, every seventh broken."""
    key = F.col("o_orderkey").cast("string")
    text = F.format_string(
        '[{"roles":["write","read"],"grantedToV2":{"user":{"id":"u%s","displayName":"User","email":"u%s@x.org"}}},{"roles":["read"],"grantedToIdentitiesV2":[{"user":{"id":"u%s"}},{"group":{"displayName":"%s"}}]}%s]',
        (F.col("o_custkey")).cast("string"), F.col("o_custkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(',{"roles":["read"],"link":{"scope":"organization"}}')).otherwise(F.lit("")),
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("{broken"), key)).otherwise(text).alias("permissions"))


PRINCIPALS = """principals AS (SELECT o_orderkey AS document_id, 'user' AS type, 'u' || CAST(o_custkey AS VARCHAR) AS id, 'read,write' AS roles FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT o_orderkey, 'group', o_orderpriority, 'read' FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'link', 'organization', 'read' FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 4 = 0)"""


@query("a3_principals", f"WITH {PRINCIPALS} SELECT document_id, type, id, roles FROM principals")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.principals(permission_json(spark, sf_dir)).select("document_id", "type", "id", "roles")


@query("a4_resolved", """
WITH p AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'group' WHEN 2 THEN 'user' WHEN 3 THEN 'everyone' ELSE 'application' END AS type FROM customer)
SELECT 'p' || CAST(c_custkey AS VARCHAR) AS principal_id, type, CASE WHEN c_custkey % 20 = 0 THEN 'mapped' WHEN type = 'application' THEN 'ignored' WHEN type = 'everyone' THEN 'auto' WHEN type = 'user' THEN CASE WHEN c_custkey % 3 = 0 THEN 'auto' ELSE 'no_account' END
  WHEN c_custkey % 2 = 1 THEN 'auto' ELSE 'unmapped' END AS status FROM p""")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("c_custkey"), table(spark, sf_dir, "customer")
    kind = F.when(key % 5 == 0, "user").when(key % 5 == 1, "group").when(key % 5 == 2, "user").when(key % 5 == 3, "everyone").otherwise("application")
    name = F.when(key % 2 == 1, F.concat(F.lit("Phòng Nation "), (key % 25).cast("string"), F.lit(" - Owners"))).otherwise("Elsewhere Members")
    who = customer.select(F.concat(F.lit("p"), key.cast("string")).alias("principal_id"), kind.alias("type"), name.alias("name"), F.lit(None).cast("string").alias("email"), F.concat(F.lit("i:0#.f|membership|C"), key.cast("string"), F.lit("@X.org")).alias("login"))
    mappings = customer.where("c_custkey % 20 = 0").select(F.concat(F.lit("p"), key.cast("string")).alias("principal_id"), F.lit("t").alias("target"))
    people = customer.select(key.alias("user_id"), F.concat(F.lit("c"), key.cast("string"), F.lit("@x.org")).alias("email"), (key % 3 == 0).alias("active"))
    departments = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("department_id"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("name"))
    return a.resolved(who, mappings, people, departments).select("principal_id", "type", "status")


@query("a5_restricted", """
WITH s AS (SELECT l_orderkey AS article_id, list(DISTINCT l_linenumber) AS d0, list(DISTINCT l_suppkey % 7) AS d1, list(DISTINCT l_suppkey) AS u0, list(DISTINCT l_suppkey - l_suppkey % 2) AS u1, list(DISTINCT l_partkey % 10) AS n0 FROM lineitem GROUP BY 1)
SELECT article_id, list_sort(list_intersect(d0, d1)) AS departments, list_sort(list_filter(list_intersect(u0, u1), lambda u: NOT list_contains(list_concat(n0, [4]), u))) AS users, list_sort(list_distinct(list_concat(n0, [4]))) AS denied,
  CASE WHEN len(list_intersect(d0, d1)) > 0 THEN 'department' ELSE 'users' END AS visibility FROM s""")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("article_id"))
    four = F.array(F.lit(4).cast("long"))
    internal = line.agg(F.collect_set(F.col("l_linenumber").cast("long")).alias("departments"), F.collect_set("l_suppkey").alias("users"), F.collect_set(F.col("l_partkey") % 10).alias("denied"))
    provider = line.agg(F.collect_set(F.col("l_suppkey") % 7).alias("departments"), F.collect_set(F.col("l_suppkey") - F.col("l_suppkey") % 2).alias("users"), F.first(four).alias("denied"))
    return a.restricted(internal, provider)


@query("a6_permission_fingerprints", f"""
WITH {PRINCIPALS}, l AS (SELECT document_id, sha256(string_agg(type || '|' || id || '|' || roles, chr(10) ORDER BY type || '|' || id || '|' || roles)) AS fingerprint FROM principals GROUP BY 1)
SELECT document_id, fingerprint, document_id % 3 <> 0 AS changed FROM l""")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = a.principals(permission_json(spark, sf_dir))
    none = spark.createDataFrame([], "document_id long, fingerprint string")
    old = a.permission_fingerprints(found, none).where("document_id % 6 <> 1").select("document_id", F.when(F.col("document_id") % 3 == 0, F.col("fingerprint")).otherwise("old").alias("fingerprint"))
    return a.permission_fingerprints(found, old)


@query("a7_propagate", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 THEN 'moved' ELSE l_returnflag END AS dept, CASE WHEN l_orderkey % 8 = 0 THEN 'secret' ELSE l_linestatus END AS sensitivity FROM lineitem""")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), "l_linenumber", F.col("l_returnflag").alias("dept"), F.col("l_linestatus").alias("sensitivity"))
    changed = chunks.where("article_id % 4 = 0").select("article_id").distinct().select("article_id", F.lit("moved").alias("dept"), F.when(F.col("article_id") % 8 == 0, "secret").alias("sensitivity"))
    return a.propagate(chunks, changed, ("dept", "sensitivity")).withColumnRenamed("article_id", "l_orderkey")


@query("a8_suggest_departments")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("group_id"), F.concat("p_type", F.lit(" "), "p_brand", F.lit(" Members")).alias("name"))
    departments = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("department_id"))
    return a.suggest_departments(groups, departments, 0.62, -(-groups.count() // a.NAMES), -(-departments.count() // a.DEPARTMENTS))


@query("a9_visible_citations", f"WITH {ALLOWED} SELECT user_id, article_id * 10 AS chunk_id FROM allowed")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs as citations; those that may not be seen go."""
    chunks = articles(spark, sf_dir).select((F.col("article_id") * 10).alias("chunk_id"), "article_id")
    cited = asked(spark, sf_dir).select("user_id", (F.col("article_id") * 10).alias("chunk_id"))
    return a.visible_citations(cited, chunks, allowed(spark, sf_dir))


@query("a10_leaks", f"""
WITH {ALLOWED}, c AS (SELECT o_orderkey AS answer_id, o_custkey + o_orderkey % 40 AS user_id, o_orderkey AS article_id FROM orders UNION ALL SELECT l_orderkey, l_suppkey * 10, l_orderkey FROM lineitem WHERE l_linenumber = 1)
SELECT answer_id, user_id, list_sort(list(DISTINCT article_id * 10)) AS leaked FROM c WHERE (user_id, article_id) NOT IN (SELECT user_id, article_id FROM allowed) GROUP BY 1, 2""")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer to a customer about another's order cites it, and so does one to whoever is denied its first line."""
    orders, denied = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    one = orders.select(F.col("o_orderkey").alias("answer_id"), (F.col("o_custkey") + F.col("o_orderkey") % 40).alias("user_id"), F.array(F.col("o_orderkey") * 10).alias("cited"))
    two = denied.select(F.col("l_orderkey").alias("answer_id"), (F.col("l_suppkey") * 10).alias("user_id"), F.array(F.col("l_orderkey") * 10).alias("cited"))
    chunks = articles(spark, sf_dir).select((F.col("article_id") * 10).alias("chunk_id"), "article_id")
    return a.leaks(one.union(two), chunks, allowed(spark, sf_dir))
