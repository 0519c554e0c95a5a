"""Governance on the star schema: orders as articles and drafts, line items as versions, parts as drafts and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import governance as g
from loam.plans.registry import query
from loam.sources.tables import spread, table

NOW = "1998-06-01 00:00:00"


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query("g19_unverified_numbers", """
SELECT o_orderkey AS answer_id, CAST(o_orderkey + 100000 AS VARCHAR) || '%' AS token FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, CAST(o_orderkey + 2000000 AS VARCHAR) FROM orders WHERE o_orderkey % 5 = 0""")
def g19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figure that all sources quote has three decimals, so no key's percentage is that figure as a share."""
    key = F.col("o_orderkey")
    answers = orders(spark, sf_dir).select(key.alias("answer_id"), F.format_string("1. In 1999 it was %s%% and %s, see [C7] or 42 of 1,250.505", (key + 100000).cast("string"), (key + 2000000).cast("string")).alias("text"))
    quoted = F.concat(F.lit("about 1250.505 "), F.when(key % 3 != 0, F.concat((key + 100000).cast("string"), F.lit("% "))).otherwise(""), F.when(key % 5 != 0, (key + 2000000).cast("string")).otherwise(""))
    return g.unverified_numbers(answers, orders(spark, sf_dir).select(key.alias("answer_id"), quoted.alias("text")))


FACTS = """f AS (SELECT o_custkey % 20 AS company_domain, o_orderkey AS article_id, CASE WHEN o_orderkey % 2 = 0 THEN 'deadline' ELSE 'owner' END AS fact, 'day ' || CAST(o_orderkey % 4 AS VARCHAR) AS value FROM orders),
v AS (SELECT company_domain, fact, count(DISTINCT value) AS "values", count(*) AS articles FROM f GROUP BY 1, 2), c AS (SELECT * FROM v WHERE "values" > 1 AND NOT (company_domain = 4 AND fact = 'owner'))"""


def conflicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Notes\n"), F.when(key % 2 == 0, "Deadline").otherwise(" OWNER "), F.lit(": Day "), (key % 4).cast("string"), F.lit("\nDeadline"))
    articles = orders(spark, sf_dir).select((F.col("o_custkey") % 20).alias("company_domain"), key.alias("article_id"), text.alias("text"))
    open_facts = orders(spark, sf_dir).where("o_custkey % 20 = 4").select((F.col("o_custkey") % 20).alias("company_domain"), F.lit("owner").alias("fact")).distinct()
    return g.fact_conflicts(articles, open_facts)


@query("g20_fact_conflicts", f'WITH {FACTS} SELECT company_domain, fact, articles, "values" FROM c')
def g20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts(spark, sf_dir)[0]


@query("g20_conflict_members", f"WITH {FACTS} SELECT f.company_domain, f.fact, f.value, f.article_id FROM f JOIN c ON c.company_domain = f.company_domain AND c.fact = f.fact")
def g20_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts(spark, sf_dir)[1]


@query("g21_deciding_rule", """
WITH d AS (SELECT p_partkey AS draft_id, p_brand AS dept, CASE WHEN p_partkey % 3 = 0 THEN 'pdf' ELSE 'txt' END AS extension, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 50.0 END AS similarity, p_type AS tier FROM part),
r AS (SELECT p_partkey AS rule_id, p_size AS priority, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS dept, CASE WHEN p_partkey % 3 = 1 THEN 'pdf' END AS extension, CASE WHEN p_partkey % 5 = 0 THEN 0.5 END AS most, CASE WHEN p_partkey % 4 = 1 THEN p_type END AS tier FROM part WHERE p_partkey < 100 AND p_partkey % 7 <> 0)
SELECT draft_id, arg_min(rule_id, (priority, rule_id)) AS rule_id FROM d JOIN r ON (r.dept IS NULL OR r.dept = d.dept) AND (r.extension IS NULL OR r.extension = d.extension) AND (r.most IS NULL OR d.similarity <= r.most) AND (r.tier IS NULL OR r.tier = d.tier) GROUP BY 1""")
def g21(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    drafts = part.select(key.alias("draft_id"), F.col("p_brand").alias("dept"), F.when(key % 3 == 0, "pdf").otherwise("txt").alias("extension"), F.lit(None).cast("string").alias("connector_id"), F.when(key % 4 != 0, F.col("p_size") / 50.0).alias("similarity"), F.col("p_type").alias("risk_tier"))
    rules = part.where("p_partkey < 100").select(
        key.alias("rule_id"), (key % 7 != 0).alias("active"), F.col("p_size").alias("priority"), F.when(key % 2 == 0, F.col("p_brand")).alias("dept"), F.when(key % 3 == 1, F.array(F.lit("pdf"))).alias("extensions"),
        F.lit(None).cast("string").alias("connector_id"), F.when(key % 5 == 0, 0.5).alias("max_similarity"), F.when(key % 4 == 1, F.array("p_type")).alias("risk_tiers"),
    )
    return g.deciding_rule(drafts, rules)


@query("g22_suggest_owner", r"""
WITH s AS (SELECT p_partkey AS doc_id, unnest(list_concat(list_concat(regexp_extract_all(lower(p_name), '[\w''-]+'), regexp_extract_all(lower(p_name), '[\w''-]+')), regexp_extract_all(lower(p_type || ' ' || p_brand), '[\w''-]+'))) AS t FROM part),
a AS (SELECT doc_id, t, count(*) AS a FROM s WHERE length(t) > 2 GROUP BY 1, 2), d AS (SELECT p_partkey AS department_id, unnest(regexp_extract_all(lower(p_type || ' ' || p_name), '[\w''-]+')) AS t FROM part WHERE p_partkey < 40),
b AS (SELECT department_id, t, count(*) AS b FROM d WHERE length(t) > 2 GROUP BY 1, 2)
SELECT doc_id, 0 AS section, department_id, CAST(sum(least(a, b)) AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sum(least(a, b)) DESC, department_id) AS INTEGER) AS rank FROM a JOIN b USING (t) GROUP BY 1, 3 QUALIFY rank <= 3""")
def g22(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sections = part.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("section"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("body"))
    departments = part.where("p_partkey < 40").select(F.col("p_partkey").alias("department_id"), F.col("p_type").alias("name"), F.col("p_name").alias("description"))
    return g.suggest_owner(sections, departments)


@query("g22_merged_sections", """
WITH s AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS doc_id, l_linenumber AS section, l_returnflag AS owner, l_linenumber % 4 = 0 AS hollow FROM lineitem ORDER BY l_orderkey, l_linenumber, l_returnflag),
o AS (SELECT *, coalesce(last_value(CASE WHEN NOT hollow THEN owner END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section), first_value(CASE WHEN NOT hollow THEN owner END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'propose') AS o FROM s),
p AS (SELECT *, CASE WHEN lag(o) OVER (PARTITION BY doc_id ORDER BY section) = o THEN 0 ELSE 1 END AS st FROM o), q AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY section) AS part FROM p)
SELECT doc_id, CAST(part AS BIGINT) AS part, o AS owner, min(section) AS first, max(section) AS last FROM q GROUP BY 1, 2, 3""")
def g22_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("section")).agg(F.min("l_returnflag").alias("owner"))
    return g.merged_sections(sections.withColumn("hollow", F.col("section") % 4 == 0))


@query("g23_digest_plan", """
WITH a AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 10 = 0 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'retry' WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'generate' WHEN doc_id % 5 = 1 THEN 'embed' ELSE 'current' END AS action FROM documents)
SELECT action, count(*) AS articles, CAST(sum(CASE WHEN action IN ('generate', 'retry') THEN ceil(least(n_chars, 12000) / 4.0) ELSE 0 END) AS BIGINT) AS tokens FROM a GROUP BY 1""")
def g23(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    articles = docs.select(key.alias("article_id"), F.sha2("text", 256).alias("body_hash"), F.when(key % 10 == 0, "restricted").otherwise("internal").alias("sensitivity"), "n_chars")
    digests = docs.where("doc_id % 4 <> 0 or doc_id % 7 = 0").select(key.alias("article_id"), F.when(key % 3 == 0, "old").otherwise(F.sha2("text", 256)).alias("body_hash"), F.when(key % 5 == 1, "v0").otherwise("v1").alias("embedding_version"), F.when(key % 7 == 0, "failed").otherwise("ready").alias("status"))
    return g.digest_plan(articles, digests, "v1")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("version")).agg(F.max("l_shipdate").alias("created_at"))


VERSIONS = "v AS (SELECT l_orderkey AS article_id, l_linenumber AS version, max(l_shipdate) AS created_at FROM lineitem GROUP BY 1, 2)"


@query("g24_recent_changes", f"""
WITH {VERSIONS} SELECT article_id, max(version) FILTER (created_at >= TIMESTAMP '{NOW}') AS latest, count(*) FILTER (created_at >= TIMESTAMP '{NOW}') AS changes, max(created_at) FILTER (created_at >= TIMESTAMP '{NOW}') AS changed_at,
  max(version) FILTER (created_at < TIMESTAMP '{NOW}') AS baseline, CASE WHEN count(*) FILTER (created_at < TIMESTAMP '{NOW}') = 0 THEN 'new' ELSE 'updated' END AS kind FROM v GROUP BY 1 HAVING changes > 0 ORDER BY changed_at DESC, article_id LIMIT 50""")
def g24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.recent_changes(versions(spark, sf_dir), now())


@query("g25_version_pairs", f"WITH {VERSIONS} SELECT article_id, version, lag(version) OVER (PARTITION BY article_id ORDER BY version) AS previous FROM v QUALIFY previous IS NOT NULL")
def g25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.version_pairs(versions(spark, sf_dir))


@query("g26_line_diff")
def g26(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("article_id"), F.col("text").alias("old"), F.regexp_replace("text", r"(?m)^(\S+) (\S+)", "$2 $1").alias("new"))
    return g.line_diff(pairs)


@query("g26_snapshot_changes", """
WITH p AS (SELECT l_orderkey AS article_id, min(l_returnflag) AS r0, max(l_returnflag) AS r1, min(l_linestatus) AS s0, max(l_linestatus) AS s1, list(DISTINCT l_suppkey) FILTER (l_linenumber < 4) AS t0, list(DISTINCT l_suppkey) FILTER (l_linenumber > 1) AS t1 FROM lineitem GROUP BY 1)
SELECT article_id, list_filter([CASE WHEN r0 <> r1 THEN 'flag' END, CASE WHEN s0 <> s1 AND article_id % 2 = 0 THEN 'state' END], lambda x: x IS NOT NULL) AS fields, list_sort(list_filter(t1, lambda x: NOT list_contains(t0, x))) AS added_tags,
  list_sort(list_filter(t0, lambda x: NOT list_contains(t1, x))) AS removed_tags FROM p WHERE t0 IS NOT NULL AND t1 IS NOT NULL""")
def g26_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("article_id")).agg(
        F.min("l_returnflag").alias("old_flag"), F.max("l_returnflag").alias("new_flag"), F.min("l_linestatus").alias("s0"), F.max("l_linestatus").alias("new_state"),
        F.collect_set(F.when(line < 4, F.col("l_suppkey"))).alias("old_tags"), F.collect_set(F.when(line > 1, F.col("l_suppkey"))).alias("new_tags"),
    )
    pairs = pairs.where(F.size("old_tags") > 0).where(F.size("new_tags") > 0).withColumn("old_state", F.when(F.col("article_id") % 2 == 0, F.col("s0")))
    return g.snapshot_changes(pairs, ("flag", "state"))


@query("g27_review_due", f"SELECT o_orderkey AS article_id, 'review_due' AS event, o_orderdate AS at FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 8 <> 0 AND o_orderdate < TIMESTAMP '{NOW}'")
def g27(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = orders(spark, sf_dir).select(F.col("o_orderkey").alias("article_id"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft").alias("status"), (F.col("o_orderkey") % 8 != 0).alias("active"), F.col("o_orderdate").alias("next_review"))
    return g.review_due(articles, now())


@query("g28_escalations", f"""
WITH t AS (SELECT o_orderkey AS draft_id, unnest(list_distinct([o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 10 END])) AS user_id FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 3 DAY)
SELECT * FROM t WHERE user_id IS NOT NULL AND NOT (draft_id % 5 = 0 AND user_id % 2 = 0)""")
def g28(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    drafts = orders(spark, sf_dir).select(key.alias("draft_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("submitter_id"), F.when(key % 3 != 0, F.col("o_custkey") % 10).alias("approver_id"))
    to = orders(spark, sf_dir).select(key.alias("draft_id"), F.explode(F.array("o_custkey", F.col("o_custkey") % 10)).alias("user_id")).where("user_id % 2 = 0")
    sent = to.withColumn("created_at", F.when(F.col("draft_id") % 5 == 0, now() - F.expr("INTERVAL 2 HOURS")).otherwise(now() - F.expr("INTERVAL 2 DAYS")))
    return g.escalations(drafts, sent, now())


@query("g30_purge_plan", """
WITH a AS (SELECT o_orderkey AS article_id, o_custkey % 20 = 7 AS gone FROM orders)
SELECT 'articles' AS "table", count(*) FILTER (gone) AS rows, count(*) FILTER (NOT gone) AS kept FROM a
UNION ALL SELECT 'versions', count(*) FILTER (coalesce(gone, false)), count(*) FILTER (NOT coalesce(gone, false)) FROM lineitem LEFT JOIN a ON l_orderkey = article_id
UNION ALL SELECT 'cursors', count(*) FILTER (coalesce(gone, false)), count(*) FILTER (NOT coalesce(gone, false)) FROM events LEFT JOIN a ON event_id = article_id""")
def g30(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = orders(spark, sf_dir).select(F.col("o_orderkey").alias("article_id"), (F.col("o_custkey") % 20).alias("company_domain"))
    return g.purge_plan(F.col("company_domain") == 7, articles, {"versions": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id")), "cursors": table(spark, sf_dir, "events").select(F.col("event_id").alias("article_id"))})


@query("g34_feedback_queue", """
SELECT o_orderkey AS feedback_id, c_nationkey AS company_domain, o_orderdate AS created_at, substr(o_orderpriority, 1, 200) AS question FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def g34(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    feedback = orders(spark, sf_dir).select(key.alias("feedback_id"), key.alias("usage_id"), F.when(F.col("o_orderstatus") == "P", -1).otherwise(1).alias("rating"), F.when(key % 2 == 0, "pending").otherwise("reviewed").alias("state"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("user_id"))
    return g.feedback_queue(feedback, orders(spark, sf_dir).select(key.alias("usage_id"), F.col("o_orderpriority").alias("question")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("company_domain")))


CACHE = f"""cache AS (SELECT o_orderkey AS cache_id, o_custkey % 100 AS question_hash, o_orderpriority AS access_key, o_custkey % 3 AS owner_id, o_orderdate AS created_at, o_orderdate + INTERVAL 400 DAY AS expires_at, [o_orderkey % 500, o_custkey % 500] AS article_ids FROM orders)"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return orders(spark, sf_dir).select(F.col("o_orderkey").alias("cache_id"), (F.col("o_custkey") % 100).alias("question_hash"), F.col("o_orderpriority").alias("access_key"), (F.col("o_custkey") % 3).alias("owner_id"), day.alias("created_at"), (day + F.expr("INTERVAL 400 DAYS")).alias("expires_at"), F.array(F.col("o_orderkey") % 500, F.col("o_custkey") % 500).alias("article_ids"))


@query("g35_cached_answers", f"""
WITH {CACHE}, l AS (SELECT question_hash, access_key, owner_id, arg_max(cache_id, (created_at, cache_id)) AS cache_id FROM cache WHERE expires_at > TIMESTAMP '{NOW}' GROUP BY 1, 2, 3)
SELECT event_id AS ask_id, cache_id FROM events JOIN l ON question_hash = user_id % 100 AND access_key = '5-LOW' AND owner_id = event_id % 3""")
def g35(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("ask_id"), (F.col("user_id") % 100).alias("question_hash"), F.lit("5-LOW").alias("access_key"), (F.col("event_id") % 3).alias("owner_id"))
    return g.cached_answers(asked, cache(spark, sf_dir), now())


@query("g35_invalidated", f"WITH {CACHE} SELECT cache_id FROM cache WHERE NOT list_has_any(article_ids, (SELECT list(DISTINCT p_partkey % 500) FROM part WHERE p_size = 7))")
def g35_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "part").where("p_size = 7").select((F.col("p_partkey") % 500).alias("article_id")).distinct()
    return g.invalidated(cache(spark, sf_dir), changed).select("cache_id")


@query("g36_auto_publish", """
SELECT p_partkey AS draft_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INTEGER) AS rank FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND NOT p_type = 'ECONOMY' AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') QUALIFY rank <= 20""")
def g36(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    drafts = part.select(key.alias("draft_id"), F.col("p_brand").alias("dept"), F.when(key % 2 == 0, "pending").otherwise("done").alias("status"), (key % 3 != 0).alias("prepared"), F.when(F.col("p_type") == "ECONOMY", "high").otherwise("low").alias("risk_tier"), F.col("p_size").alias("created_at"))
    departments = part.select(F.col("p_brand").alias("dept")).distinct().withColumn("review", ~F.col("dept").isin("Brand#1", "Brand#2", "Brand#3"))
    return g.auto_publish(drafts, departments, 20).select("draft_id", "rank")


@query("g37_audit_page", """
SELECT event_id AS audit_id, user_id, event_type AS action FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND event_type = 'click' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20""")
def g37(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("audit_id"), "user_id", F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return g.audit_page(log, day("2024-01-05 00:00:00"), day("2024-01-25 00:00:00"), None, "click", 1, 20).drop("created_at")


@query("g38_publish_notices", """
SELECT DISTINCT o_orderkey AS event_id, l_suppkey AS user_id FROM orders JOIN lineitem ON l_partkey = o_orderkey % 200 WHERE l_suppkey <> o_custkey AND l_suppkey IS DISTINCT FROM CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 100 END""")
def g38(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = orders(spark, sf_dir).select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderkey") % 200).alias("article_id"), F.col("o_custkey").alias("publisher_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 100).alias("submitter_id"))
    return g.publish_notices(events, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("article_id"), F.col("l_suppkey").alias("user_id")))


@query("g39_department_references", """
WITH r AS (SELECT c_nationkey AS dept, 'users' AS t FROM customer UNION ALL SELECT s_nationkey, 'articles' FROM supplier UNION ALL SELECT CAST(p_size % 25 AS INTEGER), 'rules' FROM part)
SELECT dept, count(*) FILTER (t = 'users') AS users, count(*) FILTER (t = 'articles') AS articles, count(*) FILTER (t = 'rules') AS rules, count(*) AS total FROM r GROUP BY 1""")
def g39(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.department_references({
        "users": table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("dept")), "articles": table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("dept")), "rules": table(spark, sf_dir, "part").select((F.col("p_size") % 25).alias("dept")),
    })


@query("g40_reclassified", """
WITH a AS (SELECT o_orderkey AS article_id, o_orderpriority AS dept, o_orderstatus AS sensitivity FROM orders), l AS (SELECT l_orderkey AS article_id, arg_max(CASE WHEN l_linenumber % 2 = 0 THEN '5-LOW' ELSE '?' END, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS d, arg_max(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS s FROM lineitem GROUP BY 1),
j AS (SELECT a.article_id, CASE WHEN d = '?' THEN dept ELSE d END AS dept, s AS sensitivity, list_filter([CASE WHEN d <> '?' AND d <> dept THEN 'dept' END, CASE WHEN s <> sensitivity THEN 'sensitivity' END], lambda x: x IS NOT NULL) AS changed FROM a JOIN l USING (article_id))
SELECT *, list_contains(changed, 'dept') AS access_changed FROM j WHERE len(changed) > 0""")
def g40(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = orders(spark, sf_dir).select(F.col("o_orderkey").alias("article_id"), F.col("o_orderpriority").alias("dept"), F.col("o_orderstatus").alias("sensitivity"))
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("position"), F.when(F.col("l_linenumber") % 2 == 0, "5-LOW").alias("dept"), F.col("l_linestatus").alias("sensitivity"))
    return g.reclassified(articles, changes, ("dept", "sensitivity"), ("dept",))
