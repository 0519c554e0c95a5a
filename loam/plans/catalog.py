"""Content reports on ``documents``, ``orders``, ``part``, ``events``, ``labels`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import catalog as c
from loam.plans.registry import query
from loam.plans.telemetry import REQUESTS, USAGE, requests, usage
from loam.sources.tables import table

NOW = "1998-06-01 00:00:00"


@query("g1_grouped_counts", """
WITH g AS (SELECT CASE WHEN grouping(p_brand) = 0 THEN 'p_brand' WHEN grouping(p_type) = 0 THEN 'p_type' WHEN grouping(p_size) = 0 THEN 'p_size' END AS dimension,
  coalesce(p_brand, p_type, CAST(p_size AS VARCHAR)) AS key, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size))),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS r, count(*) OVER (PARTITION BY dimension) AS c FROM g)
SELECT dimension, CASE WHEN c > 20 AND r > 19 THEN '__other__' ELSE key END AS key, (SELECT count(*) FROM part) AS total, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.grouped_counts(table(spark, sf_dir, "part"), ("p_brand", "p_type", "p_size"), 20)


@query("g2_per_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.per_month(table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "created_at"))


@query("g3_source_formats", """
SELECT CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpg' WHEN 2 THEN CASE WHEN page_id % 3 = 0 THEN 'csv' ELSE '' END ELSE 'html' END AS format, count(*) AS n,
  CAST(sum(greatest(coalesce(CASE WHEN page_id % 6 = 0 THEN NULL ELSE page_id % 5 - 1 END, 0), 0)) AS BIGINT) AS pages FROM pages GROUP BY 1""")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "pages").selectExpr("CASE page_id % 4 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.jpeg' WHEN 2 THEN 'noext' ELSE ' c.htm ' END AS filename", "CASE WHEN page_id % 3 = 0 THEN 'text/csv; charset=utf-8' ELSE 'x/y' END AS mime_type", "CASE WHEN page_id % 6 = 0 THEN NULL ELSE page_id % 5 - 1 END AS pages")
    return c.source_formats(sources)


@query("g4_browse_tree", """
WITH t AS (SELECT l_orderkey AS article_id, l_returnflag || l_linestatus AS tag FROM lineitem WHERE l_linenumber > 3)
SELECT 'department' AS level, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'topic', tag, count(DISTINCT article_id) FROM t WHERE article_id IN (SELECT o_orderkey FROM orders) GROUP BY 2
UNION ALL SELECT 'topic', 'General knowledge', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT article_id FROM t)""")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_orderpriority").alias("dept"))
    return c.browse_tree(articles, table(spark, sf_dir, "lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("article_id"), F.concat("l_returnflag", "l_linestatus").alias("tag")))


def order_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("article_id"), F.when(F.col("o_orderkey") % 6 == 0, "lesson").otherwise("document").alias("type"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("owner_id"),
        F.col("o_orderdate").alias("next_review"), F.col("o_orderpriority").alias("dept"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("closed").alias("status"), F.col("o_orderdate").alias("created_at"),
    )


@query("g5_home_summary", f"""
SELECT count(*) AS articles, count(*) FILTER (o_orderkey % 6 = 0) AS lessons, count(*) FILTER (o_custkey % 4 <> 0) AS owned, count(*) FILTER (o_orderdate < TIMESTAMP '{NOW}') AS overdue, count(DISTINCT o_orderpriority) AS departments,
  count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 3 DAY) AS overdue_drafts, (SELECT count(*) FROM labels WHERE quality = 0) AS open_gaps,
  round_even(count(*) FILTER (o_custkey % 4 <> 0) / count(*) * 100, 1) AS owned_percent FROM orders""")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = order_articles(spark, sf_dir)
    gaps = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 0, "open").otherwise("closed").alias("status"))
    return c.home_summary(articles, articles, gaps, F.lit(NOW).cast("timestamp_ntz"))


@query("g6_health", f"""
WITH {REQUESTS}, {USAGE} SELECT round_even(o.owned / o.n * 100, 2) AS owned, round_even(o.overdue / o.n * 100, 2) AS overdue, round_even(l.good / l.n * 100, 2) AS helpful, round_even(s.miss / s.n * 100, 2) AS search_miss,
  round_even(u.hit / u.n * 100, 2) AS cache_hit, round_even(r.err / r.n * 100, 2) AS error_rate, round(r.p95, 6) AS p95_ms, u.tokens
FROM (SELECT count(*) AS n, count(*) FILTER (o_custkey % 4 <> 0) AS owned, count(*) FILTER (o_orderdate < TIMESTAMP '{NOW}') AS overdue FROM orders) o, (SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good FROM labels) l,
  (SELECT count(*) AS n, count(*) FILTER (turn % 3 = 0) AS miss FROM conversations) s, (SELECT count(*) AS n, count(*) FILTER (cache_hit) AS hit, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM usage) u,
  (SELECT count(*) AS n, count(*) FILTER (status_code >= 500) AS err, quantile_cont(duration_ms, 0.95) AS p95 FROM requests) r""")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("helpful"))
    searches = table(spark, sf_dir, "conversations").select((F.col("turn") % 3).alias("results"))
    found = c.health(order_articles(spark, sf_dir), votes, searches, usage(spark, sf_dir), requests(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))
    return found.withColumn("p95_ms", F.round("p95_ms", 6))


@query("g7_gap_demand", "SELECT o_orderpriority AS dept, count(*) AS gaps, CAST(sum(o_custkey % 9) AS BIGINT) AS demand FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dept"), (F.col("o_custkey") % 9).alias("count"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    return c.gap_demand(gaps)


@query("g7_never_cited", """
SELECT o_orderkey AS article_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE (l_orderkey * 10 + l_linenumber) IN (SELECT event_id FROM events WHERE event_id % 4 <> 0 UNION SELECT event_id + 1 FROM events WHERE event_id % 4 <> 0))""")
def g7_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"))
    chunks = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("article_id"))
    ids = F.format_string("[%d, %d]", F.col("event_id"), F.col("event_id") + 1)
    return c.never_cited(articles, chunks, table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 4 == 0, "{bad").otherwise(ids).alias("chunk_ids")))


@query("g8_votes", """
WITH v AS (SELECT user_id % 20 AS article_id, user_id, arg_max(value > 50, (ts, event_id)) AS helpful FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)
SELECT article_id, count(*) FILTER (helpful) AS helpful, count(*) FILTER (NOT helpful) AS unhelpful, round_even(avg(CAST(helpful AS INTEGER)) * 100, 2) AS rate FROM v GROUP BY 1""")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "events").where("event_type in ('click', 'view')").select((F.col("user_id") % 20).alias("article_id"), "user_id", (F.col("value") > 50).alias("helpful"), F.col("ts").alias("created_at"), F.col("event_id").alias("vote_id"))
    return c.votes_per_article(votes)


@query("g9_source_breakdown", """
WITH d AS (SELECT l_suppkey AS connector_id, count(*) FILTER (l_returnflag <> 'R') AS live, count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 10) AS published, count(*) FILTER (l_returnflag = 'Q') AS held FROM lineitem GROUP BY 1),
p AS (SELECT o_custkey % 50 AS connector_id, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderstatus = 'O') AS rejected FROM orders GROUP BY 1)
SELECT d.*, coalesce(pending, 0) AS pending, coalesce(approved, 0) AS approved, coalesce(rejected, 0) AS rejected FROM d LEFT JOIN p USING (connector_id)""")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("connector_id"), F.when(F.col("l_returnflag") == "R", "deleted").when(F.col("l_returnflag") == "Q", "quarantined").otherwise("active").alias("state"), (F.col("l_quantity") > 10).alias("published"))
    drafts = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("connector_id"), F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("status"))
    return c.source_breakdown(documents, drafts)


@query("g33_index_status", "SELECT o_orderstatus AS index_status, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2) GROUP BY 1")
def g33(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_orderstatus").alias("index_status"))
    return c.index_status(articles, table(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("article_id")))


@query("g33_reprocess_progress", "SELECT o_custkey % 40 AS batch_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, round_even(count(*) FILTER (o_orderstatus IN ('F', 'P')) / count(*) * 100, 2) AS done_percent FROM orders GROUP BY 1")
def g33_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.reprocess_progress(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("queued").alias("status")))


WORDS = lambda x: f"list_distinct(regexp_extract_all(replace(strip_accents(lower({x})), 'đ', 'd'), '[\\p{{L}}\\p{{N}}_''-]+'))"
CASES = f"""w AS (SELECT conv_id * 100 + turn AS id, {WORDS('text')} AS a, {WORDS("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS e, {WORDS("text || coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS c, conv_id, turn FROM conversations),
s AS (SELECT id, CASE WHEN turn = 0 THEN 1.0 ELSE len(list_intersect([conv_id, turn], [turn, turn + 1])) / 2 END AS recall, CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(c, a)) / len(a) END AS faithfulness,
  CASE WHEN len(e) = 0 THEN 1.0 ELSE len(list_intersect(a, e)) / len(e) END AS correctness FROM w)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    expected = F.when(F.col("turn") == 0, F.array().cast("array<bigint>")).otherwise(F.array("turn", F.col("turn") + 1))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("answer"), F.coalesce(F.lag("text").over(order), F.lit("")).alias("expected_answer"),
        F.concat("text", F.coalesce(F.lead("text").over(order), F.lit(""))).alias("context"), F.array("conv_id", "turn").alias("retrieved"), expected.alias("expected"),
    )


@query("g17_evaluation_scores", f"WITH {CASES} SELECT id, round(recall, 9) AS recall, round(faithfulness, 9) AS faithfulness, round(correctness, 9) AS correctness FROM s")
def g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = c.evaluation_scores(cases(spark, sf_dir))
    return found.select("id", *(F.round(x, 9).alias(x) for x in ("recall", "faithfulness", "correctness")))


@query("g17_evaluation_gate", f"""
WITH {CASES} SELECT round(avg(recall), 6) AS recall, round(avg(faithfulness), 6) AS faithfulness, round(avg(correctness), 6) AS correctness, count(*) AS cases,
  CASE WHEN avg(recall) >= 0.8 AND avg(faithfulness) >= 0.8 AND avg(correctness) >= 0.8 THEN 'GO' ELSE 'NO-GO' END AS verdict FROM s""")
def g17_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = c.evaluation_gate(c.evaluation_scores(cases(spark, sf_dir)))
    return found.withColumns({x: F.round(x, 6) for x in ("recall", "faithfulness", "correctness")})


def string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a table of strings: flag, quantity and price, every fifth price not reported."""
    price = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 5 == 0, "not reported").otherwise(F.format_number("l_extendedprice", 2))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.array(F.col("l_returnflag"), F.format_string("%d", F.col("l_quantity").cast("long")), price).alias("r"))
    each = rows.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "r"))).alias("l"))
    return each.select("table_id", F.array(F.lit("Flag"), F.lit("Quantity"), F.lit("Price")).alias("columns"), F.transform("l", lambda x: x["r"]).alias("rows"))


@query("g18_table_aggregates", """
WITH c AS (SELECT l_orderkey AS table_id, 'Quantity' AS "column", floor(l_quantity) AS v FROM lineitem UNION ALL SELECT l_orderkey, 'Price', CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN NULL ELSE round(l_extendedprice, 2) END FROM lineitem UNION ALL SELECT l_orderkey, 'Flag', NULL FROM lineitem)
SELECT table_id, "column", count(v) AS n, count(*) FILTER (v IS NULL) AS skipped, round(sum(v), 2) AS sum, round(avg(v), 6) AS average, round(median(v), 6) AS median, min(v) AS low, max(v) AS high FROM c GROUP BY 1, 2""")
def g18(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = c.table_aggregates(c.table_numbers(string_tables(spark, sf_dir)))
    return found.withColumns({"sum": F.round("sum", 2), "average": F.round("average", 6), "median": F.round("median", 6)})


@query("g18_table_plans", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS i, CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN NULL ELSE round(l_extendedprice, 2) END AS p FROM lineitem)
SELECT l_orderkey AS plan_id, CASE l_orderkey % 3 WHEN 0 THEN 'sum' WHEN 1 THEN 'difference' ELSE 'max' END AS operation, CASE WHEN l_orderkey % 3 = 2 THEN count(p) FILTER (l_returnflag = 'A') ELSE count(p) END AS n,
  round(CASE l_orderkey % 3 WHEN 0 THEN sum(p) WHEN 1 THEN max(p) FILTER (i = 1) - max(p) FILTER (i = 0) ELSE max(p) FILTER (l_returnflag = 'A') END, 2) AS result FROM l GROUP BY l_orderkey""")
def g18_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = string_tables(spark, sf_dir)
    key = F.col("table_id")
    plans = tables.select(
        key.alias("plan_id"), "table_id", F.when(key % 3 == 0, "sum").when(key % 3 == 1, "difference").otherwise("max").alias("operation"), F.lit("Price").alias("column"), F.when(key % 3 == 2, "Flag").alias("filter_column"),
        F.when(key % 3 == 2, "a").alias("filter_value"), F.when(key % 3 == 1, 0).alias("left_row"), F.when(key % 3 == 1, 1).alias("right_row"),
    )
    return c.table_plans(plans, tables).withColumn("result", F.round("result", 2))


@query("g3_evidence_kinds", "SELECT CASE WHEN l_quantity > 25 THEN 'table' WHEN l_quantity > 10 THEN 'figure' ELSE 'page_visual' END AS kind, count(*) AS n, count(DISTINCT l_orderkey) AS articles FROM lineitem GROUP BY 1")
def g3_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_quantity") > 25, "table").when(F.col("l_quantity") > 10, "figure").otherwise("page_visual")
    return c.evidence_kinds(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), kind.alias("kind")))


@query("g3_recent_documents", """
WITH n AS (SELECT o_orderkey AS article_id, o_orderdate AS created_at FROM orders ORDER BY 2 DESC, 1 LIMIT 10)
SELECT article_id, created_at, CAST(coalesce((SELECT sum(l_linenumber) FROM lineitem WHERE l_orderkey = article_id), 0) AS BIGINT) AS pages FROM n""")
def g3_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("pages"))
    return c.recent_documents(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_orderdate").alias("created_at")), sources)


@query("g9_source_health", """
WITH r AS (SELECT o_custkey % 50 AS connector_id, count(*) AS active_requests FROM orders WHERE o_orderstatus IN ('P', 'O') GROUP BY 1), n AS (SELECT user_id % 60 AS connector_id, count(*) AS notifications FROM events WHERE ts >= TIMESTAMP '2024-01-19' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT coalesce(r.connector_id, n.connector_id) AS connector_id, coalesce(active_requests, 0) AS active_requests, coalesce(notifications, 0) AS notifications FROM r FULL JOIN n ON r.connector_id = n.connector_id""")
def g9_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("connector_id"), F.when(F.col("o_orderstatus") == "P", "queued").when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    notes = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("connector_id"), F.col("ts").alias("received_at"))
    return c.source_health(asked, notes, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query("g9_item_errors", "SELECT event_id AS error_id, user_id AS external_id, p_name AS name FROM events LEFT JOIN part ON p_partkey = user_id WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25")
def g9_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("user_id").alias("external_id"), F.col("ts").alias("at"), F.col("props").alias("message"))
    return c.item_errors(errors, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("external_id"), F.col("p_name").alias("name"))).select("error_id", "external_id", "name")
