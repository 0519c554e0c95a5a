"""Counts and reports on content, sources, feedback, evaluation and string tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import file_format, fold, parse_decimal, tokens
from loam.operators.telemetry import percentiles

OTHER = "__other__"


def grouped_counts(articles: DataFrame, columns: tuple[str, ...], most: int = 30) -> DataFrame:
    """(dimension, key, n, total): counts by each of ``columns`` in one pass of grouping sets, with the exact total; of
    more than ``most`` groups the tail is folded into one."""
    view = articles.select(*(F.col(c).cast("string").alias(c) for c in columns))
    counts = view.groupingSets([[F.col(c)] for c in columns] + [[]], *(F.col(c) for c in columns)).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    width = len(columns)
    dimension, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        own = (1 << width) - 1 - (1 << (width - 1 - i))
        dimension, key = F.when(F.col("g") == own, c).otherwise(dimension), F.when(F.col("g") == own, F.col(c)).otherwise(key)
    named = counts.select(dimension.alias("dimension"), F.coalesce(key, F.lit("")).alias("key"), "n")
    total = named.where("dimension is null").select(F.col("n").alias("total"))
    groups = named.where("dimension is not null").join(F.broadcast(total))  # one row
    order, whole = Window.partitionBy("dimension").orderBy(F.desc("n"), "key"), Window.partitionBy("dimension")
    ranked = groups.withColumn("r", F.row_number().over(order)).withColumn("c", F.count("*").over(whole))
    folded = F.when((F.col("c") > most) & ((F.col("r") > most - 1) | (F.col("key") == OTHER)), OTHER).otherwise(F.col("key"))
    return ranked.groupBy("dimension", folded.alias("key"), "total").agg(F.sum("n").alias("n"))


def per_month(articles: DataFrame, most: int = 12) -> DataFrame:
    """(month, n): the latest months with articles (created_at)."""
    months = articles.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return months.orderBy(F.desc("month")).limit(most)


def source_formats(sources: DataFrame) -> DataFrame:
    """(format, n, pages) of sources (filename, mime_type, pages); negative and null page counts count nothing."""
    named = sources.withColumn("format", file_format(F.col("filename"), F.col("mime_type")))
    return named.groupBy("format").agg(F.count("*").alias("n"), F.sum(F.greatest(F.coalesce("pages", F.lit(0)), F.lit(0))).alias("pages"))


def evidence_kinds(evidence: DataFrame) -> DataFrame:
    """(kind, n, articles) of evidence (article_id, kind)."""
    return evidence.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("article_id").alias("articles"))


def recent_documents(articles: DataFrame, sources: DataFrame, most: int = 10) -> DataFrame:
    """The newest articles (article_id, created_at) with the pages of all their sources (article_id, pages); 0 without any."""
    newest = articles.orderBy(F.desc("created_at"), "article_id").limit(most)
    pages = sources.groupBy("article_id").agg(F.sum(F.greatest(F.coalesce("pages", F.lit(0)), F.lit(0))).alias("pages"))
    return newest.join(pages, "article_id", "left").select("article_id", "created_at", F.coalesce("pages", F.lit(0)).alias("pages"))


def browse_tree(articles: DataFrame, tags: DataFrame) -> DataFrame:
    """(level, key, n): articles by department, distinct articles by topic, and the untagged rest as General knowledge."""
    departments = articles.groupBy(F.col("dept").cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit("department").alias("level"), "key", "n")
    tagged = tags.join(articles.select("article_id"), "article_id", "left_semi")
    topics = tagged.groupBy(F.col("tag").cast("string").alias("key")).agg(F.count_distinct("article_id").alias("n")).select(F.lit("topic").alias("level"), "key", "n")
    rest = articles.join(tags.select("article_id").distinct(), "article_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("topic").alias("level"), F.lit("General knowledge").alias("key"), "n")
    return departments.union(topics).union(rest)


def home_summary(articles: DataFrame, drafts: DataFrame, gaps: DataFrame, now: Column, sla_days: int = 3) -> DataFrame:
    """One row of headline numbers: one conditional aggregate a table."""
    a = articles.agg(
        F.count("*").alias("articles"), F.count_if(F.col("type") == "lesson").alias("lessons"), F.count_if(F.col("owner_id").isNotNull()).alias("owned"),
        F.count_if(F.col("next_review") < now).alias("overdue"), F.count_distinct("dept").alias("departments"),
    )
    late = F.col("created_at") < now - F.expr(f"INTERVAL {sla_days} DAYS")
    d = drafts.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if((F.col("status") == "pending") & late).alias("overdue_drafts"))
    g = gaps.agg(F.count_if(F.col("status") == "open").alias("open_gaps"))
    one = a.join(d).join(g)  # one row each
    return one.withColumn("owned_percent", F.when(F.col("articles") > 0, F.bround(F.col("owned") / F.col("articles") * 100, 1)).otherwise(0.0))


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, F.bround(part / whole * 100, 2)).otherwise(F.lit(empty))


def health(articles: DataFrame, votes: DataFrame, searches: DataFrame, usage: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """One row: owned, overdue, helpful (100 without votes), search-miss, cache-hit and error percentages, p95, tokens."""
    a = articles.agg(F.count("*").alias("n"), F.count_if(F.col("owner_id").isNotNull()).alias("o"), F.count_if(F.col("next_review") < now).alias("d"))
    v = votes.agg(F.count("*").alias("vn"), F.count_if(F.col("helpful")).alias("vh"))
    s = searches.agg(F.count("*").alias("sn"), F.count_if(F.col("results") == 0).alias("sm"))
    u = usage.agg(F.count("*").alias("un"), F.count_if(F.col("cache_hit")).alias("uh"), F.sum("tokens_used").alias("tokens"))
    r = requests.agg(F.count("*").alias("rn"), F.count_if(F.col("status_code") >= 500).alias("re"))
    p = percentiles(requests.withColumn("_all", F.lit(0)), ["_all"], "duration_ms", {"p95_ms": 0.95}).agg(F.max("p95_ms").alias("p95_ms"))
    one = a.join(v).join(s).join(u).join(r).join(p)  # one row each
    c = F.col
    return one.select(rate(c("o"), c("n")).alias("owned"), rate(c("d"), c("n")).alias("overdue"), rate(c("vh"), c("vn"), 100.0).alias("helpful"), rate(c("sm"), c("sn")).alias("search_miss"), rate(c("uh"), c("un")).alias("cache_hit"), rate(c("re"), c("rn")).alias("error_rate"), "p95_ms", "tokens")


def gap_demand(gaps: DataFrame) -> DataFrame:
    """(dept, gaps, demand): open gaps (dept, count, status) by department."""
    return gaps.where("status = 'open'").groupBy("dept").agg(F.count("*").alias("gaps"), F.sum("count").alias("demand"))


def never_cited(articles: DataFrame, chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Articles that no answer cites; answers (chunk_ids: JSON list), rows with bad JSON are passed over."""
    cited = answers.select(F.explode(F.from_json("chunk_ids", "array<bigint>")).alias("chunk_id")).distinct()
    return articles.join(chunks.join(cited, "chunk_id", "left_semi").select("article_id").distinct(), "article_id", "left_anti")


def votes_per_article(votes: DataFrame) -> DataFrame:
    """(article_id, helpful, unhelpful, rate): the latest vote of each user (article_id, user_id, helpful, created_at, vote_id)."""
    latest = votes.groupBy("article_id", "user_id").agg(F.max_by("helpful", F.struct("created_at", "vote_id")).alias("helpful"))
    return latest.groupBy("article_id").agg(F.count_if("helpful").alias("helpful"), F.count_if(~F.col("helpful")).alias("unhelpful"), F.bround(F.avg(F.col("helpful").cast("int")) * 100, 2).alias("rate"))


def source_breakdown(documents: DataFrame, drafts: DataFrame, states: tuple[str, ...] = ("pending", "approved", "rejected")) -> DataFrame:
    """(connector_id, live, published, held, a column for each draft state) of provider documents."""
    d = documents.groupBy("connector_id").agg(F.count_if(F.col("state") != "deleted").alias("live"), F.count_if((F.col("state") != "deleted") & F.col("published")).alias("published"), F.count_if(F.col("state") == "quarantined").alias("held"))
    p = drafts.groupBy("connector_id").pivot("status", list(states)).count()
    return d.join(p, "connector_id", "left").fillna(0, list(states))


def source_health(requests: DataFrame, notifications: DataFrame, now: Column) -> DataFrame:
    """(connector_id, active_requests, notifications): open sync requests and notifications of the last 24 hours."""
    open_ = requests.where(F.col("status").isin("queued", "running")).groupBy("connector_id").agg(F.count("*").alias("active_requests"))
    day = notifications.where((F.col("received_at") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("received_at") <= now)).groupBy("connector_id").agg(F.count("*").alias("notifications"))
    return open_.join(day, "connector_id", "full").fillna(0, ["active_requests", "notifications"])


def item_errors(errors: DataFrame, documents: DataFrame, most: int = 25) -> DataFrame:
    """The newest errors of a source's items (error_id, external_id, at, message) with the documents' names where known."""
    newest = errors.orderBy(F.desc("at"), "error_id").limit(most)
    return newest.join(documents.select("external_id", "name"), "external_id", "left")


def index_status(articles: DataFrame, allowed: DataFrame) -> DataFrame:
    """(index_status, n) over articles a user may see."""
    return articles.join(allowed.select("article_id").distinct(), "article_id", "left_semi").groupBy("index_status").agg(F.count("*").alias("n"))


def reprocess_progress(jobs: DataFrame) -> DataFrame:
    """(batch_id, total, completed, failed, done_percent) of reprocess jobs (batch_id, status)."""
    per = jobs.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return per.withColumn("done_percent", rate(F.col("completed") + F.col("failed"), F.col("total")))


def evaluation_scores(cases: DataFrame) -> DataFrame:
    """Cases (id, answer, expected_answer, context, retrieved array, expected array) with recall of expected chunks (1 if
    none is expected), faithfulness (share of answer words in the context) and correctness (share of expected words)."""
    words = lambda c: F.array_distinct(tokens(F.col(c)))
    share = lambda part, whole: F.when(F.size(whole) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(F.array_distinct(whole)))
    each = cases.withColumn("_a", words("answer")).withColumn("_e", words("expected_answer")).withColumn("_c", words("context"))
    return each.select("id", share(F.col("retrieved"), F.col("expected")).alias("recall"), share(F.col("_c"), F.col("_a")).alias("faithfulness"), share(F.col("_a"), F.col("_e")).alias("correctness"))


def evaluation_gate(scores: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: averages and GO only if all of them reach the threshold."""
    one = scores.agg(*(F.avg(c).alias(c) for c in ("recall", "faithfulness", "correctness")), F.count("*").alias("cases"))
    good = (F.col("recall") >= least) & (F.col("faithfulness") >= least) & (F.col("correctness") >= least)
    return one.withColumn("verdict", F.when(F.col("cases") == 0, "NO-GO").when(good, "GO").otherwise("NO-GO"))


def table_numbers(tables: DataFrame) -> DataFrame:
    """(table_id, row, column, cell, value): cells of string tables (table_id, columns, rows) with their decimal reading.

    A column whose every dotted number reads as grouped thousands is taken as such.
    """
    rows = tables.select("table_id", "columns", F.posexplode("rows").alias("row", "cells"))
    cells = rows.select("table_id", "row", "columns", F.posexplode("cells").alias("i", "cell"))
    named = cells.select("table_id", "row", F.get("columns", F.col("i")).alias("column"), "cell")
    dotted = F.col("cell").rlike(r"^\s*-?[0-9]{1,3}(\.[0-9]{3})+\s*$")
    numeric = F.col("cell").rlike("[0-9]") & F.contains("cell", F.lit("."))
    grouped = F.min(F.when(numeric, dotted.cast("int"))).over(Window.partitionBy("table_id", "column"))
    text = F.when((grouped == 1) & dotted, F.replace("cell", F.lit("."), F.lit(""))).otherwise(F.col("cell"))
    return named.withColumn("value", parse_decimal(text).cast("decimal(38,4)"))


def table_aggregates(numbers: DataFrame) -> DataFrame:
    """(table_id, column, n, skipped, sum, average, median, low, high) of every column."""
    v = F.col("value").cast("double")
    return numbers.groupBy("table_id", "column").agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("skipped"), F.sum("value").cast("double").alias("sum"), F.avg(v).alias("average"), F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"))


def table_plans(plans: DataFrame, tables: DataFrame) -> DataFrame:
    """Results of a batch of plans (plan_id, table_id, operation, column, filter_column, filter_value, left_row, right_row).

    Rows are those whose filter cell equals the value, folded. Comparisons take two rows by index.
    """
    numbers = table_numbers(tables)
    where = numbers.select("table_id", "row", F.col("column").alias("filter_column"), fold(F.trim("cell")).alias("_f"))
    asked = plans.withColumn("_want", fold(F.trim(F.coalesce("filter_value", F.lit("")))))
    cells = asked.join(numbers, ["table_id", "column"])
    kept = cells.where("filter_column is null").select("plan_id", "row", "value").union(
        cells.where("filter_column is not null").join(where, ["table_id", "row", "filter_column"]).where("_f = _want").select("plan_id", "row", "value"))
    sums = asked.join(kept, "plan_id", "left").groupBy("plan_id", "operation", "left_row", "right_row").agg(
        F.count("value").alias("n"), F.sum("value").alias("s"), F.avg(F.col("value").cast("double")).alias("m"), F.median(F.col("value").cast("double")).alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.max(F.when(F.col("row") == F.col("left_row"), F.col("value"))).alias("a"), F.max(F.when(F.col("row") == F.col("right_row"), F.col("value"))).alias("b"),
    )
    op = F.col("operation")
    d = lambda c: F.col(c).cast("double")
    result = F.when(op == "count", d("n")).when(op == "sum", d("s")).when(op == "average", d("m")).when(op == "median", d("d")).when(op == "min", d("lo")).when(op == "max", d("hi"))
    result = result.when(op == "difference", d("b") - d("a")).when((op == "percentage_change") & (d("a") != 0), (d("b") - d("a")) / d("a") * 100)
    return sums.select("plan_id", "operation", "n", result.alias("result"))
