"""Versions, rules, reviews, drafts, caches and change sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.matching import changed_lines
from loam.functions.text import NUMBER, readings, tokens

# Fixed values.
FACT_LABELS = ("deadline", "effective date", "owner", "contact", "version", "limit", "budget")
HUNKS, HUNK_LINES, LINE_CHARS, MOST_LINES = 30, 12, 300, 20_000
#: Rules in a bundle, about: a draft meets a bundle at once.
RULES = 256


def unverified_numbers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, token): quantities of answers (answer_id, text) no reading of which is in a source (answer_id, text).

    Citations and list marks aren't read; years and whole numbers below 100 aren't quantities.
    """
    plain = F.regexp_replace(F.regexp_replace("text", r"\[[^\[\]]{1,240}\]", " "), r"(?m)^\s*(?:[-*]|\d{1,2}[.)])\s+", "")
    found = lambda df, text: df.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))).alias("token"))
    stated = found(answers, plain)
    bare = F.regexp_replace("token", "^-", "")
    quantity = F.col("token").rlike(r"[.,%]") | (~bare.rlike(r"^(19|20)\d{2}$") & (bare.try_cast("double") >= 100))
    stated = stated.where(quantity).withColumn("values", readings(F.col("token"))).where(F.size("values") > 0)
    known = found(sources, F.col("text")).select("answer_id", F.explode(readings(F.col("token"))).alias("value")).distinct()
    read = stated.select("answer_id", "token", F.explode(F.array_distinct(F.concat("values", F.transform("values", F.abs)))).alias("value"))
    quoted = read.join(known, ["answer_id", "value"], "left_semi").select("answer_id", "token")
    return stated.select("answer_id", "token").join(quoted.distinct(), ["answer_id", "token"], "left_anti")


def fact_conflicts(articles: DataFrame, open_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conflicts, members): labelled facts ("Deadline: ...") with different values in two articles at least; an article counts
    with its first value; facts with an open record (company_domain, fact) are passed over.

    articles (article_id, company_domain, text). conflicts: (company_domain, fact, articles, values), counts; members:
    (company_domain, fact, value, article_id), a row an article. A common label is added up in the tasks and never one array.
    """
    pattern = rf"(?im)^\s*({'|'.join(FACT_LABELS)})\s*:\s*(.+?)\s*$"
    labels = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.lower)
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
    facts = articles.select("company_domain", "article_id", F.posexplode(F.arrays_zip(labels.alias("label"), values.alias("value"))).alias("i", "f"))
    first = facts.groupBy("company_domain", "article_id", F.col("f.label").alias("fact")).agg(F.min_by(F.lower("f.value"), "i").alias("value"))
    by_value = first.groupBy("company_domain", "fact", "value").agg(F.count("*").alias("n"))
    conflicts = by_value.groupBy("company_domain", "fact").agg(F.sum("n").alias("articles"), F.count("*").alias("values")).where(F.col("values") > 1)
    conflicts = conflicts.join(open_facts, ["company_domain", "fact"], "left_anti")
    return conflicts, first.join(conflicts.select("company_domain", "fact"), ["company_domain", "fact"], "left_semi").select("company_domain", "fact", "value", "article_id")


def deciding_rule(drafts: DataFrame, rules: DataFrame) -> DataFrame:
    """(draft_id, rule_id): the first by (priority, rule_id) of the active rules in whose scope a draft lies.

    An unset filter of a rule means any; a set one on something unknown of the draft means no match. drafts (draft_id,
    dept, extension, connector_id, similarity, risk_tier), rules (rule_id, active, priority, dept, extensions array, connector_id,
    max_similarity, risk_tiers array).
    """
    r = rules.where("active").select(F.coalesce("dept", F.lit("*any*")).alias("_key"), F.struct("priority", "rule_id", "extensions", "connector_id", "max_similarity", "risk_tiers").alias("rule"))
    fits = lambda x: (
        (x["extensions"].isNull() | F.coalesce(F.array_contains(x["extensions"], F.col("extension")), F.lit(False)))
        & (x["connector_id"].isNull() | F.coalesce(x["connector_id"] == F.col("connector_id"), F.lit(False)))
        & (x["max_similarity"].isNull() | F.coalesce(F.col("similarity") <= x["max_similarity"], F.lit(False)))
        & (x["risk_tiers"].isNull() | F.coalesce(F.array_contains(x["risk_tiers"], F.col("risk_tier")), F.lit(False)))
    )
    # a draft is looked up under its department and under "any"; it meets rules in bundles and leaves each with its first, so that no
    # pairs are sorted. The drafts of a key are dealt over as many groups as there are tasks, and its rules go to each.
    groups, bundles = int(drafts.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-r.count() // RULES))
    bundled = r.groupBy("_key", F.pmod(F.xxhash64("rule.rule_id"), F.lit(bundles)).alias("_bundle")).agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    keyed = bundled.select("_key", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), "rules")
    asked = drafts.withColumn("_group", F.pmod(F.xxhash64("draft_id"), F.lit(groups)).cast("int")).withColumn("_key", F.explode(F.array_compact(F.array(F.col("dept"), F.lit("*any*")))))
    met = asked.join(keyed.hint("shuffle_hash"), ["_key", "_group"]).select("draft_id", F.get(F.filter("rules", fits), F.lit(0)).alias("b"))
    first = met.where("b is not null").select("draft_id", F.struct("b.priority", "b.rule_id").alias("b"))
    return first.groupBy("draft_id").agg(F.min("b").alias("b")).select("draft_id", "b.rule_id")


def suggest_owner(sections: DataFrame, departments: DataFrame, top: int = 3) -> DataFrame:
    """(doc_id, section, department_id, score, rank): departments by shared words of a section (title counts twice) and
    the department's name and description: the sum of the lesser counts."""
    words = sections.select("doc_id", "section", F.explode(F.concat(tokens(F.col("title")), tokens(F.col("title")), tokens(F.col("body")))).alias("t")).where(F.char_length("t") > 2).groupBy("doc_id", "section", "t").agg(F.count("*").alias("a"))
    known = departments.select("department_id", F.explode(tokens(F.concat_ws(" ", "name", "description"))).alias("t")).where(F.char_length("t") > 2).groupBy("department_id", "t").agg(F.count("*").alias("b"))
    scores = words.join(known, "t").groupBy("doc_id", "section", "department_id").agg(F.sum(F.least("a", "b")).alias("score"))
    order = Window.partitionBy("doc_id", "section").orderBy(F.desc("score"), "department_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def merged_sections(owned: DataFrame) -> DataFrame:
    """(doc_id, part, first, last, owner): neighbouring sections (doc_id, section, owner, hollow) of one owner as one part;
    a hollow section goes with the owner before it, at the start with the one after; without an owner: propose."""
    before = Window.partitionBy("doc_id").orderBy("section")
    after = before.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    solid = F.when(~F.col("hollow"), F.coalesce(F.col("owner").cast("string"), F.lit("propose")))
    carried = owned.withColumn("_o", F.coalesce(F.last(solid, ignorenulls=True).over(before), F.first(solid, ignorenulls=True).over(after), F.lit("propose")))
    starts = carried.withColumn("_s", F.coalesce((F.col("_o") != F.lag("_o").over(before)).cast("int"), F.lit(1)))
    parts = starts.withColumn("part", F.sum("_s").over(before))
    return parts.groupBy("doc_id", "part", F.col("_o").alias("owner")).agg(F.min("section").alias("first"), F.max("section").alias("last"))


def digest_plan(articles: DataFrame, digests: DataFrame, version: str, blocked: tuple[str, ...] = ("restricted",), chars_per_token: float = 4.0) -> DataFrame:
    """(action, articles, tokens): what a digest backfill would do. articles (article_id, body_hash, sensitivity, n_chars),
    digests (article_id, body_hash, embedding_version, status)."""
    joined = articles.join(digests.select("article_id", F.col("body_hash").alias("_h"), "embedding_version", F.col("status").alias("_s")), "article_id", "left")
    action = F.when(F.col("sensitivity").isin(*blocked), "skipped").when(F.col("_s") == "failed", "retry").when(~F.col("_h").eqNullSafe(F.col("body_hash")), "generate").when(~F.col("embedding_version").eqNullSafe(F.lit(version)), "embed").otherwise("current")
    tokens_ = F.when(F.col("action").isin("generate", "retry"), F.ceil(F.least("n_chars", F.lit(12_000)) / chars_per_token)).otherwise(0)
    return joined.withColumn("action", action).groupBy("action").agg(F.count("*").alias("articles"), F.sum(tokens_).alias("tokens"))


def recent_changes(versions: DataFrame, since: Column, top: int = 50) -> DataFrame:
    """(article_id, latest, changes, changed_at, baseline, kind): articles with versions (article_id, version, created_at)
    since a time, with the last version before it: one pass. Without a baseline an article is new."""
    new = F.col("created_at") >= since
    per = versions.groupBy("article_id").agg(
        F.max(F.when(new, F.col("version"))).alias("latest"), F.count_if(new).alias("changes"), F.max(F.when(new, F.col("created_at"))).alias("changed_at"), F.max(F.when(~new, F.col("version"))).alias("baseline"),
    )
    kind = F.when(F.col("baseline").isNull(), "new").otherwise("updated")
    return per.where("changes > 0").withColumn("kind", kind).orderBy(F.desc("changed_at"), "article_id").limit(top)


def version_pairs(versions: DataFrame) -> DataFrame:
    """(article_id, version, previous): every version with the one before it."""
    order = Window.partitionBy("article_id").orderBy("version")
    return versions.select("article_id", "version", F.lag("version").over(order).alias("previous")).where("previous is not null")


DIFF = "article_id long, added int, removed int, hunks array<string>, counted_only boolean"


def line_diff(pairs: DataFrame) -> DataFrame:
    """(article_id, added, removed, hunks, counted_only) of (article_id, old, new) texts. Hunks are clipped in number,
    lines and width; beyond 20 000 lines lines are only counted. A pair's alignment is sequential: a batched helper."""

    def one(old: str, new: str) -> tuple[int, int, list[str], bool]:
        a, b = old.splitlines(), new.splitlines()
        if len(a) + len(b) > MOST_LINES:
            return max(len(b) - len(a), 0), max(len(a) - len(b), 0), [], True
        added = removed = 0
        hunks: list[str] = []
        for i0, i1, j0, j1 in changed_lines(a, b):
            removed, added = removed + i1 - i0, added + j1 - j0
            lines = [f"-{x[:LINE_CHARS]}" for x in a[i0:i1][:HUNK_LINES]] + [f"+{x[:LINE_CHARS]}" for x in b[j0:j1][:HUNK_LINES]]
            if len(hunks) < HUNKS:
                hunks.append("\n".join(lines))
        return added, removed, hunks, False

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *one(a or "", b or "")) for i, a, b in zip(frame.article_id, frame.old, frame.new, strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIFF.split(", ")])

    return pairs.select("article_id", "old", "new").mapInPandas(work, DIFF)


def snapshot_changes(pairs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(article_id, fields, added_tags, removed_tags): snapshot fields (old_x, new_x) that differ; a field that the older
    snapshot lacks is no change."""
    changed = F.array_compact(F.array(*(F.when(F.col(f"old_{f}").isNotNull() & ~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields)))
    tags = lambda a, b: F.array_sort(F.array_except(a, b))
    return pairs.select("article_id", changed.alias("fields"), tags("new_tags", "old_tags").alias("added_tags"), tags("old_tags", "new_tags").alias("removed_tags"))


def review_due(articles: DataFrame, now: Column) -> DataFrame:
    """(article_id, event, at): published, active articles whose review date is past."""
    due = articles.where((F.col("status") == "published") & F.col("active") & (F.col("next_review") < now))
    return due.select("article_id", F.lit("review_due").alias("event"), F.col("next_review").alias("at"))


def escalations(drafts: DataFrame, sent: DataFrame, now: Column, sla_days: int = 3) -> DataFrame:
    """(draft_id, user_id): submitter and approver of overdue pending drafts, unless a notice (draft_id, user_id, created_at)
    to them was queued in the last 24 hours."""
    late = drafts.where((F.col("status") == "pending") & (F.col("created_at") < now - F.expr(f"INTERVAL {sla_days} DAYS")))
    to = late.select("draft_id", F.explode(F.array_distinct(F.array_compact(F.array("submitter_id", "approver_id")))).alias("user_id"))
    recent = sent.where(F.col("created_at") > now - F.expr("INTERVAL 24 HOURS")).select("draft_id", "user_id").distinct()
    return to.join(recent, ["draft_id", "user_id"], "left_anti")


def purge_plan(tenant: Column, articles: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, kept): rows that removing a tenant takes from its articles and from each table keyed by article_id."""
    gone = articles.where(tenant)
    out = articles.agg(F.count_if(tenant).alias("rows"), F.count_if(~tenant).alias("kept")).select(F.lit("articles").alias("table"), "rows", "kept")
    for name, df in children.items():
        hit = df.join(gone.select("article_id", F.lit(1).alias("_gone")), "article_id", "left").agg(F.count("_gone").alias("rows"), F.count_if(F.col("_gone").isNull()).alias("kept"))
        out = out.union(hit.select(F.lit(name).alias("table"), "rows", "kept"))
    return out


def feedback_queue(feedback: DataFrame, usage: DataFrame, users: DataFrame, state: str = "pending", top: int = 100) -> DataFrame:
    """Negative ratings with the usage and the rater's tenant, newest first, texts cut."""
    joined = feedback.where((F.col("rating") == -1) & (F.col("state") == state)).join(usage, "usage_id").join(users, "user_id")
    return joined.select("feedback_id", "company_domain", "created_at", F.substring("question", 1, 200).alias("question")).orderBy(F.desc("created_at"), "feedback_id").limit(top)


def cached_answers(asked: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """(ask_id, cache_id): the newest unexpired entry for (question_hash, access_key, owner_id)."""
    live = cache.where(F.col("expires_at") > now).groupBy("question_hash", "access_key", "owner_id").agg(F.max_by("cache_id", F.struct("created_at", "cache_id")).alias("cache_id"))
    return asked.join(live, ["question_hash", "access_key", "owner_id"]).select("ask_id", "cache_id")


def invalidated(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """Cache rows left when those that name a changed article (article_id) are gone."""
    hit = cache.select("cache_id", F.explode("article_ids").alias("article_id")).join(changed, "article_id", "left_semi").select("cache_id").distinct()
    return cache.join(hit, "cache_id", "left_anti")


def auto_publish(drafts: DataFrame, departments: DataFrame, top: int = 100) -> DataFrame:
    """Oldest pending, prepared drafts of departments without review (dept, review), none of high risk."""
    ready = drafts.where((F.col("status") == "pending") & F.col("prepared") & (F.col("risk_tier") != "high"))
    free = ready.join(departments.where(~F.col("review")).select("dept"), "dept", "left_semi")
    order = Window.partitionBy("dept").orderBy("created_at", "draft_id")
    return free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def audit_page(log: DataFrame, since: Column, until: Column, user: int | None, action: str | None, page: int, size: int) -> DataFrame:
    """One page of audit rows by user, action and time, newest first."""
    rows = log.where((F.col("created_at") >= since) & (F.col("created_at") < until))
    rows = rows.where(F.col("user_id") == user) if user is not None else rows
    rows = rows.where(F.col("action") == action) if action is not None else rows
    return rows.orderBy(F.desc("created_at"), "audit_id").offset(page * size).limit(size)


def publish_notices(events: DataFrame, followers: DataFrame) -> DataFrame:
    """(event_id, user_id): followers of a published article but for its publisher and its submitter."""
    met = events.join(followers, "article_id")
    return met.where(~F.col("user_id").eqNullSafe(F.col("publisher_id")) & ~F.col("user_id").eqNullSafe(F.col("submitter_id"))).select("event_id", "user_id").distinct()


def department_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(dept, a count for each table, total): references to departments over tables that have a dept."""
    counts = None
    for name, df in tables.items():
        own = df.groupBy("dept").agg(F.count("*").alias("n")).select("dept", F.lit(name).alias("t"), "n")
        counts = own if counts is None else counts.union(own)
    wide = counts.groupBy("dept").agg(*(F.sum(F.when(F.col("t") == name, F.col("n")).otherwise(0)).alias(name) for name in tables), F.sum("n").alias("total"))
    return wide


def reclassified(articles: DataFrame, changes: DataFrame, fields: tuple[str, ...] = ("dept", "sensitivity", "visibility", "type"), access: tuple[str, ...] = ("dept", "sensitivity", "visibility")) -> DataFrame:
    """(article_id, new fields, changed, access_changed): change sets (article_id, position, fields; null keeps) applied, the
    last one an article; only real changes stay."""
    last = changes.groupBy("article_id").agg(*(F.max_by(f, "position").alias(f"_{f}") for f in fields))
    joined = articles.join(last, "article_id")
    new = joined.withColumns({f"_{f}": F.coalesce(f"_{f}", f) for f in fields})
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields)))
    out = new.withColumn("changed", changed).where(F.size("changed") > 0).withColumn("access_changed", F.arrays_overlap("changed", F.array(*(F.lit(x) for x in access))))
    return out.select("article_id", *(F.col(f"_{f}").alias(f) for f in fields), "changed", "access_changed")
