"""Who may see what: entitlements, retrieval filters, provider permissions, changes and leaks. Denials beat all grants.

A company-wide or public rule is never expanded over all its readers but for the users asked about.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.matching import matching_characters
from loam.functions.text import department_key, emails, group_key


def entitlements(users: DataFrame, articles: DataFrame, departments: DataFrame, members: DataFrame, shares: DataFrame, permissions: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(user_id, article_id) of ``asked`` that may be read. Without ``asked`` all that the users may read: for the few users of a
    report only, as public articles are written out for each of them.

    users (user_id, company_domain, reviewer), articles (article_id, company_domain, dept, visibility, owner_id, status,
    active, governed), departments (dept, active), members (user_id, dept), shares (article_id, dept) for further
    departments, permissions (article_id, user_id, effect, source). Of an active article in an active department: a
    member's department, public articles of the tenant, the owner, or an explicit allow; visibility ``users`` by allow or
    owner only; governed articles also need a source allow or a shared department; unpublished ones a reviewer or the owner.
    """
    live = articles.where("active").join(departments.where("active").select("dept"), "dept", "left_semi").alias("a")
    person = users.select("user_id", "company_domain", "reviewer")
    mine = live.select("article_id", "dept").union(shares.join(live.select("article_id"), "article_id", "left_semi").select("article_id", "dept"))
    open_ = live.where("visibility <> 'users'")
    public = open_.where("visibility = 'public'").select("article_id", "company_domain")
    owned = live.select(F.col("owner_id").alias("user_id"), "article_id")
    allowed = permissions.where("effect = 'allow'").join(live.select("article_id"), "article_id", "left_semi").select("user_id", "article_id")
    pair = ["user_id", "article_id"]
    if asked is None:
        by_dept = members.join(mine, "dept").join(open_.select("article_id"), "article_id", "left_semi").select(*pair)
        public = person.join(public, "company_domain").select(*pair)
    else:  # every pair is looked up by its article, its user, or both
        asked = asked.select(*pair).distinct()
        by_dept = asked.join(open_.select("article_id"), "article_id", "left_semi").join(mine, "article_id").join(members, ["user_id", "dept"], "left_semi").select(*pair)
        public = asked.join(public, "article_id").join(person, ["user_id", "company_domain"], "left_semi").select(*pair)
        owned, allowed = asked.join(owned, pair, "left_semi"), asked.join(allowed, pair, "left_semi")
    paths = by_dept.union(public).union(owned).union(allowed).distinct()
    paths = paths.join(permissions.where("effect = 'deny'").select("user_id", "article_id"), ["user_id", "article_id"], "left_anti")
    facts = live.select("article_id", "company_domain", "owner_id", "status", "governed")
    full = paths.join(facts, "article_id").join(person, ["user_id", "company_domain"])
    full = full.where((F.col("status") == "published") | F.col("reviewer") | (F.col("owner_id") == F.col("user_id")))
    governed = full.where("governed").select(*pair)
    provider = governed.join(permissions.where("effect = 'allow' and source = 'provider'").select(*pair), pair, "left_semi")
    shared = governed.join(mine, "article_id").join(members, ["user_id", "dept"], "left_semi").select(*pair)
    return full.where(~F.col("governed")).select(*pair).union(provider.union(shared).distinct())


def retrieval_filter(chunks: DataFrame, tags: DataFrame | None = None, tag: str | None = None, since: Column | None = None, until: Column | None = None, **equal: object) -> DataFrame:
    """Chunks of published, ready articles by equal columns, a tag and a date range whose end counts."""
    rows = chunks.where((F.col("status") == "published") & (F.col("index_status") == "ready"))
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    if since is not None:
        rows = rows.where(F.col("created_at") >= since)
    if until is not None:
        rows = rows.where(F.col("created_at") <= until)
    return rows.join(tags.where(F.col("tag") == tag), "article_id", "left_semi") if tag is not None else rows


_IDENTITY = "struct<id:string,displayName:string,email:string,loginName:string>"
PERMISSION_JSON = f"array<struct<roles:array<string>,grantedToV2:struct<user:{_IDENTITY},group:{_IDENTITY},siteGroup:{_IDENTITY}>,grantedToIdentitiesV2:array<struct<user:{_IDENTITY},group:{_IDENTITY}>>,link:struct<scope:string,type:string>,invitation:struct<email:string>>>"


def principals(documents: DataFrame) -> DataFrame:
    """(document_id, type, id, name, email, login, roles): principals of permission JSON (document_id, permissions), one
    row a principal, roles united and sorted. Direct grants, groups, site groups, lists of identities, links and
    invitations; unreadable JSON has none."""
    each = documents.select("document_id", F.explode(F.from_json("permissions", PERMISSION_JSON)).alias("p"))

    def one(kind: str, who: Column) -> Column:
        key = F.coalesce(who["id"], who["email"], who["loginName"], who["displayName"])
        return F.when(key.isNotNull(), F.struct(F.lit(kind).alias("type"), key.alias("id"), who["displayName"].alias("name"), who["email"].alias("email"), who["loginName"].alias("login")))

    void = F.lit(None).cast("string")
    link = F.when(F.col("p.link").isNotNull(), F.struct(F.lit("link").alias("type"), F.coalesce("p.link.scope", F.lit("anonymous")).alias("id"), void.alias("name"), void.alias("email"), void.alias("login")))
    invited = F.when(F.col("p.invitation.email").isNotNull(), F.struct(F.lit("user").alias("type"), F.lower("p.invitation.email").alias("id"), void.alias("name"), F.lower("p.invitation.email").alias("email"), void.alias("login")))
    direct = F.array(one("user", F.col("p.grantedToV2.user")), one("group", F.col("p.grantedToV2.group")), one("site_group", F.col("p.grantedToV2.siteGroup")), link, invited)
    listed = F.coalesce("p.grantedToIdentitiesV2", F.array().cast(f"array<struct<user:{_IDENTITY},group:{_IDENTITY}>>"))
    many = F.flatten(F.transform(listed, lambda x: F.array(one("user", x["user"]), one("group", x["group"]))))
    flat = each.select("document_id", F.col("p.roles").alias("roles"), F.explode(F.array_compact(F.concat(direct, many))).alias("w"))
    grouped = flat.select("document_id", "w.*", F.explode_outer("roles").alias("role")).groupBy("document_id", "type", "id")
    return grouped.agg(F.min("name").alias("name"), F.min("email").alias("email"), F.min("login").alias("login"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


COMPANY_WIDE, IGNORED = ("everyone", "organization", "company"), ("application", "device")


def resolved(principals_: DataFrame, mappings: DataFrame, users: DataFrame, departments: DataFrame) -> DataFrame:
    """principals (principal_id, type, name, email, login) with status, method and target.

    An explicit mapping (principal_id, target); an active user's e-mail (user_id, email, active); a group whose name is
    exactly one department's (department_id, name); company-wide and ignored types. A person without an account grants
    nothing (no_account); the rest is unmapped.
    """
    mapped = mappings.select("principal_id", F.col("target").alias("_map"))
    accounts = users.where("active").select(F.lower("email").alias("_mail"), F.col("user_id").cast("string").alias("_user"))
    keys = departments.withColumn("_key", department_key(F.col("name"))).groupBy("_key").agg(F.count("*").alias("_n"), F.min("department_id").cast("string").alias("_dept")).where("_n = 1 and _key <> ''")
    each = principals_.withColumn("_key", F.when(F.col("type").isin("group", "site_group"), group_key(F.col("name"))))
    mails = each.select("principal_id", F.explode(emails(F.col("email"), F.col("login"), F.col("principal_id"), F.col("name"))).alias("_mail")).join(accounts, "_mail").groupBy("principal_id").agg(F.min("_user").alias("_user"))
    full = each.join(mapped, "principal_id", "left").join(mails, "principal_id", "left").join(keys.select("_key", "_dept"), "_key", "left")
    person = F.col("type") == "user"
    method = F.when(F.col("_map").isNotNull(), "mapping").when(F.col("type").isin(*IGNORED), "ignored").when(F.col("type").isin(*COMPANY_WIDE), "company").when(person & F.col("_user").isNotNull(), "email").when(~person & F.col("_dept").isNotNull(), "group_name")
    status = F.when(method == "mapping", "mapped").when(method == "ignored", "ignored").when(method.isNotNull(), "auto").when(person, "no_account").otherwise("unmapped")
    target = F.when(method == "mapping", F.col("_map")).when(method == "email", F.col("_user")).when(method == "group_name", F.col("_dept"))
    return full.select("principal_id", "type", status.alias("status"), method.alias("method"), target.alias("target"))


def restricted(internal: DataFrame, provider: DataFrame) -> DataFrame:
    """Per article the narrower of both sides: shared departments, shared users, united denials; (article_id, departments,
    users, denied, visibility). Both sides have (article_id, departments, users, denied) as arrays."""
    both = internal.alias("i").join(provider.alias("p"), "article_id")
    departments = F.array_sort(F.array_intersect("i.departments", "p.departments"))
    denied = F.array_sort(F.array_union("i.denied", "p.denied"))
    users = F.array_sort(F.array_except(F.array_intersect("i.users", "p.users"), F.array_union("i.denied", "p.denied")))
    visibility = F.when(F.size(departments) > 0, "department").otherwise("users")
    return both.select("article_id", departments.alias("departments"), users.alias("users"), denied.alias("denied"), visibility.alias("visibility"))


def permission_fingerprints(principals_: DataFrame, stored: DataFrame) -> DataFrame:
    """(document_id, fingerprint, changed): sha256 of a document's sorted principals against (document_id, fingerprint)."""
    entries = principals_.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", "type", "id", "roles"))), "\n").alias("l"))
    now = entries.select("document_id", F.sha2("l", 256).alias("fingerprint"))
    old = stored.select("document_id", F.col("fingerprint").alias("_old"))
    return now.join(old, "document_id", "left").select("document_id", "fingerprint", (~F.col("fingerprint").eqNullSafe(F.col("_old"))).alias("changed"))


def propagate(chunks: DataFrame, changed: DataFrame, columns: tuple[str, ...] = ("dept", "sensitivity", "visibility")) -> DataFrame:
    """Chunks with the access columns of their article where it changed; a null leaves the old value."""
    new = changed.select("article_id", *(F.col(c).alias(f"_{c}") for c in columns))
    joined = chunks.join(new, "article_id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*chunks.columns)


#: Group names in a block and departments in a part of ``suggest_departments``.
NAMES, DEPARTMENTS = 2000, 2000
SUGGESTED = "key string, dkey string, department_id long, score double"


def name_ratio(a: str, b: str) -> float:
    """Share of matching characters of two names, 0.8 at least if one holds the other."""
    ratio = 2 * matching_characters(a, b) / (len(a) + len(b))
    return max(ratio, 0.8) if a in b or b in a else ratio


def _letters(names: pd.Series) -> np.ndarray:
    return np.stack([np.bincount(np.frombuffer(n.encode(), np.uint8), minlength=256) for n in names]).astype(np.int16)


def suggest_departments(groups: DataFrame, departments: DataFrame, least: float = 0.62, blocks: int = 1, parts: int = 1) -> DataFrame:
    """(group_id, department_id, score): the closest department by name of distinct group names, from ``least`` on.

    groups (group_id, name), departments (department_id, name). Blocks of distinct group keys meet parts of distinct
    department keys. The letters two names share bound their ratio from above, and only names within the bound are compared;
    the best of each group leaves a task.
    """
    g = groups.withColumn("key", group_key(F.col("name"))).where("key <> ''")
    d = departments.withColumn("dkey", department_key(F.col("name"))).where("dkey <> ''").groupBy("dkey").agg(F.min("department_id").cast("long").alias("department_id"))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = g.select("key").distinct().withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("part", everywhere(parts))
    right = d.withColumn("part", F.pmod(F.xxhash64("dkey"), F.lit(parts)).cast("int")).withColumn("block", everywhere(blocks))

    def task(keys: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(keys) and len(names):
            own, size, dkeys = _letters(names.dkey), names.dkey.map(lambda n: len(n.encode())).to_numpy(), names.dkey.tolist()
            for key, letters in zip(keys.key, _letters(keys.key), strict=True):
                bound = 2 * np.minimum(own, letters).sum(axis=1) / (size + letters.sum())
                found = [(name_ratio(key, dkeys[i]), i) for i in np.flatnonzero((bound >= least) | [key in n or n in key for n in dkeys])]
                score, i = max(((s, i) for s, i in found if s >= least), key=lambda x: (x[0], -names.department_id.iloc[x[1]]), default=(0.0, None))
                if i is not None:
                    rows.append((key, dkeys[i], names.department_id.iloc[i], score))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SUGGESTED.split(", ")])

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(task, SUGGESTED)
    best = met.groupBy("key").agg(F.max_by(F.struct("department_id", "score"), F.struct("score", -F.col("department_id"))).alias("b"))
    return g.join(best, "key").select("group_id", "b.department_id", F.round("b.score", 6).alias("score"))


def visible_citations(cited: DataFrame, chunks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Of (user_id, chunk_id) those whose article the user may read. chunks (chunk_id, article_id)."""
    return cited.join(chunks, "chunk_id").join(allowed, ["user_id", "article_id"], "left_semi").select("user_id", "chunk_id")


def leaks(answers: DataFrame, chunks: DataFrame, allowed: DataFrame) -> DataFrame:
    """(answer_id, user_id, leaked): answers (answer_id, user_id, cited array) with cited chunks their user may not read."""
    each = answers.select("answer_id", "user_id", F.explode(F.array_distinct("cited")).alias("chunk_id")).join(chunks, "chunk_id")
    return each.join(allowed, ["user_id", "article_id"], "left_anti").groupBy("answer_id", "user_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("leaked"))
