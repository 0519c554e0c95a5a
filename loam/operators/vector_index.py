"""A stored inverted file over vectors, kept by article, and classes of near vectors over a whole table.

The file's lists belong to centres fitted on a bounded sample; every row is filed under its nearest centre. A query probes
the lists whose centres are nearest to it, all lists if asked for exact rows. Lists shorter than a part go to a task together,
a longer one is dealt over several tasks, as are many queries, and only the k best a query leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.operators.components import classes
from loam.operators.vectors import centroids, unit
from loam.sources.tables import bucket_of, cut, replace_documents, table

#: Rows that centres are fitted on at most, lists at most, rounds of fitting.
SAMPLE, LISTS, ROUNDS = 50_000, 2048, 8
#: Queries in a block, and rows in a part, of several lists or of one: one task multiplies a block by a part.
BLOCK, PART = 2048, 20_000
PROBES = 16


def fit_centres(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres (lists x width) by k-means on at most ``sample`` rows of ``vectors`` (chunk_id, vector), chosen by hash of
    the id. By default there are about as many lists as the root of the number of rows, ``LISTS`` at most."""
    known = vectors.where("vector is not null").select("chunk_id", "vector")
    lists = lists or max(1, min(LISTS, math.isqrt(known.count())))
    rows = known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").toPandas()
    if rows.empty:
        return np.zeros((0, 0))
    points = unit(rows.vector)
    centres = points[: min(lists, len(points))].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(points[at : at + 4096] @ centres.T, axis=1) for at in range(0, len(points), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def _nearest_lists(centres: np.ndarray, most: int):
    @F.pandas_udf("array<int>")
    def near(vector: pd.Series) -> pd.Series:
        products = unit(vector) @ centres.T if len(vector) else np.zeros((0, len(centres)))
        order = np.argsort(-products, axis=1, kind="stable")[:, :most]
        return pd.Series(list(order.astype(np.int32)))

    return near


def filed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` (vector ...) with list_id, the nearest centre's number; rows without a vector are left out."""
    return vectors.where("vector is not null").withColumn("list_id", _nearest_lists(centres, 1)(F.col("vector"))[0])


def build(vectors: DataFrame, path: str, lists: int | None = None, buckets: int = 64) -> None:
    """Writes the index of ``vectors`` (article_id, chunk_id, vector ...) to ``path``: its centres, and its rows by hash bucket of
    the article, in a bucket by list, so a reader of some lists skips the rest of a file."""
    spark = vectors.sparkSession
    centres = fit_centres(vectors, lists)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list_id int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres.parquet")
    rows = filed(vectors, centres).withColumn("bucket", bucket_of(F.col("article_id"), buckets))
    rows.repartition("bucket").sortWithinPartitions("bucket", "list_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """Rows and centres (at most ``LISTS``) of a stored index."""
    stored = table(spark, path, "centres").orderBy("list_id").toPandas()
    return spark.read.parquet(f"{path}/rows").drop("bucket"), np.stack(stored.centre.map(np.asarray)) if len(stored) else np.zeros((0, 0))


def update(spark: SparkSession, path: str, changed: DataFrame, buckets: int = 64) -> int:
    """Replaces all rows of the articles in ``changed`` (article_id, chunk_id, vector ...), filed under the stored centres; other
    buckets aren't touched. Returns the number of buckets written."""
    return replace_documents(spark, f"{path}/rows", filed(changed, load(spark, path)[1]), "article_id", buckets)


def _rounded_cosines(one: np.ndarray, rows: np.ndarray, places: int) -> np.ndarray:
    """Cosines of a vector and rows, half away from zero. Products are added up from the first to the last, as SQL does: a product of
    matrices adds in an order of its own, and a last digit decides a rounding."""
    dot = lambda products: np.cumsum(products, axis=-1)[..., -1]
    cosines = dot(rows * one) / np.maximum(np.sqrt(dot(rows * rows) * dot(one * one)), 1e-300)
    return np.trunc(cosines * 10**places + np.copysign(0.5, cosines)) / 10**places


def probe(queries: DataFrame, rows: DataFrame, centres: np.ndarray, k: int, most: float, probes: int | None = PROBES, by_article: bool = False, places: int | None = None) -> DataFrame:
    """(query_id, chunk_id or article_id, distance, rank): for each query the ``k`` nearest rows by cosine, at most ``most`` away.

    queries (query_id, vector), rows (chunk_id, vector, list_id). With ``scope`` in both only rows of the query's own scope count.
    ``by_article`` gives the nearest articles by their nearest row; where queries have ``article_id`` their own doesn't count.
    ``probes`` lists are looked through for each query, all of them (and so exactly the nearest rows are found) if None.
    Ranks start at 1, ties go by id. Rows and queries without a vector are left out. With ``places`` cosines are rounded to so
    many places first, and what is equal then is a tie.
    """
    target = "article_id" if by_article else "chunk_id"
    mine = F.col("article_id").cast("long") if by_article and "article_id" in queries.columns else F.lit(None).cast("long")
    scope = F.col("scope") if "scope" in queries.columns else F.lit(0).alias("scope")
    some = probes is not None and probes < len(centres)
    lists = _nearest_lists(centres, probes)(F.col("vector")) if some else F.lit(None).cast("array<int>")
    asked = cut(queries.where("vector is not null").select(scope, "query_id", mine.alias("own"), "vector", lists.alias("lists")))
    stored = rows.select(scope, F.col("list_id").alias("list"), F.col(target).alias("target"), "chunk_id", F.col("vector").alias("vector"))
    # neighbouring lists go together until they fill a part, so that a query meets a part once, whatever number of its lists lie there
    upto = Window.partitionBy("scope").orderBy("list")
    filled = F.floor((F.sum("n").over(upto) - F.col("n")) / PART).cast("int")
    sizes = stored.groupBy("scope", "list").agg(F.count("*").alias("n")).withColumn("bundle", filled).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    sizes = cut(sizes.join(asked.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "scope"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    bundles = sizes.groupBy("scope", "bundle", "blocks").agg(F.max("parts").alias("parts"), F.collect_list("list").alias("held"))
    met = asked.join(F.broadcast(bundles), "scope").where(F.arrays_overlap("lists", "held") if some else F.lit(True))  # a row a part of the lists
    left = met.select("scope", "bundle", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), every("parts").alias("part"), "query_id", "own", "vector", F.array_intersect("lists", "held").alias("lists"))
    right = stored.join(sizes, ["scope", "list"]).select("scope", "bundle", every("blocks").alias("block"), F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int").alias("part"), "list", "target", "vector")

    def task(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        queried, targets, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(one) and len(two):
            two = two.sort_values("list", kind="stable")
            b = unit(two.vector).T
            plain = np.stack([np.asarray(v, np.float64) for v in two.vector]) if places is not None else None
            held, starts = np.unique(two.list.to_numpy(), return_index=True)
            spans = list(zip(held, starts, [*starts[1:], len(two)], strict=True)) if some else [(None, 0, len(two))]
            order = np.argsort(two.target.to_numpy(), kind="stable")
            ids, firsts = np.unique(two.target.to_numpy()[order], return_index=True)
            ends = np.append(firsts[1:], len(two))
            for at in range(0, len(one), 64):
                part = one.iloc[at : at + 64]
                a = unit(part.vector)
                away = np.full((len(part), len(two)), np.inf)
                for name, start, end in spans:
                    asking = [i for i, found in enumerate(part.lists) if name is None or name in found]
                    if asking:
                        away[asking, start:end] = 1.0 - a[asking] @ b[:, start:end]
                away = np.minimum.reduceat(away[:, order], firsts, axis=1)
                for query, own, vector, row in zip(part.query_id, part.own, part.vector, away, strict=True):
                    near = np.flatnonzero(row <= most)
                    near = near[ids[near] != own] if own is not None and own == own else near
                    if len(near) > k:
                        near = near[row[near] <= np.partition(row[near], k - 1)[k - 1] + (0 if places is None else 2 * 0.1**places)]
                    if places is not None and len(near):
                        turned = _rounded_cosines(np.asarray(vector, np.float64), plain[np.concatenate([order[firsts[t] : ends[t]] for t in near])], places)
                        row[near] = 1.0 - np.maximum.reduceat(turned, np.cumsum(ends[near] - firsts[near]) - (ends[near] - firsts[near]))
                    best = near[np.lexsort((ids[near], row[near]))[:k]]
                    queried.append(np.full(len(best), query, np.int64))
                    targets.append(ids[best])
                    distances.append(row[best])
        return pd.DataFrame({"query_id": np.concatenate(queried), "target": np.concatenate(targets), "distance": np.concatenate(distances)})

    groups = ["scope", "bundle", "block", "part"]
    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(task, "query_id long, target long, distance double")
    if by_article:  # an article's rows lie in several parts, a row in one
        found = found.groupBy("query_id", "target").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "target")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("target", target)


def probes_for(rows: DataFrame, centres: np.ndarray, k: int, most: float, recall: float = 0.9, sample: int = 64) -> int:
    """How many lists a query has to probe so that ``recall`` of its ``k`` nearest rows are found: measured on ``sample`` of the
    filed rows as queries, chosen by hash, against all rows. Vectors without clusters need most lists, close ones few."""
    asked = rows.orderBy(F.xxhash64("chunk_id", F.lit(11)), "chunk_id").limit(sample).select(F.col("chunk_id").alias("query_id"), "vector")
    asked = cut(asked)
    found = probe(asked, rows, centres, k, most, None).join(rows.select("chunk_id", "list_id"), "chunk_id").select("query_id", "list_id").toPandas()  # sample x k rows at most
    if found.empty:
        return 1
    own = asked.toPandas()
    order = np.argsort(np.argsort(-(unit(own.vector) @ centres.T), axis=1, kind="stable"), axis=1)
    place = {q: i for i, q in enumerate(own.query_id)}
    needed = np.sort([order[place[q], lst] + 1 for q, lst in zip(found.query_id, found.list_id, strict=True)])
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))])


def article_links(articles: DataFrame, vectors: DataFrame, now: Column, version: str, k: int = 5, most: float = 0.45, hours: int = 24, centres: np.ndarray | None = None, probes: int | None = None) -> DataFrame:
    """(article_id, related, added): articles changed in the last ``hours`` whose list of related ones grows.

    articles (article_id, company_domain, status, lifecycle_status, updated_at, related array<long>), vectors (chunk_id, article_id,
    embedding, embedding_version). Published and active articles count, on both sides, and vectors of ``version``. The mean
    of a changed article's vectors looks for the ``k`` articles of its tenant whose nearest passage is nearest, at most
    ``most`` away; these are united with the ids already there, in order of id. ``probes`` lists are looked through, by
    default all.
    """
    live = articles.where((F.col("status") == "published") & (F.col("lifecycle_status") == "active"))
    current = vectors.where((F.col("embedding_version") == version) & F.col("embedding").isNotNull())
    changed = live.where(F.col("updated_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    means = centroids(current.join(changed.select("article_id"), "article_id", "left_semi"), "article_id")
    asked = means.join(changed.select("article_id", F.col("company_domain").alias("scope")), "article_id").select(F.col("article_id").alias("query_id"), "article_id", "scope", "vector")
    rows = current.join(live.select("article_id", F.col("company_domain").alias("scope")), "article_id").select("scope", "article_id", "chunk_id", F.col("embedding").alias("vector"))
    centres = fit_centres(rows) if centres is None else centres
    found = probe(asked, filed(rows, centres), centres, k, most, probes, by_article=True)
    new = found.groupBy(F.col("query_id").alias("article_id")).agg(F.collect_set(F.col("article_id")).alias("found"))
    old = F.coalesce("related", F.array().cast("array<long>"))
    both = changed.join(new, "article_id").select("article_id", F.array_sort(F.array_union(old, "found")).alias("related"), F.array_sort(F.array_except("found", old)).alias("added"))
    return both.where(F.size("added") > 0)


# --- near vectors of a whole table -----------------------------------------------------------------------------------
def bands_for(rows: int, similarity: float, miss: float, bucket: int) -> tuple[int, int]:
    """(bits of a band, bands): so that a bucket of random rows has about ``bucket`` of them, and two vectors just that similar
    share no band with a chance of ``miss``."""
    bits = max(4, min(30, math.ceil(math.log2(max(rows / bucket, 1)))))
    shared = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - shared))


def _forest(points: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among unit rows, as pairs of row numbers: rows reached leave the search."""
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(points))
    stack: list[int] = []
    while len(rest):
        if not stack:
            stack, rest = [int(rest[0])], rest[1:]
        one = stack.pop()
        hit = points[rest] @ points[one] >= similarity
        edges += [(one, int(x)) for x in rest[hit]]
        stack += rest[hit].tolist()
        rest = rest[~hit]
    return edges


def near_classes(vectors: DataFrame, similarity: float = 0.97, miss: float = 0.001, bucket: int = 256, block: int = 1024) -> DataFrame:
    """(id, class_id) for every row of ``vectors`` (id long, vector): rows of a cosine of ``similarity`` or more are linked, and a
    class is what links connect, named after its least id.

    Equal vectors are one from the start. The others meet where a band of random hyperplanes (fixed by seed) gives them the
    same bits; a bucket is dealt over blocks of ``block`` rows, every two of which meet in a task that gives back a spanning
    forest, so no task holds more than two blocks and never all pairs of a family leave it. Every link is an exact cosine;
    a link is missed with a chance of ``miss`` at most. Rows without a vector, or with one of zeros, stand alone.
    """
    rows = vectors.select("id", "vector")
    has = F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    members = cut(rows.where(has).select("id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")))
    named = members.groupBy("h1", "h2").agg(F.min("id").alias("lead"))
    distinct = cut(rows.join(named.select(F.col("lead").alias("id")), "id", "left_semi"))
    first = distinct.first()
    bits, bands = bands_for(distinct.count(), similarity, miss, bucket)
    planes = np.random.default_rng(97).normal(size=(len(first.vector) if first else 1, bits * bands))

    @F.pandas_udf("array<long>")
    def sides(vector: pd.Series) -> pd.Series:
        over = (unit(vector) @ planes > 0).reshape(len(vector), bands, bits) if len(vector) else np.zeros((0, bands, bits), bool)
        return pd.Series(list((over.astype(np.int64) << np.arange(bits)).sum(axis=2)))

    keyed = cut(distinct.select("id", F.posexplode(sides("vector")).alias("band", "key")))
    held = keyed.groupBy("band", "key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    dealt = keyed.join(held, ["band", "key"]).select("band", "key", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = dealt.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id").join(distinct, "id")

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame.id.to_numpy()
        edges = np.array(_forest(unit(frame.vector), similarity), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": ids[edges[:, 0]], "v": ids[edges[:, 1]]})

    edges = met.groupBy("band", "key", "i", "j").applyInPandas(task, "u long, v long").where("u <> v").distinct()
    leads = classes(distinct.select("id"), edges).withColumnRenamed("id", "lead")
    known = members.join(named, ["h1", "h2"]).join(leads, "lead").select("id", "class_id")
    return known.unionByName(rows.where(~has).select("id", F.col("id").alias("class_id")))


def representative_pairs(vectors: DataFrame, near: DataFrame) -> DataFrame:
    """(class_id, id, cosine): each member of a class of two or more with its cosine to the class's first row."""
    held = vectors.select("id", "vector")
    many = near.where("id <> class_id").select("id", "class_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = many.join(held, "id").join(held.select(F.col("id").alias("class_id"), F.col("vector").alias("first")), "class_id")
    return both.select("class_id", "id", (dot("vector", "first") / F.sqrt(dot("vector", "vector") * dot("first", "first"))).alias("cosine"))
