"""Nearest vectors and groups of near vectors: blocked NumPy products in cogrouped tasks, and greedy collapse of copies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block and passages in a part: one task multiplies a block by a part.
BLOCK, PART = 512, 50_000


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def nearest(queries: DataFrame, passages: DataFrame, k: int, most: float, blocks: int = 1, parts: int = 1) -> DataFrame:
    """(query_id, chunk_id, distance, rank): for each query the ``k`` nearest passages by cosine, at most ``most`` away.

    queries (query_id, vector), passages (chunk_id, vector). Both are dealt by hash; every block of queries meets every
    part of the passages once, and only its k best a query leave the task. Ranks start at 1; ties go by chunk_id.
    ``block_counts`` gives blocks and parts for sizes. Rows without a vector are left out.
    """
    q = queries.where("vector is not null").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    c = passages.where("vector is not null").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "chunk_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        a, b, ids = unit(left.vector), unit(right.vector), right.chunk_id.to_numpy()
        found = []
        for at in range(0, len(a), 64):
            distance = 1.0 - a[at : at + 64] @ b.T
            for query, row in zip(left.query_id.iloc[at : at + 64], distance, strict=True):
                near = np.flatnonzero(row <= most)
                best = near[np.lexsort((ids[near], row[near]))[:k]]
                found.append(pd.DataFrame({"query_id": query, "chunk_id": ids[best], "distance": row[best]}))
        return pd.concat(found, ignore_index=True)

    met = q.groupBy("block", "part").cogroup(c.groupBy("block", "part")).applyInPandas(task, "query_id long, chunk_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_counts(queries: int, passages: int) -> tuple[int, int]:
    return max(1, -(-queries // BLOCK)), max(1, -(-passages // PART))


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, vector): mean vector of each group, position by position; partial sums leave the tasks."""
    each = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


COLLAPSED = "query_id long, chunk_id long, article_id long, place int, score double, also_in array<long>"


def collapse_copies(ranked: DataFrame, similarity: float = 0.97, least_chars: int = 60) -> DataFrame:
    """Ranked result lists without copies across articles: equal text keys, or cosine of at least ``similarity``.

    ranked (query_id, position, chunk_id, article_id, key, n_chars, score, embedding, updated double). In rank order each
    passage meets the ones kept so far; a copy from another article is merged, the better of the two (score to two
    places, then newer) keeps the earlier place, and also_in names the other articles once each. Short passages are
    never merged. Greedy order matters, so a query's list is one group: a few hundred rows.
    """

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position", kind="stable")
        vectors = [None if v is None else np.asarray(v, float) for v in frame.embedding]
        vectors = [v / n if v is not None and v.size and (n := np.linalg.norm(v)) else None for v in vectors]
        rows = list(frame.drop(columns="embedding").itertuples(index=False))
        kept: list[int] = []
        also: list[list[int]] = []
        for i, row in enumerate(rows):
            slot = None
            if row.n_chars >= least_chars:
                others = [s for s, j in enumerate(kept) if rows[j].n_chars >= least_chars and rows[j].article_id != row.article_id]
                slot = next((s for s in others if rows[kept[s]].key == row.key), None)
                if slot is None and vectors[i] is not None:
                    close = [(float(vectors[kept[s]] @ vectors[i]), -s) for s in others if vectors[kept[s]] is not None and vectors[kept[s]].shape == vectors[i].shape]
                    best = max(close, default=(0.0, 0))
                    slot = -best[1] if close and best[0] >= similarity else None
            if slot is None:
                kept.append(i)
                also.append([])
                continue
            old = rows[kept[slot]]
            if (round(row.score, 2), row.updated) > (round(old.score, 2), old.updated):
                also[slot].append(old.article_id)
                kept[slot] = i
            else:
                also[slot].append(row.article_id)
        out = []
        for place, (j, names) in enumerate(zip(kept, also, strict=True)):
            out.append((rows[j].query_id, rows[j].chunk_id, rows[j].article_id, place, rows[j].score, [n for n in dict.fromkeys(names) if n != rows[j].article_id]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in COLLAPSED.split(", ")])

    return ranked.groupBy("query_id").applyInPandas(task, COLLAPSED)


def topical_links(vectors: DataFrame, k: int = 5, most: float = 0.45, blocks: int = 1, parts: int = 1) -> DataFrame:
    """(article_id, related, distance, rank): the ``k`` articles whose nearest passage lies nearest to an article's centroid.

    vectors (chunk_id, article_id, embedding). Passages of the article itself don't count. Blocks of centroids meet parts of
    the passages; an article's passages are in one part unless it is larger than a part, so a task keeps the nearest
    passage of each other article and of these the k nearest, whatever number of passages they have. Parts merge exactly.
    """
    means = centroids(vectors, "article_id").withColumnRenamed("article_id", "query_id")
    q = means.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    c = vectors.where("embedding is not null").select("article_id", F.col("embedding").alias("vector"), F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"))
    c = c.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "related": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})]
        if len(left) and len(right):
            right = right.sort_values("article_id", kind="stable")
            ids, starts = np.unique(right.article_id.to_numpy(), return_index=True)
            a, b = unit(left.vector), unit(right.vector)
            for query, row in zip(left.query_id, a, strict=True):
                nearest_ = np.minimum.reduceat(1.0 - b @ row, starts)
                near = np.flatnonzero((nearest_ <= most) & (ids != query))
                best = near[np.lexsort((ids[near], nearest_[near]))]
                # an article may have nearer passages in another part: it is merged there, so all k of a part are enough
                best = best[:k]
                found.append(pd.DataFrame({"query_id": query, "related": ids[best], "distance": nearest_[best]}))
        return pd.concat(found, ignore_index=True)

    met = q.groupBy("block", "part").cogroup(c.groupBy("block", "part")).applyInPandas(task, "query_id long, related long, distance double")
    best = met.groupBy("query_id", "related").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "related")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("query_id", "article_id")
