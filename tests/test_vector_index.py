"""The stored vector index and near classes against brute force."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import retrieval as r
from loam.operators import vector_index as x
from loam.operators.components import classes


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def frame(spark, points, articles=3, **more):
    rows = [(i, i // articles, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "chunk_id long, article_id long, vector array<float>")
    return df.withColumns({k: v for k, v in more.items()})


def clustered(seed=3, rows=1500, width=16, centres=25):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    return unit(middle[rng.integers(0, centres, rows)] + 0.35 * rng.normal(size=(rows, width))).astype(np.float32)


def exact(queries, points, k, most):
    distance = 1 - unit(queries.astype(float)) @ unit(points.astype(float)).T
    return {i: [int(j) for j in np.lexsort((np.arange(len(points)), row))[:k] if row[j] <= most] for i, row in enumerate(distance)}


def test_all_lists_give_the_exact_rows_however_rows_are_dealt(spark, monkeypatch):
    points = clustered(rows=400)
    monkeypatch.setattr(x, "PART", 7)
    monkeypatch.setattr(x, "BLOCK", 5)
    stored = frame(spark, points)
    centres = x.fit_centres(stored, lists=6)
    queries = frame(spark, points[:40]).select(F.col("chunk_id").alias("query_id"), "vector")
    found = x.probe(queries, x.filed(stored, centres), centres, 12, 0.5, probes=None).collect()
    want = {(q, c, n + 1) for q, own in exact(points[:40], points, 12, 0.5).items() for n, c in enumerate(own)}
    assert {(f.query_id, f.chunk_id, f["rank"]) for f in found} == want


def test_recall_of_few_probes(spark):
    points = clustered()
    stored = frame(spark, points)
    centres = x.fit_centres(stored, lists=30)
    queries = frame(spark, points).where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    found = x.probe(queries, x.filed(stored, centres), centres, 50, 2.0, probes=6).collect()
    want = exact(points[::20], points, 50, 2.0)
    mine = {(f.query_id, f.chunk_id) for f in found}
    assert sum((20 * q, c) in mine for q, own in want.items() for c in own) / sum(map(len, want.values())) >= 0.9


def test_recall_at_240_on_the_given_vectors(spark):
    """The given vectors have hardly any clusters, so most lists are looked through; how many is measured on other queries."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    centres = x.fit_centres(vectors)
    stored = x.filed(vectors, centres).cache()
    queries = vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    probes = x.probes_for(stored, centres, 240, 2.0, recall=0.93)
    assert probes < len(centres)
    found = x.probe(queries, stored, centres, 240, 2.0, probes)
    best = x.probe(queries, stored, centres, 240, 2.0, probes=None)
    assert found.join(best, ["query_id", "chunk_id"], "left_semi").count() / best.count() >= 0.9


def test_one_changed_article_touches_one_bucket(spark, tmp_path):
    points = clustered(rows=300)
    path = str(tmp_path / "index")
    x.build(frame(spark, points), path, lists=8, buckets=16)
    stamp = lambda: {os.path.join(d, p): 0 for d, _, files in os.walk(f"{path}/rows") for p in files if p.endswith(".parquet")}
    before = stamp()
    other = spark.createDataFrame([(15, 5, (-points[15]).tolist())], "chunk_id long, article_id long, vector array<float>")
    assert x.update(spark, path, other, buckets=16) == 1
    after = stamp()
    gone, new = set(before) - set(after), set(after) - set(before)
    assert len({os.path.dirname(p) for p in gone}) == 1 and {os.path.dirname(p) for p in new} == {os.path.dirname(p) for p in gone}
    rows, centres = x.load(spark, path)
    left = {f.chunk_id for f in rows.where("article_id = 5").collect()}
    assert left == {15} and rows.count() == 298
    changed = np.delete(points.copy(), [16, 17], axis=0)
    changed[15] = -points[15]
    ids = np.delete(np.arange(300), [16, 17])
    found = x.probe(rows.where("chunk_id < 10").select(F.col("chunk_id").alias("query_id"), "vector"), rows, centres, 5, 2.0, probes=None).collect()
    want = {(q, int(ids[c])) for q, own in exact(points[:10], changed, 5, 2.0).items() for c in own}
    assert {(f.query_id, f.chunk_id) for f in found} == want


def test_scopes_and_articles(spark):
    points = clustered(rows=120)
    stored = frame(spark, points, scope=(F.col("article_id") % 2).cast("string"))
    centres = x.fit_centres(stored, lists=4)
    queries = stored.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "article_id", "scope", "vector")
    found = x.probe(queries, x.filed(stored, centres), centres, 3, 2.0, probes=None, by_article=True).collect()
    got = {}
    for f in sorted(found, key=lambda f: f["rank"]):
        got.setdefault(f.query_id, []).append(f.article_id)
    distance = 1 - unit(points.astype(float)) @ unit(points.astype(float)).T
    for q in range(0, 120, 10):
        own = q // 3
        best = {a: distance[q, 3 * a : 3 * a + 3].min() for a in range(40) if a != own and a % 2 == own % 2}
        assert got[q] == sorted(best, key=lambda a: (best[a], a))[:3]


def test_cosines_equal_to_the_places_asked_for_are_ties(spark):
    """The farther vector of the smaller id comes first where the ninth place is the same, at the end of a list too."""
    near = [[1.0, 0.5], [1.0, 0.5 + 1e-7], [1.0, 0.0]]
    vectors = spark.createDataFrame([(3, [1.0, 0.5 - 1e-11]), (5, near[0]), (4, [1.0, 0.5 + 1e-11]), (9, near[1]), (1, near[2])], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 1.0])], "query_id long, vector array<double>")
    rows, centres = vectors.withColumn("list_id", F.lit(0)), np.array([[1.0, 0.0]])
    ids = lambda k, places: [q.chunk_id for q in x.probe(asked, rows, centres, k, 2.0, None, places=places).orderBy("rank").collect()]
    assert ids(3, None) == [9, 4, 5] and ids(3, 9) == [9, 3, 4] and ids(5, 9) == [9, 3, 4, 5, 1]
    days = spark.createDataFrame([(i, -i) for i in (1, 3, 4, 5, 9)], "article_id long, created_at long")
    digests = vectors.select(F.col("chunk_id").alias("article_id"), "vector", F.lit("ready").alias("status"), F.lit("about").alias("summary"))
    chunks = days.select("article_id", F.lit(0).alias("chunk_index"), F.col("article_id").alias("chunk_id"), F.lit(False).alias("evidence"))
    scope = r.document_scopes(days, digests, asked.withColumnRenamed("query_id", "question_id"), chunks, 3, places=9)
    assert [s.article_id for s in scope.orderBy("place").collect()] == [9, 3, 4]


@pytest.mark.parametrize("block", [1024, 3])
def test_near_classes_equal_all_pairs(spark, block):
    rng = np.random.default_rng(8)
    base = unit(rng.normal(size=(60, 24)))
    points = np.concatenate([base, *(unit(base[:25] + s * rng.normal(size=(25, 24))) for s in (0.01, 0.03, 0.045, 0.06)), base[:5], base[:5]]).astype(np.float32)
    rows = [(1000 - i, p.tolist()) for i, p in enumerate(points)] + [(5, None), (6, [0.0] * 24)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    found = {f.id: f.class_id for f in x.near_classes(df, block=block).collect()}
    like = unit(points.astype(float)) @ unit(points.astype(float)).T >= 0.97
    own = {}
    for i in range(len(points)):
        if i not in own:
            reached, stack = {i}, [i]
            while stack:
                for j in np.flatnonzero(like[stack.pop()]):
                    if int(j) not in reached:
                        reached.add(int(j))
                        stack.append(int(j))
            own |= {j: min(1000 - x for x in reached) for j in reached}
    assert found == {**{1000 - i: c for i, c in own.items()}, 5: 5, 6: 6}
    pairs = x.representative_pairs(df, spark.createDataFrame(list(found.items()), "id long, class_id long"))
    assert {f.id for f in pairs.collect()} == {i for i, c in found.items() if i != c}


def test_bands_find_what_they_promise():
    for rows in (100, 10_000, 10**9):
        bits, bands = x.bands_for(rows, 0.97, 0.001, 256)
        assert (1 - (1 - np.arccos(0.97) / np.pi) ** bits) ** bands <= 0.001 and bands < 60


def test_classes_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 20)] + [(3, 3)]
    nodes = spark.createDataFrame([(i,) for i in range(200)], "id long")
    found = {f.id: f.class_id for f in classes(nodes, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 100 if 100 <= i <= 160 else 7 if 7 <= i < 20 else i for i in range(200)}


def test_names_stand_anywhere_in_a_query(spark):
    queries = [(1, "a", "policy for datacenter access"), (2, "b", "datacenter"), (3, "a", "x"), (4, None, "center"), (5, "a", "clock tree synthesis work")]
    names = [("a", 10, "center"), ("a", 11, "data"), ("a", 12, ""), ("a", 13, "x"), ("b", 14, "datacenter"), ("b", 15, "datacenters"), (None, 16, "center"), ("a", 17, "or d"), ("a", 18, "clock tree synthesis"), ("a", 19, "tree clock"), ("a", 20, "ce"), ("a", 21, None)]
    found = r.names_within(spark.createDataFrame(queries, "query_id long, company_domain string, q string"), spark.createDataFrame(names, "company_domain string, entity_id long, normalized_name string"))
    want = {(q, e) for q, t, text in queries for u, e, n in names if t and t == u and n and n in text}
    assert {tuple(f) for f in found.collect()} == want


def test_graph_leg_orders_by_mention_count_and_keeps_to_the_tenant(spark):
    make = spark.createDataFrame
    queries = make([(1, "a", "About DataCenter rules"), (2, None, "datacenter")], "query_id long, company_domain string, text string")
    entities = make([("a", 1, "center", 3), ("a", 2, "hub", 9), ("b", 3, "center", 50), ("a", 4, "rules", 1)], "company_domain string, entity_id long, normalized_name string, mention_count long")
    relations = make([("a", 2, 1), ("b", 3, 4)], "company_domain string, source long, target long")
    mentions = make([(100, 1), (100, 4), (101, 2), (102, 4), (103, 3), (101, 2)], "article_id long, entity_id long")
    passages = make([("a", a * 10 + i, a, i) for a in (100, 101, 102) for i in (0, 1)] + [("b", 1030, 103, 0)], "company_domain string, chunk_id long, article_id long, chunk_index int")
    found = r.graph_leg(queries, entities, relations, mentions, passages, 5).orderBy("query_id", "rank").collect()
    assert [(f.query_id, f.chunk_id) for f in found] == [(1, 1010), (1, 1011), (1, 1000), (1, 1001), (1, 1020)]
