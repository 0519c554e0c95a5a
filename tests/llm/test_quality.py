from __future__ import annotations

import numpy as np

from loam.llm import quality
from loam.llm.learning import ranked_well
from tests.llm.data import awkward, empty

DATA = "/root/testdata/sf0.01"


def test_held_out_labels_are_ranked(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    y = {r.doc_id: r.quality for r in labels.collect()}
    found = [r for r in quality.scored(docs, model).collect() if r.doc_id % 3 == 0 and r.doc_id in y]
    marks = np.array([y[r.doc_id] for r in found])
    assert ranked_well(np.array([r.score for r in found]), marks) > 0.97
    assert np.mean([r.keep == y[r.doc_id] for r in found]) > 0.95
    kept = quality.kept(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.scored(docs, model).collect() if r.keep}


def test_views_teach_each_other():
    """Few labels, two noisy views: with pseudo-labels from the pool, held-out ranking is no worse than without."""
    rng = np.random.default_rng(3)
    width = quality.N_TEXT + len(quality.meta_view(None, None, None))

    def draw(n):
        y = (rng.random(n) < 0.7).astype(float)
        x = rng.normal(size=(n, width))
        x[:, 0] += 2.5 * y
        x[:, quality.N_TEXT] += 2.5 * y
        return x, y

    (x, y), (pool, _), (held, marks) = draw(40), draw(1500), draw(2000)
    taught = ranked_well(quality.co_train(x, y, pool).scores(held)[2], marks)
    alone = ranked_well(quality.co_train(x, y, pool[:0]).scores(held)[2], marks)
    assert taught > 0.9 and taught >= alone - 0.01


def test_scores_are_calibrated(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    found = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").collect()
    assert abs(np.mean([r.score for r in found]) - np.mean([r.quality for r in found])) < 0.05


def test_awkward_rows_one_class_and_empty_tables(spark):
    none = spark.createDataFrame([(1, None, 1), (None, 1, 1), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(awkward(spark), none)
    found = quality.scored(awkward(spark), model).collect()
    assert len(found) == 10 and {r.score for r in found} == {1.0} and {r.keep for r in found} == {1}
    assert quality.scored(empty(spark), model).collect() == []
    assert quality.kept(awkward(spark), model).count() == 10
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    full = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = quality.scored(awkward(spark), full).collect()
    assert all(0 <= r.score <= 1 for r in scores)
    assert quality.scored(docs.select("doc_id", "text"), full).count() == docs.count()


class Seen(list):
    """In place of co-training: notes the labelled rows and how many unlabelled ones can be looked through."""

    def __call__(self, x, y, find, *rest):
        one = lambda kind: type("Always", (), {"logit": lambda self, x: np.full(len(x), kind)})()
        found = find([one(9.0), one(-9.0)], [np.empty(0), np.empty(0)], [np.inf, np.inf]) if callable(find) else [((), (), ()), ((), (), ())]
        self.append((len(x), len(found[0][0]), len(found[1][0])))


def test_all_unlabelled_documents_are_looked_through(spark, monkeypatch):
    """More than any bound on labelled rows: both views see each of 15 000 documents."""
    seen = Seen()
    monkeypatch.setattr(quality, "co_train", seen)
    docs = spark.range(16_000).selectExpr("if(id % 4 = 1, null, id) doc_id", "concat('text ', id) text", "'en' lang", "'s' source", "9L n_chars")
    labels = spark.range(0, 40_000, 16).selectExpr("id doc_id", "cast(id % 32 = 0 as int) quality")  # 2 500, of which 1 000 of docs
    quality.fit(docs, labels, 200)
    ((known, good, bad),) = seen
    assert 130 < known <= 200 and good == bad == 15_000


def test_a_view_teaches_no_more_than_it_may(spark):
    rng = np.random.default_rng(5)
    width = quality.N_TEXT + len(quality.meta_view(None, None, None))
    pool = rng.normal(size=(500, width)).astype(np.float32)
    rows = [(float(i) / 500, bytearray(p.tobytes())) for i, p in enumerate(pool)]
    table = spark.createDataFrame(rows, "place double, features binary").repartition(5)
    y = np.arange(60) % 2.0
    x = rng.normal(size=(60, width))
    x[:, 0] += 3 * y
    x[:, quality.N_TEXT] += 3 * y
    models = [quality.Logistic(x[:, v], y) for v in quality._VIEWS]
    used = [np.array([3 / 500]), np.empty(0)]
    for most in ([4, 9], [np.inf, np.inf]):
        one, two = quality.sure_in(table)(models, used, most), quality.sure_of(pool.astype(float))(models, [u * 500 for u in used], most)
        for a, b in zip(one, two, strict=True):
            assert sorted((a[0] * 500).round().tolist()) == sorted(b[0].tolist()) and len(a[0]) <= sum(most)
            assert 3 not in (a[0] * 500).round() or a is one[1]


def test_without_a_classifier_all_rows_stay(spark):
    bad = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(awkward(spark), bad)
    assert quality.kept(awkward(spark), model).count() == 10
    assert {r.keep for r in quality.scored(awkward(spark), model).collect()} == {1}


def test_no_more_labelled_rows_than_the_bound_come_to_the_driver(spark, monkeypatch):
    """One labelled id on very many rows, and labels of ids that aren't there."""
    seen = Seen()
    monkeypatch.setattr(quality, "co_train", seen)
    same = spark.range(3000).selectExpr("if(id % 2 = 0, 7L, 9L) doc_id", "concat('text ', id) text")
    copies = spark.range(3000).selectExpr("8L doc_id", "'one text' text")
    docs = same.union(copies).union(spark.range(2000).selectExpr("id + 100 doc_id", "concat('other ', id) text"))
    labels = spark.createDataFrame([(7, 1), (9, 0), (8, 0), *((-i, 1) for i in range(1, 9000))], "doc_id long, quality int")
    quality.fit(docs, labels, 100)
    assert 0 < seen[0][0] <= 100 and seen[0][1:] == (2000, 2000)
    quality.fit(docs.where("doc_id < 10"), labels, 10_000, least_class=1)
    assert seen[1] == (3001, 0, 0)


def test_how_many_labels_a_classifier_needs(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    good, bad = ([r.doc_id for r in labels.where(f"quality = {q}").orderBy("doc_id").limit(6).collect()] for q in (1, 0))
    few = labels.where(labels.doc_id.isin(good + bad[:5]))
    assert quality.fit(docs, few).both is None and abs(quality.fit(docs, few).prior - 6 / 11) < 1e-9
    assert quality.fit(docs, labels.where(labels.doc_id.isin(good + bad))).both is not None
    assert quality.fit(docs, few, least=4, least_class=2).both is not None


def test_scores_against_plain_python(spark):
    """Every document's scores from the fitted coefficients, one feature at a time."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 300"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    found = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    logistic = lambda fit, x: sum(b * (v - m) / s for b, v, m, s in zip(fit.beta, x, fit.mean, fit.scale, strict=False)) + fit.beta[-1]
    chance = lambda z: 1 / (1 + np.exp(-min(max(z, -40), 40)))
    for r in docs.collect():
        a = logistic(model.text_fit, [logistic(model.text, quality.text_view(r.text or ""))])
        b = logistic(model.meta_fit, [logistic(model.meta, quality.meta_view(r.lang, r.source, r.n_chars))])
        score = chance(logistic(model.both, [a, b]))
        got = found[r.doc_id]
        assert np.allclose((got.text_score, got.meta_score, got.score), (chance(a), chance(b), score), atol=1e-9)
        assert got.keep == int(got.score >= quality.KEEP)


def test_text_features_against_their_definition():
    text = "Ab 1!\nAb 1!\nzz | é."
    data = text.encode()
    found = quality.text_view(text)
    share = lambda chars: sum(chr(c) in chars for c in data) / len(data)
    assert np.allclose(found[:3], [share("abcdefghijklmnopqrstuvwxyz"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789")])
    assert np.isclose(found[10], sum(c > 127 for c in data) / len(data))
    assert np.isclose(found[12], np.log1p(7)) and np.isclose(found[13], 5 / 7) and np.isclose(found[16], 1 - 2 / 3)
