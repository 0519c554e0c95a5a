from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from loam.llm import toxicity
from loam.llm.learning import Logistic, SparseLogistic, ranked_well
from tests.llm.data import SCHEMA, awkward, empty

DATA = "/root/testdata/sf0.01"


def corpus(n: int = 600):
    rng = random.Random(8)
    calm = ["the", "river", "meadow", "garden", "window", "table", "walks", "summer", "reading", "stone", "people", "ready"]
    rude = ["idiot", "moron", "pathetic", "stupid"]
    hide = [lambda w: w, lambda w: w.replace("i", "1").replace("o", "0"), lambda w: ".".join(w), lambda w: " ".join(w), lambda w: w[:2] + w[2] * 4 + w[3:]]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 40))]
        bad = i % 4 == 0
        if bad:
            words[len(words) // 2] = rng.choice(hide)(rng.choice(rude))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    # the character model reads all documents: plain uses of the hidden words
    return rows + [(n + i, f"the {w} said", "en", "s", 0) for i, w in enumerate(rude * 20)], labels


@pytest.fixture(scope="module")
def made(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, marks, toxicity.fit(docs, marks)


def test_char_counts_against_brute_force(spark):
    want: dict = {}
    for r in awkward(spark).collect():
        data = [0, 0, *(toxicity._CLASS[b] for b in (r.text or "").encode()), 0]
        for a, b, c in zip(data, data[1:], data[2:], strict=False):
            code = int(a * 784 + b * 28 + c)
            want[code] = want.get(code, 0) + 1
    assert {r.code: r.n for r in toxicity.char_counts(awkward(spark)).collect()} == want


def test_model_is_a_distribution(made):
    assert np.allclose(np.exp(made[2].chars).sum(axis=2), 1)


def test_viterbi_is_the_best_of_all_paths(made):
    model = made[2].chars.tolist()

    def ways(token: str, i: int) -> list:
        c = token[i]
        if c.isalpha():
            found = [(c, 0.0)]
            if i and token[i - 1] == c:
                run = len(token[: i + 1]) - len(token[: i + 1].rstrip(c)) + len(token[i + 1 :]) - len(token[i + 1 :].lstrip(c))
                found.append(("", toxicity.REPEATED if run >= 3 else toxicity.DOUBLED))
            return found
        found = [(x, toxicity.SUBSTITUTED) for x in toxicity.LEET.get(c, "")]
        return found if found and c.isdigit() else [*found, ("", toxicity.DROPPED if found else toxicity.SEPARATED)]

    for token in ("1d10t", "m0r0n", "st.upid", "iidiot", "a$$tt", "lll1!"):
        best = -math.inf
        for path in itertools.product(*(ways(token, i) for i in range(len(token)))):
            word, cost = "".join(x for x, _ in path), sum(c for _, c in path)
            a = b = 0
            for x in word:
                cost += model[a][b][toxicity._class(x)]
                a, b = b, toxicity._class(x)
            best = max(best, cost + model[a][b][0])
        found = toxicity.decode(token, model)
        # the decoder's word reaches the best cost under some way of making it
        assert found in {"".join(x for x, _ in p) for p in itertools.product(*(ways(token, i) for i in range(len(token))))}
        reached = max(
            sum(c for _, c in p) + _cost(found, model) for p in itertools.product(*(ways(token, i) for i in range(len(token)))) if "".join(x for x, _ in p) == found
        )
        assert math.isclose(reached, best, rel_tol=1e-9)


def _cost(word: str, model: list) -> float:
    a = b = 0
    total = 0.0
    for x in word:
        total += model[a][b][toxicity._class(x)]
        a, b = b, toxicity._class(x)
    return total + model[a][b][0]


def test_hidden_words_are_restored(made):
    model = made[2].chars.tolist()
    for hidden, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("p.a.t.h.e.t.i.c", "pathetic"), ("stuuuupid", "stupid"), ("river", "river"), ("meadow!!", "meadow")):
        assert toxicity.restored(hidden, model) == word
    assert toxicity.restore("The i d i o t said", model) == "the idiot said"


def test_words_hidden_at_any_length_and_by_any_mark(spark, made):
    model = made[2].chars.tolist()
    for hidden, word in (
        ("st" + "u" * 60 + "pid", "stupid"), ("...".join("pathetic" * 6), "pathetic" * 6), (".".join("stupid" * 8), "stupid" * 8),
        ("i..d..i..o..t", "idiot"), ("1d10t!!", "idiot"), ("meadow!", "meadow"), ("river...", "river"),
    ):
        assert toxicity.restored(hidden, model) == word
    for text, word in (("i d i o t!", "idiot"), ("i d i o t", "idiot"), ("m o r o n.", "moron"), ("(i  d - i  o  t)", "idiot"), ("s*t*u*p*i*d?!", "stupid"), ("1 d 1 0 t", "idiot")):
        assert word in toxicity.restore(f"the {text}", model)
        plain = {f for f in toxicity.word_features(word)}
        assert plain <= toxicity.Words(model).of(f"the {text} said")
    rows = [(1, "grass is as class, assets pass; an ass, pissing, piss and shit, a miss, this ship " * 50, "en", "s", 0)]
    marks = toxicity.char_model((r.code, r.n) for r in toxicity.char_counts(spark.createDataFrame(rows, SCHEMA)).collect()).tolist()
    for hidden, word in (("pi$$", "piss"), ("pi$$$$$$$$", "piss"), ("a$$", "ass"), ("@$$", "ass"), ("@55", "ass"), ("$hit", "shit")):
        assert toxicity.restored(hidden, marks) == word
    for text, word in (("a s s", "ass"), ("$ h i t", "shit"), ("@ $ $", "ass")):
        assert toxicity.restore(f"an {text} here", marks) == f"an {word} here"
    for plain in ("$50", "+1", "$$$", "1234", "3.5", "привет"):
        assert toxicity.restored(plain, marks) == plain


def test_long_tokens_take_linear_time(made):
    model = made[2].chars.tolist()
    for token in ("ab" * 50_000, "a1" * 20_000, "." * 100_000 + "x", "_ " * 50_000, "a." * 50_000 + "zz", "a " * 50_000 + "zz", "!" * 50_000):
        toxicity.restore(token, model)
        toxicity.Words(model).of(token)


def test_held_out_documents_are_ranked(made):
    docs, marks, scorer = made
    labels = {r.doc_id: r.toxic for r in marks.collect()}
    found = [r for r in toxicity.scored(docs, scorer).collect() if r.doc_id in labels and r.held_out]
    assert {r.doc_id for r in found} == {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    score, y = np.array([r.score for r in found]), np.array([labels[r.doc_id] for r in found])
    assert ranked_well(score, y) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in found)


def test_labels_of_held_out_rows_do_not_matter(spark, made):
    docs, marks, scorer = made
    turned = marks.withColumn("toxic", (toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic"))).cast("int"))
    again = toxicity.fit(docs, turned)
    assert again.features == scorer.features and np.array_equal(again.weights, scorer.weights) and again.bias == scorer.bias


def test_awkward_rows_empty_tables_and_no_labels(spark, made):
    rows, found = awkward(spark).collect(), toxicity.scored(awkward(spark), made[2]).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in rows)
    assert all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    assert toxicity.scored(empty(spark), made[2]).collect() == []
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    plain = toxicity.fit(awkward(spark), none)
    assert {r.score for r in toxicity.scored(awkward(spark), plain).collect()} == {0.5}
    assert len(toxicity.restored_texts(awkward(spark), plain).collect()) == len(rows)


def test_driver_table(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    y = {r.doc_id: r.toxic for r in labels.collect()}
    found = [r for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect() if r.held_out and r.doc_id in y]
    assert ranked_well(np.array([r.score for r in found]), np.array([y[r.doc_id] for r in found])) > 0.9


def test_no_more_rows_than_the_bound_are_fitted_on(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "Logistic", lambda x, y, ridge: seen.append(len(x)) or Logistic(x, y, ridge=ridge))
    docs = spark.range(4000).selectExpr("if(id < 2000, 7L, id) doc_id", "concat(if(id % 2 = 0, 'bad ', 'good '), 'text ', id) text")
    labels = spark.range(20_000).selectExpr("id doc_id", "cast(id % 2 = 0 as int) toxic")
    toxicity.fit(docs, labels, 300)
    assert 200 < seen[0] <= 300


def test_scores_against_plain_python(spark, made):
    """Every document's score from the chosen features and weights, over the words as the decoder restores them."""
    docs, _, scorer = made
    model, weight = scorer.chars.tolist(), dict(zip(scorer.features, scorer.weights, strict=True))
    for r in toxicity.scored(docs, scorer).join(docs, "doc_id").limit(150).collect():
        lowered = (r.text or "").lower()
        words = set(lowered.split()) | {toxicity._BETWEEN.sub("", m[0]) for m in toxicity._SPACED.finditer(lowered)}
        own = {f for w in words if (x := toxicity.restored(w, model)) for f in toxicity.word_features(x)}
        assert abs(r.score - 1 / (1 + np.exp(-(scorer.bias + sum(weight.get(f, 0) for f in own))))) < 1e-9


def test_mostly_digits_are_read_as_letters_where_these_are_likelier(spark):
    """Both readings have a likelihood: letters through the channel, or a number."""
    rows = [(1, "oh shit, this shit is shit and that shit is worse; leet the elite meet, tell them these tales, see all at ease " * 50, "en", "s", 0)]
    model = toxicity.char_model((r.code, r.n) for r in toxicity.char_counts(spark.createDataFrame(rows, SCHEMA)).collect()).tolist()
    assert toxicity.restored("5h17", model) == "shit" and toxicity.restored("5h17!", model).startswith("shit")
    assert "shit" in toxicity.restore("oh 5h17 again", model)
    for plain in ("1990", "455", "2024", "10:30", "3.14", "555-0199", "0123456789" * 4, "h264", "7b19"):
        assert toxicity.restored(plain, model) == plain, plain


def test_all_features_and_one_solution_both_ways(made):
    docs, marks, scorer = made
    full = toxicity.fit(docs, marks, features=None, least=1)
    assert len(full.features) > len(scorer.features)
    labels = {r.doc_id: r.toxic for r in marks.collect()}
    found = [r for r in toxicity.scored(docs, full).collect() if r.doc_id in labels and r.held_out]
    assert ranked_well(np.array([r.score for r in found]), np.array([labels[r.doc_id] for r in found])) > 0.9
    rng = np.random.default_rng(2)
    x = (rng.random((200, 30)) < 0.2).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.random(200) > 0.8).astype(float)
    one, two = Logistic(x, y, ridge=4.0), SparseLogistic([np.flatnonzero(r).tolist() for r in x], y, 30, ridge=4.0)
    assert np.allclose(one.beta, two.beta, atol=1e-6) and np.allclose(one.mean, two.mean) and np.allclose(one.scale, two.scale)


def test_too_few_labels_give_one_score(made):
    docs, marks, _ = made
    few = marks.where("toxic = 0 or doc_id in (0, 4, 8)")
    n = [r.toxic for r in few.where(~toxicity.held_out(toxicity.F.col("doc_id"))).collect()]
    assert 0 < sum(n) < toxicity.FEW
    (score,) = {r.score for r in toxicity.scored(docs, toxicity.fit(docs, few)).collect()}
    assert abs(score - (sum(n) + 1) / (len(n) + 2)) < 1e-9
    assert len({r.score for r in toxicity.scored(docs, toxicity.fit(docs, few, few=1)).collect()}) > 1
