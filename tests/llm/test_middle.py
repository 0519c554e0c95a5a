"""Fill-in-middle against plain slicing of the token list, and the boundary set against sorted offsets."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm.middle import Boundaries, container, fill_in_middle, op11_fill_in_middle, restored, select
from tests.llm.data import awkward, clashing, empty
from tests.oracle import compare
from loam.llm.middle import ORACLE_SQL

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def by_hand(doc_id, text, seed="1:", plain=10, spm=20):
    text = text or ""
    tokens = TOKEN.findall(text)
    key = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100 - plain:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("form", ["array", "run", "bitmap"])
def test_each_container_selects_its_members(form):
    rng = np.random.default_rng(3)
    low = {
        "array": np.sort(rng.choice(65536, 3000, replace=False)),
        "run": np.concatenate([np.arange(5, 9000), np.arange(20000, 65536)]),
        "bitmap": np.sort(rng.choice(65536, 40000, replace=False)),
    }[form]
    held = container(low)
    assert held[0] == form
    assert [select(held, k) for k in range(0, len(low), 97)] == low[::97].tolist()
    assert select(held, len(low) - 1) == low[-1]


@pytest.mark.parametrize("text", [
    "", "a", "1", "ab1cd", "  ", "x" * 65536, "x" * 65537, "x" * 200_000 + "1" + "y" * 70_000, "." * 150_000, "a." * 70_000,
    "Größe 漢字\U0001f600" * 20_000, "x" * 65535 + "." + "y" * 65536, "\n\n\t@[`{z",
])
def test_boundaries_are_the_token_ends(text):
    ends = np.cumsum([0, *map(len, TOKEN.findall(text))]).tolist()
    found = Boundaries(text)
    assert len(found) == len(ends) - 1
    for k in {*range(0, len(ends), max(1, len(ends) // 500)), len(ends) - 1}:
        assert found.end_of(k) == ends[k]


def test_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcXYZ 0.,é漢\U0001f600\n<>PSM") for _ in range(rng.randrange(60))) for _ in range(300)] + ["has <S> inside", "<P", "x<", "<M>"]
    rows = list(enumerate(texts))
    made = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    found = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(tuple(r)[:6] for r in found) == [by_hand(i, t) for i, t in rows]
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert {r.doc_id: r.back for r in found} == dict(rows)


def test_awkward_rows_and_other_parameters(spark):
    docs = clashing(awkward(spark)).withColumn("form", F.lit("x")).withColumn("output", F.lit("y"))
    found = fill_in_middle(docs, seed="other:", plain=0, spm=100).collect()
    wanted = [by_hand(r.doc_id, r.text, "other:", 0, 100) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert fill_in_middle(empty(spark)).count() == 0


def test_query_equals_sql(spark):
    assert compare(spark, "op11", op11_fill_in_middle, ORACLE_SQL, "/root/testdata/sf0.001") == ""
