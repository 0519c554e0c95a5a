"""Operators on small literal inputs where order, ties and unknowns decide."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions.matching import changed_lines, matching_characters
from loam.operators import access as a
from loam.operators import dedupe as d
from loam.operators import governance as g
from loam.operators import retrieval as r
from loam.operators import telemetry as t
from loam.operators import vectors as v

RANKED = "query_id long, position int, chunk_id long, article_id long, key string, n_chars int, score double, embedding array<double>, updated double"


def collapse(spark, rows):
    full = [(1, i, c, art, key, 80, score, vec, upd) for i, (c, art, key, score, vec, upd) in enumerate(rows)]
    return [(x.chunk_id, x.also_in) for x in v.collapse_copies(spark.createDataFrame(full, RANKED)).orderBy("place").collect()]


def test_copies_collapse_in_order(spark):
    assert collapse(spark, [(1, 1, "k", 0.9, None, 0.0), (2, 2, "k", 0.8, None, 0.0)]) == [(1, [2])]
    assert collapse(spark, [(1, 1, "k", 0.9, None, 0.0), (2, 1, "k", 0.8, None, 0.0)]) == [(1, []), (2, [])]
    assert collapse(spark, [(1, 1, "k", 0.5, None, 0.0), (2, 2, "k", 0.9, None, 0.0)]) == [(2, [1])]
    assert collapse(spark, [(1, 1, "k", 0.900, None, 2024.0), (2, 2, "k", 0.903, None, 2026.0)]) == [(2, [1])]
    assert collapse(spark, [(1, 1, "k", 0.5, None, 0.0), (9, 9, "z", 0.7, None, 0.0), (2, 2, "k", 0.9, None, 0.0)]) == [(2, [1]), (9, [])]
    near = [(1, 1, "a", 0.9, [1.0, 0.0], 0.0), (2, 2, "b", 0.8, [1.0, 0.1], 0.0), (3, 3, "c", 0.7, [0.0, 1.0], 0.0)]
    assert collapse(spark, near) == [(1, [2]), (3, [])]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(7, 5)), rng.normal(size=(60, 5))
    frame = lambda m, name: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"{name} long, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    distance = 1 - unit(q) @ unit(c).T
    for blocks, parts in ((1, 1), (3, 4)):
        found = v.nearest(frame(q, "query_id"), frame(c, "chunk_id"), 4, 0.8, blocks, parts).collect()
        want = {(i, int(j), n + 1) for i in range(7) for n, j in enumerate(np.argsort(distance[i])[:4]) if distance[i, j] <= 0.8}
        assert {(x.query_id, x.chunk_id, x["rank"]) for x in found} == want


@pytest.mark.parametrize("least", [0.02, 0.25, 0.6])
def test_no_pair_is_lost(spark, least):
    rng = np.random.default_rng(int(least * 100))
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 30)) if x < 60) or "w1" for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for i in range(40) for j in range(40) if i != j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least}
    assert {(x.query_id, x.article_id) for x in d.token_pairs(docs, docs, least).collect()} == want
    for blocks, parts in ((1, 1), (3, 4)):
        assert {(x.query_id, x.article_id) for x in d.set_similarity(docs, docs, least, blocks=blocks, parts=parts).collect()} == want


def test_best_candidates_and_short_sides(spark):
    texts = ["a b c d e f", "a b c d e g", "x", "y", "", "a b c x", "q r s t u v w"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    sets = [set(t.split()) for t in texts]
    jaccard = lambda i, j: len(sets[i] & sets[j]) / max(len(sets[i] | sets[j]), 1)
    for k in (2, 4):
        want = set()
        for i in range(7):
            near = [j for j in range(7) if i != j and (jaccard(i, j) >= 0.3 or min(len(sets[i]), len(sets[j])) < 2)]
            want |= {(i, j) for j in sorted(near, key=lambda j: (-jaccard(i, j), j))[:k]}
        for blocks, parts in ((1, 1), (2, 3)):
            assert {(x.query_id, x.article_id) for x in d.set_similarity(docs, docs, 0.3, k, 2, blocks, parts).collect()} == want
    pairs = [(1, "abcdefgh"), (2, "abcdefgx")]  # one token each and none shared: near by characters
    one = spark.createDataFrame(pairs, "doc_id long, body string")
    assert {(x.query_id, x.article_id, x.score) for x in d.similar_documents(one, one).collect()} == {(1, 2, 0.875), (2, 1, 0.875)}


def test_matching_against_the_definition():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 60))) for _ in range(2))
        blocks = SequenceMatcher(None, a, b, autojunk=False)
        assert matching_characters(a, b) == sum(x.size for x in blocks.get_matching_blocks())
        assert changed_lines(list(a), list(b)) == [x[1:] for x in blocks.get_opcodes() if x[0] != "equal"]
    assert matching_characters("x" * 300, "x" * 299 + "y") == 299


def test_topical_links_against_brute_force(spark):
    """One article holds most of the passages, all of them near: it neither hides the others nor counts more than once."""
    rng = np.random.default_rng(4)
    owner = [0] * 120 + [int(x) for x in rng.integers(1, 8, 60)]
    m = rng.normal(size=(180, 6)) + 1.5
    rows = [(i, o, x.tolist()) for i, (o, x) in enumerate(zip(owner, m, strict=True))]
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for q in range(8):
        mean = m[np.array(owner) == q].mean(axis=0)
        near = 1 - unit @ (mean / np.linalg.norm(mean))
        best = sorted((near[[i for i, o in enumerate(owner) if o == other]].min(), other) for other in range(8) if other != q)
        want |= {(q, other, n + 1) for n, (distance, other) in enumerate(best[:3]) if distance <= 0.45}
    frame = spark.createDataFrame(rows, "chunk_id long, article_id long, embedding array<double>")
    for blocks, parts in ((1, 1), (2, 5)):
        assert {(x.article_id, x.related, x["rank"]) for x in v.topical_links(frame, 3, 0.45, blocks, parts).collect()} == want


def test_titles_that_contain_a_term(spark):
    rng = random.Random(6)
    titles = [(i, "".join(rng.choice("abÉđ x") for _ in range(rng.randint(0, 25)))) for i in range(80)] + [(99, None)]
    terms = ["ab", "ba", "e", "abe", "xxd", "abx", "zzz", "dab", "bde"]
    bare = lambda t: (t or "").lower().replace("é", "e").replace("đ", "d")
    found = r.titles_with(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(titles, "article_id long, title string"))
    assert {tuple(x) for x in found.collect()} == {(t, i) for t in terms if len(t) > 1 for i, title in titles if t in bare(title)}


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(7)
    rows = [("a", float(x)) for x in rng.exponential(50, 501)] + [("b", float(x)) for x in rng.integers(-3, 3, 100)] + [(None, 5.0), ("c", None), ("d", 0.0), ("d", 1e9)]
    places = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    found = {x.k2: x for x in t.percentiles(spark.createDataFrame(rows, "k2 string, x double"), ["k2"], "x", places).collect()}
    assert set(found) == {"a", "b", None, "d"}
    for key, row in found.items():
        own = [x for k, x in rows if k == key and x is not None]
        assert all(np.isclose(row[name], np.percentile(own, 100 * q), rtol=1e-12) for name, q in places.items())


def test_copies_of_one_line_are_rows(spark):
    rows = [(i, i % 3, "k", 80, 0.5, i) for i in range(9)] + [(20, 7, "short", 10, 0.5, 0), (21, 8, "short", 10, 0.5, 0), (30, 9, "own", 80, 0.5, 0), (31, 9, "own", 80, 0.5, 0)]
    groups, members = d.collapse_exact(spark.createDataFrame(rows, "chunk_id long, article_id long, key string, n_chars int, score double, updated int"))
    assert [tuple(x) for x in groups.collect()] == [("k", 8, 2, 9, 3)]
    assert {tuple(x) for x in members.collect()} == {("k", 0), ("k", 1), ("k", 2)}


def test_search_collapses_copies_and_checks_readers(spark):
    line = "the flux capacitor needs a steady supply of power from the main rail to work at all"
    passages = [(10, 1, line), (20, 2, line), (30, 3, "flux capacitor"), (40, 4, "nothing of note"), (50, 5, "hidden flux capacitor notes")]
    titles = [(1, "one", "x"), (2, "two", "x"), (3, "three", "x"), (4, "capacitors", "x"), (5, "five", "y")]
    queries = spark.createDataFrame([(1, "flux capacitor"), (2, "unheard words")], "query_id long, text string")
    readers = spark.createDataFrame([(1, "x"), (2, "x")], "query_id long, dept string")
    results, gaps = r.search(queries, spark.createDataFrame(passages, "chunk_id long, article_id long, text string"), spark.createDataFrame(titles, "article_id long, title string, dept string"), readers=readers)
    found = {x.chunk_id: list(x.also_in) for x in results.collect()}
    assert found.keys() >= {10, 30} and 20 not in found and 50 not in found and found[10] == [2]
    assert [x.query_id for x in gaps.collect()] == [2]
    hits = spark.createDataFrame([(1, 0, 5, 0.9), (1, 1, 6, 0.2)], "question_id long, sub_id long, chunk_id long, score double")
    again = spark.createDataFrame([(1, 0, 7, 0.9), (1, 1, 6, 0.5), (1, 2, 8, 0.4)], "question_id long, sub_id long, chunk_id long, score double")
    subs = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "question_id long, sub_id long")
    assert {tuple(x) for x in r.retried(subs, hits, again).collect()} == {(1, 0, 5, 0.9), (1, 1, 6, 0.5), (1, 2, 8, 0.4)}


def test_similar_documents(spark):
    base = " ".join(f"word{i}" for i in range(200))
    edited = base.replace("word7 ", "other ").replace("word90 ", "changed ")
    docs = spark.createDataFrame([(1, base), (2, edited), (3, base), (4, ""), (5, "quite unlike 12345 | " * 30)], "doc_id long, body string")
    found = {(x.query_id, x.article_id): x.score for x in d.similar_documents(docs, docs).collect()}
    assert found[1, 3] == 1.0 and found[1, 2] > 0.85
    assert not any(4 in pair for pair in found) and (1, 5) not in found


@pytest.mark.parametrize(
    ("core", "words", "fits"),
    [("clkdiv", ["clock", "divider"], True), ("clken", ["clock", "enable"], True), ("prdata", ["peripheral", "read", "data"], True), ("intren", ["interrupt", "enable"], True), ("ieee", ["interrupt", "enable"], False), ("paddr", ["peripheral", "address"], True), ("xlkdiv", ["clock", "divider"], False)],
)
def test_abbreviations(core, words, fits):
    assert r.abbreviates(core, words) is fits


def test_aliases_and_identifiers(spark):
    names = spark.createDataFrame([("CLKDIV", 5), ("CLK_EN", 3), ("PRDATA", 2), ("INTR_ENABLE", 9), ("INTEN", 4)], "name string, uses long")
    texts = ["SPI host clock divider field", "clock enable", "peripheral read data signal", "interrupt enable", "INTR_ENABLE clock divider"]
    found = r.aliases(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"), names).collect()
    by = {i: {x.name for x in found if x.query_id == i} for i in range(5)}
    assert by == {0: {"CLKDIV"}, 1: {"CLK_EN"}, 2: {"PRDATA"}, 3: {"INTR_ENABLE", "INTEN"}, 4: set()}
    asked = spark.createDataFrame([("Thanh ghi PADOUTSET của GPIO nằm ở offset nào?",), ("Lệnh debug fetch ở 0x2000_1080 thì sao?",), ("WHAT IS THE RESET VALUE",)], "t string")
    assert [x[0] for x in asked.select(r.identifiers(F.col("t"))).collect()] == [["padoutset", "gpio"], ["0x2000_1080"], []]


def test_context_skips_what_does_not_fit(spark):
    rows = [(1, 1, 1, 0.9, "a" * 60), (1, 2, 1, 0.8, "b" * 60), (1, 3, 2, 0.7, "c" * 30), (1, 4, 2, 0.2, "d")]
    frame = spark.createDataFrame(rows, "query_id long, parent_id long, article_id long, score double, text string")
    assert [(x.parent_id, x.label) for x in r.select_context(frame, chars=100).collect()] == [(1, "C1"), (3, "C2")]


def test_validity(spark):
    results = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "query_id long, article_id long, place int")
    validity = spark.createDataFrame([(1, "2024-01-15", "2025-12-31"), (2, None, None), (3, None, "2030-01-01"), (4, "2025-04-01", None), (5, "2020-01-01", None)], "article_id long, issued string, expires string")
    validity = validity.withColumns({c: F.to_date(c) for c in ("issued", "expires")})
    decisions = spark.createDataFrame([(5, 1)], "article_id long, kept long")
    found = {x.article_id: x.bucket for x in r.as_of(results, validity, decisions, F.lit("2025-03-01").cast("date")).collect()}
    assert found == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2}


def test_denial_beats_every_grant(spark):
    users = spark.createDataFrame([(1, "t", False), (2, "t", False), (3, "u", False), (4, "t", True)], "user_id long, company_domain string, reviewer boolean")
    articles = spark.createDataFrame(
        [(10, "t", "d", "company", 1, "published", True, False), (11, "t", "d", "public", 9, "published", True, False), (12, "t", "d", "users", 9, "published", True, False), (13, "t", "d", "company", 1, "draft", True, False), (14, "t", "x", "public", 1, "published", True, False), (15, "t", "d", "public", 9, "published", True, True)],
        "article_id long, company_domain string, dept string, visibility string, owner_id long, status string, active boolean, governed boolean",
    )
    departments = spark.createDataFrame([("d", True), ("x", False)], "dept string, active boolean")
    members = spark.createDataFrame([(2, "d"), (4, "d")], "user_id long, dept string")
    shares = spark.createDataFrame([], "article_id long, dept string")
    permissions = spark.createDataFrame([(11, 1, "deny", "internal"), (11, 1, "allow", "internal"), (12, 1, "allow", "internal"), (15, 1, "allow", "provider")], "article_id long, user_id long, effect string, source string")
    found = {tuple(x) for x in a.entitlements(users, articles, departments, members, shares, permissions).collect()}
    assert found == {(1, 10), (1, 12), (1, 13), (1, 15), (2, 10), (2, 11), (2, 15), (4, 10), (4, 11), (4, 13), (4, 15)}
    asked = spark.createDataFrame([(u, x) for u in range(1, 6) for x in range(10, 17)], "user_id long, article_id long")
    assert {tuple(x) for x in a.entitlements(users, articles, departments, members, shares, permissions, asked).collect()} == found


def test_unset_filters_match_and_unknowns_do_not(spark):
    drafts = spark.createDataFrame([(1, "d", "pdf", None, None, "low"), (2, "d", "pdf", None, 0.1, "low")], "draft_id long, dept string, extension string, connector_id string, similarity double, risk_tier string")
    rules = spark.createDataFrame([(1, True, 1, None, None, None, 0.5, None), (2, True, 2, None, None, None, None, None), (3, False, 0, None, None, None, None, None)], "rule_id long, active boolean, priority int, dept string, extensions array<string>, connector_id string, max_similarity double, risk_tiers array<string>")
    assert {tuple(x) for x in g.deciding_rule(drafts, rules).collect()} == {(1, 2), (2, 1)}


def test_line_diff(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, "same", "same"), (3, None, "n")], "article_id long, old string, new string")
    found = {x.article_id: (x.added, x.removed, x.hunks) for x in g.line_diff(pairs).collect()}
    assert found == {1: (2, 1, ["-b\n+x", "+d"]), 2: (0, 0, []), 3: (1, 0, ["+n"])}


def test_suggested_departments(spark):
    groups = spark.createDataFrame([(1, "Engineering Team Members"), (2, "Finanse"), (3, "zzzz")], "group_id long, name string")
    departments = spark.createDataFrame([(10, "Engineering"), (11, "Finance")], "department_id long, name string")
    assert {(x.group_id, x.department_id) for x in a.suggest_departments(groups, departments).collect()} == {(1, 10), (2, 11)}
