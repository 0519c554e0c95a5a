"""Preparation helpers on small literal inputs: structure, invariants, round trips."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.operators import prepare as p


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_boilerplate_and_stripping(spark):
    rows = [(1, i, f"Cong ty ABC - Quy dinh noi bo | Trang {i}/3\nDieu {i}. Noi dung {'x' * i}") for i in (1, 2, 3)]
    rows += [(2, i, f"Same heading\nbody {'y' * i}") for i in (1, 2)]
    rows += [(3, i, "z" * 121 + f"\n- {i} -\nChuong 1 ........ 12") for i in (1, 2, 3)]
    pages = frame(spark, rows, "doc_id long, page_number int, text string")
    found = {(r.doc_id, r.line_key) for r in p.boilerplate(pages).collect()}
    assert (1, "cong ty abc - quy dinh noi bo | trang #/#") in found
    assert not any(d == 2 for d, _ in found)
    kept = {(r.doc_id, r.page_number): r.text for r in p.strip_noise(pages).collect()}
    assert kept[1, 1] == "Dieu 1. Noi dung x"
    assert kept[2, 1] == "Same heading\nbody y"
    assert kept[3, 1].startswith("z" * 121)


def test_a_document_of_noise_keeps_its_text(spark):
    pages = frame(spark, [(1, i, f"Header {i}") for i in range(4)], "doc_id long, page_number int, text string")
    assert {r.text for r in p.strip_noise(pages).collect()} == {f"Header {i}" for i in range(4)}


def test_tables_and_lists_keep_their_type(spark):
    body = "## Retention policy\n\n| Kind | Years |\n| Standard | 5 |\n| Exception | 9 |"
    steps = "## Required steps\n\n1. first\n2. second\n3. third"
    rows = p.passages(p.sections(frame(spark, [(1, body), (2, steps)], "doc_id long, body string"))).collect()
    table = [r for r in rows if r.doc_id == 1]
    assert table[0].chunk_type == "table" and table[0].heading == "Retention policy"
    assert "Standard" in "".join(r.child_text for r in table) and "Exception" in "".join(r.child_text for r in table)
    assert [r.chunk_type for r in rows if r.doc_id == 2][0] == "list"


@pytest.mark.parametrize("seed", range(4))
def test_passages_hold_all_words_within_their_sizes(seed):
    rng = random.Random(seed)
    sentence = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 40))) + rng.choice(".!?")
    text = "\n\n".join(" ".join(sentence() for _ in range(rng.randint(1, 12))) for _ in range(20)) + "\n\n" + "x" * 5000
    parents = list(p.packed(p.blocks(text), p.PARENT, p.PARENT_OVERLAP))
    assert all(len(t) <= p.PARENT + p.PARENT_OVERLAP + 2 for t, _, _ in parents)
    children = [c for t, _, _ in parents for c in p.packed(p.blocks(t), p.CHILD, p.CHILD_OVERLAP)]
    assert all(len(t) <= p.CHILD + p.CHILD_OVERLAP + 2 for t, _, _ in children)
    words = {w for w in text.split() if len(w) < 100}
    assert words <= {w for t, _, _ in parents for w in t.split()}


def test_review_ranges_cover_the_text(spark):
    text = "# Title\n" + "\n".join(f"line {i} " + "w" * 50 for i in range(200))
    rows = p.review_ranges(frame(spark, [(1, "doc", text), (2, "e", "")], "doc_id long, title string, body string"), 1000).orderBy("position").collect()
    assert all(len(r.body) <= 1000 and text[r.source_start : r.source_end].strip() == r.body for r in rows)
    assert rows[0].title == "Title" and rows[0].heading == "Title" and rows[1].title == "doc — part 2"
    assert "".join(r.body for r in rows).replace("\n", "") == text.replace("\n", "")


def test_fidelity(spark):
    rows = [(1, "Budget 1,000 and 1,000 in 2024 for 15 %", "budget 1000 in 2024"), (2, "", "x"), (3, "same 7 words here", "same 7 words here")]
    found = {r.doc_id: r for r in p.fidelity(frame(spark, rows, "doc_id long, original string, formatted string")).collect()}
    assert (found[1].numeric_coverage, found[1].missing) == (0.5, ["15%"])
    assert (found[2].token_coverage, found[2].numeric_coverage) == (1.0, 1.0)
    assert (found[3].token_coverage, found[3].numeric_coverage) == (1.0, 1.0)


def test_reading_view_and_parts(spark):
    view = p.reading_view(frame(spark, [(1, "• item\nShort Label\nShort Label\nA sentence here.\n\n\n\nend of it.")], "doc_id long, body string")).first().view
    assert view == "- item\n### Short Label\nShort Label\nA sentence here.\n\nend of it."
    body = "\n\n".join("word " * n for n in (3, 10, 400))
    parts = [r.text for r in p.oversized_parts(frame(spark, [(1, body)], "doc_id long, body string"), 300).orderBy("part").collect()]
    assert all(len(t) <= 300 for t in parts) and " ".join(parts).split() == body.split()


def one(spark, value, *functions):
    row = spark.createDataFrame([(value,)], "t string").select(*(f(F.col("t")).alias(str(i)) for i, f in enumerate(functions))).first()
    return list(row)


def test_redaction(spark):
    url = "https://x.io/a?keyword=k&author=a&status_code=2&access_token=T1&X-Amz-Signature=S2&api_key=A3&accessToken=B4&page=1"
    (found,) = one(spark, url, tx.redact)
    assert all(x in found for x in ("keyword=k", "author=a", "status_code=2", "page=1"))
    assert not any(x in found for x in ("T1", "S2", "A3", "B4"))
    assert one(spark, "Authorization: Bearer abcdefgh1234", tx.redact) == ["Authorization: Bearer ***"]


def test_numbers(spark):
    cases = {"1,200.50": 1200.5, "1.500,50": 1500.5, "12,5%": 12.5, "1,234": 1234.0, "=SUM(A1)": None, "NaN": None, "1e9": None, "$ 3": 3.0, "": None}
    for text, value in cases.items():
        (found,) = one(spark, text, tx.parse_decimal)
        assert (None if found is None else float(found)) == value, text
    assert one(spark, "1,234", tx.readings) == [[1.234, 1234.0]]
    assert one(spark, "15%", tx.readings) == [[15.0, 0.15]]


def test_keys_and_names(spark):
    assert one(spark, "Nhân sự Members", tx.group_key) == ["nhan su"]
    assert one(spark, "Phòng Nhân sự - Owners", tx.group_key) == ["nhan su"]
    assert one(spark, "Đường Số", tx.fold) == ["duong so"]
    assert one(spark, "[C4: 2026-08-08] [C1, C2] [2024] [7]", tx.citation_numbers) == [[1, 2, 4, 7]]


def test_unknown_markers(spark):
    row = spark.createDataFrame([("a [C3] b [C1, C3]. [2024]", [1])], "t string, k array<int>").select(tx.keep_known_markers("t", "k").alias("x")).first()
    assert row.x == "a b [C1]. [2024]"


def test_compress(spark):
    (found,) = one(spark, "First sentence. Second one is long. Third", lambda c: tx.compress(c, 30))
    assert found == "First sentence. Second one is …"
    (found,) = one(spark, "abc def. ghi jkl mno", lambda c: tx.compress(c, 13))
    assert found == "abc def. …"
