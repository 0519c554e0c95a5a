from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loam.llm import mixing, quality, resemblance
from tests.llm.data import CLASHING, SCHEMA, awkward, clashing
from tests.llm.test_mixing import WORD, place, shared
from tests.llm.test_resemblance import all_pairs, roots, signed
from tests.llm.test_secrets import near
from tests.llm.test_simhash import plain

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, DATA)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns
        made.write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        found.append(docs.collect())
    return found


def test_quality_drops_what_it_rejects(spark, stages):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    keep = {r.doc_id for r in quality.scored(docs, model).collect() if r.score >= quality.KEEP}
    assert sorted(stages[1]) == sorted(r for r in stages[0] if r.doc_id in keep)
    assert 0 < len(stages[1]) < len(stages[0])


def alike_though_estimated_less(rows, signatures):
    """Pairs whose estimate lies a little below the threshold and whose sets of five-word shingles are alike."""
    words = [WORD.findall(r.text or "") for r in rows]
    words = [[x.translate({i: i + 32 for i in range(65, 91)}) for x in own] for own in words]
    sets = [{tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set() for own in words]
    size = resemblance.SAMPLES // resemblance.BANDS
    for i in range(len(rows)):
        same = signatures[:i] == signatures[i]
        band = same.reshape(i, resemblance.BANDS, size).all(axis=2).any(axis=1)
        guess = resemblance.likeness(signatures[:i], signatures[i])
        for j in np.flatnonzero(band & (guess >= resemblance.DOUBT) & (guess < resemblance.LEAST)).tolist():
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                yield i, j


def test_one_of_each_component_stays(stages):
    rows = stages[1]
    prints, signatures = [plain(r.text) for r in rows], np.stack([signed(r.text) for r in rows])
    ids = np.array(prints, np.uint64)
    pairs = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(ids[:i] ^ ids[i]) <= 3)]
    of = roots(len(rows), [*pairs, *all_pairs(signatures), *alike_though_estimated_less(rows, signatures)])
    least: dict = {}
    for r, c in zip(rows, of, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert sorted(stages[2]) == sorted(r for r, c in zip(rows, of, strict=True) if r.doc_id == least[c])


def test_texts_of_four_fifths_the_same_shingles_are_near_copies(spark):
    words = [f"word{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join("other" if i in (80, 200, 320) else w for i, w in enumerate(words))), (3, " ".join(words[:200] + [f"new{i}" for i in range(200)]))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, DATA).orderBy("doc_id").collect()] == [1, 3]


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    fox = "the quick brown fox jumps over the lazy dog near the old mill by the river " * 20
    texts = {"fox": fox, "near": fox + "end", "rain": "rain falls on seven hills while nobody is looking up " * 9, "bread": "she bakes bread with rye and caraway every other morning " * 9}
    texts |= {"tide": "low tide uncovers a field of stones, ropes and shells " * 9 + "again", "tide2": "low tide uncovers a field of stones, ropes and shells " * 9}
    assert all((plain(texts[a]) ^ plain(texts[b])).bit_count() <= 3 for a, b in (("fox", "near"), ("tide", "tide2")))
    # a row without id is a near copy of 1, one is clean, two are near copies of each other; 5 has a near copy of 1 and
    # a clean text, which comes twice with different sources; 6 has near copies under one id
    rows = [(1, "fox"), (None, "near"), (None, "rain"), (None, "tide"), (None, "tide2"), (5, "near"), (5, "bread")]
    docs = spark.createDataFrame([(i, texts[t], "en", "a", len(texts[t])) for i, t in rows] + [(5, texts["bread"], "en", "b", 1)], SCHEMA)
    found = corpus_pipeline.without_near_copies(spark, docs, DATA).collect()
    named = sorted((str(r.doc_id), next(k for k, t in texts.items() if t == r.text)) for r in found)
    assert [x for x in named if not x[1].startswith("tide")] == [("1", "fox"), ("5", "bread"), ("None", "rain")]
    assert len([x for x in named if x[1].startswith("tide")]) == 1
    same = docs.select("doc_id", "text", "lang", "source", "n_chars").where("text like 'low tide%'").withColumn("doc_id", corpus_pipeline.F.lit(6).cast("long"))
    assert len(corpus_pipeline.without_near_copies(spark, same, DATA).collect()) == 1


def test_secrets_are_masked(stages):
    def masked(text: str) -> str:
        out, at = "", 0
        for s, e, _ in near(text):
            if s >= at:
                out += text[at:s] + "<secret>"
            at = max(at, e)
        return out + text[at:]

    assert sorted((r.doc_id, r.text, r.n_chars) for r in stages[3]) == sorted((r.doc_id, masked(r.text), len(masked(r.text))) for r in stages[2])


def test_mix_takes_the_targets(stages):
    rows = stages[3]
    sizes: dict = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    target, want = shared(sizes), []
    for s in sizes:
        at, goal = 0, int(target[s])
        for _, r in sorted((place(r), r) for r in rows if r.source == s):
            words = WORD.findall(r.text)
            for i in range(mixing.CAP):
                take = min(len(words), max(0, goal - at - i * sizes[s]))
                if take:
                    want.append((r.doc_id, r.text if take == len(words) else " ".join(words[:take])))
            at += len(words)
    assert sorted((r.doc_id, r.text) for r in stages[4]) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in stages[4])


def test_packing_holds_every_token_once(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[4])
    assert sum(r.length for r in stages[5]) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and r.length & (r.length - 1) == 0 for r in stages[5])


def test_run_gives_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, DATA).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, found)) == sorted(map(key, stages[5]))


@pytest.mark.parametrize("i", range(1, 5))
def test_awkward_rows_pass_every_stage(spark, i):
    docs = awkward(spark).drop("fp", "key", "size", "label", "kind", "position")
    found = corpus_pipeline.STAGES[i][1](spark, docs, DATA).collect()
    if i == 1:
        assert sorted((r.doc_id, (r.text or "")[:4]) for r in found if r.doc_id is not None) == [(1, "One "), (3, ""), (6, "word"), (7, "the "), (8, "Größ")]
        assert len([r for r in found if r.doc_id is None]) == 1
    if i == 2:
        assert len(found) == 10
    if i == 3:
        assert all(re.search(r"\w", r.text) for r in found)


@pytest.mark.parametrize("i", range(4))
def test_columns_may_have_any_names(spark, i):
    docs = clashing(awkward(spark))
    found = corpus_pipeline.STAGES[i][1](spark, docs, DATA)
    assert found.columns == docs.columns
    rows = found.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING)


def test_empty_table_passes_every_stage(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert all(stage(spark, docs, DATA).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "secret scan", "mixing", "packing"]
