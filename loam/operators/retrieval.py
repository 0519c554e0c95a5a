"""Batch retrieval: query terms, candidate legs over one token index, rank fusion, lexical rerank, context selection.

queries (query_id, text ...), passages (chunk_id, article_id, text ...). Every list is ordered in full: ties go by chunk_id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import TOKEN, compress, fold, passage_key, tokens
from loam.operators.postings import entries, keyword_top
from loam.operators.vector_index import filed, fit_centres, probe
from loam.operators.vectors import collapse_copies
from loam.sources.tables import cut, written

# Words without retrieval signal. English ones count as typed, Vietnamese ones also without marks.
ENGLISH = (
    "a an and are as at be by can could do does for from give how i in is it list me my need of on or please provide show so some tell that the them there these this "
    "those to us use used using want we what when where which who why will with would you your"
).split()
VIETNAMESE = (
    "à ạ ai bạn bằng các cách cần cho chúng có của cung cấp danh dùng dụng gì giúp hãy khi không là làm liệt kê một muốn nào này nêu như những ở ra rằng sách sao sẽ sử "
    "thì tôi trong và vậy về với được đó để đưa"
).split()
POOL, IDENTIFIER_POOL, IDENTIFIERS, RRF, GRAPH_POOL = 240, 48, 8, 60.0, 30
IDENTIFIER_WEIGHT, PHRASE, DEFINED, REFERENCES, LINKS, REFERENCES_ELSEWHERE = 12.0, 0.35, 0.75, 1.0, 0.5, 0.25
ASSIST_RANK, ASSIST_SCORE, RELEVANT = 5, 0.4, 0.12
DEFINITION_QUERIES = ("what is", "what are", "define", "definition", "meaning", "explain", "la gi", "dinh nghia", "co nghia la", "giai thich", "khai niem")
REFERENCE_MARKS = ("references", "reference", "helpful documents", "sources", "bibliography", "tai lieu tham khao", "nguon tham khao", "http://", "https://", "www.")
DEFINES = r"\b(?:is|are|means|refers to|defined as|describes)\b|\b(?:la|duoc goi la|co nghia la|dung de chi|duoc dinh nghia la)\b"
COMPARISONS = ("so sanh", "khac nhau", "khac biet", "hay la", "nen chon", "compare", "comparison", "difference between", "differences between", "versus")


def _pool() -> tuple[list[str], list[str]]:
    import unicodedata

    bare = {"".join(c for c in unicodedata.normalize("NFD", w.replace("đ", "d")) if unicodedata.category(c) != "Mn") for w in VIETNAMESE}
    return ENGLISH, sorted(bare | set(VIETNAMESE))


# --- queries ---------------------------------------------------------------------------------------------------------
def query_terms(text: Column) -> Column:
    """Folded terms in order, of more than one character, without stop words."""
    english, vietnamese = _pool()
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    kept = F.filter(raw, lambda w: ~w.isin(*english) & ~fold(w).isin(*vietnamese) & (F.char_length(fold(w)) > 1))
    return F.transform(kept, fold)


def identifiers(text: Column) -> Column:
    """At most 8 names among a query's words (capitals, an inner underscore, digits with letters) that are terms too; none
    if four or more words are all so shaped."""
    words = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: w.rlike("[A-Za-z]"))
    shaped = F.filter(words, lambda w: (F.char_length(w) > 1) & (((w == F.upper(w)) & w.rlike("[A-Z]")) | F.regexp_replace(w, "^_+|_+$", "").contains("_") | w.rlike("[0-9]")))
    shouted = (F.size(shaped) == F.size(words)) & (F.size(words) >= 4)
    keys = F.array_distinct(F.filter(F.transform(shaped, lambda w: F.lower(F.regexp_replace(w, "^_+|_+$", ""))), lambda w: F.char_length(w) > 1))
    return F.when(shouted, F.array().cast("array<string>")).otherwise(F.filter(F.slice(keys, 1, IDENTIFIERS), lambda w: F.array_contains(query_terms(text), w)))


def is_definition(text: Column) -> Column:
    folded = F.regexp_replace(fold(text), r"\s+", " ")
    return F.exists(F.array(*(F.lit(m) for m in DEFINITION_QUERIES)), lambda m: F.contains(folded, m))


def routing(queries: DataFrame) -> DataFrame:
    """queries with comparison, subjects (at most 3) and deep (comparison or two question marks)."""
    folded = fold(F.col("text"))
    comparison = F.exists(F.array(*(F.lit(m) for m in COMPARISONS)), lambda m: F.contains(folded, m)) | F.col("text").rlike(r"(?i)\bvs\b")
    parts = F.filter(F.transform(F.split("text", r"(?i)\s+(?:và|va|and|hay|or|vs\.?|versus)\s+"), F.trim), lambda p: F.char_length(p) >= 2)
    subjects = F.when(F.size(parts) < 2, F.array(F.trim("text"))).otherwise(F.slice(parts, 1, 3))
    return queries.withColumn("comparison", comparison).withColumn("subjects", F.when(comparison, subjects)).withColumn("deep", comparison | (F.regexp_count("text", F.lit(r"\?")) >= 2))


# --- index and vocabulary --------------------------------------------------------------------------------------------
def token_index(passages: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(term, chunk_id, tf) of folded passages; counted in the tasks first. For one batch of queries ``only`` (term) keeps
    other words from being counted and shuffled at all; an index to store has all."""
    each = passages.select("chunk_id", F.explode(tokens(F.col("text"))).alias("term"))
    each = each if only is None else each.join(only.select("term").distinct(), "term", "left_semi")
    return each.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def vocabulary(passages: DataFrame) -> DataFrame:
    """(name, uses): capitalised names of 4 to 16 characters with the number of articles that use them."""
    names = passages.select("article_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])[A-Z][A-Z0-9_]{3,15}(?![\p{L}\p{N}_])"), F.lit(0))).alias("name")).distinct()
    return names.groupBy("name").agg(F.count("*").alias("uses"))


# Words that no spelled-out name holds.
_SKIPPED = frozenset("the a an of for is are was were what which how do does to in on and or i me my that this with by at from be can it its as if not no".split())


def abbreviates(core: str, words: list[str]) -> bool:
    """Whether the letters of ``core`` are, word by word, a beginning of the word or its first letter and later consonants."""

    def fits(piece: str, word: str) -> bool:
        if word.startswith(piece):
            return True
        if any(c in "aeiou" for c in piece[1:]):
            return False
        at = 0
        for c in piece:
            at = word.find(c, at) + 1
            if not at:
                return False
        return True

    # reached: how many letters may be used up after each word, with the length of the shortest part so far
    reached = {0}
    for i, word in enumerate(words):
        after = set()
        for start in reached:
            for end in range(start + 1, len(core) - (len(words) - i - 1) + 1):
                if core[start] != word[0]:
                    break
                lone = end - start == 1 and len(words) == 2 and len(core) - start - 1 < 3
                if not lone and fits(core[start:end], word):
                    after.add(end)
        reached = after
    return len(core) in reached


#: Letters of a core that deal it to a group, cores in a group, windows in a part of a group.
BEGINNING, CORES, WINDOWS = 3, 2048, 20_000


def _grown(states: set[tuple[int, int, int]], letter: str, words: list[str]) -> set[tuple[int, int, int]]:
    """Where a core read so far may stand in ``words``, one letter on. A state is the word's number, the letters used up of it
    if they are its beginning, the place after the last one if they are its first letter and consonants; 0 where they aren't."""
    after = set()
    for i, begun, at in states:
        word = words[i]
        more = begun + 1 if 0 < begun < len(word) and word[begun] == letter else 0
        place = word.find(letter, at) + 1 if at and letter not in "aeiou" else 0
        if more or place:
            after.add((i, more, place))
        if i + 1 < len(words) and words[i + 1][0] == letter:
            after.add((i + 1, 1, 1))
    return after


def beginnings(words: list[str], size: int = BEGINNING) -> set[str]:
    """The first ``size`` letters of all that abbreviates ``words``."""
    reached = {words[0][0]: {(0, 1, 1)}}
    letters = sorted(set("".join(words)))
    for _ in range(size - 1):
        longer = {text + c: _grown(states, c, words) for text, states in reached.items() for c in letters}
        reached = {text: states for text, states in longer.items() if states}
    return set(reached)


def _tree(cores: list[str]) -> dict:
    """Cores by letter; a core ends where "" stands."""
    root: dict = {}
    for core in cores:
        at = root
        for c in core:
            at = at.setdefault(c, {})
        at[""] = core
    return root


def abbreviations(words: list[str], tree: dict) -> list[str]:
    """Those cores of a tree, of five letters or more, that ``abbreviates`` finds in ``words``: only branches that a beginning of
    the words goes along are looked at."""
    found, open_ = [], [(tree[words[0][0]], {(0, 1, 1)})] if words[0][0] in tree else []
    last = len(words) - 1
    while open_:
        node, states = open_.pop()
        # of two words the second doesn't go by one letter
        if "" in node and any(i == last and (len(words) > 2 or begun > 1 or at > 1) for i, begun, at in states):
            found.append(node[""])
        for c, below in node.items():
            if c and (after := _grown(states, c, words)):
                open_.append((below, after))
    return found


def _matched(windows: DataFrame, cores: DataFrame) -> DataFrame:
    """(window, core) of distinct windows (window array<string>) and distinct cores (core), of five letters or more, that abbreviate them.

    Cores are dealt to groups by their beginning, and a window goes to the groups of the beginnings it can have; there it runs
    along the tree of the group's cores. So no pairs of windows and cores are made but those that match."""
    groups, tasks = max(1, cores.count() // CORES), int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")

    @F.pandas_udf("array<string>")
    def begun(window: pd.Series) -> pd.Series:
        return pd.Series([sorted(beginnings(list(w))) for w in window])

    # few bytes that take long: the number of tasks is given, as adaptive execution goes by bytes
    asked = cut(windows.repartition(tasks).select("window", F.explode(F.array_distinct(F.transform(begun("window"), group))).alias("group")))
    parts = asked.groupBy("group").agg(F.ceil(F.count("*") / F.lit(WINDOWS)).cast("int").alias("parts"))
    left = asked.join(parts, "group").select("group", F.pmod(F.xxhash64("window"), F.col("parts")).cast("int").alias("part"), "window")
    dealt = cores.select("core", group(F.substring("core", 1, BEGINNING)).alias("group")).join(parts, "group")
    right = dealt.select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "core")

    def task(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        tree = _tree(two.core.tolist())
        rows = [(w, core) for w in one.window for core in abbreviations(list(w), tree)]
        return pd.DataFrame(rows, columns=["window", "core"])

    left, right = (side.repartition(tasks, "group", "part").groupBy("group", "part") for side in (left, right))
    return left.cogroup(right).applyInPandas(task, "window array<string>, core string")


def aliases(queries: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, name, uses, rank): names that read as abbreviations of two or three neighbouring words of a query.

    Distinct windows of words meet distinct cores of names by their beginnings; queries that already name something get none.
    """
    named = F.exists(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: (F.regexp_replace(w, "^_+|_+$", "").contains("_") & w.rlike("[A-Za-z]")) | ((w == F.upper(w)) & w.rlike("([A-Z].*){5}")))
    words = F.transform(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0)), F.lower)
    each = queries.where(~named).select("query_id", words.alias("words"))
    spans = each.select("query_id", "words", F.explode(F.array(F.lit(2), F.lit(3))).alias("n")).where(F.size("words") >= F.col("n"))
    windows = spans.select("query_id", "words", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.slice("words", i, F.col("n")))).alias("window"))
    windows = cut(windows.where(~F.exists("window", lambda w: (F.char_length(w) < 2) | w.isin(*_SKIPPED))))
    cores = cut(names.withColumn("core", F.regexp_replace(F.lower(F.replace("name", F.lit("_"), F.lit(""))), "[0-9]+$", "")).where(F.char_length("core") >= 5).groupBy("core").agg(F.max(F.struct("uses", "name")).alias("b")))
    pairs = _matched(windows.select("window").distinct(), cores.select("core"))
    found = windows.join(pairs, "window").where(~F.array_contains("words", F.col("core"))).select("query_id", "core").distinct().join(cores, "core")
    order = Window.partitionBy("query_id").orderBy(F.desc("b.uses"), "b.name")
    return found.select("query_id", "b.name", "b.uses", F.row_number().over(order).alias("rank")).where(F.col("rank") <= most)


# --- legs: (query_id, chunk_id, rank), rank from 0 -------------------------------------------------------------------
def _top(scored: DataFrame, most: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "chunk_id"))
    return scored.withColumn("rank", rank - 1).where(F.col("rank") < most).select("query_id", "chunk_id", "rank")


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): a query's distinct terms, for the keyword leg; words without signal meet in every passage and stay out."""
    return queries.select("query_id", F.explode(F.array_distinct(query_terms(F.col("text")))).alias("term"))


def keyword_leg(terms: DataFrame, index: DataFrame, most: int = POOL) -> DataFrame:
    """Passages that hold any of a query's terms, by occurrences."""
    return _top(terms.join(index, "term").groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("score")), most, F.desc("score"))


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    starts = F.sequence(F.lit(1), F.char_length(text) - n + 1)
    return F.when(F.char_length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def titles_with(terms: DataFrame, titles: DataFrame) -> DataFrame:
    """(term, article_id) of distinct terms (term, of two characters or more) and titles (article_id, title) that contain
    them, folded. A term has no characters but those of words, so it lies inside one word of the title. The titles' distinct
    words are filed under those of their runs of three characters (two for terms of two) that some term has; a term meets
    them on its rarest run and is then looked for itself."""
    asked = terms.select("term").distinct()
    runs = asked.select("term", F.explode(F.when(F.char_length("term") > 2, _grams(F.col("term"), 3)).otherwise(_grams(F.col("term"), 2))).alias("gram"))
    worded = cut(titles.select("article_id", F.explode(F.array_distinct(tokens(F.col("title")))).alias("word")))
    every = worded.select("word").distinct().select("word", F.explode(F.concat(_grams(F.col("word"), 2), _grams(F.col("word"), 3))).alias("gram"))
    filed = cut(every.join(runs.select("gram").distinct(), "gram", "left_semi"))
    counts = filed.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = runs.join(counts, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("b"))
    met = rarest.select("term", F.col("b.gram").alias("gram")).join(filed, "gram").where(F.contains("word", F.col("term"))).select("term", "word")
    return met.join(worded, "word").select("term", "article_id").distinct()


def title_leg(terms: DataFrame, titles: DataFrame, passages: DataFrame, keyword: DataFrame, most: int = POOL) -> DataFrame:
    """Passages of articles (article_id, title) whose folded title contains a term, after those of the keyword leg."""
    met = terms.join(titles_with(terms, titles), "term").select("query_id", "article_id").distinct()
    new = met.join(passages.select("article_id", "chunk_id"), "article_id").join(keyword, ["query_id", "chunk_id"], "left_anti")
    found = keyword.groupBy("query_id").agg(F.count("*").alias("_n"))
    ranked = _top(new, most).join(found, "query_id", "left")
    return ranked.select("query_id", "chunk_id", (F.col("rank") + F.coalesce("_n", F.lit(0))).alias("rank")).where(F.col("rank") < most)


def identifier_leg(queries: DataFrame, index: DataFrame, most: int = IDENTIFIER_POOL) -> DataFrame:
    """Each identifier's own best passages, an even share of ``most``; those of more identifiers first, then by best rank."""
    asked = queries.select("query_id", identifiers(F.col("text")).alias("ids")).where(F.size("ids") > 0).select("query_id", F.ceil(F.lit(most) / F.size("ids")).alias("share"), F.explode("ids").alias("term"))
    order = Window.partitionBy("query_id", "term").orderBy(F.desc("tf"), "chunk_id")
    own = asked.join(index, "term").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("share"))
    return _top(own.groupBy("query_id", "chunk_id").agg(F.count("*").alias("names"), F.min("r").alias("r")), most, F.desc("names"), F.col("r"))


def names_within(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id): entities (company_domain, entity_id, normalized_name) whose whole name stands anywhere in a query
    (query_id, company_domain, q) of their tenant, inside words too. Empty names and rows without a tenant meet nothing.

    A name lies in a query only if each of its runs of three characters (the name itself, if shorter) does. The queries' runs
    are counted; a name with a run that no query of its tenant has goes at once, the others meet the queries that have
    their rarest run, and are then looked for themselves. So no name meets a query but over a run that few queries have.
    """
    cut_up = lambda c: F.array_union(F.array_union(_grams(c, 1), _grams(c, 2)), _grams(c, 3))
    asked = queries.where("company_domain is not null and q <> ''")
    filed = cut(asked.select("query_id", "company_domain", F.explode(cut_up(F.col("q"))).alias("gram")))
    counts = filed.groupBy("company_domain", "gram").agg(F.count("*").alias("df"))
    named = entities.where("company_domain is not null and normalized_name <> ''").select("company_domain", F.col("normalized_name").alias("name")).distinct()
    size = F.char_length("name")
    own = F.when(size > 2, _grams(F.col("name"), 3)).otherwise(F.array("name"))
    each = named.select("company_domain", "name", F.size(own).alias("n"), F.explode(own).alias("gram"))
    known = each.join(counts, ["company_domain", "gram"]).groupBy("company_domain", "name", "n").agg(F.count("*").alias("met"), F.min(F.struct("df", "gram")).alias("b"))
    rarest = known.where("met = n").select("company_domain", "name", F.col("b.gram").alias("gram"))
    pairs = rarest.join(filed, ["company_domain", "gram"]).join(asked.select("query_id", "company_domain", "q"), ["query_id", "company_domain"])
    hits = pairs.where(F.contains("q", F.col("name"))).select("query_id", "company_domain", "name")
    return hits.join(entities.select("company_domain", F.col("normalized_name").alias("name"), "entity_id"), ["company_domain", "name"]).select("query_id", "entity_id").distinct()


def graph_leg(queries: DataFrame, entities: DataFrame, relations: DataFrame, mentions: DataFrame, passages: DataFrame, most: int = GRAPH_POOL) -> DataFrame:
    """Passages of articles that mention entities named in a query or one hop from them, by the greatest mention count among
    those entities, then by their place in the article; each passage once, everything within the query's tenant.

    queries (query_id, company_domain, text), entities (company_domain, entity_id, normalized_name, mention_count), relations
    (company_domain, source, target), mentions (article_id, entity_id), passages (company_domain, chunk_id, article_id,
    chunk_index). Of an entity only the ``most`` articles whose first passages come first can have a passage among a
    query's ``most``, so a hub that half the corpus mentions costs no more than another entity.
    """
    asked = queries.select("query_id", "company_domain", fold(F.col("text")).alias("q"))
    seeds = names_within(asked, entities).join(asked.select("query_id", "company_domain"), "query_id")
    there = relations.select("company_domain", F.col("source").alias("entity_id"), F.col("target").alias("other"))
    hops = there.union(relations.select("company_domain", "target", "source"))
    near = seeds.select("query_id", "company_domain", "entity_id").union(seeds.join(hops, ["company_domain", "entity_id"]).select("query_id", "company_domain", F.col("other").alias("entity_id"))).distinct()
    near = cut(near.join(entities.select("company_domain", "entity_id", "mention_count"), ["company_domain", "entity_id"]))
    firsts = passages.groupBy("company_domain", "article_id").agg(F.min(F.struct("chunk_index", "chunk_id")).alias("first"))
    met = mentions.select("article_id", "entity_id").distinct().join(near.select("company_domain", "entity_id").distinct(), "entity_id").join(firsts, ["company_domain", "article_id"])
    place = F.row_number().over(Window.partitionBy("company_domain", "entity_id").orderBy("first"))
    few = met.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")
    articles = near.join(few, ["company_domain", "entity_id"]).groupBy("query_id", "company_domain", "article_id", "first").agg(F.max("mention_count").alias("count"))
    order = Window.partitionBy("query_id").orderBy(F.desc("count"), "first")
    best = articles.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("query_id", "company_domain", "article_id", "count")
    return _top(best.join(passages, ["company_domain", "article_id"]), most, F.desc("count"), F.col("chunk_index"))


def fused(*legs: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rrf, rank): reciprocal ranks summed over the legs, ranks from 0."""
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    summed = every.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (F.lit(RRF) + F.col("rank"))).alias("rrf"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "chunk_id")) - 1
    return summed.withColumn("rank", rank)


def merged_wordings(*searches: DataFrame) -> DataFrame:
    """Results (query_id, chunk_id, score) of several wordings: each passage once, with its best score."""
    every = searches[0]
    for other in searches[1:]:
        every = every.unionByName(other)
    return every.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def merged_aliases(ordinary: DataFrame, extended: DataFrame, keep: int = 2, insert: int = 3) -> DataFrame:
    """(query_id, chunk_id, place) of two ranked lists (query_id, chunk_id, rank from 0): the first ``keep`` ordinary
    ones, at most ``insert`` that only the extended search found, the other ordinary ones, the other extended ones."""
    both = ordinary.select("query_id", "chunk_id", F.col("rank").alias("o")).join(extended.select("query_id", "chunk_id", F.col("rank").alias("e")), ["query_id", "chunk_id"], "full")
    new = F.when(F.col("o").isNull(), F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("o").isNotNull(), "e")))
    group = F.when(F.col("o") < keep, 0).when(F.col("o").isNull() & (F.col("new") <= insert), 1).when(F.col("o").isNotNull(), 2).otherwise(3)
    order = Window.partitionBy("query_id").orderBy("group", F.coalesce("o", "e"))
    return both.withColumn("new", new).withColumn("group", group).select("query_id", "chunk_id", (F.row_number().over(order) - 1).alias("place"))


# --- rerank ----------------------------------------------------------------------------------------------------------
def rerank(queries: DataFrame, pool: DataFrame, vector: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, place) of candidate pools (query_id, chunk_id, rank, text).

    Share of the query's findable terms, names weighing 1 + 11 ln(N / df) / ln N; bonus for the query as a phrase; for
    questions of definition bonus and penalties by the passage's shape. ``vector`` (query_id, chunk_id, rank from 1) lifts
    its first five to 0.4. Everything is within one query's pool.
    """
    asked = queries.select("query_id", query_terms(F.col("text")).alias("list"), identifiers(F.col("text")).alias("names"), is_definition(F.col("text")).alias("define"))
    asked = asked.withColumn("phrase", F.array_join("list", " ")).withColumn("terms", F.array_distinct("list"))
    joined = pool.join(asked, "query_id").withColumn("passage", fold(F.col("text"))).withColumn("words", tokens(F.col("text")))
    joined = joined.withColumn("found", F.array_intersect("terms", "words")).select("query_id", "chunk_id", "rank", "terms", "names", "define", "phrase", "passage", F.array_join("words", " ").alias("run"), "found")
    per = joined.select("query_id", "chunk_id", F.explode("found").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df"))
    sizes = pool.groupBy("query_id").agg(F.count("*").alias("size"))
    known = per.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    joined = joined.join(sizes, "query_id").join(known, "query_id", "left")
    findable = F.filter("terms", lambda t: F.coalesce(F.map_contains_key("df", t), F.lit(False)))
    scored_terms = F.when(F.size(findable) > 0, findable).otherwise(F.col("terms"))
    named = F.filter("names", lambda n: F.array_contains(F.col("scored"), n))

    def extra(name: Column) -> Column:
        df = F.least(F.greatest(F.coalesce(F.try_element_at(F.col("df"), name), F.lit(1)), F.lit(1)), F.col("size"))
        return F.when(F.col("size") < 2, F.lit(IDENTIFIER_WEIGHT - 1)).otherwise(F.lit(IDENTIFIER_WEIGHT - 1) * F.ln(F.col("size") / df) / F.ln("size"))

    total = lambda names: F.aggregate(names, F.lit(0.0), lambda s, n: s + extra(n))
    joined = joined.withColumn("scored", scored_terms).withColumn("named", named)
    hits = F.size(F.array_intersect("scored", "found")) + total(F.filter("named", lambda n: F.array_contains("found", n)))
    base = hits / F.greatest(F.size("scored") + total(F.col("named")), F.lit(1.0))
    phrase = F.when((F.char_length("phrase") > 2) & F.contains("run", F.col("phrase")), PHRASE).otherwise(0.0)
    refers = F.exists(F.array(*(F.lit(m) for m in REFERENCE_MARKS)), lambda m: F.contains(F.col("passage"), m))
    shape = F.when(F.col("define"), F.when(F.col("passage").rlike(DEFINES), DEFINED).otherwise(0.0) - F.when(refers, REFERENCES).otherwise(0.0) - F.when(F.regexp_count("passage", F.lit(r"https?://|www\.")) >= 2, LINKS).otherwise(0.0)).otherwise(F.when(refers, -REFERENCES_ELSEWHERE).otherwise(0.0))
    scored = joined.select("query_id", "chunk_id", "rank", F.round(base + phrase + shape, 9).alias("score"))
    if vector is not None:
        near = vector.where(F.col("rank") <= ASSIST_RANK).select("query_id", "chunk_id", F.lit(ASSIST_SCORE).alias("_floor"))
        scored = scored.join(near, ["query_id", "chunk_id"], "left").withColumn("score", F.greatest("score", "_floor")).drop("_floor")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("place", F.row_number().over(order) - 1).drop("rank")


def promoted(ranked: DataFrame, second: DataFrame, vector: DataFrame, lexical: int = 10, near: int = 5, top: int = 3, sure: float = 0.05, floor: float = ASSIST_SCORE) -> DataFrame:
    """Second-stage order of (query_id, chunk_id, score, place): the first ``lexical`` and the ``near`` best by vector go
    first by the probability in ``second`` (query_id, chunk_id, probability); the first three, if sure, score 0.4 at
    least; the rest follow as they were."""
    close = Window.partitionBy("query_id").orderBy(F.col("v").asc_nulls_last(), "place")
    both = ranked.join(vector.select("query_id", "chunk_id", F.col("rank").alias("v")), ["query_id", "chunk_id"], "left")
    chosen = both.withColumn("_c", (F.col("place") < lexical) | (F.col("v").isNotNull() & (F.row_number().over(close) <= near)))
    scored = chosen.join(second, ["query_id", "chunk_id"], "left").withColumn("_p", F.when(F.col("_c"), F.coalesce("probability", F.lit(0.0))))
    head = F.row_number().over(Window.partitionBy("query_id", "_c").orderBy(F.desc("_p"), "place"))
    lifted = F.when(F.col("_c") & (head <= top) & (F.col("_p") >= sure), F.greatest("score", F.lit(floor))).otherwise(F.col("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("_c"), F.desc_nulls_last("_p"), "place")
    return scored.select("query_id", "chunk_id", lifted.alias("score"), (F.row_number().over(order) - 1).alias("place"))


def legs(queries: DataFrame, passages: DataFrame, titles: DataFrame, vector: DataFrame | None = None, graph: DataFrame | None = None, index: DataFrame | None = None, postings: str | None = None) -> DataFrame:
    """All legs fused: keyword with title, identifier, and if given vector (rank from 1) and graph (rank from 0). Words are looked up
    in the stored index at ``postings``, in ``index`` (term, chunk_id, tf), or counted for this batch."""
    terms = cut(asked_terms(queries))
    if postings is not None:
        spark = queries.sparkSession
        keyword = cut(keyword_top(spark, postings, terms))
        named = queries.select(F.explode(identifiers(F.col("text"))).alias("term"))
        index = entries(spark, postings, cut(named))
    else:
        index = cut(token_index(passages, terms)) if index is None else index
        keyword = cut(keyword_leg(terms, index))
    found = [keyword.unionByName(title_leg(terms, titles, passages, keyword)), identifier_leg(queries, index)]
    if vector is not None:
        found.append(vector.select("query_id", "chunk_id", (F.col("rank") - 1).alias("rank")))
    if graph is not None:
        found.append(graph.select("query_id", "chunk_id", "rank"))
    return fused(*found)


def search(
    queries: DataFrame, passages: DataFrame, titles: DataFrame, limit: int | None = 10, vector: DataFrame | None = None, graph: DataFrame | None = None,
    index: DataFrame | None = None, readers: DataFrame | None = None, vectors: DataFrame | None = None, collapse: bool = True, postings: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, gaps): all legs fused, reranked, cut at 0.12, copies across articles collapsed, what a query's reader may
    not see left out, and only then cut at ``limit``; queries without a result are gaps.

    results (query_id, chunk_id, score, place, also_in). titles (article_id, title, dept); readers (query_id, dept): the
    departments a query may read, all if not given. vectors (chunk_id, embedding) let near copies collapse too; equal
    passage keys always do. A list has at most the legs' pools, some hundreds of rows.
    """
    # stored, so that Spark knows how small it is and moves no other passage's text
    pool = written(legs(queries, passages, titles, vector, graph, index, postings)).join(passages.select("chunk_id", "article_id", "text"), "chunk_id")
    if readers is not None:
        # checked before copies collapse, so a hidden copy never stands for a visible one
        pool = pool.join(titles.select("article_id", "dept"), "article_id").join(readers.select("query_id", "dept").distinct(), ["query_id", "dept"], "left_semi")
    pool = cut(pool.select("query_id", "chunk_id", "article_id", "rrf", "rank", "text"))
    ranked = rerank(queries, pool, vector).where(F.col("score") >= RELEVANT)
    if collapse:
        listed = ranked.join(pool.select("query_id", "chunk_id", "article_id", "text"), ["query_id", "chunk_id"])
        listed = listed.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left") if vectors is not None else listed.withColumn("embedding", F.lit(None).cast("array<double>"))
        listed = listed.select("query_id", F.col("place").alias("position"), "chunk_id", "article_id", passage_key(F.col("text")).alias("key"), F.char_length("text").alias("n_chars"), "score", "embedding", F.lit(0.0).alias("updated"))
        ranked = collapse_copies(listed).select("query_id", "chunk_id", "score", "place", "also_in")
    else:
        ranked = ranked.withColumn("also_in", F.array().cast("array<long>"))
    results = ranked if limit is None else ranked.where(F.col("place") < limit)
    return results, queries.select("query_id").join(results, "query_id", "left_anti")


# --- context ---------------------------------------------------------------------------------------------------------
def parents(results: DataFrame) -> DataFrame:
    """(query_id, parent_id, chunk_id, score, children): the best child of each parent, all its child ids sorted.

    results (query_id, parent_id, chunk_id, score).
    """
    return results.groupBy("query_id", "parent_id").agg(F.max_by("chunk_id", F.struct("score", -F.col("chunk_id"))).alias("chunk_id"), F.max("score").alias("score"), F.array_sort(F.collect_set("chunk_id")).alias("children"))


CONTEXT = "query_id long, parent_id long, article_id long, score double, label string, context string"


def select_context(parents_: DataFrame, least: float = 0.35, per_article: int = 15, most: int = 40, chars: int = 70_000, tokens_: int = 17_500, cut: int = 4000) -> DataFrame:
    """Labelled context of each query from (query_id, parent_id, article_id, score, text): best first, at most
    ``most`` parents, an article's share capped, character and token budgets. A parent that doesn't fit is passed over
    and smaller ones may follow, so the fold runs in order within a query's list."""
    wide = parents_.withColumn("text", compress(F.col("text"), cut)).where((F.col("text") != "") & F.col("score").isNotNull())

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        cap = max(per_article, math.ceil(most / frame.article_id.nunique()))
        used, size, spent, out = {}, 0, 0, []
        for row in frame.sort_values(["score", "parent_id"], ascending=[False, True]).itertuples(index=False):
            own = max(1, (len(row.text) + 3) // 4)
            if row.score < least or used.get(row.article_id, 0) >= cap or (size and (size + len(row.text) > chars or spent + own > tokens_)):
                continue
            out.append((row.query_id, row.parent_id, row.article_id, row.score, f"C{len(out) + 1}", row.text))
            used[row.article_id] = used.get(row.article_id, 0) + 1
            size, spent = size + len(row.text), spent + own
            if len(out) == most:
                break
        return pd.DataFrame(out, columns=[c.split()[0] for c in CONTEXT.split(", ")])

    return wide.select("query_id", "parent_id", "article_id", "score", "text").groupBy("query_id").applyInPandas(task, CONTEXT)


def as_of(results: DataFrame, validity: DataFrame, decisions: DataFrame, day: Column) -> DataFrame:
    """results (query_id, article_id, place) with bucket and new place: in force on ``day`` (0), undated (1), not in
    force (2), otherwise in the old order. validity (article_id, issued, expires); decisions (article_id, kept): a decision
    for ``kept`` ends the other's validity the day before the kept one was issued."""
    ends = decisions.where("article_id <> kept").join(validity.select(F.col("article_id").alias("kept"), "issued"), "kept").where("issued is not null")
    ends = ends.groupBy("article_id").agg(F.min(F.date_sub("issued", 1)).alias("_end"))
    known = validity.join(ends, "article_id", "full").select("article_id", "issued", F.least("expires", "_end").alias("expires"))
    joined = results.join(known, "article_id", "left")
    bucket = F.when(F.col("issued").isNull() & F.col("expires").isNull(), 1).when((F.col("issued") > day) | (F.col("expires") < day), 2).when(F.col("issued").isNotNull(), 0).otherwise(1)
    order = Window.partitionBy("query_id").orderBy("bucket", "place")
    return joined.withColumn("bucket", bucket).select("query_id", "article_id", "bucket", (F.row_number().over(order) - 1).alias("place"))


def without_superseded(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """results (query_id, article_id, ...) without articles for which the kept one of a decision is in the same list."""
    lost = decisions.where("article_id <> kept")
    present = lost.join(results.select("query_id", F.col("article_id").alias("kept")).distinct(), "kept").select("query_id", "article_id").distinct()
    return results.join(present, ["query_id", "article_id"], "left_anti")


def page_evidence(citations: DataFrame, evidence: DataFrame, per_citation: int = 2, total: int = 4) -> DataFrame:
    """(query_id, position, evidence_id): evidence of cited pages, tables and figures before the page's image (dropped if
    one of those is there), each once an answer, with caps for a citation and for an answer."""
    kind = F.when(F.col("kind") == "page_visual", 1).otherwise(0)
    met = citations.join(evidence, ["article_id", "page_number"]).withColumn("_image", kind)
    least = F.min("_image").over(Window.partitionBy("query_id", "position"))
    met = met.withColumn("_least", least).where(F.col("_image") == F.col("_least"))
    once = met.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "evidence_id").orderBy("position"))).where("_n = 1")
    each = once.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "position").orderBy("_image", "evidence_id"))).where(F.col("_r") <= per_citation)
    all_ = each.withColumn("_t", F.row_number().over(Window.partitionBy("query_id").orderBy("position", "_r"))).where(F.col("_t") <= total)
    return all_.select("query_id", "position", "evidence_id")


def ambiguous_departments(results: DataFrame, top: int = 5, margin: float = 0.85) -> DataFrame:
    """(query_id, departments): departments near the top score among the first results, where there is more than one."""
    first = results.where((F.col("place") < top) & F.col("dept").isNotNull())
    best = Window.partitionBy("query_id")
    near = first.withColumn("_top", F.max("score").over(best)).withColumn("_n", F.count("*").over(best)).where((F.col("_n") >= 2) & (F.col("_top") > 0) & (F.col("score") >= F.col("_top") * margin))
    per = near.groupBy("query_id", "dept").agg(F.min(F.struct((-F.col("score")).alias("s"), "place")).alias("o"))
    lists = per.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "dept"))), lambda x: x["dept"]).alias("departments"))
    return lists.where(F.size("departments") > 1)


def related_articles(articles: DataFrame, tags: DataFrame, most: int = 6) -> DataFrame:
    """(article_id, related, rank): articles of the same department, domain or tag, newest first: three equal joins over
    the newest ``most`` + 1 of each key, united; never one join on alternatives.

    articles (article_id, dept, domain, created_at), tags (article_id, tag).
    """
    def by(key: str, keyed: DataFrame) -> DataFrame:
        newest = Window.partitionBy(key).orderBy(F.desc("created_at"), "article_id")
        few = keyed.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most + 1).select(key, F.col("article_id").alias("related"), F.col("created_at").alias("at"))
        return keyed.select("article_id", key).join(few, key).select("article_id", "related", "at")

    dated = articles.select("article_id", "created_at")
    pairs = by("dept", articles.select("article_id", "dept", "created_at")).union(by("domain", articles.select("article_id", "domain", "created_at"))).union(by("tag", tags.join(dated, "article_id")))
    distinct = pairs.where("article_id <> related").distinct()
    order = Window.partitionBy("article_id").orderBy(F.desc("at"), "related")
    return distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("article_id", "related", "rank")


def listing(articles: DataFrame, contains: str | None, page: int, size: int, **equal: str) -> DataFrame:
    """One page of articles in a total order (newest, then id) with the total of the same predicate."""
    rows = articles
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    if contains:
        rows = rows.where(F.contains(fold(F.col("title")), fold(F.lit(contains))))
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(F.desc("created_at"), "article_id").offset(page * size).limit(size)
    return shown.join(F.broadcast(total))  # one row


def coverage(hits: DataFrame, least: float = 0.35) -> DataFrame:
    """By question and sub-question (question_id, sub_id, score): hits, best score and whether it is covered."""
    per = hits.groupBy("question_id", "sub_id").agg(F.count("score").alias("hits"), F.max("score").alias("best"))
    return per.withColumn("covered", F.coalesce(F.col("best") >= least, F.lit(False)))


def retried(subs: DataFrame, hits: DataFrame, again: DataFrame, least: float = 0.35) -> DataFrame:
    """Hits of all sub-questions: those that ``hits`` doesn't cover get what the search without filters found as well, each
    passage once with its best score. subs (question_id, sub_id); hits, again (question_id, sub_id, chunk_id, score)."""
    keys = ["question_id", "sub_id"]
    covered = coverage(hits, least).where("covered").select(*keys)
    more = again.join(subs.join(covered, keys, "left_anti"), keys, "left_semi")
    return hits.unionByName(more).groupBy(*keys, "chunk_id").agg(F.max("score").alias("score"))


def document_scopes(articles: DataFrame, digests: DataFrame, questions: DataFrame, chunks: DataFrame, most: int = 120, centres: np.ndarray | None = None, probes: int | None = None, places: int | None = None) -> DataFrame:
    """(question_id, article_id, cosine, first_chunk, place, total, with_digest, without_digest): for each question the ``most``
    documents with a ready digest that lie nearest to it, digests without a vector last, then the newest first.

    articles (article_id, created_at); digests (article_id, vector, status, summary), of which those with status ready and a
    summary count; questions (question_id, vector); chunks (article_id, chunk_index, chunk_id, evidence): the first chunk that
    is no evidence stands for a document. The totals are of all articles. Digests are looked up in the lists of ``centres``,
    of which ``probes`` are looked through, by default all. Where many tie at the end of a list the smaller ids stay.
    With ``places`` cosines are rounded to so many places before they are compared.
    """
    ready = digests.where((F.col("status") == "ready") & (F.coalesce(F.trim("summary"), F.lit("")) != "")).join(articles, "article_id").select("article_id", "created_at", F.col("vector").cast("array<double>").alias("vector"))
    ready = cut(ready)
    known = ready.select("article_id", F.col("article_id").alias("chunk_id"), "vector")
    centres = fit_centres(known) if centres is None else centres
    near = probe(questions.select(F.col("question_id").alias("query_id"), "vector"), filed(known, centres), centres, most, 2.1, probes, places=places)
    cosine = 1 - F.col("distance") if places is None else F.round(1 - F.col("distance"), places)
    near = near.select(F.col("query_id").alias("question_id"), F.col("chunk_id").alias("article_id"), cosine.alias("cosine"))
    # at most ``most`` rows, the same for every question
    plain = ready.where("vector is null").orderBy(F.desc("created_at"), "article_id").limit(most).select("article_id", F.lit(None).cast("double").alias("cosine"))
    every = near.unionByName(questions.select("question_id").join(F.broadcast(plain), F.lit(True))).join(articles.select("article_id", "created_at"), "article_id")
    order = Window.partitionBy("question_id").orderBy(F.col("cosine").desc_nulls_last(), F.desc("created_at"), "article_id")
    listed = every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    first = chunks.where(~F.col("evidence")).groupBy("article_id").agg(F.min_by("chunk_id", "chunk_index").alias("first_chunk"))
    totals = articles.agg(F.count("*").alias("total")).join(ready.agg(F.count("*").alias("with_digest")))  # one row
    full = listed.join(first, "article_id", "left").join(F.broadcast(totals))
    return full.select("question_id", "article_id", "cosine", "first_chunk", "place", "total", "with_digest", (F.col("total") - F.col("with_digest")).alias("without_digest"))


def token_batches(documents: DataFrame, budget: int = 6000) -> DataFrame:
    """(question_id, article_id, batch): documents (question_id, place, article_id, tokens) in greedy batches in order."""

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        batch, used, out = 0, 0, []
        for row in frame.sort_values("place").itertuples(index=False):
            if used and used + row.tokens > budget:
                batch, used = batch + 1, 0
            used += row.tokens
            out.append((row.question_id, row.article_id, batch))
        return pd.DataFrame(out, columns=["question_id", "article_id", "batch"])

    return documents.groupBy("question_id").applyInPandas(task, "question_id long, article_id long, batch int")
