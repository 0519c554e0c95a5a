"""Text functions and document preparation on ``documents``, ``pages``, ``conversations`` and ``embeddings``."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.operators import indexing as ix
from loam.operators import prepare as p
from loam.plans.registry import query
from loam.sources.tables import shared_folder, spread, table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: A page is three lines of a document.
PAGES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
pages AS (SELECT doc_id, CAST(pos // 3 + 1 AS INTEGER) AS page_number, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines GROUP BY 1, 2)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("l"))
    starts = each.select("doc_id", "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 3).cast("int"))).alias("i"))
    return starts.select("doc_id", (F.col("i") + 1).alias("page_number"), F.array_join(F.slice("l", F.col("i") * 3 + 1, F.lit(3)), "\n").alias("text"))


FOLDED = "replace(strip_accents(lower(text)), 'đ', 'd')"


@query("t1_clean", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(0), ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents""")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.clean(F.col("text")).alias("text"))


KEY = r"regexp_replace(lower(trim(regexp_replace(trim(line), '\s+', ' ', 'g'))), '[0-9]+', '#', 'g')"
BOILERPLATE = rf"""{PAGES}, sizes AS (SELECT doc_id, count(*) AS n FROM pages WHERE trim(text, ' ' || chr(10)) <> '' GROUP BY 1),
keys AS (SELECT DISTINCT doc_id, pos // 3 AS page, {KEY} AS line_key FROM lines WHERE trim(line) <> '' AND length(trim(line)) <= 120),
noise AS (SELECT doc_id, line_key FROM keys JOIN sizes USING (doc_id) WHERE line_key <> '' GROUP BY doc_id, line_key, n HAVING count(*) >= greatest(3, ceil(n * 0.6 - 1e-9)))"""


@query("t2_boilerplate", f"WITH {BOILERPLATE} SELECT doc_id, line_key FROM noise")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.boilerplate(pages(spark, sf_dir))


#: Page labels and rows of dots.
NOISE = r"""regexp_matches(trim(line), '(?i)^[-–—|(\[]*\s*(?:(?:trang|page|pg|p)\s*\.?\s*)?[0-9]+(?:\s*(?:/|\\|of|tren|trên|-|–|—)\s*[0-9]+)?\s*[-–—|)\]]*$') OR regexp_matches(trim(line), '[.·•…]{4,}\s*[0-9]+\s*$')"""


@query("t3_strip_noise", rf"""
WITH {BOILERPLATE}, dn AS (SELECT DISTINCT doc_id FROM noise),
kl AS (SELECT l.doc_id, CAST(pos // 3 + 1 AS INTEGER) AS page_number, pos, line FROM lines l JOIN dn ON dn.doc_id = l.doc_id
  WHERE trim(line) = '' OR NOT ({NOISE} OR EXISTS (SELECT 1 FROM noise n WHERE n.doc_id = l.doc_id AND n.line_key = regexp_replace(lower(trim(regexp_replace(trim(line), '\s+', ' ', 'g'))), '[0-9]+', '#', 'g')))),
kp AS (SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY pos) AS t FROM kl GROUP BY 1, 2),
np AS (SELECT p.doc_id, p.page_number, p.text, CASE WHEN dn.doc_id IS NULL THEN p.text ELSE regexp_replace(regexp_replace(coalesce(t, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') END AS new
  FROM pages p LEFT JOIN dn ON dn.doc_id = p.doc_id LEFT JOIN kp ON kp.doc_id = p.doc_id AND kp.page_number = p.page_number)
SELECT doc_id, page_number, CASE WHEN max(CASE WHEN trim(new) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) = 1 THEN new ELSE text END AS text FROM np""")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.strip_noise(pages(spark, sf_dir)).select("doc_id", "page_number", "text")


@query("t4_sections", r"""
WITH parts AS (SELECT doc_id, unnest(regexp_split_to_array('## ' || replace(text, '. ', chr(10) || '## '), '\n## ')) AS s, generate_subscripts(regexp_split_to_array('## ' || replace(text, '. ', chr(10) || '## '), '\n## '), 1) - 1 AS i FROM documents),
heads AS (SELECT doc_id, i, CASE WHEN i = 0 THEN s ELSE '## ' || s END AS s FROM parts),
named AS (SELECT *, string_split(ltrim(s, ' ' || chr(10) || chr(9)), chr(10))[1] AS first FROM heads)
SELECT doc_id, CAST(i AS INTEGER) AS section, CASE WHEN trim(regexp_replace(trim(first), '^#+', '')) <> '' THEN substr(trim(regexp_replace(trim(first), '^#+', '')), 1, 255) ELSE 'Section ' || CAST(i + 1 AS VARCHAR) END AS section_ref,
  length(CASE WHEN position(chr(10) IN ltrim(s, ' ' || chr(10) || chr(9))) > 0 THEN substr(ltrim(s, ' ' || chr(10) || chr(9)), position(chr(10) IN ltrim(s, ' ' || chr(10) || chr(9))) + 1) ELSE '' END) AS chars
FROM named""")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("## "), F.replace("text", F.lit(". "), F.lit("\n## "))).alias("body"))
    return p.sections(bodies).select("doc_id", "section", "section_ref", F.char_length("text").cast("long").alias("chars"))


def made_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.passages(p.sections(spread(docs(spark, sf_dir)).select("doc_id", F.col("text").alias("body"))))


@query("t5_t6_passages")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_passages(spark, sf_dir)


@query("t7_match_pages", rf"""
WITH {PAGES}, w AS (SELECT doc_id, page_number, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_''-]+') AS t FROM pages),
p AS (SELECT doc_id, page_number, list_distinct(t) AS s, array_to_string(t, ' ') AS run FROM w WHERE len(t) > 0),
c AS (SELECT doc_id, pos AS chunk_id, regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}_''-]+') AS t FROM lines),
k AS (SELECT doc_id, chunk_id, list_distinct(t) AS s, array_to_string(t[1:24], ' ') AS preview FROM c WHERE len(t) > 0),
m AS (SELECT k.doc_id, chunk_id, page_number, len(list_intersect(k.s, p.s)) / least(len(k.s), 80) + CASE WHEN length(preview) >= 24 AND contains(run, preview) THEN 0.75 ELSE 0 END AS score FROM k JOIN p ON k.doc_id = p.doc_id),
b AS (SELECT doc_id, chunk_id, page_number FROM m WHERE score >= 0.12 QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY score DESC, page_number) = 1)
SELECT c.doc_id, CAST(c.chunk_id AS INTEGER) AS chunk_id, b.page_number FROM c LEFT JOIN b ON c.doc_id = b.doc_id AND c.chunk_id = b.chunk_id""")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_id", "text"))
    return p.match_pages(chunks, pages(spark, sf_dir))


@query("t8_reuse_vectors", rf"""
WITH {PAGES}, h AS (SELECT doc_id, pos, sha256(line) AS hash FROM lines), old AS (SELECT DISTINCT doc_id, hash FROM h WHERE pos % 3 <> 0)
SELECT h.doc_id, CAST(pos AS INTEGER) AS child_index, h.hash AS content_hash, old.hash IS NULL AS to_embed FROM h LEFT JOIN old ON h.doc_id = old.doc_id AND h.hash = old.hash""")
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("child_index", "text"))
    stored = children.where("child_index % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit("v1").alias("embedding_version"), F.array(F.lit(1.0)).alias("embedding"))
    return p.reuse_vectors(children, stored, "v1").select("doc_id", "child_index", "content_hash", "to_embed")


def articles(spark: SparkSession, sf_dir: str, body: Column | None = None) -> DataFrame:
    """Documents as articles: every tenth a draft, every thirteenth retired."""
    key, text = F.col("doc_id"), F.col("text") if body is None else body
    return spread(docs(spark, sf_dir)).select("doc_id", text.alias("body"), F.when(key % 10 == 0, "draft").otherwise("published").alias("status"), F.when(key % 13 == 0, "retired").otherwise("active").alias("lifecycle_status"), F.col("source").alias("dept"), F.lit("internal").alias("sensitivity"), F.lit("company").alias("visibility"))


SHOWN = ("doc_id", "section", "parent_index", "child_index", "chunk_type", "heading", "page_number", "content_hash", "to_embed", "dept", "sensitivity", "visibility")


@query("t9_index_build")
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.index_build(articles(spark, sf_dir), pages(spark, sf_dir)).select(*SHOWN)


@query("t9_index_upkeep", """
WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 13 <> 0 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')
SELECT doc_id, doc_id % 7 = 0 AS changed FROM a WHERE doc_id % 11 <> 0""")
def t9_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index brought up to changes: every seventh article has a new first line, every eleventh is retired. Which articles it holds,
    and which of them have a passage of the new line."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    ix.index_upkeep(spark, path, articles(spark, sf_dir), pages(spark, sf_dir))
    key = F.col("doc_id")
    later = articles(spark, sf_dir, F.when(key % 7 == 0, F.concat(F.lit("a line that is new\n\n"), "text")).otherwise(F.col("text"))).withColumn("lifecycle_status", F.when(key % 11 == 0, "retired").otherwise(F.col("lifecycle_status")))
    ix.index_upkeep(spark, path, later, pages(spark, sf_dir))
    return spark.read.parquet(path).groupBy("doc_id").agg(F.bool_or(F.contains("child_text", F.lit("a line that is new"))).alias("changed"))


@query("t10_review_ranges", rf"""
WITH RECURSIVE {PAGES}, b AS (SELECT doc_id, source AS title, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
c AS (SELECT doc_id, 0 AS position, 0 AS a, 0 AS e, 0 AS nxt FROM b WHERE t <> ''
  UNION ALL SELECT doc_id, position + 1, nxt, stop, stop + length(substr(t, stop + 1)) - length(regexp_replace(substr(t, stop + 1), '^\s+', '')) FROM (
    SELECT doc_id, position, nxt, t, CASE WHEN nxt + 4000 < length(t) AND contains(h, chr(10)) AND 4000 - position(chr(10) IN reverse(h)) > 2000 THEN nxt + 4000 - position(chr(10) IN reverse(h)) ELSE least(nxt + 4000, length(t)) END AS stop
    FROM (SELECT c.doc_id, position, nxt, t, substr(t, nxt + 1, 4000) AS h FROM c JOIN b ON b.doc_id = c.doc_id WHERE nxt < length(t)) x) y),
r AS (SELECT c.doc_id, position, title, a, e, regexp_replace(substr(t, a + 1, e - a), '^\s+|\s+$', '', 'g') AS body FROM c JOIN b ON b.doc_id = c.doc_id WHERE position > 0),
g AS (SELECT *, nullif(substr(regexp_replace(regexp_extract(body, '(?m)^\s*(#{{1,6}}\s+\S.*?)\s*$', 1), '^#+\s*', ''), 1, 255), '') AS heading FROM r),
pl AS (SELECT doc_id, page_number, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page_number) AS p1, length(text) AS n FROM pages),
m AS (SELECT g.doc_id, position, min(page_number) AS page_start, max(page_number) AS page_end FROM g JOIN pl ON pl.doc_id = g.doc_id AND e > p1 - n AND a < p1 GROUP BY 1, 2)
SELECT g.doc_id, g.position, coalesce(heading, substr(title || ' — part ' || CAST(g.position AS VARCHAR), 1, 255)) AS title, body, a AS source_start, e AS source_end, heading, page_start, page_end FROM g LEFT JOIN m ON m.doc_id = g.doc_id AND m.position = g.position""")
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = spread(docs(spark, sf_dir)).select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    return p.range_pages(p.review_ranges(bodies, 4000), pages(spark, sf_dir))


@query("t11_splitter_report", """
SELECT count(*) AS documents, CAST(sum(1 + CASE WHEN length(text) > 2000 THEN 1 ELSE 0 END) AS BIGINT) AS pieces, count(*) FILTER (doc_id % 5 = 0) AS corrections,
  count(*) FILTER (doc_id % 5 = 0) / count(*) AS correction_share FROM documents""")
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = docs(spark, sf_dir)
    bodies = base.select("doc_id", F.concat(F.lit("# Heading "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("body"))
    lost = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("# Heading "), F.col("doc_id").cast("string"), F.lit("\n")))
    pieces = base.select("doc_id", F.concat(lost, F.substring("text", 1, 2000)).alias("body")).union(base.where(F.char_length("text") > 2000).select("doc_id", F.expr("substring(text, 2001)").alias("body")))
    return p.splitter_report(bodies, pieces)


#: Every fourth line of a document starts as a heading, every ninth is a fence.
MARKDOWN = """lines AS (SELECT doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) - 1 AS pos FROM documents),
md AS (SELECT doc_id, pos, CASE WHEN pos % 9 = 8 THEN '```' WHEN pos % 4 = 3 THEN '## ' || replace(s, chr(10), ' ') ELSE replace(s, chr(10), ' ') END AS line FROM lines),
f AS (SELECT *, CAST(sum(CASE WHEN line = '```' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) % 2 = 1 OR line = '```' AS fenced FROM md),
b AS (SELECT *, NOT fenced AND regexp_matches(line, '^#{2,3}\\s+\\S') AS boundary FROM f)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.split("text", r"\. "), lambda s: F.replace(s, F.lit("\n"), F.lit(" ")))
    lines = F.transform(parts, lambda s, i: F.when(i % 9 == 8, F.lit("```")).when(i % 4 == 3, F.concat(F.lit("## "), s)).otherwise(s))
    return docs(spark, sf_dir).select("doc_id", F.array_join(lines, "\n").alias("body"))


@query("t12_markdown_chunks", f"""
WITH {MARKDOWN}, g AS (SELECT *, sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM b),
t AS (SELECT doc_id, part, trim(string_agg(line, chr(10) ORDER BY pos), ' ' || chr(10)) AS text FROM g GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS chunk, text FROM t WHERE text <> ''""".replace("\\\\", "\\"))
def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.markdown_chunks(markdown(spark, sf_dir))


@query("t12_structure_report", f"""
WITH {MARKDOWN}, n AS (SELECT doc_id, length(trim(string_agg(line, chr(10) ORDER BY pos))) AS n FROM md GROUP BY 1)
SELECT b.doc_id, count(*) FILTER (NOT fenced AND regexp_matches(line, '^#{{1,6}}\\s+\\S')) AS headings, count(*) FILTER (boundary) AS boundaries,
  count(*) FILTER (boundary) >= 3 AND count(*) FILTER (boundary) * 10000 >= max(n.n) * 2 AS structured FROM b JOIN n USING (doc_id) GROUP BY 1""".replace("\\\\", "\\"))
def t12_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.structure_report(markdown(spark, sf_dir))


@query("t13_fidelity", r"""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-zÀ-ỹ0-9][A-Za-zÀ-ỹ0-9_-]{3,}')) AS w0,
  list_distinct(regexp_extract_all(lower(replace(text, 'e', 'é')), '[A-Za-zÀ-ỹ0-9][A-Za-zÀ-ỹ0-9_-]{3,}')) AS w1 FROM documents)
SELECT doc_id, CASE WHEN len(w0) = 0 THEN 1.0 ELSE len(list_intersect(w0, w1)) / len(w0) END AS token_coverage FROM w""")
def t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = docs(spark, sf_dir).select("doc_id", F.col("text").alias("original"), F.replace("text", F.lit("e"), F.lit("é")).alias("formatted"))
    return p.fidelity(pairs).select("doc_id", "token_coverage")


#: Without look-around: a percent sign before a digit ends no number.
CLAIMS = lambda x: rf"""list_transform(list_transform(regexp_extract_all(regexp_replace({x}, '[%％]([0-9])', 'x\1', 'g'), '[0-9]+(?:[.,][0-9]+)*(?:\s?[%％])?'), lambda v: regexp_replace(replace(v, '％', '%'), '\s+', '', 'g')),
  lambda v: CASE WHEN regexp_matches(v, '^[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]+)?%?$') THEN replace(v, ',', '') ELSE v END)"""  # noqa: E731


@query("t13_numeric_fidelity", f"""
WITH n AS (SELECT doc_id, {CLAIMS('text')} AS n0, {CLAIMS("replace(text, '7', '8')")} AS n1 FROM documents),
a AS (SELECT doc_id, unnest(n0) AS v, generate_subscripts(n0, 1) AS pos FROM n), b AS (SELECT doc_id, unnest(n1) AS v FROM n),
c AS (SELECT doc_id, v, count(*) AS n0, min(pos) AS pos FROM a GROUP BY 1, 2), d AS (SELECT doc_id, v, count(*) AS n1 FROM b GROUP BY 1, 2),
m AS (SELECT doc_id, v, n0, coalesce(n1, 0) AS n1, pos FROM c LEFT JOIN d USING (doc_id, v))
SELECT doc_id, coalesce(sum(least(n0, n1)) / sum(n0), 1.0) AS numeric_coverage, coalesce(string_agg(v, ' ' ORDER BY pos) FILTER (n1 = 0), '') AS missing FROM documents LEFT JOIN m USING (doc_id) GROUP BY 1""")
def t13_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = docs(spark, sf_dir).select("doc_id", F.col("text").alias("original"), F.replace("text", F.lit("7"), F.lit("8")).alias("formatted"))
    return p.fidelity(pairs).select("doc_id", "numeric_coverage", F.array_join("missing", " ").alias("missing"))


@query("t14_reading_view", r"""
WITH x AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r]') AS lines FROM documents), y AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM x),
l AS (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM y),
k AS (SELECT *, starts_with(line, '•') AS bullet, line <> '' AND length(line) <= 90 AND right(line, 1) NOT IN ('.', '!', '?') AND (right(line, 1) = ':' OR (regexp_matches(line, '^\p{Lu}') AND NOT regexp_matches(line, '\s[a-z]{1,2}\s'))) AS label FROM l),
e AS (SELECT doc_id, pos, lag(CASE WHEN label THEN line END) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM k WHERE line <> '' AND NOT bullet),
v AS (SELECT doc_id, pos, CASE WHEN bullet THEN '- ' || regexp_replace(substr(line, 2), '^\s+', '') WHEN label AND line IS DISTINCT FROM last THEN '### ' || line ELSE line END AS line FROM k LEFT JOIN e USING (doc_id, pos)),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS view FROM v GROUP BY 1)
SELECT doc_id, regexp_replace(regexp_replace(view, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS view FROM t""")
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.reading_view(spread(docs(spark, sf_dir)).select("doc_id", F.col("text").alias("body")))


@query("t15_oversized_parts", r"""
WITH RECURSIVE ps AS (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS p FROM documents),
st AS (SELECT doc_id, p, 1 AS i, '' AS run, CAST(NULL AS VARCHAR) AS rest, CAST(NULL AS VARCHAR) AS part, 0 AS step FROM ps
  UNION ALL SELECT doc_id, p, CASE WHEN rest IS NULL THEN i + 1 ELSE i END,
    CASE WHEN rest IS NOT NULL THEN CASE WHEN length(rest) > 1000 THEN '' ELSE rest END WHEN i <= len(p) AND length(joined) <= 1000 THEN joined ELSE '' END,
    CASE WHEN rest IS NOT NULL THEN CASE WHEN length(rest) > 1000 THEN regexp_replace(substr(rest, cut + 1), '^\s+', '') END WHEN i <= len(p) AND length(joined) > 1000 THEN p[i] END,
    CASE WHEN rest IS NOT NULL THEN CASE WHEN length(rest) > 1000 THEN regexp_replace(substr(rest, 1, cut), '^\s+|\s+$', '', 'g') END WHEN i > len(p) OR length(joined) > 1000 THEN run END, step + 1
  FROM (SELECT *, CASE WHEN run <> '' THEN run || chr(10) || chr(10) || p[i] ELSE p[i] END AS joined,
    CASE WHEN position(' ' IN reverse(substr(rest, 1, 1000))) BETWEEN 1 AND 500 THEN 1000 - position(' ' IN reverse(substr(rest, 1, 1000))) ELSE 1000 END AS cut FROM st WHERE rest IS NOT NULL OR i <= len(p) + 1))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS part, part AS text FROM st WHERE regexp_matches(part, '\S')""")
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.oversized_parts(spread(docs(spark, sf_dir)).select("doc_id", F.col("text").alias("body")), 1000)


@query("t16_digest_input", r"""
WITH b AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS b FROM documents), s AS (SELECT *, CAST(greatest(100, (greatest(200, 3000 - 44 - 35)) // 6) AS INTEGER) AS size FROM b)
SELECT doc_id, CASE WHEN length(b) <= 3000 THEN b ELSE 'EXCERPTS (in order; the gaps are left out):' || chr(10) ||
  array_to_string([substr(b, CAST(round_even(i * greatest(0, length(b) - size) / 5.0, 0) AS INTEGER) + 1, size) FOR i IN [0, 1, 2, 3, 4, 5]], chr(10) || '[...]' || chr(10)) END AS input,
  length(b) > 3000 AS truncated FROM s""")
def t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.digest_input(docs(spark, sf_dir).select("doc_id", F.col("text").alias("body")), 3000)


@query("t17_table_evidence", r"""
WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:501]) AS line, generate_subscripts(string_split(text, chr(10))[1:501], 1) AS pos FROM documents WHERE contains(text, ' | ')),
c AS (SELECT doc_id, pos, [substr(trim(regexp_replace(x, '\s+', ' ', 'g')), 1, 2000) FOR x IN string_split(line, ' | ')[1:40]] AS cells FROM r),
k AS (SELECT * FROM c WHERE len(list_filter(cells, lambda x: x <> '')) > 0),
w AS (SELECT doc_id, max(list_max([CASE WHEN cells[i] <> '' THEN i ELSE 0 END FOR i IN range(1, len(cells) + 1)])) AS width FROM k GROUP BY 1),
e AS (SELECT k.doc_id, pos, width, [coalesce(cells[i], '') FOR i IN range(1, width + 1)] AS cells, row_number() OVER (PARTITION BY k.doc_id ORDER BY pos) AS n FROM k JOIN w ON k.doc_id = w.doc_id),
l AS (SELECT doc_id, n, width, CASE WHEN n = 1 THEN array_to_string([CASE WHEN cells[i] <> '' THEN cells[i] ELSE 'Column ' || CAST(i AS VARCHAR) END FOR i IN range(1, width + 1)], ' | ') ELSE array_to_string(cells, ' | ') END AS line FROM e)
SELECT doc_id AS table_id, CAST(max(width) AS INTEGER) AS n_columns, CAST(count(*) - 1 AS INTEGER) AS n_rows, sha256('Table' || chr(10) || string_agg(line, chr(10) ORDER BY n)) AS content_hash FROM l GROUP BY 1""")
def t17(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform(F.split("text", "\n"), lambda line: F.split(line, r" \| "))
    tables = docs(spark, sf_dir).where(F.contains("text", F.lit(" | "))).select(F.col("doc_id").alias("table_id"), F.lit("Table").alias("label"), cells.alias("cells"))
    return p.table_evidence(tables).select("table_id", F.size("columns").alias("n_columns"), F.size("rows").alias("n_rows"), "content_hash")


#: Line items as image placements: part as document, line number as page, supplier as image.
FIGURES = """SELECT l_partkey % 50 AS doc_id, l_linenumber AS page, l_suppkey AS xref, l_quantity * 2 AS x0, l_extendedprice / 500 AS y0, l_quantity * 2 + l_discount * 3000 AS x1,
  l_extendedprice / 500 + l_tax * 4000 AS y1, 595.0 AS page_width, 842.0 AS page_height, 7 AS page_count FROM lineitem"""


@query("t18_page_figures", f"""
WITH p AS ({FIGURES}), b AS (SELECT doc_id, page, xref, min(least(x0, x1)) AS x0, min(least(y0, y1)) AS y0, max(greatest(x0, x1)) AS x1, max(greatest(y0, y1)) AS y1 FROM p GROUP BY 1, 2, 3),
s AS (SELECT doc_id, xref, count(DISTINCT page) AS n FROM p GROUP BY 1, 2)
SELECT doc_id, page, xref, x0, y0, x1, y1, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY round(y0, 1), round(x0, 1), xref) AS INTEGER) AS figure FROM b JOIN s USING (doc_id, xref)
WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) >= 0.02 * 595 * 842 AND least(x1 - x0, y1 - y0) >= 48 AND n < 4""")
def t18(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    placements = line.selectExpr(
        "l_partkey % 50 AS doc_id", "l_linenumber AS page", "l_suppkey AS xref", "l_quantity * 2 AS x0", "l_extendedprice / 500 AS y0", "l_quantity * 2 + l_discount * 3000 AS x1",
        "l_extendedprice / 500 + l_tax * 4000 AS y1", "595.0D AS page_width", "842.0D AS page_height", "7 AS page_count",
    )
    return p.page_figures(placements)


@query("t19_passage_quality", rf"""
WITH {PAGES}, c AS (SELECT doc_id, line, count(*) OVER (PARTITION BY doc_id, lower(trim(regexp_replace(line, '\s+', ' ', 'g')))) AS same, CASE WHEN pos % 10 = 0 THEN 'v0' ELSE 'v1' END AS ev FROM lines)
SELECT doc_id AS article_id, count(*) AS children, CAST(round_even(avg(length(line)), 0) AS BIGINT) AS avg_chars, count(*) FILTER (length(trim(line)) < 40) AS tiny, count(*) FILTER (length(line) > 3000) AS huge,
  count(*) FILTER (same > 1 AND trim(line) <> '') AS duplicate, count(*) FILTER (ev <> 'v1') AS stale_embedding, count(*) FILTER (false) AS old_chunking FROM c GROUP BY 1""")
def t19(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = docs(spark, sf_dir).select(F.col("doc_id").alias("article_id"), F.posexplode(F.split("text", "\n")).alias("at", "chunk_text"))
    children = lines.select("article_id", "chunk_text", F.when(F.col("at") % 10 == 0, "v0").otherwise("v1").alias("embedding_version"), F.lit("c1").alias("chunking_version"))
    return p.passage_quality(children, "v1", "c1")


@query("t20_unit_vectors", """
WITH n AS (SELECT vec_id, embedding, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])) AS norm FROM embeddings)
SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) / norm * CAST(x AS DOUBLE) / norm FOR x IN embedding]), 6) AS length2, round(CAST(embedding[1] AS DOUBLE) / norm, 6) AS first FROM n WHERE len(embedding) = 64 AND norm > 0""")
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = p.unit_vectors(table(spark, sf_dir, "embeddings"), 64)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return kept.select("vec_id", F.round(length, 6).alias("length2"), F.round(F.element_at("embedding", 1), 6).alias("first"))


@query("t21_embedding_text", r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE source || chr(10) || chr(10) || text END AS child,
  substr(source || chr(10) || text || chr(10) || 'Topics: ' || lang || ', ' || source, 1, 2000) AS digest FROM documents""")
def t21(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("source"))
    return docs(spark, sf_dir).select("doc_id", p.embedding_text(header, F.col("text")).alias("child"), p.digest_text(F.col("source"), F.col("text"), F.array("lang", "source")).alias("digest"))


@query("t22_compress", r"""
WITH h AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS t, substr(trim(text, ' ' || chr(10)), 1, 500) AS h FROM documents),
l AS (SELECT *, greatest(CASE WHEN contains(h, chr(10)) THEN 500 - position(chr(10) IN reverse(h)) ELSE -1 END, CASE WHEN contains(h, '. ') THEN 500 - position(' .' IN reverse(h)) - 1 ELSE -1 END) AS last FROM h)
SELECT doc_id, CASE WHEN length(t) <= 500 THEN t ELSE rtrim(substr(h, 1, CASE WHEN last > 250 THEN last + 1 ELSE 500 END), ' ' || chr(10)) || ' …' END AS text FROM l""")
def t22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.compress(F.col("text"), 500).alias("text"))


@query("f1_fold", f"SELECT doc_id, {FOLDED} AS folded FROM documents")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.fold(F.col("text")).alias("folded"))


#: Every third text with its accented letters taken apart and every fifth with full-width a: composed and folded they are as before.
@query("f2_passage_key", r"SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM documents")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.col("text")
    for letter in "äöüéèàçñ":
        apart = F.replace(apart, F.lit(letter), F.lit(unicodedata.normalize("NFD", letter)))
    text = F.when(F.col("doc_id") % 3 == 0, apart).when(F.col("doc_id") % 5 == 0, F.translate("text", "aA", "ａＡ")).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", tx.passage_key(text).alias("key"))


#: Names with accents, ligatures, sharp s, capitals and odd spaces, taken apart or not.
@query("f3_entity_key", r"SELECT s_suppkey, 'office strasse ' || trim(regexp_replace(lower(s_name), '\s+', ' ', 'g')) || ' aeo' AS key FROM supplier")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Oﬃce\u2003 STRAßE "), F.upper("s_name"), F.lit("  ÁÈÔ "))).otherwise(F.concat(F.lit(" o\u0308ﬀICE Strasse\u00a0"), "s_name", F.lit(" A\u0301e\u0300Ｏ")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", tx.entity_key(name).alias("key"))


@query("f4_group_key", r"""
SELECT p_partkey, trim(regexp_replace(' ' || lower(p_name) || ' ', '[^a-z0-9]+', ' ', 'g')) AS key, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS department FROM part""")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" Team - "), F.when(F.col("p_size") % 2 == 0, "Members").otherwise("Chủ sở hữu"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.group_key(name).alias("key"), tx.department_key(F.concat(F.lit("Phòng "), "p_type", F.lit(" Department"))).alias("department"))


@query("f5_emails", r"""
SELECT c_custkey, array_to_string(list_distinct([lower(replace(c_name, '#', '.')) || '@corp.com', 'u' || CAST(c_custkey % 7 AS VARCHAR) || '@x.org'])::VARCHAR[], ',') IS NOT NULL AS found,
  lower(replace(c_name, '#', '.')) || '@corp.com' AS first FROM customer""")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Corp.com"))
    login = F.concat(F.lit("i:0#.f|membership|U"), (F.col("c_custkey") % 7).cast("string"), F.lit("@x.org"))
    found = tx.emails(mail, login, F.upper(mail), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", (F.size(found) == 2).alias("found"), F.element_at(found, 1).alias("first"))


@query("f6_parse_decimal", r"""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS value FROM orders""")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.format_number("o_totalprice", 2)
    swapped = F.translate(number, ",.", ".,")
    cell = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("=SUM("), number, F.lit(")"))).when(F.col("o_orderkey") % 3 == 0, F.concat(swapped, F.lit(" ₫"))).otherwise(F.concat(F.lit("$"), number))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(tx.parse_decimal(cell).cast("double"), 2).alias("value"))


@query("f7_readings", r"""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [CAST('1.' || CAST(o_orderkey % 900 + 100 AS VARCHAR) AS DOUBLE), CAST(1000 + o_orderkey % 900 + 100 AS DOUBLE)]
  WHEN o_orderkey % 3 = 1 THEN [CAST(o_orderkey AS DOUBLE), CAST(o_orderkey AS DOUBLE) / 100] ELSE [CAST(o_orderkey AS DOUBLE)] END AS readings FROM orders WHERE o_orderkey > 0""")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    token = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("1,"), (F.col("o_orderkey") % 900 + 100).cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat(key, F.lit("%"))).otherwise(key)
    return table(spark, sf_dir, "orders").where("o_orderkey > 0").select("o_orderkey", tx.readings(token).alias("readings"))


@query("f8_redact", r"""SELECT page_id, url || '&keyword=a&author=b&status_code=4&access_token=***&X-Amz-Signature=***&api_key=***&sortKey=up Bearer ***' AS url FROM pages""")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.concat("url", F.lit("&keyword=a&author=b&status_code=4&access_token=abc&X-Amz-Signature=f00&api_key=k%20&sortKey=up Bearer abcdef123456"))
    return table(spark, sf_dir, "pages").select("page_id", tx.redact(secret).alias("url"))


#: Assistant turns with citation markers worked in.
CITED = r"""cited AS (SELECT conv_id, turn, text || ' [C' || CAST(turn % 5 + 1 AS VARCHAR) || ': 2026-08-08] so [C' || CAST(conv_id % 3 + 1 AS VARCHAR) || ', C9] and [2024] or [' || CAST(turn + 1 AS VARCHAR) || ']. Next 15% holds.' AS text FROM conversations WHERE role = 'assistant')"""


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    mark = F.concat("text", F.lit(" [C"), (F.col("turn") % 5 + 1).cast("string"), F.lit(": 2026-08-08] so [C"), (F.col("conv_id") % 3 + 1).cast("string"), F.lit(", C9] and [2024] or ["), (F.col("turn") + 1).cast("string"), F.lit("]. Next 15% holds."))
    return turns.select("conv_id", "turn", mark.alias("text"))


@query("f9_citations", r"""
SELECT conv_id, turn, list_sort(list_distinct([CAST(turn % 5 + 1 AS INTEGER), CAST(conv_id % 3 + 1 AS INTEGER), 9, CASE WHEN turn + 1 < 100 THEN CAST(turn + 1 AS INTEGER) ELSE 9 END])) AS ids
FROM conversations WHERE role = 'assistant'""")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited(spark, sf_dir).select("conv_id", "turn", tx.citation_numbers(F.col("text")).alias("ids"))


@query("f9_known_markers", rf"""
WITH m AS (SELECT conv_id, turn, text || ' ' || CASE WHEN turn % 5 + 1 IN (1, 2) THEN '[C' || CAST(turn % 5 + 1 AS VARCHAR) || ': 2026-08-08]' ELSE '' END || ' so ' || CASE WHEN conv_id % 3 + 1 IN (1, 2) THEN '[C' || CAST(conv_id % 3 + 1 AS VARCHAR) || ']' ELSE '' END
  || ' and [2024] or ' || CASE WHEN turn + 1 IN (1, 2) OR turn + 1 > 99 THEN '[' || CAST(turn + 1 AS VARCHAR) || ']' ELSE '' END || '. Next 15% holds.' AS t FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]{{2,}}', ' ', 'g'), '[ \t]+([.,;:!?])', '\1', 'g'), '^\s+|\s+$', '', 'g') AS text FROM m""")
def f9_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited(spark, sf_dir).select("conv_id", "turn", tx.keep_known_markers("text", F.array(F.lit(1), F.lit(2))).alias("text"))


@query("f10_sentences", rf"""
WITH {CITED}, s AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM cited)
SELECT conv_id, turn, CAST(len(s) AS INTEGER) AS n, CAST(len(list_filter(s, lambda x: regexp_matches(regexp_replace(x, '\[([^\[\]]{{1,240}})\]', '', 'g'), '[0-9]'))) AS INTEGER) AS claims FROM s""")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.sentences(F.col("text"))
    return cited(spark, sf_dir).select("conv_id", "turn", F.size(found).alias("n"), F.size(F.filter(found, tx.has_claim)).alias("claims"))


@query("f11_file_format", r"""
WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.jpeg' WHEN 2 THEN 'noext' ELSE ' c.htm ' END AS filename, CASE WHEN page_id % 3 = 0 THEN 'text/csv; charset=utf-8' ELSE 'x/y' END AS mime FROM pages)
SELECT page_id, CASE WHEN trim(filename) = 'a.PDF' THEN 'pdf' WHEN filename = 'b.jpeg' THEN 'jpg' WHEN filename = 'noext' THEN CASE WHEN starts_with(mime, 'text/csv') THEN 'csv' ELSE '' END ELSE 'html' END AS format FROM n""")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "CASE page_id % 4 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.jpeg' WHEN 2 THEN 'noext' ELSE ' c.htm ' END AS filename", "CASE WHEN page_id % 3 = 0 THEN 'text/csv; charset=utf-8' ELSE 'x/y' END AS mime")
    return rows.select("page_id", tx.file_format(F.col("filename"), F.col("mime")).alias("format"))


@query("f12_period", r"""
SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN DATE '2024-05-10' WHEN 1 THEN DATE '2024-05-13' WHEN 2 THEN DATE '2024-05-01' WHEN 3 THEN DATE '2024-05-16' - CAST(turn AS INTEGER) END AS since FROM conversations""")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.concat(F.lit("changed in the last "), (F.col("turn") + 1).cast("string"), F.lit(" days"))
    question = F.when(F.col("conv_id") % 5 == 0, "new in 7 ngay qua").when(F.col("conv_id") % 5 == 1, "what came this week").when(F.col("conv_id") % 5 == 2, "thang nay").when(F.col("conv_id") % 5 == 3, days).otherwise("how many documents")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.period_start(question, F.lit("2024-05-16").cast("date")).alias("since"))


@query("f13_iso_date", r"""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS issued FROM orders""")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("T00:00:00"))).when(F.col("o_orderkey") % 3 == 1, F.lit("unknown")).otherwise(F.lit("2024-13-77"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.iso_date(raw).alias("issued"))


@query("f14_rollout_bucket", r"SELECT c_custkey, CAST(CAST('0x' || substr(sha256(c_name), 1, 8) AS BIGINT) % 100 AS INTEGER) AS bucket FROM customer")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tx.rollout_bucket(F.col("c_name")).alias("bucket"))


@query("f15_error_line", r"""
SELECT doc_id, CASE WHEN length(t) <= 300 THEN nullif(t, '') ELSE substr(t, 1, 299) || '…' END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.operators.telemetry import error_line

    return docs(spark, sf_dir).select("doc_id", error_line(F.col("text")).alias("line"))


@query("f16_guard_flags", r"""
SELECT doc_id, regexp_matches(lower(text), 'ignore previous instructions|developer mode|jailbreak') AS injection,
  regexp_matches(text, '(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9]{20,}|(password|secret|api[_-]?key|token)\s*[:=]\s*\S{6,}') AS leak FROM documents""")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.injection(F.col("text")).alias("injection"), tx.leaks_credential(F.col("text")).alias("leak"))


@query("f18_follow_up", rf"""
SELECT conv_id, turn, len(regexp_split_to_array(trim(f), '\s+')) <= 16 AND regexp_matches(f, '\b(it|its|they|them|this|that|these|those|he|she|no|do|nay|kia|ay)\b|\b(what about|how about|and the|the same|con|the con|vay con|tiep theo)\b') AS follow_up,
  trim(text, ' ' || chr(10)) AS plain FROM (SELECT *, replace(strip_accents(lower(text)), 'đ', 'd') AS f FROM conversations)""")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat("text", F.lit(" [C1] [C2: now]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.is_follow_up(F.col("text")).alias("follow_up"), tx.without_markers(marked).alias("plain"))


@query("f3_clean_tags", """
WITH t AS (SELECT l_orderkey AS article_id, 'tag ' || CAST(l_suppkey % 12 AS VARCHAR) AS tag, min(l_linenumber * 1000000 + l_partkey) AS pos FROM lineitem WHERE l_suppkey % 12 <> 5 GROUP BY 1, 2)
SELECT article_id, 'Tag ' || substr(tag, 5) AS tag, CAST(row_number() OVER (PARTITION BY article_id ORDER BY pos, tag) AS INTEGER) AS rank FROM t QUALIFY rank <= 3""")
def f3_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    tags = line.select(F.col("l_orderkey").alias("article_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("position"), F.concat(F.lit(" TÀG  "), (F.col("l_suppkey") % 12).cast("string")).alias("tag"))
    catalogue = line.select((F.col("l_suppkey") % 12).alias("k")).distinct().where("k <> 5").select(F.concat(F.lit("Tag "), F.col("k").cast("string")).alias("tag"))
    return p.clean_tags(tags, catalogue, 3)


@query("f3_tag_proposal", """
SELECT o_orderkey AS article_id, CASE WHEN o_custkey % 3 = 0 THEN ['Alpha', 'Beta'] ELSE ['Alpha', 'Beta', 'Gamma ' || CAST(o_custkey % 9 AS VARCHAR)] END AS proposal, CASE WHEN o_custkey % 3 = 0 THEN [] ELSE ['Gamma ' || CAST(o_custkey % 9 AS VARCHAR)] END AS added FROM orders""")
def f3_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("alpha"), F.lit("BETA "))).otherwise(F.array(F.lit("béta"), F.concat(F.lit("Gamma "), (F.col("o_custkey") % 9).cast("string"))))
    return p.tag_proposal(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.array(F.lit("Alpha"), F.lit("Beta")).alias("current"), new.alias("new")))
