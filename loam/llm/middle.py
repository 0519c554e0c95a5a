"""Fill-in-middle: every text is cut at two of its token boundaries and its three parts are put in another order.

Tokens are runs of ASCII letters and single other code points. The offsets at which tokens end are kept as a set in
containers of 65 536 offsets, each in the smallest of three forms: a sorted array of low halves, a bitmap, or runs of
neighbouring offsets (text without letters is one run). The containers' cumulative cardinalities tell how many tokens a
text has and in which container the k-th boundary lies; a select inside that container gives its offset. So both cuts
are found from two numbers, and a text of any length needs little beside itself.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import spread, table, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Low bits of an offset within its container, and the most members of an array container.
LOW = 16
SPAN, ARRAY = 1 << LOW, 4096


def container(low: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """(form, data, counts) of a sorted, non-empty array of offsets below ``SPAN``, in the form that takes the fewest bytes.

    counts are cumulative: of a run container the members up to each run, of a bitmap those up to each word.
    """
    breaks = np.flatnonzero(np.diff(low) != 1)
    runs = len(breaks) + 1
    if 4 * runs < min(2 * len(low), SPAN // 8):
        ends = np.concatenate([breaks, [len(low) - 1]])
        return "run", low[np.concatenate([[0], breaks + 1])].astype(np.uint16), ends + 1
    if len(low) <= ARRAY:
        return "array", low.astype(np.uint16), np.empty(0, np.int64)
    bits = np.zeros(SPAN, np.uint8)
    bits[low] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    return "bitmap", words, np.cumsum(np.bitwise_count(words), dtype=np.int64)


def select(held: tuple[str, np.ndarray, np.ndarray], k: int) -> int:
    """The k-th (from 0) offset of a container."""
    form, data, counts = held
    if form == "array":
        return int(data[k])
    at = int(np.searchsorted(counts, k, "right"))
    rest = k - (int(counts[at - 1]) if at else 0)
    if form == "run":
        return int(data[at]) + rest
    word = int(data[at])
    for _ in range(rest):
        word &= word - 1
    return 64 * at + (word & -word).bit_length() - 1


class Boundaries:
    """The offsets (code points) at which the tokens of a text end."""

    def __init__(self, text: str):
        self.keys: list[int] = []
        self.held: list[tuple[str, np.ndarray, np.ndarray]] = []
        self.upto: list[int] = []
        total = 0
        for key in range((len(text) >> LOW) + 1):
            low = self._ends(text, key << LOW)
            if len(low):
                total += len(low)
                self.keys.append(key)
                self.held.append(container(low))
                self.upto.append(total)

    @staticmethod
    def _ends(text: str, first: int) -> np.ndarray:
        """Boundaries from ``first`` on, within one container and less ``first``; the start of the text is none."""
        start = max(first - 1, 0)
        part = text[start : first + SPAN]
        codes = np.frombuffer(part.encode("utf-32-le"), "<u4")
        letter = (codes | 32) - 97 < 26  # unsigned: what lies below a letter wraps round
        inner = ~(letter[:-1] & letter[1:])  # between two code points of the part
        ends = np.flatnonzero(inner) + 1 + start
        if first < len(text) + 1 <= first + SPAN and len(text):
            ends = np.append(ends, len(text))
        return ends - first

    def __len__(self) -> int:
        return self.upto[-1] if self.upto else 0

    def end_of(self, k: int) -> int:
        """The offset after the first ``k`` tokens."""
        if k == 0:
            return 0
        at = bisect_left(self.upto, k)
        before = self.upto[at - 1] if at else 0
        return (self.keys[at] << LOW) + select(self.held[at], k - before - 1)


def rearranged(text: str, h1: int, h2: int, h3: int, h4: int, plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of prefix and middle, output) of one text under four hashes."""
    ends = Boundaries(text)
    n = len(ends)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends.end_of(one), ends.end_of(two)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: str = "1:", plain: int = 10, spm: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): a row for every row of ``docs``, output being the text to train on.

    The hashes come from sha256 of ``seed`` and the doc_id, so equal ids get equal draws at every run. ``plain`` in a hundred
    texts stay as they are (form plain), as do empty ones and those that hold a mark; of the others ``spm`` in a hundred are
    spm, the rest psm. A null text counts as empty; a null doc_id as an empty one. Repeated rows come out as often as they go
    in; very long texts are cut whole; other columns are left out whatever their names; an empty table gives an empty table.
    """
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))).cast("binary"), 256)
    hashes = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
    fields = pa.schema(list(kinds.items()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            made = [rearranged(text.as_py(), *own, plain, spm) for text, own in zip(batch.column(1), draws, strict=True)]
            columns = list(zip(*made, strict=True)) if made else [[]] * 5
            rest = [pa.array(c, kind) for c, kind in zip(columns, list(kinds.values())[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest], schema=fields)

    rows = docs.select(F.col("doc_id").cast("long"), text_of().cast("string").alias("text"), *hashes)
    return rows.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of; no part holds a mark."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spread(table(spark, sf_dir, "documents")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    digests = sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), drawn AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || substr(key, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(key, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(key, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(key, 25, 8) AS BIGINT) AS h4
  FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS one, greatest(h1 % (n + 1), h2 % (n + 1)) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(tokens[1:one], '') AS prefix, array_to_string(tokens[one + 1:two], '') AS middle, array_to_string(tokens[two + 1:], '') AS suffix
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""
