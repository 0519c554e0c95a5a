"""Secrets in texts: plain patterns, and weak candidates that count only beside a complementary part.

A credential often comes in parts: an access identifier, a secret, an endpoint. Plain patterns (``assign``, ``access``,
``hex``) are reported wherever they match. Weak candidates are shapes that alone mean little: an upper-case code (``id``),
a mixed token (``key``), an address (``endpoint``). Each part opens the scope that reaches ``SCOPE`` code points beyond
both its ends; a weak one is reported only if its scope meets a complementary part of the same document: an identifier
needs a secret, an endpoint needs a secret, a secret needs an identifier or an endpoint. ``access`` serves as an
identifier, ``assign`` and ``hex`` as secrets.

Patterns run in Arrow batches and leave short rows of spans. The interval join is a pair of windows over the spans of a
document: the farthest end of the complementary parts before, and the nearest start of those after, decide about
any number of them, so no pairs are made.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import cut, spread, table, text_of

SCOPE = 256
#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
#: What each kind serves as, and what it needs nearby if it is weak.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "id": "identifier", "key": "secret", "endpoint": "endpoint"}
NEEDS = {"id": ("secret",), "key": ("identifier", "endpoint"), "endpoint": ("secret",)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: Every code of 16 or more characters lies in such a run, and so does any maximal run of a narrower alphabet.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ID = re.compile(r"(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{16,}")
_KEY = re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20\"'<>|]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, leftmost and non-overlapping within a kind, by start and then kind."""
    return sorted(_spans(text)[0], key=lambda s: (s[0], KINDS.index(s[2])))


def _spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base: list[tuple[int, int, str]] = []
    weak: list[tuple[int, int, str]] = []
    lowered = text.lower()
    if any(hint in lowered for hint in _HINTS):
        base += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for run in _RUN.finditer(text):
        own, at = run[0], run.start()
        if own.islower() and own.isalpha() and not set(own) <= set("abcdef"):
            if max(map(len, re.split("[^a-f]", own))) < 24:
                continue
        base += [(at + m.start(), at + m.end(), kind) for kind, shape in (("access", _ACCESS), ("hex", _HEX)) for m in shape.finditer(own)]
        if _ID.fullmatch(own):
            weak.append((at, run.end(), "id"))
        elif _KEY.fullmatch(own):
            weak.append((at, run.end(), "key"))
    if "://" in text:
        weak += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    taken = sorted((s, e) for s, e, _ in base)
    starts, reach = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]
    return base, [w for w in weak if reach[bisect_left(starts, w[1])] <= w[0]]


_FOUND = "doc_id long, h long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, parts array<struct<start:long,end:long,kind:string,weak:boolean>>"
_PART = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("weak", pa.bool_())])
_FIELDS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("base", pa.string()), ("parts", pa.list_(_PART))])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with h, a hash of the text: (doc_id, h) names a row up to repeated ones."""
    return docs.withColumn("h", F.xxhash64(text_of()))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            base, weak = _spans(batch.column(2)[i].as_py() or "")
            base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            listed = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
            counts = [sum(s[2] == k for s in base) for k in KINDS[:3]]
            parts = [{"start": s, "end": e, "kind": k, "weak": k in NEEDS} for s, e, k in base + weak]
            rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), *counts, hashlib.sha256(listed.encode()).hexdigest(), listed, parts or None))
        columns = zip(*rows, strict=True) if rows else [[]] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)


def parts(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: counts and list of the plain spans, and all parts, null where there are none."""
    return keyed(docs).select(F.col("doc_id").cast("long"), "h", F.col("text").cast("string")).mapInArrow(_scan, _FOUND)


def linked(found: DataFrame) -> DataFrame:
    """The spans that count: doc_id, h, start, end, kind, weak, and near_start, near_end of the nearest complement.

    Of documents in ``found`` (rows of ``parts``); repeated rows count once. Plain spans always stay, with nulls for
    the complement.
    """
    each = found.where("parts is not null").dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.inline("parts"))
    role = F.element_at(F.create_map(*(F.lit(x) for pair in ROLE.items() for x in pair)), F.col("kind"))
    each = each.withColumn("role", role)
    order = Window.partitionBy("doc_id", "h").orderBy("start", "end", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def nearest(roles: tuple[str, ...]) -> tuple[Column, Column]:
        end_first = F.when(F.col("role").isin(*roles), F.struct("end", "start"))
        start_first = F.when(F.col("role").isin(*roles), F.struct("start", "end"))
        return F.max(end_first).over(before), F.min(start_first).over(after)

    left, right = F.lit(None), F.lit(None)
    for kind, roles in NEEDS.items():
        past, next_ = nearest(roles)
        left, right = F.when(F.col("kind") == kind, past).otherwise(left), F.when(F.col("kind") == kind, next_).otherwise(right)
    each = each.withColumn("_left", left).withColumn("_right", right)
    gap_left = F.when(F.col("_left").isNotNull(), F.greatest(F.col("start") - F.col("_left.end"), F.lit(0)))
    gap_right = F.when(F.col("_right").isNotNull(), F.greatest(F.col("_right.start") - F.col("end"), F.lit(0)))
    use_left = F.coalesce(gap_left <= F.coalesce(gap_right, gap_left), F.lit(False))
    near = F.when(use_left, F.struct(F.col("_left.start").alias("start"), F.col("_left.end").alias("end"), gap_left.alias("gap")))
    near = near.otherwise(F.struct(F.col("_right.start").alias("start"), F.col("_right.end").alias("end"), gap_right.alias("gap")))
    each = each.withColumn("_near", near)
    kept = each.where(~F.col("weak") | (F.col("_near.gap") <= SCOPE))
    complement = lambda c: F.when(F.col("weak"), F.col(f"_near.{c}")).alias(f"near_{c}")
    return kept.select("doc_id", "h", "start", "end", "kind", "weak", complement("start"), complement("end"))


def secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, h, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    spans lists kind:start:end of all spans by start and then kind (code points, end exclusive); n_linked counts
    the weak ones among them. Null and empty texts have none; very long ones are read whole. Other columns
    are left out whatever their names; an empty table gives an empty table.
    """
    found = cut(parts(docs))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    listed = F.concat_ws(":", "kind", "start", "end")
    # only documents with a weak part need the join; of the others the plain list is all
    per = linked(found.where(F.exists("parts", lambda p: p["weak"]))).groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), listed.alias("listed")))).alias("all"), F.count_if("weak").alias("weak")
    )
    per = per.select("doc_id", "h", F.array_join(F.transform("all", lambda s: s["listed"]), ",").alias("all"), "weak").alias("p")
    same = F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("f.h") == F.col("p.h"))
    joined = found.alias("f").join(per, same, "left")
    return joined.select("f.doc_id", "f.h", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("all", "base").alias("spans"), F.coalesce("weak", F.lit(0)).alias("n_linked"))


def masked(text: str, spans: list, mask: str) -> str:
    """``text`` with the spans (start, end), sorted, replaced; overlapping ones share one mask. Linear in both."""
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at : span["start"]], mask]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """``docs`` with every reported span's text replaced by ``mask``; all rows and columns stay, n_chars is counted anew
    where a text changed. Overlapping spans share one mask.

    A null text stays null and an empty one empty; repeated rows are masked alike; a null doc_id is an id; other columns
    may have any names; an empty table gives an empty table.
    """
    found = cut(parts(docs))
    per = linked(found).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")).alias("p")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("h")).alias("d")
    joined = rows.join(per, F.col("d.id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.h") == F.col("p.h")), "left")

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, list(s), mask) for t, s in zip(texts, spans, strict=True)], dtype=object)

    # only texts with a span go to Python
    changed = F.col("spans").isNotNull()
    made = joined.select("row", "spans", cleaned(F.when(changed, F.col("row.text").cast("string")), F.col("spans")).alias("clean"))
    new = {"text": F.when(changed, F.col("clean")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return made.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spread(table(spark, sf_dir, "documents"))).drop("h")
