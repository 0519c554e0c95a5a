"""Token ids and counts by a public byte-level BPE vocabulary, and the exact histogram of encoded lengths.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import cut, spread, table

#: The ranks of byte_bpe_50k.json: the same ids, made several times faster. The tokens added to them stand in that file.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How such a vocabulary splits a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Histogram lengths that share one partial sum.
BLOCK = 1024


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that the vocabulary's JSON file, beside its ranks, adds to them; a vocabulary of ranks alone has none."""
    described = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(described):
        return {}
    with open(described, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


class Encoder:
    """Token ids of a text as unsigned 32-bit bytes, lowest byte first.

    ids(text) takes added tokens such as <|endoftext|> as ordinary text. document(text) gives what the vocabulary's JSON
    file gives as loaded: the text is split at added tokens, and each becomes its one id.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))

    def ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def document(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special="all", disallowed_special=()), "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def map_texts(docs: DataFrame, row: Callable[[object, str], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``row(doc_id, text)`` makes of each document, in Arrow batches; a null text counts as empty."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")]
    fields = pa.schema(list(zip(names, kinds, strict=True)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [r for i in range(batch.num_rows) for r in row(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or "")]
            columns = list(zip(*made, strict=True)) if made else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema=fields)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) for every row; null and empty texts have 0 tokens, very long ones are counted whole. Other columns are left out
    whatever their names; an empty table gives an empty table."""
    path = path or vocabulary_path()
    return map_texts(docs, lambda i, text: [(i, len(encoder(path).document(text)) // 4)], "doc_id long, n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """For each length that occurs in ``counts`` (n_tokens), read as a context limit:

    n_docs and n_tokens_total of that length; docs_below, docs_up_to, docs_from, tokens_from (suffix sums: that length
    or longer); total_docs, total_tokens; truncated_total, the tokens left if every document is cut to the limit;
    quantile_low, quantile_high: the quantiles q in (low, high] are this length. No rows for an empty table.

    Sums run first within blocks of lengths and then over the blocks, so no task holds all lengths of a huge range.
    """
    hist = cut(counts.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")))
    hist = hist.withColumn("n_tokens_total", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens_total").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(whole).alias("total_docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        hist.join(blocks, "block")
        .withColumn("docs_from", F.col("d_after") + F.sum("n_docs").over(inside))
        .withColumn("tokens_from", F.col("t_after") + F.sum("n_tokens_total").over(inside))
        .withColumn("docs_below", F.col("total_docs") - F.col("docs_from"))
        .withColumn("docs_up_to", F.col("docs_below") + F.col("n_docs"))
        .withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from"))
        .withColumn("quantile_low", F.col("docs_below") / F.col("total_docs"))
        .withColumn("quantile_high", F.col("docs_up_to") / F.col("total_docs"))
        .select("length", "n_docs", "n_tokens_total", "docs_below", "docs_up_to", "docs_from", "tokens_from", "total_docs", "total_tokens", "truncated_total", "quantile_low", "quantile_high")
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, truncated_total) for any context limits, from a histogram: no further look at the documents."""
    sums = [F.sum(F.least(F.col("length"), F.lit(x)) * F.col("n_docs")).alias(str(x)) for x in limits]
    wide = histogram.agg(*sums)
    pairs = F.array(*(F.struct(F.lit(x).alias("limit"), F.coalesce(F.col(str(x)), F.lit(0)).alias("truncated_total")) for x in limits))
    return wide.select(F.inline(pairs))


def op5_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_counts(spread(table(spark, sf_dir, "documents"))))
