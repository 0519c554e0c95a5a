"""Packing by powers of two: every document is cut into pieces of 2048 tokens and then of the binary lengths of the rest.

A piece is a sequence of its own: its length is a power of two, so it needs no padding, and no sequence crosses
documents. Sequences of equal length form a bucket, so a reader takes batches of one length.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import spread, table
from loam.llm.tokens import encoder, map_texts, vocabulary_path

CONTEXT = 2048
END = (1).to_bytes(4, "little")


def cuts(tokens: int, context: int = CONTEXT) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole contexts, then the rest's powers of two from large to small."""
    found = [(at, context) for at in range(0, tokens - context + 1, context)]
    at = len(found) * context
    for bit in range(context.bit_length() - 1, -1, -1):
        if (tokens - at) >> bit & 1:
            found.append((at, 1 << bit))
            at += 1 << bit
    return found


def pieces(docs: DataFrame, context: int = CONTEXT, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and the ids as bytes unless told otherwise.

    A document's tokens are its text's ids and one end token with id 1; null and empty texts have that one token.
    Repeated rows are documents of their own.
    """
    path = path or vocabulary_path()

    def row(doc_id: object, text: str) -> list[tuple]:
        ids = memoryview(encoder(path).document(text) + END)
        n = len(ids) // 4
        parts = ((at, size, ids[4 * at : 4 * (at + size)]) for at, size in cuts(n, context))
        return [(doc_id, at, size, zlib.crc32(own), n, *([bytes(own)] if with_ids else [])) for at, size, own in parts]

    return map_texts(docs, row, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, context: int = CONTEXT, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """``pieces`` with sequence_id and offset (0: one piece a sequence).

    The top bits of sequence_id are the bucket, longest sequences first, the others are unique within it, so an order
    by sequence_id goes bucket by bucket. Nothing is shuffled. Very long texts are cut whole; other columns are left
    out whatever their names; an empty table gives an empty table.
    """
    bucket = F.lit(context.bit_length() - 1) - F.log2("length").cast("long")
    number = F.shiftleft(bucket, 58).bitwiseOR(F.monotonically_increasing_id())
    made = pieces(docs, context, path, with_ids)
    return made.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes a packed table with a folder for each sequence length, for readers that take batches of one length."""
    packed.write.partitionBy("length").parquet(path)


def op7_pack_powers_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents")), with_ids=False)
