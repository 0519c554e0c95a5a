"""A corpus made ready for training: quality, near copies, secrets, mix, packing. Each stage is one operator of loam.llm.

Each stage's result is written as Parquet in the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import mixing, packing, quality, secrets, simhash
from loam.llm.common import shared_folder, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each component exactly one row stays, the one with the smallest doc_id.

    Rows without an id come last, rows of one doc_id go by a hash of the whole row; of equal rows one stays. So a row
    goes only if another row of its own component stays. Null and empty texts are copies of each other; other columns may
    have any names; an empty table gives an empty table.
    """
    no_id, number = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    mark = F.xxhash64(*docs.columns)
    first = simhash.first_rows(docs, mark).select(F.col("key").alias("mark"), number.alias("id"), no_id.alias("no_id"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), mark.alias("mark"), number.alias("id"), no_id.alias("no_id"))
    kept = rows.join(first, ["mark", "id", "no_id"], "left_semi").dropDuplicates(["mark", "id", "no_id"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: what it reports is masked in the texts; all rows stay."""
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target takes it, in the order of the curriculum.

    Texts without words, null ones among them, are never taken; repeated rows are taken each on its own; other columns may
    have any names; an empty table gives an empty table.
    """
    order = mixing.training_order(docs)
    return order.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences of at most 2048 tokens, with their ids. A null text counts as an empty one, whose only piece is
    its end mark; repeated rows are packed each on its own; other columns are left out; an empty table gives an empty table."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", without_near_copies),
    ("secret scan", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm holds run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    base = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/pipeline-{uuid.uuid4().hex}-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
