"""Small shared pieces: reading a table, the words of a text, cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.tables import cut, shared_folder, spread

__all__ = ["WORD", "cut", "partitions", "place", "shared_folder", "spread", "table", "text_of"]

#: A word: a run without ASCII white space (space and U+0009 to U+000D).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def place(salt: str, *columns: Column | str) -> Column:
    """A number from 0 to 1 by hash of the columns: rows below a share of 1 are a sample of that share, at every run the same."""
    return F.xxhash64(*columns, F.lit(salt)).cast("double") / F.lit(2.0**64) + F.lit(0.5)


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle gets in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
