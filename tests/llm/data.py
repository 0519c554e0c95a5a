"""Small tables that hold the awkward cases: nulls, empty texts, copies, repeated rows, clashing extra columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD_SCHEMA = SCHEMA + ", fp string, key string, size string, label string, kind string, position string"


def awkward(spark):
    long = "the quick brown fox jumps over the lazy dog again " * 3000
    texts = [
        (1, "One plain text of several words, nothing else.", "en", "a"),
        (2, "One plain text of several words, nothing else.", "en", "a"),
        (2, "One plain text of several words, nothing else.", "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, None),
        (5, "   \t\n ", "de", "b"),
        (6, "word", "fr", "a"),
        (None, "A row without an id but with words in it.", "en", None),
        (7, long, "en", "a"),
        (8, "Größe Ünïcode \U0001f600 straße 漢字   end", "de", "c"),
    ]
    rows = [(i, t, lang, source, len(t) if t is not None else None, "x", "x", "x", "x", "x", "x") for i, t, lang, source in texts]
    return spark.createDataFrame(rows, AWKWARD_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHING = ("target", "weight", "tilt", "source_size", "taken", "_size", "_source", "_order", "row", "round", "rounds", "h", "_h", "spans", "clean", "mark", "id", "no_id", "_place", "y", "sid", "sig", "n", "u", "v")


def clashing(df):
    """``df`` with extra columns under names that the operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
