"""The queries of this package by name. Modules are imported when a query is called, so workers import little."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this package that has a function of that name.
MODULES = {
    "op1_weighted_fingerprints": "weighted",
    "op2_secret_scan": "secrets",
    "op3_simhash_near_dedup": "simhash",
    "op4_cotrained_quality": "quality",
    "op5_token_length_histogram": "tokens",
    "op6_png_media": "media",
    "op7_pack_powers_of_two": "packing",
    "op8_sampled_splitters": "sharding",
    "op9_noisy_channel_toxicity": "toxicity",
    "op10_mix_curriculum": "mixing",
    "op11_fill_in_middle": "middle",
    "op12_importance_resampling": "resampling",
    "op13_sentencepiece": "pieces",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"loam.llm.{MODULES[name]}"), name)(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the others are tested against brute force in tests/llm."""
    found = ((name, getattr(import_module(f"loam.llm.{module}"), "ORACLE_SQL", None)) for name, module in MODULES.items())
    return {name: sql for name, sql in found if sql}
