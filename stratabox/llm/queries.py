"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> module of this subpackage that has `query(spark, sf_dir)` and perhaps `ORACLE_SQL`
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_ann_multiprobe": "ann",
    "op3_byte_bpe": "byte_bpe",
    "op4_extendible_sharding": "sharding",
    "op5_html_extraction": "html_extract",
    "op6_lm_scoring": "lm_score",
    "op7_language_id": "lang_id",
    "op8_ngram_jaccard": "jaccard",
    "op9_substring_dedup": "substring_dedup",
    "op10_decontamination": "decontaminate",
}


def _query(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: import_module(f"stratabox.llm.{module}").query(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"stratabox.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
