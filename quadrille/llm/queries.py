"""The queries of this subpackage's operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module that defines a function of that name (and SQL, where SQL can express it).
MODULES = {
    "op1_embedding_near_dedup": "embedding_dedup",
    "op2_quality_classifier": "quality",
    "op3_lm_scoring": "lm",
    "op4_sentencepiece": "sentencepiece_codec",
    "op5_simhash_near_dedup": "simhash",
    "op6_source_mixing": "mixing",
    "op7_language_id": "language",
    "op8_substring_dedup": "substring_dedup",
    "op9_line_dedup": "line_dedup",
    "op10_exact_dedup": "exact_dedup",
    "op11_embedding_whitening": "whitening",
    "op12_toxicity": "toxicity",
    "op13_hard_negatives": "hard_negatives",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: getattr(importlib.import_module(f"quadrille.llm.{module}"), name) for name, module in MODULES.items()}
    return found | {"pipeline": importlib.import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"quadrille.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
