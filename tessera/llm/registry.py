"""Queries of the llm operators and the SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: (module, query function, SQL constant or None)
_ENTRIES = (
    ("chat", "op1_chat_formatting", "OP1_SQL"),
    ("decontamination", "op2_decontamination", None),
    ("quality_rules", "op3_quality_rules", None),
    ("near_dups", "op4_near_duplicates", None),
    ("mixing", "op5_mixing", None),
    ("toxicity", "op6_toxicity", None),
    ("warc", "op7_warc", "OP7_SQL"),
    ("quality_classifier", "op8_quality_classifier", None),
    ("lm_scoring", "op9_lm_scoring", None),
    ("repeats", "op10_suffix_dedup", None),
    ("divergence", "op11_source_divergence", "OP11_SQL"),
    ("importance", "op12_importance_resampling", "OP12_SQL"),
    ("main_text", "op13_html_extraction", "OP13_SQL"),
)


def _module(name: str):
    return importlib.import_module(f"tessera.llm.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f: getattr(_module(m), f) for m, f, _ in _ENTRIES}


def oracle_sql() -> dict[str, str]:
    return {f: getattr(_module(m), sql) for m, f, sql in _ENTRIES if sql}
