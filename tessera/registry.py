"""Registry of the queries of the library's own operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera import catalog

MODULES = ("queries_text", "queries_sandbox", "queries_rank", "queries_search", "queries_plan", "queries_eval", "queries_state", "queries_sources", "queries_records")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessera.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(catalog.PLANS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(catalog.SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents for each benchmark item by hybrid search: dense and sparse hits, fused."""
    from tessera.queries_search import hybrid

    return hybrid(spark, sf_dir).where("unified_rank <= 10").select("query_id", "item_id", "fused_score", "support", "unified_rank")
