"""Planning of retrieval, for batches of queries: each rule is a column or a plan over all queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

WHITELIST = 1000
MOST_VALUES = 16
DEEP_TASKS = ("comparison", "timeline", "research")
ASSET_SOURCES = ("pptx", "xlsx", "image", "pdf")
# What a comparison is split at, in this order.
SEPARATORS = (" 和 ", " 与 ", " and ", " vs ", " VS ", " versus ", " compare ", "对比")
EDGE = " ：:，,。"


def complexity_gate(query: Column, task: Column, constrained: Column, needs_graph: Column) -> Column:
    units = T.text_unit_count(query)
    return F.when(task.isin(*DEEP_TASKS), "complex").when((units <= 24) & ~constrained, "fast_track").when((units <= 72) & ~needs_graph, "standard").otherwise("complex")


def semantic_route(needs_special: Column, needs_structure: Column, special_targets: Column, source_types: Column, pages: Column) -> Column:
    asset = F.arrays_overlap(F.transform(source_types, F.lower), F.array(*map(F.lit, ASSET_SOURCES)))
    return (
        F.when(needs_special & ~needs_structure, "asset_first")
        .when(needs_special | (F.size(special_targets) > 0) | (asset & (F.size(pages) > 0)), "text_plus_asset")
        .otherwise("text_first")
    )


def runtime_mode(task: Column, scope_size: Column, needs_graph: Column) -> Column:
    return F.when(needs_graph | task.isin(*DEEP_TASKS) | ((task == "synthesis") & (scope_size != 1)), "deep").otherwise("fast")


def rewritten(query: Column, gate: Column, extras: Column) -> Column:
    """The query with its focus and quoted terms, each once, unless it is on the fast track."""
    terms = F.array_distinct(extras)
    return F.when((gate == "fast_track") | (F.size(terms) == 0), T.strip(query)).otherwise(F.concat_ws(" ", T.strip(query), F.array_join(terms, " ")))


def comparison_sides(query: Column) -> Column:
    """[left, right] at the first separator that the query has, if both sides have text, else null."""
    body, out = T.strip(query), F.lit(None).cast("array<string>")
    trim = lambda c: F.regexp_replace(c, f"^[{EDGE}]+|[{EDGE}]+$", "")
    for s in reversed(SEPARATORS):
        at = F.locate(s, body)
        left = trim(F.replace(F.replace(F.substring(body, F.lit(1), at - 1), F.lit("Compare"), F.lit("")), F.lit("compare"), F.lit("")))
        right = trim(F.substring(body, at + len(s), F.length(body)))
        out = F.when((at > 0) & (left != "") & (right != ""), F.array(left, right)).otherwise(out)
    return out


def predicate_plans(scopes: DataFrame, documents: DataFrame, attributes: list[str], whitelist: int = WHITELIST, most: int = MOST_VALUES) -> DataFrame:
    """How each query's scope (query_id, doc_id) becomes a predicate: query_id, n_docs, strategy, field, n_values.

    Up to `whitelist` documents are listed; beyond it an attribute that all documents have, with the
    fewest values, `most` at most, stands for them (ties in the order given); else the scope overflows.
    """
    scopes = scopes.select("query_id", "doc_id").distinct()
    known = scopes.join(documents.select("doc_id", *attributes), "doc_id", "left")
    value = lambda a: F.nullif(F.trim(F.col(a).cast("string")), F.lit(""))
    counts = known.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_docs"), *(F.count_distinct(value(a)).alias(f"n_{a}") for a in attributes), *(F.count_if(value(a).isNull()).alias(f"missing_{a}") for a in attributes))
    usable = [F.when((F.col(f"missing_{a}") == 0) & F.col(f"n_{a}").between(1, most), F.struct(F.col(f"n_{a}").alias("n"), F.lit(k).alias("place"), F.lit(a).alias("field"))) for k, a in enumerate(attributes)]
    best = F.array_min(F.filter(F.array(*usable), lambda x: x.isNotNull()))
    listed = F.col("n_docs") <= whitelist
    strategy = F.when(listed, "doc_id_whitelist").when(best.isNotNull(), "attribute_filter").otherwise("none")
    return counts.select("query_id", "n_docs", strategy.alias("strategy"), F.when(~listed, best["field"]).alias("field"), F.when(~listed, best["n"]).alias("n_values"))


def version_gate(scope: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, doc_id: the active documents of the version group of each scoped document, or itself if there is none.

    documents: doc_id, version_group_id, is_active. What isn't a document is dropped.
    """
    known = scope.join(documents.select("doc_id", "version_group_id"), "doc_id")
    groups = known.where("version_group_id IS NOT NULL").select("query_id", "version_group_id").distinct()
    active = documents.where("is_active AND version_group_id IS NOT NULL").select("version_group_id", F.col("doc_id").alias("active_id"))
    gated = groups.join(active, "version_group_id").select("query_id", F.col("active_id").alias("doc_id"))
    alone = known.join(active.select("version_group_id").distinct(), "version_group_id", "left_anti").select("query_id", "doc_id")
    return gated.union(alone).distinct()
