"""Clean-up of candidate pools before a reranker, and what follows it.

Candidates have query_id, candidate_id, doc_id, kind, family, score and, by operator, section_id,
asset_id, section_path, version_group_id, version_no, is_active, index_ready, doc_status,
rerank_score, feature_score. Every operator works on all queries at once; pools of one query are
small. Orders are total: score, then candidate_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How many candidates of a family are kept, and its floors.
KEEP = {"dense": 8, "sparse": 8, "hybrid": 12, "asset": 8, "lexical": 8, "grounding": 12, "fallback": 6, "unknown": 6}
RELATIVE_FLOOR = {"dense": 0.20, "sparse": 0.15, "hybrid": 0.20, "asset": 0.10, "lexical": 0.05, "grounding": 0.05, "fallback": 0.05, "unknown": 0.10}
ABSOLUTE_FLOOR = {"dense": 0.01, "sparse": 0.01, "hybrid": 0.01, "asset": 0.001, "lexical": 0.001, "grounding": 0.001, "fallback": 0.001, "unknown": 0.001}
GONE = ("retired", "expired", "deleted")
PER_SECTION = 2
MODEL_POOL = 50
RANK_CONSTANT, FEATURE_WEIGHT = 60, 0.02
LOW_MARGIN, ASSET_MARGIN = 0.03, 0.08


def _policy(values: dict, default: Column) -> Column:
    out = None
    for k, v in values.items():
        hit = F.col("family") == k
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(default)


def _top(df: DataFrame, by: list[str], order: list, limit: Column | int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= limit).drop("__r")



def _stable() -> list[Column]:
    return [F.desc("score"), F.asc("candidate_id")]


def deduplicate(c: DataFrame) -> DataFrame:
    """The best candidate of each document, section or asset, by kind; others by candidate."""
    same = (
        F.when(F.col("kind").isin("doc_summary", "grounded_doc"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
        .when(F.col("kind").isin("section_summary", "grounded_section") & F.col("section_id").isNotNull(), F.concat(F.lit("section:"), F.col("section_id").cast("string")))
        .when(F.col("kind").isin("asset_summary", "grounded_asset") & F.col("asset_id").isNotNull(), F.concat(F.lit("asset:"), F.col("asset_id").cast("string")))
        .otherwise(F.concat(F.lit("id:"), F.col("candidate_id")))
    )
    return _top(c.withColumn("__same", same), ["query_id", "kind", "__same"], _stable(), 1).drop("__same")


def governed(c: DataFrame) -> DataFrame:
    """Active, indexed and not retired, expired or deleted."""
    status = F.lower(F.trim(F.coalesce("doc_status", F.lit(""))))
    return c.where(F.col("is_active") & F.col("index_ready") & ~status.isin(*GONE))


def newest_versions(c: DataFrame) -> DataFrame:
    """The newest version of each candidate within a version group; what has no version passes."""
    versioned = F.col("version_group_id").isNotNull() & F.col("version_no").isNotNull()
    key = F.when(versioned, F.concat_ws("/", F.col("version_group_id").cast("string"), "kind", "candidate_id")).otherwise(F.concat(F.lit("none/"), F.col("kind"), F.lit("/"), F.col("candidate_id"), F.lit("/"), F.coalesce(F.col("version_no").cast("string"), F.lit(""))))
    return _top(c.withColumn("__key", key), ["query_id", "__key"], [F.desc_nulls_last("version_no"), *_stable()], 1).drop("__key")


def above_floors(c: DataFrame) -> DataFrame:
    """At or above the family's absolute floor and its share of the family's best score."""
    own = F.greatest(F.col("score"), F.lit(0.0))
    top = F.max(own).over(Window.partitionBy("query_id", "family"))
    floor = F.greatest(_policy(ABSOLUTE_FLOOR, F.lit(0.0)), top * _policy(RELATIVE_FLOOR, F.lit(0.0)))
    return c.withColumn("__floor", floor).where(own >= F.col("__floor")).drop("__floor")


def section_key() -> Column:
    deep = F.size("section_path") >= 2
    doc = F.col("doc_id").cast("string")
    return F.when(deep, F.concat_ws(":", doc, F.get("section_path", F.lit(0)), F.get("section_path", F.lit(1)))).otherwise(F.concat_ws(":", doc, F.lit("section"), F.coalesce(F.col("section_id").cast("string"), F.lit("0"))))


def diverse(c: DataFrame, per_section: int = PER_SECTION) -> DataFrame:
    """At most `per_section` candidates of a document's section."""
    return _top(c.withColumn("__key", section_key()), ["query_id", "__key"], _stable(), per_section).drop("__key")


def within_families(c: DataFrame, least: int = 0) -> DataFrame:
    """At most so many of a family as its limit, or `least`, if that is more, allows; families without a limit stay whole."""
    limit = F.greatest(_policy(KEEP, F.lit(1 << 30)), F.lit(least))
    return _top(c.withColumn("__limit", limit), ["query_id", "family"], _stable(), F.col("__limit")).drop("__limit")


def model_pool(c: DataFrame, most: int = MODEL_POOL) -> DataFrame:
    return _top(c, ["query_id"], _stable(), most)


def fused(c: DataFrame) -> DataFrame:
    """final_score: reciprocal ranks by retrieval and by reranker, and the weighted feature score.

    Candidates without a rerank score rank behind the others where a query has any, else only
    retrieval counts.
    """
    by = Window.partitionBy("query_id")
    retrieval = F.row_number().over(by.orderBy(*_stable()))
    rerank = F.row_number().over(by.orderBy(F.desc_nulls_last("rerank_score"), "candidate_id"))
    any_ = F.count("rerank_score").over(by) > 0
    out = c.withColumn("__a", retrieval).withColumn("__b", rerank).withColumn("__any", any_)
    total = 1 / (RANK_CONSTANT + F.col("__a")) + F.when(F.col("__any"), 1 / (RANK_CONSTANT + F.col("__b"))).otherwise(0.0) + FEATURE_WEIGHT * F.col("feature_score")
    return out.withColumn("final_score", F.round(total, 8)).drop("__a", "__b", "__any")


def ranked(c: DataFrame, most: int = 12) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("feature_score"), F.desc("score"), "candidate_id")
    return c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def exit_signal(r: DataFrame, asset_fallback: bool = False) -> DataFrame:
    """Per query of ranked candidates: margin between the best two, confidence, and the decision."""
    g = r.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("final_score"))).alias("top1"),
        F.max(F.when(F.col("rank") == 2, F.col("final_score"))).alias("top2"),
        F.max(F.when(F.col("rank") == 1, F.coalesce("rerank_score", F.lit(0.0)))).alias("top1_rerank"),
        F.count(F.lit(1)).alias("candidates"),
    )
    margin = F.round(F.col("top1") - F.col("top2"), 6)
    alone = F.abs("top1") / (F.abs("top1") + 1)
    sure = F.least(F.lit(1.0), F.abs(margin) / F.greatest(F.abs("top1") + F.abs("top2"), F.lit(1e-6)))
    back = F.lit("asset_fallback" if asset_fallback else "empty_response")
    decision = F.when(F.col("top1_rerank") < 0, back).when(F.col("top2").isNull(), "answer").when(margin < LOW_MARGIN, back)
    if asset_fallback:
        decision = decision.when(margin < ASSET_MARGIN, "asset_fallback")
    return g.select("query_id", "candidates", margin.alias("margin"), F.round(F.when(F.col("top2").isNull(), alone).otherwise(sure), 6).alias("confidence"), decision.otherwise("answer").alias("decision"))
