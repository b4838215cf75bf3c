"""Fusion of branches by reciprocal rank."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEMANTIC = ("vector", "local", "global", "special")
LEXICAL = ("section", "metadata")
RANK_CONSTANT = 60


def branch_weights(hits: DataFrame, alpha: float = 0.5) -> DataFrame:
    """query_id, branch, weight of the branches that have hits (query_id, branch).

    Where a query has both kinds, alpha is dealt among its semantic branches and the rest among its
    lexical ones, 0.05 a kind at least, and other branches weigh 1; else each branch weighs 1.
    """
    alpha = min(max(alpha, 0.0), 1.0)
    used = hits.select("query_id", "branch").distinct()
    kind = F.when(F.col("branch").isin(*SEMANTIC), 1).when(F.col("branch").isin(*LEXICAL), 2).otherwise(0)
    by = Window.partitionBy("query_id")
    used = used.withColumn("kind", kind).withColumn("semantic", F.count_if(F.col("kind") == 1).over(by)).withColumn("lexical", F.count_if(F.col("kind") == 2).over(by))
    both = (F.col("semantic") > 0) & (F.col("lexical") > 0)
    weight = F.when(both & (F.col("kind") == 1), max(alpha, 0.05) / F.col("semantic")).when(both & (F.col("kind") == 2), max(1 - alpha, 0.05) / F.col("lexical")).otherwise(1.0)
    return used.select("query_id", "branch", weight.alias("weight"))


def weighted_scores(hits: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Fuses dense and sparse hits (query_id, branch, item_id, score) by alpha and 1 - alpha of their scores.

    Scores are brought to 0..1 first: a cosine of the branch `vector` by (1 + s) / 2, others, which have no
    upper bound, by 2 / pi * atan(s). Returns query_id, item_id, fused_score, support, unified_rank;
    order: score, support, id.
    """
    dense = F.col("branch") == "vector"
    scaled = F.when(dense, (1 + F.col("score")) / 2 * alpha).otherwise(F.atan(F.greatest(F.col("score"), F.lit(0.0))) * (2 / math.pi) * (1 - alpha))
    fused = hits.groupBy("query_id", "item_id").agg(F.round(F.sum(scaled), 12).alias("fused_score"), F.count(F.lit(1)).alias("support"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), F.desc("support"), F.col("item_id").cast("string"))
    return fused.withColumn("unified_rank", F.row_number().over(order))


def reciprocal_rank(hits: DataFrame, weights: DataFrame | None = None, k: int = RANK_CONSTANT) -> DataFrame:
    """Fuses hits (query_id, branch, item_id, rank, score): the sum of weight / (k + rank) over branches.

    Returns query_id, item_id, fused_score, support, best_rank, branch_scores, unified_rank. Order:
    score, support, best rank, id. Scores are rounded to 12 digits, so the order of sums is of no account.
    """
    weighted = hits.withColumn("weight", F.lit(1.0)) if weights is None else hits.join(weights, ["query_id", "branch"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    fused = weighted.groupBy("query_id", "item_id").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 12).alias("fused_score"),
        F.count(F.lit(1)).alias("support"),
        F.min("rank").alias("best_rank"),
        F.map_from_entries(F.collect_list(F.struct("branch", F.greatest(F.col("score"), F.lit(0.0))))).alias("branch_scores"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), F.desc("support"), "best_rank", "item_id")
    return fused.withColumn("unified_rank", F.row_number().over(order))
