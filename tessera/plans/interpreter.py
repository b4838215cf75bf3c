"""Runs retrieval plans: each branch once for all queries whose plan has it, then what stages and fallbacks add for those that need it.

A plan is columns of the query's row: `paths`, `stages` and `fallback`, as `plans.paths` makes them. A retriever
is a function from queries (query_id, text) and a number to hits (query_id, item_id, score, rank from 1), by a name:
that of a branch, or branch:collection for the stages. A branch without a retriever has no hits and is told so.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.runtime import shared_path

Retriever = Callable[[DataFrame, int], DataFrame]
Judge = Callable[[DataFrame, DataFrame], DataFrame]


def _kept(df: DataFrame, tag: str) -> DataFrame:
    """df, run once: later steps ask it what is still to do."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _asked(queries: DataFrame, steps: str) -> DataFrame:
    """query_id, branch, text, limit of the steps of each query; a branch that a plan names twice runs once, by its greatest limit.

    Sparse variants are asked by sparse_text, where a query has one, others by text.
    """
    sparse = F.col("sparse_text") if "sparse_text" in queries.columns else F.lit(None).cast("string")
    rows = queries.select("query_id", "text", sparse.alias("sparse_text"), F.explode(steps).alias("s"))
    variant = F.col("s.variant") if "variant" in rows.schema["s"].dataType.names else F.lit("dense")
    text = F.when(variant == "sparse", F.coalesce("sparse_text", "text")).otherwise(F.col("text"))
    return rows.groupBy("query_id", F.col("s.branch").alias("branch")).agg(F.first(text).alias("text"), F.max("s.limit").alias("limit"))


def run_branches(asked: DataFrame, retrievers: Mapping[str, Retriever]) -> DataFrame:
    """Hits (query_id, branch, item_id, score, rank) of asked (query_id, branch, text, limit): as many of each branch as its limit says."""
    asked, found = _kept(asked, "asked"), None
    most = {r["branch"]: r["most"] for r in asked.groupBy("branch").agg(F.max("limit").alias("most")).collect()}  # a row per branch
    for name, n in sorted(most.items()):
        if name in retrievers and n > 0:
            own = asked.where(F.col("branch") == name)
            hits = retrievers[name](own.select("query_id", "text"), n).join(own.select("query_id", "limit"), "query_id").where(F.col("rank") <= F.col("limit"))
            part = hits.select("query_id", F.lit(name).alias("branch"), "item_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        kind = asked.schema["query_id"].dataType.simpleString()
        return asked.sparkSession.createDataFrame([], f"query_id {kind}, branch string, item_id string, score double, rank int")
    return _kept(found, "hits")


def run_stages(queries: DataFrame, retrievers: Mapping[str, Retriever]) -> DataFrame:
    """Hits of staged plans: queries (query_id, text, stages).

    A stage runs for its query always, or, as `if_insufficient`, where earlier stages of its branch have
    given fewer than its min_hits; then it adds up to its limit of what they haven't got. Ranks go on.
    """
    steps = queries.select("query_id", "text", F.posexplode("stages").alias("at", "s")).select("query_id", "text", "at", "s.*")
    steps = _kept(steps, "stages")
    found, last = None, steps.agg(F.max("at")).first()[0]
    for at in range((last if last is not None else -1) + 1):
        own = steps.where(F.col("at") == at)
        if found is not None:
            have = found.groupBy("query_id", "branch").agg(F.count(F.lit(1)).alias("have"))
            own = own.join(have, ["query_id", "branch"], "left").where((F.col("trigger") == "always") | (F.coalesce("have", F.lit(0)) < F.col("min_hits")))
        asked = own.select("query_id", "text", F.concat_ws(":", "branch", "collection").alias("branch"), "limit")
        new = run_branches(asked, retrievers)
        new = new.withColumn("branch", F.substring_index("branch", ":", 1)).withColumn("stage", F.lit(at))
        if found is None:
            found = new
            continue
        new = new.join(found.select("query_id", "branch", "item_id"), ["query_id", "branch", "item_id"], "left_anti")
        last_rank = found.groupBy("query_id", "branch").agg(F.max("rank").alias("before"))
        nth = F.row_number().over(Window.partitionBy("query_id", "branch").orderBy("rank"))
        new = new.withColumn("rank", nth).join(last_rank, ["query_id", "branch"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("before")
        found = _kept(found.unionByName(new), "hits")
    return found if found is not None else run_branches(queries.select("query_id", F.lit("").alias("branch"), "text", F.lit(0).alias("limit")).limit(0), {}).withColumn("stage", F.lit(0))


def run_plans(queries: DataFrame, retrievers: Mapping[str, Retriever], judge: Judge | None = None) -> DataFrame:
    """Hits of queries (query_id, text, paths; sparse_text and fallback where they have them), with `step`: main or fallback.

    `judge` gives a signal (query_id, signal) for the hits of the first step and its queries. Where it is
    the trigger of steps of a query's fallback, their branches run for that query, unless its paths had them.
    """
    main = run_branches(_asked(queries, "paths"), retrievers).withColumn("step", F.lit("main"))
    if judge is None or "fallback" not in queries.columns:
        return main
    signals = judge(main.drop("step"), queries.select("query_id", "text"))
    had = F.transform("paths", lambda p: p["branch"])
    steps = F.filter("fallback", lambda s: (s["trigger"] == F.col("signal")) & ~F.array_contains(had, s["branch"]))
    again = queries.join(signals.select("query_id", "signal"), "query_id").withColumn("__again", steps).where(F.size("__again") > 0)
    more = run_branches(_asked(again, "__again"), retrievers).withColumn("step", F.lit("fallback"))
    return main.unionByName(more.withColumn("item_id", F.col("item_id").cast(main.schema["item_id"].dataType)))


def too_few(least: int, signal: str = "asset_fallback") -> Judge:
    """A judge that gives `signal` to queries with fewer than `least` hits, `answer` to the others."""

    def judge(hits: DataFrame, queries: DataFrame) -> DataFrame:
        n = hits.groupBy("query_id").agg(F.count_distinct("item_id").alias("n"))
        return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.when(F.coalesce("n", F.lit(0)) < least, signal).otherwise("answer").alias("signal"))

    return judge


def unavailable(queries: DataFrame, retrievers: Mapping[str, Retriever]) -> DataFrame:
    """query_id, branch of what plans name and no retriever serves."""
    return queries.select("query_id", F.explode("paths").alias("p")).select("query_id", F.col("p.branch").alias("branch")).where(~F.col("branch").isin(*retrievers)).distinct()
