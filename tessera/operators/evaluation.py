"""Ranking metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.tiles import block_count, blocks, deal


def ranking_metrics(predicted: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """hit, recall, mrr and ndcg at k of each query that has gold.

    predicted: query_id, doc_id, rank (from 1). gold: query_id, doc_id, relevance; only positive ones
    count. Gains are 2 ** relevance - 1, discounts log2(rank + 1); the ideal list ends at k too. A
    query without predictions has zeros.
    """
    gold = gold.where("relevance > 0").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    gain = lambda rank: (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col(rank) + 1)
    ideal = gold.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"), F.sum(F.when(F.col("i") <= k, gain("i"))).alias("ideal"))
    hits = predicted.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"])
    found = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.count_distinct("doc_id").alias("n_found"), F.sum(gain("rank")).alias("dcg"))
    return _metrics(ideal.join(found, "query_id", "left"))


def _metrics(both: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "query_id",
        F.when(F.col("first").isNotNull(), 1).otherwise(0).alias("hit"),
        F.round(zero(F.col("n_found") / F.col("n_gold")), 6).alias("recall"),
        F.round(zero(1 / F.col("first")), 6).alias("mrr"),
        F.round(zero(F.col("dcg") / F.col("ideal")), 6).alias("ndcg"),
    )


def first_hits(predicted: DataFrame, gold: DataFrame, on: list[str], name: str) -> DataFrame:
    """query_id and the rank of its first prediction that is gold by `on`."""
    return predicted.join(gold.select("query_id", *on).distinct(), ["query_id", *on]).groupBy("query_id").agg(F.min("rank").alias(name))


def grouped_report(ranks: DataFrame, by: str, cuts: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """Hit rates at the cuts and MRR of a `rank` column, over all queries and by `by`, in one pass."""
    rates = [F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), 6).alias(f"hit_{k}") for k in cuts]
    out = ranks.groupingSets([[], [by]], by).agg(F.grouping(by).cast("int").alias("overall"), F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), *rates)
    return out


# --- gold by topic -----------------------------------------------------------------------------
#
# Where a whole topic of documents is gold to every query of that topic, the pairs grow with the product
# of both. They are given as topics (query_id, topic), shared (topic, doc_id, relevance) and own
# (query_id, doc_id, relevance, for single queries), and nothing below but `gold_ranks` makes the pairs.


def _most(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("relevance").alias("relevance"))


def judged(pairs: DataFrame, topics: DataFrame, shared: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (query_id, doc_id, ...) that are gold, with their greatest relevance, and `shared`: that of the topic, null if only an own one."""
    t = topics.distinct()
    s, o = _most(shared, "topic", "doc_id").withColumnRenamed("relevance", "shared"), _most(own, "query_id", "doc_id").withColumnRenamed("relevance", "own")
    both = pairs.join(t, "query_id", "left").join(s, ["topic", "doc_id"], "left").join(o, ["query_id", "doc_id"], "left")
    return both.where("shared IS NOT NULL OR own IS NOT NULL").withColumn("relevance", F.greatest("shared", "own")).drop("own")


def topic_hits(predicted: DataFrame, topics: DataFrame, shared: DataFrame, own: DataFrame, name: str) -> DataFrame:
    """`first_hits` by document, with gold by topic."""
    return judged(predicted, topics, shared, own).groupBy("query_id").agg(F.min("rank").alias(name))


def topic_metrics(predicted: DataFrame, topics: DataFrame, shared: DataFrame, own: DataFrame, k: int = 10) -> DataFrame:
    """`ranking_metrics` with gold by topic. The ideal list needs the number of documents per relevance only: the topic's, changed by the query's own."""
    shared, own = shared.where("relevance > 0"), own.where("relevance > 0")
    s, t = _most(shared, "topic", "doc_id"), topics.where("query_id IS NOT NULL").distinct()
    counts = t.join(s.groupBy("topic", "relevance").agg(F.count(F.lit(1)).alias("n")), "topic").select("query_id", "relevance", "n")
    o = _most(own, "query_id", "doc_id").join(t, "query_id", "left").join(s.withColumnRenamed("relevance", "was"), ["topic", "doc_id"], "left").where("was IS NULL OR relevance > was")
    change = F.array(F.struct("relevance", F.lit(1).cast("long").alias("n")), F.struct(F.col("was").alias("relevance"), F.lit(-1).cast("long").alias("n")))
    counts = counts.unionByName(o.select("query_id", F.inline(change)).where("relevance IS NOT NULL")).groupBy("query_id", "relevance").agg(F.sum("n").alias("n")).where("n > 0")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("relevance")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = F.when(F.col("before") < k, F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k).cast("long"))))
    discounts = F.aggregate(places, F.lit(0.0), lambda x, i: x + 1 / F.log2(i + 1))
    gained = F.pow(F.lit(2.0), "relevance") - 1
    ideal = counts.withColumn("before", before).groupBy("query_id").agg(F.sum("n").alias("n_gold"), F.sum(gained * F.coalesce(discounts, F.lit(0.0))).alias("ideal"))
    hits = judged(predicted.where(F.col("rank") <= k), topics, shared, own)
    found = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.count_distinct("doc_id").alias("n_found"), F.sum(gained / F.log2(F.col("rank") + 1)).alias("dcg"))
    return _metrics(ideal.join(found, "query_id", "left"))


def gold_ranks(predicted: DataFrame, topics: DataFrame, shared: DataFrame, own: DataFrame, size: int = 512) -> DataFrame:
    """query_id, doc_id, rank: every gold pair once, with the least rank it was predicted at, or null.

    The result is as large as the pairs are many. Each task has some queries and some blocks of their
    topics' documents, writes what was not predicted, and no pair is shuffled but those predicted and the own ones.
    """
    shared, own = shared.where("relevance > 0"), own.where("relevance > 0")
    s, t = shared.select("topic", "doc_id").distinct(), topics.where("query_id IS NOT NULL AND topic IS NOT NULL").distinct()
    apart = own.select("query_id", "doc_id").withColumn("own", F.lit(True))
    given = predicted.select("query_id", "doc_id", "rank")
    named = given.unionByName(apart.select("query_id", "doc_id", F.lit(None).cast("long").alias("rank"))).groupBy("query_id", "doc_id").agg(F.min("rank").cast("long").alias("rank"))
    told = judged(named, topics, shared, own)  # what was predicted or is an own one, in the topic or not
    n = block_count(s, "topic", size)
    held = told.where("shared IS NOT NULL").select("query_id", "topic", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("__j"))
    held = held.groupBy("query_id", "topic", "__j").agg(F.collect_list("doc_id").alias("__held"))
    asked = t.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(held, ["query_id", "topic", "__j"], "left")
    rows = deal(asked, "topic", "__j").join(blocks(s, "topic", "doc_id", n, "__docs", "__j"), ["topic", "__j"])
    docs = F.col("__docs.doc_id")
    rest = rows.select("query_id", F.explode(F.when(F.col("__held").isNull(), docs).otherwise(F.array_except(docs, "__held"))).alias("doc_id"))
    unknown = apart.where("query_id IS NULL OR doc_id IS NULL").select("query_id", "doc_id").distinct()  # joins leave these out
    return told.select("query_id", "doc_id", "rank").unionByName(rest.unionByName(unknown).withColumn("rank", F.lit(None).cast("long")))


# --- the retrieval report ----------------------------------------------------------------------

CUTS = (1, 3, 5, 10, 20)


def _related(predicted: DataFrame, gold: DataFrame, sections: DataFrame, radius: int) -> DataFrame:
    """query_id, parent_rank, neighbor_rank: the first prediction that is a gold section, or one of its group, or one of its windows within `radius`.

    A group is the windows of one section: same document, source, path and parent, none of these
    parents null. Predictions meet the gold groups of their own query only.
    """
    group = ["doc_id", "source_id", "toc_path", "parent_section_id"]
    known = sections.select("section_id", F.when(F.col("parent_section_id").isNotNull(), F.struct(*group)).alias("g"), "window_index")
    p = predicted.select("query_id", "rank", "section_id").join(known, "section_id").select("query_id", "rank", F.col("section_id").alias("p"), F.col("g").alias("pg"), F.col("window_index").alias("pw"))
    q = gold.select("query_id", "section_id").distinct().join(known, "section_id").select("query_id", F.col("section_id").alias("q"), F.col("g").alias("qg"), F.col("window_index").alias("qw"))
    both = p.join(q, "query_id")
    same, grouped = F.col("p") == F.col("q"), F.coalesce(F.col("pg") == F.col("qg"), F.lit(False))
    near = grouped & F.coalesce(F.abs(F.col("pw") - F.col("qw")) <= radius, F.lit(False))
    ranks = both.groupBy("query_id").agg(F.min(F.when(same | grouped, F.col("rank"))).alias("parent_rank"), F.min(F.when(same | near, F.col("rank"))).alias("neighbor_rank"))
    located = q.select("query_id").distinct().withColumn("located", F.lit(True))
    return located.join(ranks, "query_id", "left")


def miss_category(doc_rank: Column, parent_rank: Column, neighbor_rank: Column, same_doc: Column) -> Column:
    """Why a query found none of its sections."""
    return (
        F.when(doc_rank.isNull(), "doc_miss").when(neighbor_rank.isNotNull(), "same_parent_neighbor").when(parent_rank.isNotNull(), "same_parent_non_neighbor")
        .when(same_doc, "same_doc_other_section").otherwise("section_miss_other")
    )


def retrieval_details(queries: DataFrame, predicted: DataFrame, gold: DataFrame, sections: DataFrame, top_k: int, radius: int = 1) -> DataFrame:
    """A row per query: ranks of its first hits by document, section, parent and neighbour, candidates, and the category of a miss.

    queries: query_id, question_type; predicted: query_id, rank, doc_id, section_id; gold: query_id,
    doc_id, section_id; sections: section_id, doc_id, source_id, toc_path, parent_section_id,
    window_index. Ranks beyond `top_k` are none. Where no gold section is known, parent and
    neighbour ranks are that of the section.
    """
    top = predicted.where(F.col("rank") <= top_k)
    doc = first_hits(top, gold.where("doc_id IS NOT NULL"), ["doc_id"], "doc_rank")
    section = first_hits(top, gold.where("section_id IS NOT NULL"), ["section_id"], "section_rank")
    counts = predicted.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    owned = predicted.select("query_id", "section_id").join(sections.select("section_id", "doc_id"), "section_id").join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    same = owned.select("query_id").distinct().withColumn("same_doc", F.lit(True))
    out = queries.select("query_id", F.coalesce("question_type", F.lit("unknown")).alias("question_type"))
    for part in (doc, section, _related(top, gold, sections, radius), counts, same):
        out = out.join(part, "query_id", "left")
    for c in ("parent_rank", "neighbor_rank"):
        out = out.withColumn(c, F.when(F.col("located"), F.col(c)).otherwise(F.col("section_rank")))
    category = miss_category(F.col("doc_rank"), F.col("parent_rank"), F.col("neighbor_rank"), F.coalesce("same_doc", F.lit(False)))
    return out.select(
        "query_id", "question_type", "doc_rank", "section_rank", "parent_rank", "neighbor_rank", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(F.col("section_rank").isNull(), category).alias("miss_category"),
    )


def retrieval_report(details: DataFrame, top_k: int, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Rates over all queries (question_type null) and by question type: hits at the cuts, reciprocal ranks, candidates, and a count per category of miss."""
    kinds = ("doc", "section", "parent", "neighbor")
    rates = [F.round(F.avg(F.coalesce((F.col(f"{x}_rank") <= k).cast("int"), F.lit(0))), 6).alias(f"{x}_hit_{k}") for x in kinds for k in cuts if k <= top_k]
    mrr = [F.round(F.avg(F.coalesce(1 / F.col(f"{x}_rank"), F.lit(0.0))), 6).alias(f"{x}_mrr") for x in kinds]
    of = [F.min("candidates").alias("candidates_min"), F.round(F.avg("candidates"), 6).alias("candidates_avg"), F.max("candidates").alias("candidates_max")]
    missed = [F.count_if(F.col("miss_category") == c).alias(c) for c in ("doc_miss", "same_parent_neighbor", "same_parent_non_neighbor", "same_doc_other_section", "section_miss_other")]
    return details.groupingSets([[], ["question_type"]], "question_type").agg(F.count(F.lit(1)).alias("queries"), *mrr, *rates, *of, *missed)
