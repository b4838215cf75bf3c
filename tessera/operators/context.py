"""Evidence for a prompt: token budgets, priorities, local ranking, support and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T

MOST_TOKENS, LEAST_TOKENS = 2500, 40
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def token_budgets(evidence: DataFrame, budget: int, priority: list[Column]) -> DataFrame:
    """query_id, evidence_id, assigned of evidence (query_id, evidence_id, tokens).

    If all fit, each gets what it wants. Else, in order of priority, each gets what is left, up to
    2,500 tokens; less than 40 counts as none and uses nothing up. The rule is sequential, so it is a
    fold over the evidence of one query.
    """
    items = evidence.select("query_id", F.struct(F.row_number().over(Window.partitionBy("query_id").orderBy(*priority)).alias("place"), F.greatest("tokens", F.lit(1)).cast("long").alias("tokens"), "evidence_id").alias("x"))
    g = items.groupBy("query_id").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.sum("x.tokens").alias("total"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<long>").alias("out"))

    def step(acc, x):
        t = F.least(x["tokens"], acc["left"], F.lit(MOST_TOKENS).cast("long"))
        t = F.when(t < LEAST_TOKENS, F.lit(0).cast("long")).otherwise(t)
        return F.struct((acc["left"] - t).alias("left"), F.concat(acc["out"], F.array(t)).alias("out"))

    folded = F.aggregate("xs", start, step)["out"]
    wanted = F.transform("xs", lambda x: x["tokens"])
    given = F.when(F.col("total") <= budget, wanted).otherwise(folded)
    return g.select("query_id", F.explode(F.arrays_zip(F.col("xs.evidence_id").alias("evidence_id"), given.alias("assigned"))).alias("z")).select("query_id", F.col("z.evidence_id").alias("evidence_id"), F.col("z.assigned").alias("assigned"))


def family_order(profile: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(families that are to be covered, all families in order) of a retrieval profile."""
    orders = {"bypass": (1, ("vector", "kg", "multimodal", "external")), "fast": (1, ("vector", "multimodal", "kg", "external")), "asset": (2, ("multimodal", "vector", "kg", "external"))}
    n, order = orders.get(profile, (3, ("kg", "vector", "multimodal", "external")))
    return order[:n], order


def prioritized(evidence: DataFrame, most: int, coverage: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The rows of evidence (query_id, place, family, score, group_key, doc_id, internal) that a prompt has room for, `most` a query.

    Where there are more, the best of each family in `coverage` comes first. Best is by family, score,
    whether its group and its document are new among those chosen, whether it is internal, and place.
    The rest follow by the same order, what is new being judged by the coverage alone.
    """
    rank = F.lit(0)
    for i, f in enumerate(order):
        rank = F.when(F.col("family") == f, len(order) - i).otherwise(rank)
    e = evidence.withColumn("__rank", rank).withColumn("__score", F.greatest(F.col("score"), F.lit(0.0)))
    e = e.withColumn("__many", F.count(F.lit(1)).over(Window.partitionBy("query_id")) > most)
    crowded = e.where("__many")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    doc = evidence.schema["doc_id"].dataType.simpleString()
    chosen = crowded.select("query_id").distinct().select("query_id", none("string").alias("__groups"), none(doc).alias("__docs"), none("int").alias("__places"))

    def key(df: DataFrame) -> Column:
        new_group = ~F.array_contains("__groups", F.col("group_key"))
        new_doc = F.col("doc_id").isNotNull() & ~F.coalesce(F.array_contains("__docs", F.col("doc_id")), F.lit(False))
        return F.struct(F.col("__rank"), F.col("__score"), new_group.cast("int").alias("g"), new_doc.cast("int").alias("d"), F.col("internal").cast("int").alias("i"), (-F.col("place")).alias("p"))

    for family in coverage:
        open_ = crowded.where(F.col("family") == family).join(chosen, "query_id").where((F.size("__places") < most) & ~F.array_contains("__places", F.col("place")))
        best = open_.groupBy("query_id").agg(F.max_by(F.struct("group_key", "doc_id", "place"), key(open_)).alias("b"))
        grown = lambda c, x: F.when(F.col("b").isNotNull(), F.array_append(c, F.col(f"b.{x}"))).otherwise(F.col(c)).alias(c)
        chosen = chosen.join(best, "query_id", "left").select("query_id", grown("__groups", "group_key"), grown("__docs", "doc_id"), grown("__places", "place"))
    rest = crowded.join(chosen, "query_id")
    taken = F.array_contains("__places", F.col("place"))
    rest = rest.withColumn("__key", key(rest)).withColumn("__n", F.row_number().over(Window.partitionBy("query_id", taken).orderBy(F.desc("__key"))))
    kept = rest.where(taken | (F.col("__n") <= most - F.size("__places")))
    return e.where("NOT __many").select(*evidence.columns).unionByName(kept.select(*evidence.columns))


def numbered(evidence: DataFrame, room: int) -> DataFrame:
    """evidence (query_id, place, tokens) with label (E1, E2...), selected_tokens, truncated, and per query how many were clipped and skipped.

    `room` is what one item may have; items without tokens are skipped and get no label.
    """
    by = Window.partitionBy("query_id")
    marked = evidence.withColumn("__used", F.col("tokens") > 0).withColumn("truncated", F.col("tokens") > room).withColumn("selected_tokens", F.least(F.col("tokens"), F.lit(room)))
    n = F.sum(F.col("__used").cast("int")).over(by.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("label", F.concat(F.lit("E"), n.cast("string"))).withColumn("n_clipped", F.count_if("truncated").over(by)).withColumn("n_skipped", F.count_if(~F.col("__used")).over(by))
    return out.where("__used").drop("__used")


def clipped_to_total(items: DataFrame, budget: int, order: list) -> DataFrame:
    """Adds `kept`: tokens of each item until the budget is used up; the item that crosses it is clipped."""
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("tokens"), budget - before)))


def local_score(score: Column, overlap: Column, rank: Column, n: Column) -> Column:
    """Retrieval score, terms in common, and a bonus for the place the reranker gave."""
    return F.round(score + 0.05 * overlap + F.when(rank.isNotNull(), 0.25 * (n - rank) / n).otherwise(0.0), 6)


def support(answer: Column, evidence: Column) -> Column:
    """Share of the answer's terms that the evidence has."""
    terms = T.search_terms(answer)
    return F.when(F.size(terms) > 0, F.round(F.size(F.array_intersect(terms, T.search_terms(evidence))) / F.size(terms), 6)).otherwise(0.0)


def grounded(answer: Column, evidence: Column) -> Column:
    """Each sentence is in the evidence, or shares two terms with it and half of its own."""
    known = T.search_terms(evidence)

    def held(s):
        terms = T.search_terms(s)
        return F.contains(F.lower(evidence), F.lower(s)) | (F.size(F.array_intersect(terms, known)) >= F.greatest(F.lit(2), F.ceil(F.size(terms) / 2)))

    return F.forall(T.sentences(answer), held)


def numbered_citations(text: Column) -> Column:
    """[Doc-N] markers become superscripts, numbered by first appearance."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[Doc-\d+\]"), F.lit(0)))
    pairs = F.transform(marks, lambda m, i: F.struct(m.alias("m"), F.translate((i + 1).cast("string"), "0123456789", SUPERSCRIPTS).alias("s")))
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["m"], p["s"]))
