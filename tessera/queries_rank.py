"""Queries of fusion and ranking. Candidates stand for hits: order lines, by supplier as the query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.catalog import query, table
from tessera.operators import fusion, rank

_HITS = """hits AS (SELECT query_id, branch, item_id, score, row_number() OVER (PARTITION BY query_id, branch ORDER BY score DESC, item_id) AS rank FROM (
  SELECT l_suppkey AS query_id, CASE l_returnflag WHEN 'A' THEN 'vector' WHEN 'N' THEN 'section' ELSE 'special' END AS branch, CAST(l_partkey AS VARCHAR) AS item_id, max(l_extendedprice) AS score
  FROM lineitem WHERE NOT (l_suppkey % 7 = 0 AND l_returnflag = 'N') GROUP BY ALL)),
top AS (SELECT * FROM hits WHERE rank <= 12)"""


def hits(spark, sf, most: int = 12):
    """Up to `most` hits of each branch: query_id, branch, item_id, score, rank."""
    li = table(spark, sf, "lineitem").where(~((F.col("l_suppkey") % 7 == 0) & (F.col("l_returnflag") == "N")))
    branch = F.when(F.col("l_returnflag") == "A", "vector").when(F.col("l_returnflag") == "N", "section").otherwise("special")
    h = li.groupBy(F.col("l_suppkey").alias("query_id"), branch.alias("branch"), F.col("l_partkey").cast("string").alias("item_id")).agg(F.max("l_extendedprice").alias("score"))
    return h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "branch").orderBy(F.desc("score"), "item_id"))).where(F.col("rank") <= most)


_WEIGHTS = """used AS (SELECT DISTINCT query_id, branch FROM top), kinds AS (SELECT *, branch IN ('vector', 'local', 'global', 'special') AS s, branch IN ('section', 'metadata') AS x FROM used),
n AS (SELECT query_id, count(*) FILTER (s) AS ns, count(*) FILTER (x) AS nx FROM kinds GROUP BY query_id),
weights AS (SELECT query_id, branch, CASE WHEN ns > 0 AND nx > 0 AND s THEN 0.65::DOUBLE / ns WHEN ns > 0 AND nx > 0 AND x THEN 0.35::DOUBLE / nx ELSE 1.0 END AS weight FROM kinds JOIN n USING (query_id))"""


@query("branch_weights", f"WITH {_HITS}, {_WEIGHTS} SELECT query_id, branch, round(weight, 9) AS weight FROM weights")
def branch_weights(spark, sf):
    return fusion.branch_weights(hits(spark, sf), 0.65).withColumn("weight", F.round("weight", 9))


_FUSED = """fused AS (SELECT query_id, item_id, round(sum(weight / (60 + rank)), 12) AS fused_score, count(*) AS support, min(rank) AS best_rank FROM top JOIN weights USING (query_id, branch) GROUP BY 1, 2)"""


@query("rrf_fusion", f"WITH {_HITS}, {_WEIGHTS}, {_FUSED} SELECT query_id, item_id, round(fused_score, 9) AS fused_score, support, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, support DESC, best_rank, item_id) AS unified_rank FROM fused")
def rrf_fusion(spark, sf):
    h = hits(spark, sf)
    f = fusion.reciprocal_rank(h, fusion.branch_weights(h, 0.65))
    return f.select("query_id", "item_id", F.round("fused_score", 9).alias("fused_score"), "support", F.col("best_rank").cast("long").alias("best_rank"), F.col("unified_rank").cast("long").alias("unified_rank"))


@query("branch_union", f"WITH {_HITS} SELECT query_id, branch, count(*) AS n, max(rank) AS deepest FROM top GROUP BY ALL")
def branch_union(spark, sf):
    h = hits(spark, sf)
    parts = [h.where(F.col("branch") == b) for b in ("vector", "section", "special")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("query_id", "branch").agg(F.count(F.lit(1)).alias("n"), F.max("rank").cast("long").alias("deepest"))


_CANDIDATES = """c AS (SELECT l_suppkey AS query_id, l_orderkey || '-' || l_linenumber AS candidate_id, l_partkey AS doc_id, l_partkey % 50 AS section_id, l_partkey % 20 AS asset_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'section_summary' WHEN 1 THEN 'doc_summary' ELSE 'asset_summary' END AS kind,
  CASE l_linenumber WHEN 1 THEN 'dense' WHEN 2 THEN 'sparse' WHEN 3 THEN 'hybrid' WHEN 4 THEN 'asset' WHEN 5 THEN 'lexical' WHEN 6 THEN 'grounding' ELSE 'fallback' END AS family,
  round(l_discount * l_quantity / 5, 6) AS score, CASE WHEN l_tax > 0.02 THEN l_partkey % 30 END AS version_group_id, l_linenumber AS version_no, l_returnflag <> 'R' AS is_active, true AS index_ready,
  CASE WHEN l_tax = 0.08 THEN ' Retired' ELSE 'published' END AS doc_status, CASE WHEN l_tax > 0.03 THEN [l_linestatus, l_returnflag] ELSE [l_linestatus] END AS section_path,
  CASE WHEN l_discount > 0.01 THEN round(0.1 - l_tax + l_quantity / 1000, 6) END AS rerank_score, round(l_linenumber * 0.05, 6) AS feature_score FROM lineitem)"""


def candidates(spark, sf):
    n, tax = F.col("l_linenumber"), F.col("l_tax")
    kind = F.when(n % 3 == 0, "section_summary").when(n % 3 == 1, "doc_summary").otherwise("asset_summary")
    family = F.element_at(F.array(*map(F.lit, ("dense", "sparse", "hybrid", "asset", "lexical", "grounding", "fallback"))), F.least(n, F.lit(7)))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string")).alias("candidate_id"), F.col("l_partkey").alias("doc_id"),
        (F.col("l_partkey") % 50).alias("section_id"), (F.col("l_partkey") % 20).alias("asset_id"), kind.alias("kind"), family.alias("family"),
        F.round(F.col("l_discount") * F.col("l_quantity") / 5, 6).alias("score"), F.when(tax > 0.02, F.col("l_partkey") % 30).alias("version_group_id"), n.alias("version_no"),
        (F.col("l_returnflag") != "R").alias("is_active"), F.lit(True).alias("index_ready"), F.when(tax == 0.08, " Retired").otherwise("published").alias("doc_status"),
        F.when(tax > 0.03, F.array("l_linestatus", "l_returnflag")).otherwise(F.array("l_linestatus")).alias("section_path"),
        F.when(F.col("l_discount") > 0.01, F.round(0.1 - tax + F.col("l_quantity") / 1000, 6)).alias("rerank_score"), F.round(n * 0.05, 6).alias("feature_score"),
    )


_ROW = "row_number() OVER (PARTITION BY {} ORDER BY score DESC, candidate_id)"
_SAME = "CASE kind WHEN 'doc_summary' THEN 'doc:' || doc_id WHEN 'section_summary' THEN 'section:' || section_id ELSE 'asset:' || asset_id END"
_DEDUP = f"dedup AS (SELECT * EXCLUDE r FROM (SELECT *, {_ROW.format(f'query_id, kind, {_SAME}')} AS r FROM c) WHERE r = 1)"
_GOV = "governed AS (SELECT * FROM dedup WHERE is_active AND index_ready AND lower(trim(doc_status)) NOT IN ('retired', 'expired', 'deleted'))"
_POLICY = "policy(family, keep, rel, least) AS (VALUES ('dense', 8, 0.20, 0.01), ('sparse', 8, 0.15, 0.01), ('hybrid', 12, 0.20, 0.01), ('asset', 8, 0.10, 0.001), ('lexical', 8, 0.05, 0.001), ('grounding', 12, 0.05, 0.001), ('fallback', 6, 0.05, 0.001))"


def _floors(of: str) -> str:
    return f"floored AS (SELECT * EXCLUDE (keep, rel, least, top) FROM (SELECT f.*, p.*EXCLUDE family, max(greatest(score, 0)) OVER (PARTITION BY query_id, family) AS top FROM {of} f JOIN policy p USING (family)) WHERE greatest(score, 0) >= greatest(least::DOUBLE, top * rel::DOUBLE))"


_KEY = "CASE WHEN len(section_path) >= 2 THEN doc_id || ':' || section_path[1] || ':' || section_path[2] ELSE doc_id || ':section:' || section_id END"


def _diverse(of: str) -> str:
    return f"varied AS (SELECT * EXCLUDE r FROM (SELECT *, {_ROW.format(f'query_id, {_KEY}')} AS r FROM {of}) WHERE r <= 2)"


def _families(of: str) -> str:
    return f"limited AS (SELECT * EXCLUDE (r, keep) FROM (SELECT f.*, p.keep, {_ROW.format('query_id, family')} AS r FROM {of} f JOIN policy p USING (family)) WHERE r <= keep)"


_IDS = ["query_id", "candidate_id", "family", "score"]
_SELECT = "SELECT query_id, candidate_id, family, score FROM"


@query("dedup_candidates", f"WITH {_CANDIDATES}, {_DEDUP} {_SELECT} dedup")
def dedup_candidates(spark, sf):
    return rank.deduplicate(candidates(spark, sf)).select(*_IDS)


@query("governance_filter", f"WITH {_CANDIDATES}, {_DEDUP}, {_GOV} {_SELECT} governed")
def governance_filter(spark, sf):
    return rank.governed(rank.deduplicate(candidates(spark, sf))).select(*_IDS)


@query(
    "version_filter",
    """WITH v AS (SELECT o_custkey AS query_id, o_orderpriority AS candidate_id, o_orderstatus AS kind, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 END AS version_group_id, o_orderkey % 11 AS version_no, o_orderkey AS row_id, o_totalprice AS score FROM orders)
SELECT query_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, version_group_id, kind, candidate_id ORDER BY version_no DESC, score DESC) AS r FROM v) WHERE r = 1 OR version_group_id IS NULL""",
)
def version_filter(spark, sf):
    o = F.col("o_orderkey")
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("candidate_id"), F.col("o_orderstatus").alias("kind"), F.when(o % 5 > 0, o % 3).alias("version_group_id"), (o % 11).alias("version_no"), o.alias("row_id"), F.col("o_totalprice").alias("score"))
    free = c.where("version_group_id IS NULL")
    return rank.newest_versions(c.where("version_group_id IS NOT NULL")).unionByName(free).select("query_id", "row_id")


@query("score_floors", f"WITH {_CANDIDATES}, {_POLICY}, {_floors('c')} {_SELECT} floored")
def score_floors(spark, sf):
    return rank.above_floors(candidates(spark, sf)).select(*_IDS)


@query("section_diversity", f"WITH {_CANDIDATES}, {_diverse('c')} {_SELECT} varied")
def section_diversity(spark, sf):
    return rank.diverse(candidates(spark, sf)).select(*_IDS)


@query("family_limits", f"WITH {_CANDIDATES}, {_POLICY}, {_families('c')} {_SELECT} limited")
def family_limits(spark, sf):
    return rank.within_families(candidates(spark, sf)).select(*_IDS)


def _pool(spark, sf):
    c = rank.governed(rank.deduplicate(candidates(spark, sf)))
    return rank.model_pool(rank.within_families(rank.diverse(rank.above_floors(c))))


_PIPELINE = f"""WITH {_CANDIDATES}, {_POLICY}, {_DEDUP}, {_GOV}, {_floors('governed')}, {_diverse('floored')}, {_families('varied')},
pool AS (SELECT * EXCLUDE r FROM (SELECT *, {_ROW.format('query_id')} AS r FROM limited) WHERE r <= 50),
f AS (SELECT *, round(1.0::DOUBLE / (60 + {_ROW.format('query_id')}) + CASE WHEN count(rerank_score) OVER (PARTITION BY query_id) > 0
  THEN 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, candidate_id)) ELSE 0 END + 0.02::DOUBLE * feature_score, 8) AS final_score FROM pool),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, feature_score DESC, score DESC, candidate_id) AS rank FROM f) WHERE rank <= 12)"""


@query("rank_pipeline", f"{_PIPELINE} SELECT query_id, candidate_id, family, score, final_score, CAST(rank AS INT) AS rank FROM ranked")
def rank_pipeline(spark, sf):
    """All steps: copies, governance, floors, diversity, family limits, pool, fusion, order."""
    return rank.ranked(rank.fused(_pool(spark, sf))).select(*_IDS, "final_score", "rank")


@query(
    "exit_signal",
    f"""{_PIPELINE}, g AS (SELECT query_id, max(final_score) FILTER (rank = 1) AS a, max(final_score) FILTER (rank = 2) AS b, coalesce(max(rerank_score) FILTER (rank = 1), 0) AS rr, count(*) AS candidates FROM ranked GROUP BY query_id)
SELECT query_id, candidates, round(a - b, 6) AS margin, round(CASE WHEN b IS NULL THEN abs(a) / (abs(a) + 1) ELSE least(1.0, abs(round(a - b, 6)) / greatest(abs(a) + abs(b), 1e-6)) END, 6) AS confidence,
  CASE WHEN rr < 0 THEN 'asset_fallback' WHEN b IS NULL THEN 'answer' WHEN round(a - b, 6) < 0.03 THEN 'asset_fallback' WHEN round(a - b, 6) < 0.08 THEN 'asset_fallback' ELSE 'answer' END AS decision FROM g""",
)
def exit_signal(spark, sf):
    return rank.exit_signal(rank.ranked(rank.fused(_pool(spark, sf))), asset_fallback=True)


@query(
    "feature_scores",
    """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x, source, lang FROM documents)
SELECT doc_id, round(least(len(list_intersect(x, ['the', 'of', 'and', 'der', 'la', 'idiot', 'token'])), 5) * 0.05::DOUBLE + CASE WHEN list_contains(x, '2') THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN lang = 'en' THEN 0.30::DOUBLE ELSE 0 END, 6) AS feature_score FROM t""",
)
def feature_scores(spark, sf):
    from tessera.functions import text as T

    d = table(spark, sf, "documents").select("doc_id", "lang", T.search_terms("text").alias("x"))
    asked = F.array(*map(F.lit, ("the", "of", "and", "der", "la", "idiot", "token")))
    score = F.least(F.size(F.array_intersect("x", asked)), F.lit(5)) * 0.05 + F.when(F.array_contains("x", "2"), 0.25).otherwise(0.0) + F.when(F.col("lang") == "en", 0.30).otherwise(0.0)
    return d.select("doc_id", F.round(score, 6).alias("feature_score"))


@query("rank_assign", "SELECT l_suppkey AS query_id, l_orderkey, l_linenumber, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 12")
def rank_assign(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("rank", F.row_number().over(w)).where("rank <= 12").select(F.col("l_suppkey").alias("query_id"), "l_orderkey", "l_linenumber", "rank")


@query(
    "collapse_by_target",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS d FROM lineitem)
SELECT l_suppkey AS query_id, l_partkey AS target, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM b WHERE d = 1) WHERE r <= 10""",
)
def collapse_by_target(spark, sf):
    """The best hit of each grounding target, then the ten best targets."""
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]
    best = table(spark, sf, "lineitem").withColumn("d", F.row_number().over(Window.partitionBy("l_suppkey", "l_partkey").orderBy(*order))).where("d = 1")
    out = best.withColumn("rank", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order))).where("rank <= 10")
    return out.select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("target"), "rank")


@query("rerank_pool", f"WITH {_CANDIDATES} SELECT query_id, candidate_id, CASE WHEN r <= 20 THEN rerank_score END AS rerank_score FROM (SELECT *, {_ROW.format('query_id')} AS r FROM c) WHERE r <= 50")
def rerank_pool(spark, sf):
    """Only the head of the pool is scored by the reranker."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    c = candidates(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 50")
    return c.select("query_id", "candidate_id", F.when(F.col("r") <= 20, F.col("rerank_score")).alias("rerank_score"))


@query(
    "reranker_caps",
    f"""WITH {_CANDIDATES}, t AS (SELECT query_id, candidate_id, least(1 + doc_id % 500, 384) AS tok, {_ROW.format('query_id')} AS r FROM c), s AS (SELECT *, sum(tok) OVER (PARTITION BY query_id ORDER BY r) AS total FROM t WHERE r <= 16)
SELECT query_id, candidate_id, tok AS tokens FROM s WHERE total <= 2048""",
)
def reranker_caps(spark, sf):
    """What a reranker is given: sixteen texts at most, 384 tokens of each and 2,048 in all."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    c = candidates(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 16").withColumn("tokens", F.least(1 + F.col("doc_id") % 500, F.lit(384)))
    return c.withColumn("total", F.sum("tokens").over(Window.partitionBy("query_id").orderBy("r"))).where("total <= 2048").select("query_id", "candidate_id", "tokens")
