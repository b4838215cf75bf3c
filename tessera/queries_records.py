"""Queries of records, index maintenance, grounding and answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.catalog import query, table
from tessera.functions import hooks, spans
from tessera.functions import text as T
from tessera.functions import structured
from tessera.operators import context, layout, sections, telemetry
from tessera.operators.order import numbered
from tessera.queries_text import windows_sql
from tessera.runtime import ship

# --- records and index rows --------------------------------------------------------------------

# Fixed value: characters of an index row's texts.
MOST_CHARS = 65_535


@query("index_rows", "SELECT doc_id, coalesce(source, '') AS source_id, left(text, 65535) AS summary, left(concat_ws(' ', lang, source, text), 65535) AS bm25_text, CASE WHEN doc_id % 4 = 0 THEN 'cold' ELSE 'hot' END AS partition_key, 1700000000000 + doc_id * 1000 AS updated_ms FROM documents")
def index_rows(spark, sf):
    updated = F.unix_millis(F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id")))
    return table(spark, sf, "documents").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source_id"), F.left("text", F.lit(MOST_CHARS)).alias("summary"), F.left(F.concat_ws(" ", "lang", "source", "text"), F.lit(MOST_CHARS)).alias("bm25_text"),
        F.when(F.col("doc_id") % 4 == 0, "cold").otherwise("hot").alias("partition_key"), updated.alias("updated_ms"),
    )


@query("section_invariants", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= l_discount * 100 OR l_tax * 100 > l_linenumber")
def section_invariants(spark, sf):
    """Sections whose ranges are empty or reach out of their record: an assertion returns what violates it."""
    ok = (F.col("l_quantity") > F.col("l_discount") * 100) & (F.col("l_tax") * 100 <= F.col("l_linenumber"))
    return table(spark, sf, "lineitem").where(~ok).select("l_orderkey", "l_linenumber")


@query(
    "contract_diff",
    "WITH a AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier WHERE s_suppkey % 5 > 0), b AS (SELECT s_suppkey AS k, s_nationkey + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM supplier WHERE s_suppkey % 3 > 0) SELECT coalesce(a.k, b.k) AS k, a.v AS stored, b.v AS current_value FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v",
)
def contract_diff(spark, sf):
    """Keys on which two contracts differ, those that only one has included."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    a = s.where(k % 5 > 0).select(k.alias("k"), F.col("s_nationkey").alias("stored"))
    b = s.where(k % 3 > 0).select(k.alias("k"), (F.col("s_nationkey") + F.when(k % 7 == 0, 1).otherwise(0)).alias("current_value"))
    return a.join(b, "k", "full").where(~F.col("stored").eqNullSafe(F.col("current_value")))


@query("metadata_strings", """SELECT event_id, coalesce(CAST(CASE WHEN user_id % 3 > 0 THEN user_id END AS VARCHAR), '') AS user_text, '{"type":"' || event_type || '","n":' || user_id || '}' AS payload, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def metadata_strings(spark, sf):
    """Metadata as strings: null is empty, structures are JSON."""
    user = F.coalesce(F.when(F.col("user_id") % 3 > 0, F.col("user_id")).cast("string"), F.lit(""))
    payload = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("n")))
    return table(spark, sf, "events").select("event_id", user.alias("user_text"), payload.alias("payload"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("scope_tokens", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_partkey AS VARCHAR) IN ('7', '12', '99') OR list_has_any(string_split(l_suppkey || ',' || (l_suppkey + 1), ','), ['7', '12', '99'])")
def scope_tokens(spark, sf):
    """Rows whose own id or listed ids meet the requested scope."""
    tokens = F.array_union(F.array(F.col("l_partkey").cast("string")), F.split(F.concat_ws(",", F.col("l_suppkey").cast("string"), (F.col("l_suppkey") + 1).cast("string")), ","))
    return table(spark, sf, "lineitem").where(F.arrays_overlap(tokens, F.array(*map(F.lit, ("7", "12", "99"))))).select("l_orderkey", "l_linenumber")


@query("collection_names", "SELECT p_partkey, left(lower(regexp_replace('index__' || p_brand || '__' || p_type, '[^A-Za-z0-9_]', '_', 'g')), 200) AS collection FROM part")
def collection_names(spark, sf):
    name = F.concat_ws("__", F.lit("index"), "p_brand", "p_type")
    return table(spark, sf, "part").select("p_partkey", F.left(F.lower(F.regexp_replace(name, "[^A-Za-z0-9_]", "_")), F.lit(200)).alias("collection"))


@query(
    "upsert_natural_key",
    """WITH old AS (SELECT c_name AS name, c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey % 3 > 0), new AS (SELECT c_name AS name, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(old.id, (SELECT max(id) FROM old) + row_number() OVER (PARTITION BY old.id IS NULL ORDER BY new.name)) AS id, coalesce(new.name, old.name) AS name, round(coalesce(new.v, old.v), 2) AS v FROM old FULL JOIN new ON old.name = new.name""",
)
def upsert_natural_key(spark, sf):
    """Known keys keep their ids and get new values; new keys are numbered after the greatest id."""
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 3 > 0").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("old_v"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), (F.col("c_acctbal") + 1).alias("new_v"))
    known = old.join(new, "name", "left").select("id", "name", F.coalesce("new_v", "old_v").alias("v"))
    fresh = numbered(new.join(old, "name", "left_anti"), "n", [F.col("name")]).crossJoin(F.broadcast(old.agg(F.max("id").alias("top"))))
    return known.union(fresh.select(F.col("top") + F.col("n"), "name", "new_v")).select("id", "name", F.round("v", 2).alias("v"))


@query("delete_documents", "SELECT l_returnflag, count(*) AS kept FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def delete_documents(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(gone, "l_orderkey", "left_anti").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("kept"))


@query("point_lookup", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_id IN (3, 77, 5000)")
def point_lookup(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_id").isin(3, 77, 5000))
    return e.select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


@query("version_activate", "SELECT o_orderkey, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_active FROM orders")
def version_activate(spark, sf):
    """One active version of each group."""
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") == F.max("o_orderkey").over(Window.partitionBy("o_custkey"))).alias("is_active"))


@query("index_state", "SELECT d.doc_id, coalesce(l.quality = 1, false) AS index_ready, CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.doc_id IS NULL THEN 'pending' ELSE 'ready' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def index_state(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("known").isNull(), "pending").otherwise("ready")
    return d.select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("index_ready"), status.alias("status"))


@query("deactivate", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def deactivate(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_anti")


@query("summary_rows", "SELECT d.doc_id, 'doc:' || d.doc_id || ':' || b.n AS item_id, md5(d.text) AS summary_md5 FROM documents d JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) b USING (source) WHERE length(trim(d.text)) > 0")
def summary_rows(spark, sf):
    """Summaries joined to what they are of; empty ones aren't saved."""
    d = table(spark, sf, "documents")
    b = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    d = d.join(b, "source").where(F.length(F.trim("text")) > 0)
    return d.select("doc_id", F.concat_ws(":", F.lit("doc"), F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("item_id"), F.md5(F.col("text").cast("binary")).alias("summary_md5"))


@query("asset_records", "SELECT p_partkey AS asset_id, CASE WHEN p_size % 4 = 0 THEN 'table' WHEN p_size % 4 = 1 THEN 'figure' ELSE 'caption' END AS kind, p_size % 4 = 0 AS compute_only, p_size AS bbox_l, p_size + 20 AS bbox_b FROM part WHERE p_size % 4 < 3")
def asset_records(spark, sf):
    """Kinds that are assets, with their box; tables are for computing only."""
    s = F.col("p_size")
    kind = F.when(s % 4 == 0, "table").when(s % 4 == 1, "figure").otherwise("caption")
    box = F.struct(s.alias("l"), (s + 1).alias("t"), (s + 10).alias("r"), (s + 20).alias("b"))
    out = F.col("bbox")
    return table(spark, sf, "part").where(s % 4 < 3).select(F.col("p_partkey").alias("asset_id"), kind.alias("kind"), (s % 4 == 0).alias("compute_only"), box.alias("bbox")).select("asset_id", "kind", "compute_only", out["l"].alias("bbox_l"), out["b"].alias("bbox_b"))


@query("candidate_structs", "SELECT l_orderkey || '#' || l_linenumber AS citation_anchor, CASE WHEN l_linenumber = 1 THEN 'document' ELSE 'section' END AS target_kind, l_orderkey AS target_id FROM lineitem")
def candidate_structs(spark, sf):
    anchor = F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    target = F.struct(F.when(F.col("l_linenumber") == 1, "document").otherwise("section").alias("kind"), F.col("l_orderkey").alias("id"))
    return table(spark, sf, "lineitem").select(anchor.alias("citation_anchor"), target.alias("t")).select("citation_anchor", F.col("t.kind").alias("target_kind"), F.col("t.id").alias("target_id"))


@query("evidence_split", "SELECT user_id, count(*) FILTER (event_type = 'error') AS external, count(*) FILTER (event_type = 'signup') AS graph, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS internal FROM events GROUP BY 1")
def evidence_split(spark, sf):
    e = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(e == "error").alias("external"), F.count_if(e == "signup").alias("graph"), F.count_if(~e.isin("error", "signup")).alias("internal"))


@query("rerank_text", "SELECT p_partkey, concat_ws(chr(10) || chr(10), p_name, CASE WHEN p_size % 2 = 0 THEN p_brand || ' > ' || p_type ELSE p_brand END, CASE WHEN p_size % 3 = 0 THEN 'parent' END) AS rendered FROM part")
def rerank_text(spark, sf):
    """Title, path and parent text, where there are any, apart by blank lines."""
    path = F.concat_ws(" > ", F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")).otherwise(F.array("p_brand")))
    parts = F.array("p_name", path, F.when(F.col("p_size") % 3 == 0, "parent").otherwise(" "))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.filter(F.transform(parts, T.strip), lambda x: x != ""), "\n\n").alias("rendered"))


@query("web_branch", "SELECT url AS item_id, 'web' AS branch, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]+)', 1) ORDER BY page_id) AS r FROM pages) WHERE r <= 3")
def web_branch(spark, sf):
    """Three web results of each host."""
    w = Window.partitionBy(F.regexp_extract("url", "//([^/]+)", 1)).orderBy("page_id")
    return table(spark, sf, "pages").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select(F.col("url").alias("item_id"), F.lit("web").alias("branch"), "rank")


@query("focus_terms", "WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM benchmark) SELECT item_id, len(CASE WHEN len(list_filter(x, lambda t: t NOT IN ('the', 'of', 'and', 'de', 'la'))) = 0 THEN x ELSE list_filter(x, lambda t: t NOT IN ('the', 'of', 'and', 'de', 'la')) END) AS n_focus FROM t")
def focus_terms(spark, sf):
    """Terms without stop words, or all if nothing is left."""
    x = T.search_terms("text")
    kept = F.array_except(x, F.array(*map(F.lit, ("the", "of", "and", "de", "la"))))
    return table(spark, sf, "benchmark").select("item_id", F.size(F.when(F.size(kept) == 0, x).otherwise(kept)).cast("long").alias("n_focus"))


# --- context and grounding ---------------------------------------------------------------------

_EV = "e AS (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS evidence_id, CAST(l_quantity * 60 AS BIGINT) AS tokens, l_extendedprice AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem)"


def evidence(spark, sf, most: int):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    e = table(spark, sf, "lineitem").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return e.select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), (F.col("l_quantity") * 60).cast("long").alias("tokens"), F.col("l_extendedprice").alias("score"), "r")


@query(
    "context_budget",
    f"""WITH {_EV}, g AS (SELECT query_id, sum(tokens) AS total, list(tokens ORDER BY r) AS ts, list(evidence_id ORDER BY r) AS ids FROM e WHERE r <= 12 GROUP BY 1),
f AS (SELECT query_id, total, ts, ids, list_reduce(list_prepend({{'a': 9000::BIGINT, 'o': []::BIGINT[]}}, list_transform(ts, lambda t: {{'a': t, 'o': []::BIGINT[]}})),
  lambda acc, x: {{'a': acc.a - CASE WHEN least(x.a, acc.a, 2500) < 40 THEN 0 ELSE least(x.a, acc.a, 2500) END, 'o': list_append(acc.o, CASE WHEN least(x.a, acc.a, 2500) < 40 THEN 0 ELSE least(x.a, acc.a, 2500) END)}}).o AS o FROM g)
SELECT query_id, unnest(ids) AS evidence_id, unnest(CASE WHEN total <= 9000 THEN ts ELSE o END) AS assigned FROM f""",
)
def context_budget(spark, sf):
    return context.token_budgets(evidence(spark, sf, 12), 9000, [F.desc("score"), F.asc("r")])


@query(
    "output_budget",
    f"WITH {_EV}, s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e WHERE r <= 20) SELECT query_id, evidence_id, CAST(greatest(0, least(tokens, 5000 - b)) AS BIGINT) AS kept FROM s WHERE 5000 - b > 0",
)
def output_budget(spark, sf):
    return context.clipped_to_total(evidence(spark, sf, 20), 5000, ["r"]).where("kept > 0").select("query_id", "evidence_id", F.col("kept").cast("long").alias("kept"))


@query(
    "context_priority",
    """WITH e AS (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS evidence_id, CASE l_returnflag WHEN 'A' THEN 'kg' WHEN 'N' THEN 'vector' ELSE 'multimodal' END AS family, l_extendedprice AS score, l_partkey FROM lineitem),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, family ORDER BY score DESC, evidence_id, l_partkey) AS f FROM e)
SELECT query_id, evidence_id, family FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f > 1, CASE family WHEN 'kg' THEN 0 WHEN 'vector' THEN 1 ELSE 2 END, score DESC, evidence_id, l_partkey) AS r FROM c) WHERE r <= 10""",
)
def context_priority(spark, sf):
    """The best of each family first, then by family and score, ten a query."""
    family = F.when(F.col("l_returnflag") == "A", "kg").when(F.col("l_returnflag") == "N", "vector").otherwise("multimodal")
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), family.alias("family"), F.col("l_extendedprice").alias("score"), "l_partkey")
    best = [F.desc("score"), "evidence_id", "l_partkey"]
    e = e.withColumn("f", F.row_number().over(Window.partitionBy("query_id", "family").orderBy(*best)))
    place = F.when(F.col("family") == "kg", 0).when(F.col("family") == "vector", 1).otherwise(2)
    return e.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("f") > 1, place, *best))).where("r <= 10").select("query_id", "evidence_id", "family")


@query("context_items", f"WITH {_EV} SELECT query_id, evidence_id, 'E' || r AS label, tokens > 1500 AS truncated, least(tokens, 1500) AS selected_tokens FROM e WHERE r <= 8")
def context_items(spark, sf):
    """Evidence numbered E1, E2..., clipped to 1,500 tokens each."""
    e = evidence(spark, sf, 8)
    return e.select("query_id", "evidence_id", F.concat(F.lit("E"), F.col("r").cast("string")).alias("label"), (F.col("tokens") > 1500).alias("truncated"), F.least(F.col("tokens"), F.lit(1500)).alias("selected_tokens"))


@query("local_rank", f"WITH {_EV} SELECT query_id, evidence_id, round(score / 100000 + 0.05::DOUBLE * (tokens % 7) + CASE WHEN r % 3 > 0 THEN 0.25::DOUBLE * (10 - r) / 10 ELSE 0 END, 6) AS local_score FROM e WHERE r <= 10")
def local_rank(spark, sf):
    e = evidence(spark, sf, 10)
    rank = F.when(F.col("r") % 3 > 0, F.col("r"))
    return e.select("query_id", "evidence_id", context.local_score(F.col("score") / 100000, F.col("tokens") % 7, rank, F.lit(10)).alias("local_score"))


_TURNS = "t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"


def _turns(spark, sf):
    return table(spark, sf, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant' AND before IS NOT NULL")


@query(
    "support_links",
    f"WITH {_TURNS}, x AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(before), '[a-z0-9]+')) AS b FROM t WHERE role = 'assistant' AND before IS NOT NULL) SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(a), 6) END AS support FROM x",
)
def support_links(spark, sf):
    """How much of an answer the turn before it supports."""
    return _turns(spark, sf).select("conv_id", "turn", context.support(F.col("text"), F.col("before")).alias("support"))


@query(
    "groundedness",
    rf"""WITH {_TURNS}, s AS (SELECT conv_id, turn, before, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([。！？!?；;.\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS x FROM t WHERE role = 'assistant' AND before IS NOT NULL),
h AS (SELECT conv_id, turn, x, contains(lower(before), lower(x)) AS inside, list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(before), '[a-z0-9]+')) AS b FROM s)
SELECT conv_id, turn, bool_and(inside OR len(list_intersect(a, b)) >= greatest(2, ceil(len(a) / 2))) AS grounded FROM h GROUP BY 1, 2""",
)
def groundedness(spark, sf):
    return _turns(spark, sf).where(F.size(T.sentences("text")) > 0).select("conv_id", "turn", context.grounded(F.col("text"), F.col("before")).alias("grounded"))


@query("citations", "SELECT conv_id, turn, 'a' || conv_id || ' ¹ b ² c ¹ d ³' AS rendered FROM conversations")
def citations(spark, sf):
    text = F.concat(F.lit("a"), F.col("conv_id").cast("string"), F.lit(" [Doc-3] b [Doc-1] c [Doc-3] d [Doc-12]"))
    return table(spark, sf, "conversations").select("conv_id", "turn", context.numbered_citations(text).alias("rendered"))


_ASKED = "['the', 'of', 'und', 'de', 'la', 'erth']"


def _ranked_windows_sql(size: int, overlap: int, most: int) -> str:
    return f"""WITH {windows_sql(size, overlap)}, x AS (SELECT w.doc_id, w.window_index, len(list_intersect(list_distinct(regexp_extract_all(lower(substr(d.text, w.char_start + 1, w.char_end - w.char_start)), '[a-z0-9]+')), {_ASKED})) AS overlap FROM windows w JOIN documents d USING (doc_id))
SELECT doc_id, window_index, overlap, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, window_index) AS r FROM x) WHERE r <= {most}"""


def _ranked_windows(spark, sf, size: int, overlap: int, most: int):
    ship(spark)
    w = spans.windows(table(spark, sf, "documents"), "doc_id", "text", size, overlap)
    asked = F.array(*map(F.lit, ("the", "of", "und", "de", "la", "erth")))
    w = w.select("doc_id", "window_index", T.keyword_overlap(asked, "window_text").cast("long").alias("overlap"))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("overlap"), "window_index"))).where(F.col("rank") <= most)


@query("ground_section", _ranked_windows_sql(220, 30, 6))
def ground_section(spark, sf):
    """The six windows of a section that share most terms with the query."""
    return _ranked_windows(spark, sf, 220, 30, 6)


@query("ground_document", _ranked_windows_sql(120, 20, 2))
def ground_document(spark, sf):
    """The two sections of a document that share most terms with the query."""
    return _ranked_windows(spark, sf, 120, 20, 2)


@query("ground_asset", "SELECT p_partkey AS asset_id, coalesce(CASE WHEN p_size % 3 = 0 THEN p_name END, CASE WHEN p_size % 3 = 1 THEN p_type END, left(p_brand || ' bytes', 4096)) AS asset_text FROM part")
def ground_asset(spark, sf):
    """Preview, else caption, else the first bytes."""
    s = F.col("p_size")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), F.coalesce(F.when(s % 3 == 0, F.col("p_name")), F.when(s % 3 == 1, F.col("p_type")), F.left(F.concat("p_brand", F.lit(" bytes")), F.lit(4096))).alias("asset_text"))


_PARTS = f"""{windows_sql(120, 20)}, parts AS (SELECT w.doc_id, w.window_index, w.doc_id * 1000 + w.window_index AS section_id, w.token_end - w.token_start AS tokens,
  list_distinct(regexp_extract_all(lower(substr(d.text, w.char_start + 1, w.char_end - w.char_start)), '[a-z0-9]+')) AS terms FROM windows w JOIN documents d USING (doc_id)),
asked AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS terms FROM benchmark)"""


@query(
    "ground_hits",
    f"""WITH {_PARTS}, hits AS (SELECT query_id, terms, CAST(p AS INT) AS place, (query_id * 7 + p * 13) % 200 AS doc_id, (query_id * 7 + p * 13) % 200 * 1000 + (query_id + p) % 4 AS section_id, 1 - p / 10.0::DOUBLE AS score FROM asked, range(1, 5) r(p)),
wanted AS (SELECT query_id, terms, place, score, section_id, 'hit' AS source FROM hits JOIN (SELECT section_id FROM parts) USING (section_id)
  UNION ALL SELECT h.query_id, h.terms, h.place, h.score, n.section_id, 'neighbour' FROM hits h JOIN parts s USING (section_id) JOIN parts n ON n.doc_id = s.doc_id AND abs(n.window_index - s.window_index) = 1),
found_pieces AS (SELECT query_id, place, 'grounded:section:' || section_id || ':1' AS evidence_id, source, round(score + 0.05 * len(list_intersect(wanted.terms, parts.terms)), 6) AS local_score, tokens FROM wanted JOIN parts USING (section_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY local_score DESC, evidence_id) AS rank FROM found_pieces WHERE place <= 3),
every AS (SELECT * FROM ranked UNION ALL SELECT query_id, place, 'hit-' || place, 'item', round(score, 6), 2, 1 FROM hits WHERE place <= 3 AND section_id NOT IN (SELECT section_id FROM parts)),
once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY place, rank) = 1),
room AS (SELECT *, 500 - coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY place, rank, evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM once)
SELECT query_id, place, evidence_id, source, local_score, CAST(rank AS INT) AS rank, CAST(least(tokens, room) AS BIGINT) AS n_tokens FROM room WHERE room > 0""",
)
def ground_hits(spark, sf):
    """Four hits of every benchmark item on windows of documents as sections, some of which aren't there: three are read, with their neighbours, up to 500 tokens."""
    ship(spark)
    w = spans.windows(table(spark, sf, "documents"), "doc_id", "text", 120, 20)
    parts = w.select((F.col("doc_id") * 1000 + F.col("window_index")).alias("section_id"), "doc_id", F.col("doc_id").alias("parent_section_id"), "window_index", F.col("window_index").alias("order_index"), F.col("window_text").alias("section_text"))
    hits = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.explode(F.array(*map(F.lit, range(1, 5)))).alias("place"))
    section = (F.col("query_id") * 7 + F.col("place") * 13) % 200 * 1000 + (F.col("query_id") + F.col("place")) % 4
    hits = hits.withColumn("section_id", section).withColumn("score", 1 - F.col("place") / 10).withColumn("evidence_id", F.concat(F.lit("hit-"), F.col("place"))).withColumn("text", F.concat(F.lit("own "), F.col("place")))
    none = spark.createDataFrame([], "section_id long, asset_id long, asset_text string")
    found = sections.ground_sections(hits, parts.drop("section_text"), parts.select("section_id", "section_text"), none, tokens=500)
    return found.select("query_id", "place", "evidence_id", "source", "local_score", "rank", "n_tokens")


@query(
    "section_layout_assets",
    """WITH e AS (SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 3 = 0 THEN 'Table ' WHEN l_linenumber % 3 = 1 THEN 'paragraph' END AS kind, l_linestatus AS path, CAST(1 + l_partkey % 6 AS INT) AS page,
  CASE WHEN l_discount < 0.09 THEN l_quantity * 20 + l_tax * 100 END AS top, CASE WHEN l_discount < 0.09 THEN l_quantity * 20 + l_tax * 100 + 15 END AS bottom FROM lineitem),
a AS (SELECT * FROM e WHERE lower(trim(kind)) = 'table' AND id % 4 <> 0),
s AS (SELECT s_suppkey * 4 + k AS section_id, s_suppkey AS doc_id, CASE k % 2 WHEN 0 THEN 'F' ELSE 'O' END AS path, CASE WHEN k = 3 THEN NULL ELSE 1 + k END AS p1, 2 + k AS p2 FROM supplier, range(4) r(k)),
x AS (SELECT section_id, a.id, s.path, a.path AS own, page, top, s.doc_id, coalesce(p1, p2) AS p1, p2 FROM s JOIN a ON a.doc_id = s.doc_id AND (a.path = s.path OR a.page BETWEEN coalesce(p1, p2) AND p2)),
g AS (SELECT x.section_id, x.id, x.page, x.top, min(abs(x.top - t.bottom)) AS gap FROM x JOIN e t ON t.doc_id = x.doc_id AND t.path = x.path AND t.page = x.page AND x.page BETWEEN x.p1 AND x.p2 AND coalesce(trim(t.kind), '') <> 'Table' GROUP BY ALL),
best AS (SELECT section_id, id, min((CASE WHEN own = path THEN 0 ELSE 1 END, coalesce(gap, 'infinity'::DOUBLE), abs(page - p1))) AS near FROM x LEFT JOIN g USING (section_id, id, page, top) GROUP BY ALL)
SELECT section_id, id AS asset_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY near, id) AS INT) AS place FROM best QUALIFY place <= 6""",
)
def section_layout_assets(spark, sf):
    """The six nearest assets of each section over pages laid out from lineitem: some elements without a box, some assets without a record."""
    li, q = table(spark, sf, "lineitem"), F.col("l_quantity") * 20 + F.col("l_tax") * 100
    kind = F.when(F.col("l_linenumber") % 3 == 0, "Table ").when(F.col("l_linenumber") % 3 == 1, "paragraph")
    box = F.when(F.col("l_discount") < 0.09, F.array(F.lit(0.0), q, F.lit(1.0), q + 15))
    e = li.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("element_id"), kind.alias("kind"), F.array("l_linestatus", F.lit(" ")).alias("toc_path"), (1 + F.col("l_partkey") % 6).cast("int").alias("page_no"), box.alias("bbox"))
    a = e.where("kind = 'Table ' AND element_id % 4 <> 0").select("doc_id", F.col("element_id").alias("asset_id"), F.col("element_id").alias("element_ref"))
    k = F.col("k")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    s = s.select((F.col("doc_id") * 4 + k).alias("section_id"), "doc_id", F.array(F.when(k % 2 == 0, "F").otherwise("O")).alias("toc_path"), F.when(k != 3, k + 1).alias("page_start"), (k + 2).alias("page_end"))
    return layout.section_assets(s, e, a, 6)


class _Stub:
    """A model that fails on every eleventh length of a text."""

    def generate_text(self, prompt):
        if len(prompt) % 11 == 0:
            raise ValueError("no")
        return prompt[:10]

    def embed(self, texts):
        return [[float(len(t))] for t in texts]


@query(
    "provider_telemetry",
    """SELECT 'chat' AS capability, 'stub' AS provider, count(*) AS texts, count(*) FILTER (WHERE length(text) % 11 = 0) AS errors, count(*) AS stage_rows FROM documents
UNION ALL SELECT 'embedding', 'stub', count(*), 0, count(*) FROM documents""",
)
def provider_telemetry(spark, sf):
    """Texts and errors of a model that is told to fail on some, and of one that embeds; rows that went by."""
    seen = telemetry.Telemetry(spark)
    say, embed = hooks.told(seen.watched(_Stub, "chat", "stub")), hooks.embedder(seen.watched(_Stub, "embedding", "stub"))
    docs = seen.stage(table(spark, sf, "documents").select("text"), "documents")
    docs.select(say("text").alias("said"), embed("text").alias("vector")).write.format("noop").mode("overwrite").save()
    rows = seen.stages()[0]["rows"]
    return seen.report().select("capability", "provider", "texts", "errors", F.lit(rows).cast("long").alias("stage_rows"))


@query(
    "fallback_branches",
    """WITH a AS (SELECT l_partkey AS query_id, l_orderkey * 10 + l_linenumber AS item_id FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40), b AS (SELECT l_partkey AS query_id, l_orderkey * 10 + l_linenumber AS item_id FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45)
SELECT *, 'main' AS branch FROM a UNION ALL SELECT *, 'fallback' FROM b WHERE query_id NOT IN (SELECT query_id FROM a)""",
)
def fallback_branches(spark, sf):
    """Queries without a hit get those of the fallback branch; each branch runs once."""
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), "l_returnflag", "l_quantity")
    a = li.where("l_returnflag = 'A' AND l_quantity > 40").select("query_id", "item_id")
    b = li.where("l_returnflag = 'N' AND l_quantity > 45").select("query_id", "item_id").join(a.select("query_id").distinct(), "query_id", "left_anti")
    return a.withColumn("branch", F.lit("main")).union(b.withColumn("branch", F.lit("fallback")))


@query(
    "answer_rows",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS cited, l_suppkey FROM lineitem), f AS (SELECT l_orderkey, cited, min((l_linenumber, l_suppkey)) AS first FROM x GROUP BY 1, 2)
SELECT l_orderkey, cited, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY first, cited) AS INT) AS citation_no FROM f""",
)
def answer_rows(spark, sf):
    """Citations numbered by their first use in an answer."""
    f = table(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 3).alias("cited")).agg(F.min(F.struct("l_linenumber", "l_suppkey")).alias("first"))
    return f.select("l_orderkey", "cited", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("first", "cited")).alias("citation_no"))


# --- prompts and structured text ---------------------------------------------------------------


@query("prompt_render", "SELECT item_id, md5('Question: ' || text || chr(10) || 'Evidence:' || chr(10) || '[E1] ' || text) AS prompt_md5 FROM benchmark")
def prompt_render(spark, sf):
    p = F.concat(F.lit("Question: "), "text", F.lit("\nEvidence:\n[E1] "), "text")
    return table(spark, sf, "benchmark").select("item_id", F.md5(p.cast("binary")).alias("prompt_md5"))


@query("compute_extract", "SELECT conv_id, turn, 'SELECT ' || turn AS sql, conv_id AS asset_id FROM conversations")
def compute_extract(spark, sf):
    """The compute request within a model's text."""
    said = F.concat("text", F.lit('\n<compute_request>{"sql": "SELECT '), F.col("turn").cast("string"), F.lit('",\n "asset_id": '), F.col("conv_id").cast("string"), F.lit("}</compute_request> tail"))
    found = F.from_json(F.regexp_extract(said, r"(?s)<compute_request>\s*(\{.*?\})\s*</compute_request>", 1), "sql string, asset_id long")
    return table(spark, sf, "conversations").select("conv_id", "turn", found["sql"].alias("sql"), found["asset_id"].alias("asset_id"))


@query("json_extract", "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events")
def json_extract(spark, sf):
    """The object within a model's text, null if it isn't valid."""
    said = F.concat(F.lit("Sure:\n"), "props", F.when(F.col("event_id") % 5 > 0, "\nbye").otherwise(" }broken"))
    return table(spark, sf, "events").select("event_id", F.from_json(structured.json_object(said), "k int")["k"].alias("k"))


@query("subtask_query", "SELECT conv_id, turn, text || CASE WHEN turn > 1 THEN ' missing: scope; date' ELSE '' END AS subtask, CASE WHEN turn > 1 THEN 'deep' ELSE 'auto' END AS mode FROM conversations")
def subtask_query(spark, sf):
    """What is missing is added to the query from the second attempt on."""
    again = F.col("turn") > 1
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", F.when(again, " missing: scope; date").otherwise("")).alias("subtask"), F.when(again, "deep").otherwise("auto").alias("mode"))


@query("commit_anchor", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","operation":"index","source":"' || source || '"}') AS anchor FROM documents""")
def commit_anchor(spark, sf):
    """SHA-256 of the compact JSON of a document's state, keys in order."""
    state = F.to_json(F.struct("doc_id", "lang", F.lit("index").alias("operation"), "source"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(state.cast("binary"), 256).alias("anchor"))


@query("eval_items", "SELECT item_id, substr(sha1('q:' || item_id || ':' || text), 1, 16) AS query_id, text AS evidence_text, length(text) AS evidence_end FROM benchmark")
def eval_items(spark, sf):
    key = F.concat_ws(":", F.lit("q"), F.col("item_id").cast("string"), "text")
    ev = F.struct(F.col("text"), F.lit(0).alias("start"), F.length("text").alias("end"))
    return table(spark, sf, "benchmark").select("item_id", F.substring(F.sha1(key.cast("binary")), 1, 16).alias("query_id"), ev.alias("e")).select("item_id", "query_id", F.col("e.text").alias("evidence_text"), F.col("e.end").cast("long").alias("evidence_end"))


@query("generation_resume", "SELECT d.doc_id FROM documents d WHERE substr(sha1(doc_id || ':fact'), 1, 16) NOT IN (SELECT substr(sha1(doc_id || ':fact'), 1, 16) FROM labels)")
def generation_resume(spark, sf):
    """Documents whose generation key isn't done yet."""
    key = F.substring(F.sha1(F.concat(F.col("doc_id").cast("string"), F.lit(":fact")).cast("binary")), 1, 16).alias("key")
    return table(spark, sf, "documents").select("doc_id", key).join(table(spark, sf, "labels").select(key), "key", "left_anti").select("doc_id")


@query("agent_plan", "SELECT conv_id, turn, s AS step, CASE s WHEN 0 THEN 'understand' WHEN 1 THEN 'retrieve' ELSE 'synthesise' END AS purpose FROM conversations, (SELECT unnest(range(3)) AS s) WHERE role = 'user'")
def agent_plan(spark, sf):
    """A plan of three steps for each request."""
    steps = F.array(*map(F.lit, ("understand", "retrieve", "synthesise")))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(steps).alias("step", "purpose")).withColumn("step", F.col("step").cast("long"))


@query("layout_cache", "SELECT l_orderkey AS page, count(*) AS n_elements, string_agg(l_linenumber, ',' ORDER BY l_linenumber, l_partkey) AS elements FROM lineitem GROUP BY 1")
def layout_cache(spark, sf):
    """Elements of each page, in order."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count(F.lit(1)).alias("n_elements"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return g.select("page", "n_elements", F.array_join(F.col("x.l_linenumber").cast("array<string>"), ",").alias("elements"))


@query("graph_edges", "SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, count(*) AS evidence FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2")
def graph_edges(spark, sf):
    """Edges that have evidence, with how much."""
    return table(spark, sf, "lineitem").groupBy(F.least("l_partkey", "l_suppkey").alias("u"), F.greatest("l_partkey", "l_suppkey").alias("v")).agg(F.count(F.lit(1)).alias("evidence")).where("evidence >= 2")
