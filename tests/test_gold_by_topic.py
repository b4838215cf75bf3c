"""Gold by topic and tiles of pairs, against the plain joins."""

import random

from tessera.operators import evaluation, tiles


def tables(spark):
    rng = random.Random(5)
    topics = spark.createDataFrame([(q, q % 3) for q in range(9)] + [(4, 1), (None, 1)], "query_id long, topic long")
    shared = spark.createDataFrame([(d % 4, d, d % 4 - 1) for d in range(80)] + [(0, 8, 3)], "topic long, doc_id long, relevance int")
    own = spark.createDataFrame([(rng.randrange(11), rng.randrange(90), rng.randrange(4)) for _ in range(60)] + [(None, 3, 3), (2, None, 3)], "query_id long, doc_id long, relevance int")
    predicted = spark.createDataFrame([(q, d, i + 1) for q in range(11) for i, d in enumerate(rng.sample(range(90), 30))], "query_id long, doc_id long, rank int")
    return predicted, topics, shared, own


def plain(topics, shared, own):
    return topics.join(shared, "topic").select("query_id", "doc_id", "relevance").where("query_id IS NOT NULL").union(own)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_metrics_and_first_hits_need_no_pairs(spark):
    predicted, *by_topic = tables(spark)
    gold = plain(*by_topic)
    assert rows(evaluation.topic_metrics(predicted, *by_topic)) == rows(evaluation.ranking_metrics(predicted, gold))
    assert rows(evaluation.topic_hits(predicted, *by_topic, "rank")) == rows(evaluation.first_hits(predicted, gold, ["doc_id"], "rank"))


def test_gold_ranks_give_every_pair_once(spark):
    predicted, *by_topic = tables(spark)
    pairs = plain(*by_topic).where("relevance > 0").select("query_id", "doc_id").distinct()
    want = pairs.join(predicted.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").selectExpr("query_id", "doc_id", "CAST(rank AS long)")
    assert rows(evaluation.gold_ranks(predicted, *by_topic, size=4)) == rows(want)


def test_pairs_of_one_key_are_many_tasks(spark):
    left = spark.range(300).selectExpr("7 AS key", "CASE WHEN id > 0 THEN id END AS a").union(spark.createDataFrame([(None, 1)], "key int, a long"))
    right = spark.range(200).selectExpr("7 AS key", "id % 150 AS b")
    got = tiles.pairs(left, right, "key", "a", "b", size=20)
    assert rows(got) == rows(left.join(right, "key").select("key", "a", "b"))
    assert len({r[0] for r in got.selectExpr("spark_partition_id()").collect()}) > 8


def made(plan):
    """Rows that joins and generators of a plan have made, the most of any."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return made(plan.executedPlan())
    inner = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if kind in ("GenerateExec", "SortMergeJoinExec") else 0
    return max([own, *map(made, inner)])


def test_first_pairs_come_before_the_rest_of_their_tile_is_made(spark):
    left, right = spark.range(1500).selectExpr("7 AS key", "id AS a"), spark.range(1000).selectExpr("7 AS key", "id AS b")
    first = tiles.pairs(left, right, "key", "a", "b", size=2000).limit(5)
    assert first.count() == 5
    first.collect()
    assert made(first._jdf.queryExecution().executedPlan()) <= 20_000  # one tile has 1,500,000


def test_tasks_grow_with_the_pairs(spark):
    left, right = spark.range(300).selectExpr("id % 3 AS key", "id AS a"), spark.range(200).selectExpr("id % 3 AS key", "id AS b")
    got = tiles.pairs(left, right, "key", "a", "b", size=10, task=500)
    assert rows(got) == rows(left.join(right, "key").select("key", "a", "b"))
    assert got.rdd.getNumPartitions() == -(-tiles.extent(left, right, "key")[2] // 500) == 40
