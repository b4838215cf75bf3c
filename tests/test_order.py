"""Places and quantiles in a total order, against plain loops."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.operators.order import nearest_rank, numbered


def _sample():
    """A key with most rows, small ones, a null key, null values and ties."""
    r = random.Random(5)
    return [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None] + [x / 4 for x in range(60)]), n) for n in range(900)]


def test_numbered_with_and_without_keys(spark):
    data = _sample()
    df = spark.createDataFrame(data, "k string, v double, n long").repartition(5)
    order = [F.desc("v"), F.col("n")]  # descending puts nulls last
    plain = lambda rows: sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
    got = {x.n: x.place for x in numbered(df, "place", order).collect()}
    assert got == {x[2]: p for p, x in enumerate(plain(data), 1)}
    groups = defaultdict(list)
    for x in data:
        groups[x[0]].append(x)
    got = {x.n: x.place for x in numbered(df, "place", order, ["k"]).collect()}
    assert got == {x[2]: p for g in groups.values() for p, x in enumerate(plain(g), 1)}


def test_numbered_ties_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([("x", 1)] * 50 + [(None, None)] * 7, "k string, v int")
    places = [x.place for x in numbered(df, "place", [F.col("v")]).collect()]
    assert sorted(places) == list(range(1, 58))
    empty = numbered(df.where("false"), "place", [F.col("v")], ["k"])
    assert empty.columns == ["k", "v", "place"] and empty.count() == 0


def test_nearest_rank(spark):
    data = _sample()
    df = spark.createDataFrame(data + [("none", None, 0)], "k string, v double, n long").repartition(5)
    groups = defaultdict(list)
    for k, v, _ in data:
        if v is not None:
            groups[k].append(v)
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {x.k: x.p for x in nearest_rank(df, ["k"], "v", share, "p").collect()}
        assert got == {k: sorted(v)[max(math.ceil(share * len(v)), 1) - 1] for k, v in groups.items()}
    assert nearest_rank(df.where("false"), ["k"], "v", 0.5, "p").count() == 0
