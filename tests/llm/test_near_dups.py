import itertools
import random
import re

from pyspark.sql import functions as F

from tessera.llm import near_dups
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def corpus(seed, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "LO", "mi", "né", "tu"]) for _ in range(rng.randrange(1, 4)))
    texts = [None, "", " \n", "one", "One", "one two", "two one", "one\ttwo"]
    base = [[word() for _ in range(rng.choice([3, 4, 20, 60, 200]))] for _ in range(size)]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.choice([0, 0, 1, 3])):
            c = list(b)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    hot = [word() for _ in range(120)]
    for k in range(60):  # a large group whose members are not all alike
        c = list(hot)
        for _ in range(k % 5):
            c[rng.randrange(len(c))] = word()
        texts.append(" ".join(c))
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def test_components_match_brute_force(spark):
    for n, percent, seed in ((3, 85, 1), (5, 80, 2)):
        rows = corpus(seed, 120)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, n, percent).collect()}
        want = brute(rows, n, percent)
        assert {k: (got[k], want[k]) for k in want if got.get(k) != want[k]} == {} and len(got) == len(want)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, None), (9, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dups.near_duplicates(docs, 3, 85).collect()), key=str)
    assert got == sorted([(7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False), (None, 1, None, True), (None, 0, None, True), (9, 0, 9, True)], key=str)
    assert near_dups.near_duplicates(docs.limit(0), 3, 85).count() == 0


def test_banding_and_sketch_limits():
    for t in (0.5, 0.8, 0.85, 0.95):
        bands, rows = near_dups.banding(t)
        assert (1 - t**rows) ** bands <= 1e-6 or rows == 1
    assert near_dups.odd_sketch_limit(0.85, 140) < 256


def test_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 51)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 51: 50}
