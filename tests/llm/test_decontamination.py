import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import decontamination as d


def brute_align(item, words):
    best, table = 0, [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(words, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_matches_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        score, start, end = d.align(np.array(a), np.array(b, np.int64))
        assert score == brute_align(a, b)
        assert brute_align(a, b[start:end]) == score and (not score or b[start] in a)


def prose(rng, n):
    return ["".join(rng.choice("ka lo mi né tu so ra ße".split()) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def test_finds_copies_edits_and_case_but_no_others(spark):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (15, 20, 30, 40, 59, 8)]
    docs, want = [], set()
    for k in range(240):
        words = prose(rng, rng.choice([10, 100, 900]))
        if k % 3 == 0:
            i = k // 3 % len(items)
            copy = list(items[i])
            kind = k % 4
            if kind == 1:
                copy = [w.upper() + rng.choice(["", ",", "!!"]) for w in copy]
            elif kind == 2:  # every sixth word replaced, one left out
                copy = [w if j % 6 != 5 else "zz" for j, w in enumerate(copy)]
                del copy[len(copy) // 2]
            at = rng.randrange(len(words))
            words[at:at] = copy
            want.add((k, i))
        docs.append((k, " ".join(words)))
    docs += [(900, None), (901, ""), (None, " ".join(items[2]))]
    want.add((None, 2))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, ""), (92, "ka lo"), (None, None)], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(4)
    for size in (d.SLICE, 50):
        got = d.contaminated(table, bench, slice_ngrams=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert min(r.score for r in got) > 0.6 and max(r.score for r in got) == 1
    assert d.contaminated(table.limit(0), bench).count() == 0 and d.contaminated(table, bench.limit(0)).count() == 0


def test_scripts_without_spaces_and_short_items(spark):
    rng = random.Random(5)
    han = [chr(c) for c in range(0x4E00, 0x4F00)]
    text = lambda n: "".join(rng.choice(han) for _ in range(n))
    items = [(1, text(31)), (2, "ラーメンを食べに行きました。とても美味しかった"), (3, "ภาษาไทยไม่มีช่องว่างระหว่างคำ"), (4, "zq xw"), (5, "唯一"), (6, "common word"), (7, "，。！"), (8, " ".join(prose(rng, 20)))]
    edited = items[0][1][:15] + "错" + items[0][1][16:]
    docs = [(10, text(200) + items[0][1] + text(100)), (11, text(50) + edited), (12, "x" + items[1][1] + "y"), (13, "ก " + items[2][1]), (14, "a ZQ, xw! b"), (15, "只有唯一的"), (16, items[0][1][:9] + text(40)), (17, "zq a xw")]
    docs += [(100 + k, f"common word {k}") for k in range(40)] + [(14, "a ZQ, xw! b"), (18, text(300_000) + items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect())
    assert got == [(10, 1), (11, 1), (12, 2), (13, 3), (14, 4), (14, 4), (15, 5), (18, 1)]


def test_rows_without_copies_stay_as_they_are(spark):
    rng = random.Random(6)
    item = " ".join(prose(rng, 20))
    rows = [(1, "clean " + " ".join(prose(rng, 30)), 1), (1, f"has {item}", 2), (None, item, 3), (None, None, 4), (2, "", 5), (2, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(7, item), (8, item.upper())], "item_id long, text string")
    for size in (d.SLICE, 20):
        out = d.without_contaminated(docs, bench, slice_ngrams=size)
        assert out.columns == docs.columns and sorted(r.item_id for r in out.collect()) == [1, 4, 5, 5]
    assert sorted((r.doc_id or 0, r.item_id) for r in d.contaminated(docs, bench).collect()) == [(0, 7), (0, 8), (1, 7), (1, 8)]


def test_shared_lines_of_items_are_no_seeds(spark, monkeypatch):
    monkeypatch.setattr(d, "SHARED_ITEMS", 5)
    rng = random.Random(8)
    line = " ".join(prose(rng, 10))
    items = [(i, line + " " + " ".join(prose(rng, 15))) for i in range(20)] + [(50, line)]
    seeds = next(d._seeds(spark.createDataFrame([(0, "x")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), d.SLICE))
    assert set(np.unique(seeds.item)) == set(range(21))
    assert (seeds.edges[1:] - seeds.edges[:-1]).max() <= 5  # that of the line alone keeps it, two words of it may go on alike
    docs = [(i, f"a b {t} c") for i, t in items]
    got = {(r.doc_id, r.item_id) for r in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, _ in items} | {(i, 50) for i, _ in items}


def test_recall_by_edit_rate(spark):
    """Copies whose words are replaced, left out or doubled at random; what the README states."""
    rng = random.Random(7)
    items = [prose(rng, 30) for _ in range(60)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for rate, least in ((0.0, 1.0), (0.1, 0.99), (0.2, 0.9)):
        docs = []
        for i, words in enumerate(items):
            copy = []
            for w in words:
                x = rng.random()
                copy += [w] if x >= rate else [rng.choice(["zz", "yy"])] if x < rate / 3 else [w, w] if x < 2 * rate / 3 else []
            docs.append((i, " ".join([*prose(rng, 60), *copy, *prose(rng, 60)])))
        found = {(r.doc_id, r.item_id) for r in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
        assert all(a == b for a, b in found) and len(found) >= least * len(items)
