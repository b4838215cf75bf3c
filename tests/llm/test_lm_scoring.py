import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_scoring as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_base(rows):
    toks = [(i, [*WORD.findall(lower(t)), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    return {i: (held(i), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in toks}


def corpus(seed, n):
    rng = random.Random(seed)
    tongues = [["ka", "LO", "mi", "né"], ["tu", "sso", "ra", "ße"]]
    rows = [(-1, None), (-2, ""), (-3, " \n"), (None, "kalo kalo")]
    for i in range(n):
        parts = tongues[i % 2]
        rows.append((i, " ".join("".join(rng.choice(parts) for _ in range(rng.choice([1, 1, 2, 3, 4]))) for _ in range(rng.randrange(0, 150)))))
    return rows


def test_base_matches_brute_force_and_model_beats_it(spark):
    rows = corpus(1, 700)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pack", F.lit("clash")).repartition(3)
    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    want = brute_base(rows)
    assert got.keys() == want.keys()
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert len(out) > 30 and sum(r.score for r in out) > sum(r.base_score for r in out) + 1


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert lm.score_texts(docs).count() == 3
    assert lm.score_texts(docs.limit(0)).count() == 0
    held = next(i for i in range(100) if lm.is_held_out(i))
    only = lm.score_texts(spark.createDataFrame([(held, "x y")], "doc_id long, text string")).collect()
    assert only[0].held_out and only[0].train_tokens == 0 and only[0].base_score == 0 and only[0].n_known == 0


def test_probabilities_are_normalised():
    share = np.full(7, 1 / 7)
    m = lm.Model.start(share)
    one, two = np.repeat(3, 7), np.repeat(5, 7)
    assert np.exp(m.log_probability(np.arange(7), one, two)).sum() == pytest.approx(1, abs=1e-5)


def test_rounds_take_every_training_position_once():
    sizes, train = [1, 3, 2, 9, 1, 30], np.array([True, True, False, True, True, True])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    taken = np.concatenate([lm.examples(train, doc, k, lm.ROUNDS) for k in range(lm.ROUNDS)])
    assert sorted(taken) == [i for i, d in enumerate(doc) if train[d]]


def test_own_classes_follow_the_vocabulary(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(100))) for i in range(200)], "doc_id long, text string")
    _, totals = lm._counted(lm.deal(docs)[0], 4)
    v = lm._vocabulary(totals)
    assert len(v.top) > lm.TOP and lm.END in v.top
    assert v.shared_tokens.sum() <= (1 - lm.COVER) * v.tokens
    assert lm._own_classes([(1, 10**6)]) == lm.COVER * 10**6 + 1 and lm._own_classes([(900, 3), (1, 5)]) == lm.TOP


def test_normaliser_of_very_large_and_small_logits():
    for shift in (-300, -60, 0, 60, 300):
        m = lm.Model.start(np.full(7, 1 / 7))
        m.bias += np.float32(shift)
        one, two = np.repeat(3, 7), np.repeat(5, 7)
        assert np.exp(m.log_probability(np.arange(7), one, two)).sum() == pytest.approx(1, abs=1e-4)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAINER", 20_000)
    monkeypatch.setattr(lm, "PACK", 6_000)
    rows = corpus(6, 300) + [(None, "ka lo mi"), (None, "ka lo mi"), (5, "again"), (7000, "tu sso " * 9000)]
    found = []
    for parts in (1, 4):
        docs = spark.createDataFrame(rows[:: 1 if parts == 1 else -1], "doc_id long, text string").repartition(parts)
        found.append(sorted(((r.doc_id, r.n_tokens, r.base_score, r.score) for r in lm.score_texts(docs).collect()), key=str))
    assert lm.deal(docs)[1] > 4 and found[0] == found[1] and len(found[0]) == len(rows)


def test_sums_of_parameters_are_exact():
    rng = np.random.default_rng(1)
    parts = [(rng.normal(0, 30, 50).astype(np.float32), int(rng.integers(1, 900_000))) for _ in range(40)]
    blobs = [lm._fixed(x, n).astype("<i8").tobytes() for x, n in parts]
    one, two = lm._total(blobs), lm._total(blobs[::-1])
    assert (one == two).all()
    flat = one[0].astype(float) * (1 << 24) + one[1]
    want = sum(x.astype(float) * n for x, n in parts) / sum(n for _, n in parts)
    assert np.abs(flat[:-1] / flat[-1] - want).max() < 1e-5


def test_ties_at_the_edge_of_the_vocabulary(spark):
    words = [f"w{k}" for k in range(2000)]  # all as frequent as each other
    rows = [(i, " ".join(words)) for i in range(3)]
    tops = []
    for part in (rows, rows[::-1]):
        _, totals = lm._counted(lm.deal(spark.createDataFrame(part, "doc_id long, text string"))[0], 3)
        tops.append(lm._vocabulary(totals).top.tolist())
    assert tops[0] == tops[1] and len(tops[0]) >= lm.TOP
