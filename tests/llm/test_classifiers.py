import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_classifier as q
from tessera.llm import toxicity as tox
from tessera.llm.training import labelled
from tessera.llm.trees import binned, bin_edges, boost, grow, isotonic, predict


def prose(rng, n):
    return " ".join("".join(rng.choice("ka lo mi né tu so ra in the".split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(spark, seed=1, n=500):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, good, toxic = prose(rng, rng.randrange(30, 120)), rng.random() < 0.7, rng.random() < 0.25
        if not good:
            text = rng.choice([lambda t: t.replace(" ", "### "), lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(t.split()[:3] * 40)])(text)
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "you m0r0n", "zorgblat", "l.o.s.e.r"]))
            text = " ".join(words)
        docs.append((i, text))
        if rng.random() < 0.8:
            labels.append((i, int(good), int(toxic)))
    docs += [(-1, None), (-2, ""), (None, "x y")]
    labels += [(3, None, None), (None, 1, 1), (9999, 1, 1), labels[0]]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(4),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        dict((i, (g, t)) for i, g, t in labels),
    )


def test_quality_learns_and_compiles(spark):
    docs, labels, truth = corpus(spark)
    out = q.score_quality(docs, labels, ["doc_id", "score"]).toDF("doc_id", "kept_column", "score", "predicted").collect()
    assert len(out) == 503 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.kept_column == "clash" for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id > 3 and r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean([(r.score >= 0.5) == truth[r.doc_id][0] for r in held]) > 0.9
    model = q.fit(docs, labels)
    rows = q.with_statistics(docs, ["doc_id"]).withColumn("s", model.column()).collect()
    assert [r.s for r in rows] == pytest.approx(model.score(np.array([r["__x"] for r in rows])).tolist())
    assert 0 < len(model.rules) < 200 and len(model.explain()) == len(model.rules)


def test_labels_of_the_held_out_fold_are_never_used(spark):
    docs, labels, _ = corpus(spark)
    flip = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    assert q.fit(docs, labels) == q.fit(docs, labels.withColumn("quality", flip.cast("int")))
    assert 49 <= labelled(docs, labels, "toxic", 50).count() <= 50  # one label is of no document


def test_toxicity_learns(spark):
    docs, labels, truth = corpus(spark, 2)
    out = {r.doc_id: r for r in tox.score_toxicity(docs, labels).collect()}
    assert len(out) == 503 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [r for r in out.values() if r.held_out and r.doc_id is not None and r.doc_id in truth and truth[r.doc_id][1] is not None]
    assert len(held) > 40 and np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.93


def test_without_labels_or_rows(spark):
    docs, labels, _ = corpus(spark, n=20)
    assert {r.score for r in tox.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in q.score_quality(docs, labels.limit(0), ["doc_id"]).collect()} == {0.5}
    assert tox.score_toxicity(docs.limit(0), labels).count() == 0 and q.score_quality(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_skeletons():
    import pyarrow as pa

    from tessera.llm.common import blocks

    texts = ["idiot", "1D10T", "i.d.i.o.t", "idiiiot", "(idiot)", "id iot", "", "!!!"]
    data, offs = next(blocks(pa.array(texts)))[2:]
    w = tox.words_of(data, offs)
    first = [w.skeleton[w.who == k][0] for k in range(5)]
    assert len(set(first)) == 1 and w.counts.tolist() == [1, 1, 1, 1, 1, 2, 0, 0]
    assert w.plain[0] == w.plain[w.who == 4][0] != w.plain[1]


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    raw = boost(x, y, 30, 2, 0.3, 0.8, 1).raw(x)
    assert np.mean((raw > 0) == y) > 0.98
    e = bin_edges(x)
    tree = grow(binned(x, e), e, -y, np.ones(len(y)), 2)
    assert predict(tree, x)[y == 1].mean() > 0.8 > 0.2 > predict(tree, x)[y == 0].mean()
    xs, ys = isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([0, 1, 0, 0, 1]))
    assert (np.diff(ys) >= 0).all() and np.interp([1, 2, 4], xs, ys).tolist() == pytest.approx([0, 1 / 3, 1])
