"""Operators 11 and 12 against plain loops, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm.divergence import divergences, shares
from tessera.llm.importance import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, value int, rank string"


def divergence_loops(docs, least, top):
    find = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    n, has, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = find.findall((text or "").translate(LOWER))
        n[lang, source].update(terms)
        has[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, c in has[lang].items() if c >= least]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update({t: n[g][t] for t in kept})

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        mine, every = p(n[lang, source]), p(whole)
        pairs = []
        for other in (g[1] for g in groups if g[0] == lang and g[1] != source):
            q = p(n[lang, other])
            pairs.append((-sum((mine[t] - q[t]) ** 2 // q[t] for t in kept), other.encode(), other))
        terms = [(-((mine[t] - every[t]) ** 2 // every[t]), t.encode(), t) for t in kept if n[lang, source][t] and mine[t] > every[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("sizes", [{}, {"chunk_terms": 3, "span_chunks": 2, "block_sources": 2, "top": 4}])
def test_divergences_are_those_of_plain_loops(spark, sizes):
    rng = random.Random(5)
    words = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)] + ["Été", "été", "東京", "a1b"]
    rows = []
    for i in range(150):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", "ä", None, "s1"])
        text = None if i % 19 == 0 else " ".join(rng.choices(words, weights=[3 + (len(source or "") * k) % 7 for k in range(len(words))], k=rng.randrange(0, 40)))
        rows.append((i // 2, text, lang, source, 1, "x"))
    rows += [(900, "1 2 3", "en", "no terms", 0, ""), (901, "rare", "xx", "a", 0, ""), (902, "", "xx", "b", 0, ""), (903, "word " * 70_000, "de", "long", 0, "")]
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(divergences(frame, **sizes)) == divergence_loops([r[1:4] for r in rows], 3, sizes.get("top", 200))


def test_no_documents_no_divergences(spark):
    assert got(divergences(spark.createDataFrame([], DOCS))) == []


def test_shares_are_exact_for_great_counts():
    for count, total in ((10**15, 3 * 10**15), (7, 8), (0, 1), (9 * 10**15 - 1, 9 * 10**15)):
        assert shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


def resample_loops(docs, target, n, buckets, least, percent, seed):
    def found(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(found(text)[1])
    for text in target:
        t.update(found(text)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    out = []
    for doc_id, text in docs:
        words, own = found(text)
        weight = sum(math.floor(1000 * math.log(((t[b] + 1) * (all_s + buckets)) / ((s[b] + 1) * (all_t + buckets)))) for b in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= least])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, row in enumerate(drawn[: percent * len(drawn) // 100], 1):
        row.append(k)
    return sorted(tuple((r[:4] + [r[5] if len(r) > 5 else None])) for r in out if r[0] is not None), [r[:4] for r in out if r[0] is None]


@pytest.mark.parametrize("n", [1, 3])
def test_draw_is_that_of_plain_loops(spark, n):
    rng = random.Random(n)
    words = [f"W{i}x" for i in range(60)] + ["Ünï", "東京"]
    docs = [(i, None if i % 31 == 0 else " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(300)]
    docs += [(7, docs[7][1]), (8, "other " * 25), (None, "without an id " * 9), (400, ""), (401, "-- !!"), (402, "deep " * 60_000)]
    target = [" ".join(rng.choices(words[:15], k=30)) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame([(*d, 1, "a") for d in docs], "doc_id long, text string, rank int, score string").repartition(7)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    found = [tuple(r) for r in resample(frame, wanted, n=n, buckets=500).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want, no_id = resample_loops(docs, target, n, 500, 20, 10, 2024)
    assert sorted((r for r in found if r[0] is not None), key=repr) == sorted(want, key=repr)
    assert [list(r[:4]) for r in found if r[0] is None] == no_id


def test_draws_from_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two " * 20), (2, "two three " * 20)], "doc_id long, text string")
    assert resample(none, some).count() == 0
    assert {r["rank"] for r in resample(some, none, percent=50).collect()} == {1, None}


def test_target_like_documents_are_drawn(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices([f"{'t' if i % 10 == 0 else 'o'}{k}" for k in range(50)], k=80))) for i in range(400)]
    target = spark.createDataFrame([(0, " ".join(f"t{k}" for k in range(50)))], "item_id long, text string")
    drawn = resample(spark.createDataFrame(docs, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(drawn) == 40 and all(r["doc_id"] % 10 == 0 for r in drawn)
