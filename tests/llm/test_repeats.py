import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import repeats
from tessera.llm.suffix_sort import BlindTrie, sort_suffixes, suffix_array


def brute(rows, length=50):
    first = {}
    order = [(r if r[0] is not None else (1 << 62, r[1])) for r in rows]
    for i, t in order:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in order:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
        out.append((None if i == 1 << 62 else i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "né", "tu", "漢"]) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(k) for k in (4, 8, 9, 12, 30, 100)]
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 120, "ab" * 100, prose(3000)]
    for _ in range(150):
        parts = [prose(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            cut = rng.choice(passages)
            a = rng.randrange(len(cut) // 2)
            parts += [rng.choice([cut, cut[a:], cut[:-a] if a else cut]), prose(rng.randrange(0, 20))]
        texts.append(rng.choice([" ", "", "\n"]).join(parts))
    texts += rng.sample(texts, 30)
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


def test_spans_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pack", F.lit("clash")).repartition(6)
        for heavy in (64, 2):  # with 2, most anchors of passages are heavy
            got = sorted((tuple(r) for r in repeats.digest_repeats(docs, heavy_segments=heavy).collect()), key=str)
            assert got == brute(rows)


def test_odd_rows(spark):
    long = "lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do"
    rows = [(3, long), (3, long), (None, long + "!"), (1, None), (9, "é" * 60), (8, "x" + "é" * 60), (7, "a" + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in repeats.digest_repeats(docs).collect()), key=str) == brute(rows)
    assert repeats.digest_repeats(docs.limit(0)).count() == 0
    wide = docs.withColumn("removed", F.lit(1)).withColumn("row", F.col("doc_id"))
    out = repeats.remove_repeats(wide).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "removed", "row", "removed_bytes"} and len(out) == len(rows)
    by = {r.doc_id: r.text for r in out}
    assert by[1] is None and by[None] == "!" and by[7] == "a" and set(by[9]) <= {"é"}


def test_suffix_sort_matches_sorted():
    rng = random.Random(5)
    for _ in range(60):
        text = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(0, 200))) + b"abc" * rng.randrange(0, 60)
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        data, starts = np.frombuffer(text, np.uint8), np.array([i for i in range(len(text)) if rng.random() < 0.7], np.int64)
        for depth, shallow in ((5, 24), (50, 24), (30, 8), (40, 12)):
            order, group = sort_suffixes(data, starts, depth, shallow)
            strings = [(text[s : s + depth]).ljust(depth, b"\0") for s in starts]
            want = sorted(range(len(starts)), key=lambda i: strings[i])
            assert [strings[i] for i in order] == [strings[i] for i in want]
            same = [strings[order[k]] == strings[order[k - 1]] for k in range(1, len(order))]
            assert same == [bool(group[k] == group[k - 1]) for k in range(1, len(order))]


def test_blind_trie():
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(300)]
    trie = BlindTrie()
    for k, t in enumerate(texts):
        trie.insert(t, k)
    leaves = [[texts[k] for k in ids] for ids in trie.leaves()]
    assert [x[0] for x in leaves] == sorted(set(texts)) and all(len(set(x)) == 1 for x in leaves)
    assert BlindTrie().leaves() == []


def test_multikey_quicksort_reads_few_characters(monkeypatch):
    from tessera.llm import suffix_sort

    read, word = [0], suffix_sort._word
    monkeypatch.setattr(suffix_sort, "_word", lambda padded, at: (read.__setitem__(0, read[0] + len(at)), word(padded, at))[1])
    rng = np.random.default_rng(2)
    for letters in (2, 26):
        data, read[0] = rng.integers(0, letters, 60_000).astype(np.uint8), 0
        starts = rng.permutation(59_000)
        order, _ = sort_suffixes(data, starts, 50)
        strings = [data[s : s + 50].tobytes() for s in starts[order]]
        assert strings == sorted(strings) and read[0] < len(starts) * (2 * np.log2(len(starts)) + 6)
